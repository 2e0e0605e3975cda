"""WARC archives as .warc.zst: a dictionary in the leading skippable frame, one Zstandard frame per record.

Tasks write archives to the shared folder (a new name on every attempt; only
the names in the saved manifest count, so retried or lost tasks leave nothing
behind that is read). Tasks then stream each archive frame by frame and check
headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_folder, slices
from .exact_dedup import tree_merge

DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that .warc.zst reserves for dictionaries
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 64, 4096
ARCHIVE_BYTES = 64 << 20  # payload bytes after which a task begins another archive
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, payload_bytes long, revisits long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "stored_bytes long, record_id string, refers_to_record string, payload binary"
)
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


class BadRecord(ValueError):
    """A record whose headers, lengths or digests don't hold."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    """The page of a record id that this writer made; null for any other."""
    kind, _, at = record.strip("<>").rpartition(":")
    return int(at) if kind == "urn:page" and at.removeprefix("-").isdecimal() else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit stores the HTTP head alone, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(lines: list[str]) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with a blank goes on with the one before. Of a repeated name the first value counts."""
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"header line without a colon: {line[:80]!r}")
        last = name.strip().lower()
        fields.setdefault(last, value.strip())
    return fields


def sha1_of(digest: str | None) -> str | None:
    """The bare base32 SHA-1 of a digest field, in base32 or hexadecimal; null for other algorithms."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32encode(bytes.fromhex(value)).decode() if len(value) == 40 else value.upper()


def parse_record(raw: bytes) -> dict:
    """Check one decoded frame and return its parts; any record type, whoever wrote it.

    Header names are read without case. The payload is the body of an HTTP message, of other records the block. A payload digest or an
    HTTP length that is there must hold, except where the HTTP body is truncated or coded for transfer; a revisit names its target or its payload's digest.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = header_fields(lines[1:])
    for name in MANDATORY:
        if name not in fields:
            raise BadRecord(f"{name} is missing")
    if not fields["content-length"].isdecimal():
        raise BadRecord(f"Content-Length {fields['content-length'][:20]!r}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {n} but {len(rest) - 4} bytes")
    block, kind = rest[:n], fields["warc-type"].lower()
    if (want := sha1_of(fields.get("warc-block-digest"))) and want != base32_sha1(block):
        raise BadRecord("block digest differs")
    payload, full, coded = block, n, "warc-truncated" in fields
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = header_fields(http.decode("latin-1").split("\r\n")[1:])
        coded = coded or "transfer-encoding" in said
        full = int(said["content-length"]) if said.get("content-length", "").isdecimal() else len(payload)
    digest, revisit = sha1_of(fields.get("warc-payload-digest")), kind == "revisit"
    if not revisit and not coded and (len(payload) != full and payload is not block or digest not in (None, base32_sha1(payload))):
        raise BadRecord("payload length or digest differs")
    if revisit and (payload or not {"warc-refers-to", "warc-payload-digest"} & set(fields)):
        raise BadRecord("revisit without a target, or with a payload")
    refers = fields.get("warc-refers-to")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": full,
        "payload_digest": digest or (None if revisit else base32_sha1(payload)), "record_type": kind, "payload": None if revisit else payload,
        "refers_to": page_of(refers) if refers else None, "record_id": fields["warc-record-id"], "refers_to_record": refers,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples their own bytes serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")


def write_archive(records: list[bytes], out: io.RawIOBase, level: int = 3) -> int:
    """Write the dictionary frame, then one frame per record; returns the bytes written."""
    import zstandard

    words = dictionary([r[:SAMPLE_BYTES] for r in records[:: max(1, len(records) // SAMPLE_RECORDS)]])
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)
    total = 8 + len(words)
    for r in records:
        total += out.write(packer.compress(r)) or 0
    return total


def read_frames(source, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(stored bytes, decoded bytes) of each frame after the dictionary; ``source`` is read in chunks."""
    import zstandard

    def more(buffer: bytes, need: int) -> bytes:
        while len(buffer) < need and (got := source.read(chunk)):
            buffer += got
        return buffer

    buffer, words = more(b"", 8), None
    if len(buffer) >= 8 and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", buffer[4:8])[0]
        buffer = more(buffer, 8 + size)
        if len(buffer) < 8 + size:
            raise BadRecord("dictionary frame cut short")
        words, buffer = buffer[8 : 8 + size], buffer[8 + size :]
        if words[:4] == ZSTD_MAGIC:  # the dictionary may itself be compressed
            words = zstandard.ZstdDecompressor().decompress(words, max_output_size=64 << 20)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while buffer := more(buffer, 4):
        if buffer[1:4] == b"\x2a\x4d\x18" and 0x50 <= buffer[0] <= 0x5F:  # other skippable frames
            buffer = more(buffer, 8)
            size = struct.unpack("<I", buffer[4:8])[0]
            buffer = more(buffer, 8 + size)[8 + size :]
            continue
        frame, out, stored = unpacker.decompressobj(), [], 0
        while not frame.eof:
            if not buffer and not (buffer := source.read(chunk)):
                raise BadRecord("frame cut short")
            out.append(frame.decompress(buffer))
            stored += len(buffer) - len(frame.unused_data)
            buffer = frame.unused_data
        yield stored, b"".join(out)


def plan_records(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """The rows (by row number) that revisit another, with its page_id, by a tree-merge that keeps the row with the smallest id, of rows that repeat it the first."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = saved(
        pages.select(
            F.col(id_col).cast("long").alias("doc_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"),
            F.xxhash64(body).alias("second"), F.monotonically_increasing_id().alias("row"),
        ),
        "payloads",
    )
    merged = tree_merge(rows, "smallest").filter((F.col("group_size") > 1) & (F.col("row") != F.col("keep_row")) & (F.col("n_bytes") >= F.lit(revisit_from)))
    return merged.select("row", "digest", "keep_id")


def write_warc(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all pages as archives in the shared folder; returns the saved manifest (path, records, payload_bytes, revisits).

    Of equal payloads of at least ``revisit_from`` bytes the smallest page_id is
    the response and the others revisit it; of rows that repeat this id, one row is. A row is known by its number, so it doesn't
    matter which task meets it; ``pages`` must give the same rows when it is read again, as a table does, and the number of revisits is checked.
    Null bodies are empty payloads; a null id is kept and comes after all others.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), url.alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    plan = saved(plan_records(pages, revisit_from, id_col, body_col), "plan")
    both = rows.join(plan.select("row", "digest", "keep_id", F.lit(True).alias("revisit")), ["row", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        records: list[bytes] = []
        size = again = 0

        def flush() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path) as out:
                write_archive(records, out)
            done = pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)], "payload_bytes": [size], "revisits": [again]})
            records.clear()
            return done

        for whole in batches:
            for batch in slices(whole, "body"):
                for r in batch.to_pylist():
                    payload = r["body"].encode()
                    records.append(build_record(r["doc_id"], r["url"], payload, base32_sha1(payload), r["keep_id"], bool(r["revisit"])))
                    size, again = size + len(payload), again + bool(r["revisit"])
                    if size >= ARCHIVE_BYTES:
                        yield flush()
                        size = again = 0
        if records:
            yield flush()

    manifest = saved(both.select("doc_id", "url", "body", "keep_id", "revisit").mapInArrow(write, MANIFEST), "manifest")
    if (manifest.agg(F.sum("revisits")).first()[0] or 0) != plan.count():
        raise ValueError("the pages changed between two readings")
    return manifest


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in the manifest; raises if a frame, header, length or digest doesn't hold.

    An archive is read as a stream, a record at a time, whatever its length; an empty manifest gives no records. ``manifest``: path and records
    (null: not known), of archives of this or any other writer; records of theirs have a record_id and a null page_id.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, n = [], 0, 0
                with store.open_input_stream(path) as source:
                    for stored, raw in read_frames(source):
                        row = parse_record(raw) | {"stored_bytes": stored}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size, n = size + len(row["payload"] or b"") + 100, n + 1
                        if size > 4 << 20:
                            yield as_rows(rows)
                            rows, size = [], 0
                if expected is not None and n != expected:
                    raise BadRecord(f"{path}: {n} records, {expected} were written")
                if rows:
                    yield as_rows(rows)

    n = max(1, manifest.count())
    return manifest.select("path", "records").repartition(n).mapInArrow(read, RECORDS)


def as_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "stored_bytes": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


def warc_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write the archives, read them back, and return one row per record, without its payload.

    Null and empty payloads are equal and empty. Of equal payloads the least page_id is the response; of rows that repeat it
    one is, the others revisit it. A null page_id comes after all others. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    manifest = write_warc(pages, revisit_from)
    return read_warc(spark, manifest, shared_folder(spark), payloads=False).drop("payload", "url", "record_id", "refers_to_record")
