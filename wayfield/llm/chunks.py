"""Keys of chunks of documents, counted by buckets that answer each chunk in its own key order.

A chunk is a run of rows of one partition with about CHUNK_TEXT bytes of text. What is shuffled
is packed: a chunk sends each bucket of the key space one row of sorted 64-bit keys and counts, and
gets one row back. The chunk's documents meet the answers as one compressed row.

A chunk is known by its partition and number, so ``rows`` must give the same partitions each
time they are read, as a table scan does. Chunks carry a checksum; one that changed stops the job.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, slices

CHUNK_TEXT = 4 << 20
BUCKET_KEYS = 1 << 20  # about so many keys of all chunks are counted at once
CHUNKS = "chunk long, mark long, rows binary"


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, all first bytes, then all second ones, ..., compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes()) if len(values) else b""


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(number, checksum, rows) of each chunk of this partition; the text is the column ``text``."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", limit):
            text = batch.column(batch.schema.get_field_index("text"))
            yield number, zlib.crc32(buffers(text)[0]) << 31 | batch.num_rows, batch
            number += 1


def chunk_rows(rows: DataFrame) -> DataFrame:
    """One row a chunk: its documents as compressed Arrow."""
    limit = CHUNK_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mark, batch in chunks(batches, limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([mark]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "mark", "rows"])

    return rows.mapInArrow(run, CHUNKS)


def bucket_bits(rows: DataFrame, keys_per_byte: float) -> int:
    """How many first bits of a key name its bucket, for about BUCKET_KEYS keys a bucket."""
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(40, max(1, math.ceil(math.log2(max(1, n_bytes * keys_per_byte / BUCKET_KEYS)))))


def send(rows: DataFrame, kinds: list[str], bits: int, keys_of: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(bucket, chunk, mark, and for each kind its keys and kind_n): ``keys_of`` gives sorted distinct keys and counts of each kind."""
    names = ["bucket", "chunk", "mark", *kinds, *(f"{k}_n" for k in kinds)]
    limit = CHUNK_TEXT
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mark, batch in chunks(batches, limit):
            found = keys_of(batch)
            cuts = [np.append(np.searchsorted(keys, edges), len(keys)) for keys, _ in found]
            out = []
            for k in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist():
                part = [slice(c[k], c[k + 1]) for c in cuts]
                keys = [packed(np.diff(x[s], prepend=edges[k])) for (x, _), s in zip(found, part, strict=True)]
                out.append((k, number, mark, *keys, *(packed(n[s]) for (_, n), s in zip(found, part, strict=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} {'long' if i < 3 else 'binary'}" for i, n in enumerate(names)))


def count(sent: DataFrame, kinds: list[str], bits: int, answer: Callable[[np.ndarray], bytes], sums: dict[str, Callable[[dict[str, np.ndarray]], int]]) -> DataFrame:
    """(chunk, mark, bucket, kind_n and ``sums``): for each chunk what ``answer`` makes of the total counts of its keys.

    ``sums``: numbers made of all totals of a bucket, on one of its rows; the others have 0.
    """
    names = ["chunk", "mark", "bucket", *(f"{k}_n" for k in kinds), *sums]
    schema = ", ".join(f"{n} {'binary' if 3 <= i < 3 + len(kinds) else 'long'}" for i, n in enumerate(names))

    def run(table: pa.Table) -> pa.Table:
        base = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(64 - bits)
        answers, totals = [], {}
        for kind in kinds:
            keys = [unpacked(x) for x in table.column(kind).to_pylist()]
            cuts = np.cumsum([0, *map(len, keys)])
            distinct, at = np.unique(np.concatenate([np.cumsum(k) + base for k in keys]), return_inverse=True)
            n = np.concatenate([unpacked(x) for x in table.column(f"{kind}_n").to_pylist()])
            totals[kind] = np.bincount(at, n, len(distinct)).astype(np.uint64)
            answers.append(pa.array([answer(totals[kind][at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
        once = [pa.array([int(f(totals))] + [0] * (table.num_rows - 1), pa.int64()) for f in sums.values()]
        return pa.table([table.column("chunk"), table.column("mark"), table.column("bucket"), *answers, *once], names=names)

    return sent.groupBy("bucket").applyInArrow(run, schema)


def answered(rows: DataFrame, answers: DataFrame, kinds: list[str], of_chunk: Callable[[int, pa.RecordBatch, list[list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``of_chunk`` makes of each chunk's number, rows and answers (of each kind, in the order of buckets); it sees a chunk at a time."""
    parts = F.sort_array(F.collect_list(F.struct("bucket", *(f"{k}_n" for k in kinds)))).alias("answers")
    got = answers.groupBy("chunk").agg(F.max("mark").alias("counted"), parts)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        out = []
        for row in table.to_pylist():
            if row["answers"] is not None and row["counted"] != row["mark"]:
                raise ValueError("docs gave other rows when they were read again; save them first")
            for batch in pa.ipc.open_stream(row["rows"]):
                out += of_chunk(row["chunk"], batch, [[a[f"{k}_n"] for a in row["answers"] or ()] for k in kinds])
        empty = [pa.RecordBatch.from_pylist([], schema=pa.schema([(n, _TYPES[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)]))]
        return pa.Table.from_batches(out or empty)

    return chunk_rows(rows).join(got, "chunk", "left").groupBy("chunk").applyInArrow(run, schema)


_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
