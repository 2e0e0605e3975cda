"""Removing repeated passages of ``window`` words, through an FM-index per shard.

1. The windows of a document fall into runs that share one anchor,
   the least hash among a window's word n-grams (its place depends on the
   window alone, so equal windows have equal anchors). A run of windows with
   its words is a passage. Anchors that come once in the corpus hold no repeated window: chunks send
   their anchors, packed, to buckets that answer which come again (see ``chunks``), and give out the
   passages of these.
2. Equal passages are merged before a shuffle brings them together, with their first place; what is merged into
   an earlier one is repeated whole.
3. Passages are dealt to shards by anchor. An anchor with more than
   ``hot_passages`` different passages is dealt by single windows instead, again
   merged first, so no shard holds an unbounded group.
4. Each shard builds an FM-index over its passages in order of place and streams
   them through it: backward search gives the matched length of every window, up to the
   threshold, and its interval; a window whose interval was met before is repeated.
5. Each chunk meets the repeated windows of its rows and gives out what is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .chunks import answered, bucket_bits, chunk_rows, count, send
from .common import buffers, id_text, saved
from .fm_index import FMIndex, earlier

GRAM = 8
HOT_PASSAGES = 4096
SHARD_PASSAGES = 16_384
ANCHORS_PER_BYTE = 0.02
_NO_ID = -(1 << 63)
_PLACE_BITS = 24
_BLOCK = 1 << 22

PASSAGES = "a long, passage binary, id long, tx long, place long, chunk long, row long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_runs(w: words.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document, first window (from 0 in its document), number of windows, anchor."""
    wide = window - gram + 1
    lasts = w.first[1:]
    out = [], [], [], []
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    doc_of = w.doc()
    for at in range(0, max(0, len(w) - window + 1), _BLOCK):
        to = min(at + _BLOCK, len(w) - window + 1)
        g = words.grams(w.hash[at : to + window - 1], gram)
        key = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        least, span = key, 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            rest = wide - span
            least = np.minimum(least[: len(least) - rest], least[rest:])
        n = to - at
        place = (least[:n] & mask).astype(np.int64)
        doc = doc_of[at:to]
        whole = np.arange(at, to) + window <= lasts[doc]
        cut = np.ones(n, bool)
        cut[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(cut & whole)
        if not len(begin):
            continue
        stop = np.append(np.flatnonzero(cut | ~whole), n)
        end = stop[np.searchsorted(stop, begin, "right")]
        out[0].append(doc[begin])
        out[1].append(begin + at - w.first[doc[begin]])
        out[2].append(end - begin)
        out[3].append(g[place[begin]])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (never null) and tx, a hash of the text: rows that repeat both are one document."""
    return id_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("tx"), "text"
    )


def _passages(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """The passages whose anchor comes more than once in the corpus, with the chunk and row they stand in."""

    def keys_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        anchor = window_runs(words.split(*buffers(batch.column(2))), window, gram)[3]
        a, n = np.unique(anchor.astype(np.uint64), return_counts=True)
        return [(a, n.astype(np.uint64))]

    def of_chunk(number: int, batch: pa.RecordBatch, parts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        w = words.split(*buffers(batch.column(2)))
        doc, first, n, anchor = window_runs(w, window, gram)
        own, at = np.unique(anchor.astype(np.uint64), return_inverse=True)
        again = np.frombuffer(b"".join(parts[0]), np.uint8).astype(bool)
        assert len(again) == len(own)
        hit = np.flatnonzero(again[at])
        doc, first, n, anchor = doc[hit], first[hit], n[hit], anchor[hit]
        ids, tx = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        begin, raw = w.first[doc] + first, w.data.tobytes()
        spans = zip(w.start[begin].tolist(), w.end[begin + n + window - 2].tolist(), strict=True)
        text = [b" ".join(raw[s:e].split()) for s, e in spans]
        columns = [
            pa.array(anchor.astype(np.uint64).view(np.int64)), pa.array(text, pa.binary()), pa.array(ids[doc]), pa.array(tx[doc]),
            pa.array(first * 32 + n), pa.array(np.full(len(doc), number)), pa.array(doc.astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PASSAGES.split(", ")])

    bits = bucket_bits(keyed, ANCHORS_PER_BYTE)
    answers = count(send(keyed, ["anchors"], bits, keys_of), ["anchors"], bits, lambda n: (n > 1).astype(np.uint8).tobytes(), {})
    return answered(keyed, answers, ["anchors"], of_chunk, PASSAGES)


def _single_windows(passages: DataFrame, window: int) -> DataFrame:
    """Each window of each passage as a passage of its own; ``place`` keeps that of the passage, ``at`` the window in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for passage, i, tx, place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                w = passage.split()
                for at in range(len(w) - window + 1):
                    for c, v in zip(cols, (b" ".join(w[at : at + window]), i, tx, place, at), strict=True):
                        c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["passage", "id", "tx", "place", "at"])

    return passages.select("passage", "id", "tx", "place").mapInArrow(run, "passage binary, id long, tx long, place long, at long")


def repeated_windows(passages: list[bytes], window: int) -> np.ndarray:
    """For passages in order of place: a bit mask of their windows that also stand at an earlier place of the shard."""
    split = [p.split() for p in passages]
    sizes = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(x, len(number) + 1) for w in split for x in w], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begin[-1], np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(split)), sizes)] = flat
    index = FMIndex(text)
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(split)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[owner] + at
    found, step = np.full(len(start), -1), 1 << 16
    for k in range(0, len(start), step):
        matched, low, _ = index.search(text, start[k : k + step] + window, window, least=2)
        found[k : k + step] = np.where(matched == window, low, -1)
    hit = np.flatnonzero(found >= 0)
    hit = hit[earlier(found[hit])]
    masks = np.zeros(len(split), np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << at[hit])
    return masks


def _search_shards(passages: DataFrame, window: int, shard_passages: int) -> DataFrame:
    """(id, tx, place, at, mask) of passages that hold repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("id", "ascending"), ("tx", "ascending"), ("place", "ascending"), ("at", "ascending")])
        masks = repeated_windows(rows.column("passage").to_pylist(), window)
        hit = pa.array(np.flatnonzero(masks))
        kept = rows.select(["id", "tx", "place", "at"]).take(hit).append_column("mask", pa.array(masks[np.flatnonzero(masks)]))
        yield from kept.combine_chunks().to_batches()

    shards = max(1, math.ceil(passages.count() / shard_passages))
    dealt = passages.select("a", "passage", "id", "tx", "place", "at").repartition(shards, "a")
    return dealt.mapInArrow(run, "id long, tx long, place long, at long, mask long")


def _removed(keyed: DataFrame, covers: DataFrame, window: int) -> DataFrame:
    """Counts of each row and the digest of what is kept; ``covers``: chunk, row, place, mask."""
    of_chunk = covers.groupBy("chunk").agg(F.collect_list(F.struct("row", "place", "mask")).alias("cover"))

    def run(table: pa.Table) -> pa.Table:
        out = []
        for chunk in table.to_pylist():
            for batch in pa.ipc.open_stream(chunk["rows"]):
                cover: dict[int, list[dict]] = {}
                for c in chunk["cover"] or ():
                    cover.setdefault(c["row"], []).append(c)
                ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out += [(i, *kept_words(t, cover.get(k, ()), window)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        i, n, removed, digest = zip(*out, strict=True)
        return pa.table([pa.array([None if x == _NO_ID else x for x in i], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return chunk_rows(keyed).join(of_chunk, "chunk", "left").groupBy("chunk").applyInArrow(run, RESULT)


def kept_words(text: str, cover, window: int) -> tuple[int, int, str]:
    """Words, removed words and the digest of the others, of a text with repeated windows (place, mask)."""
    w = text.encode().split()
    kept = w
    if cover:
        gone = np.zeros(len(w) + 1, np.int64)
        for c in cover:
            at, mask = c["place"] // 32, c["mask"]
            while mask:
                low = mask & -mask
                s = at + low.bit_length() - 1
                gone[s] += 1
                gone[s + window] -= 1
                mask ^= low
        kept = [x for x, g in zip(w, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    return len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def repeated_places(docs: DataFrame, window: int, gram: int, hot_passages: int, shard_passages: int) -> DataFrame:
    """(chunk, row, place, mask): the repeated windows of each run that has any."""
    key = ["id", "tx", "place"]
    found = saved(_passages(docs, window, gram), "passages")
    first = found.groupBy("a", "passage").agg(F.min(F.struct(*key)).alias("at0")).select("a", "passage", "at0.*")
    first = saved(first, "first")
    crowded = saved(first.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_passages).select("a"), "crowded")
    calm = first.join(crowded, "a", "left_anti").withColumn("at", F.lit(-1).cast("long"))
    single = saved(_single_windows(first.join(crowded, "a", "left_semi"), window), "windows")
    once = single.groupBy("passage").agg(F.min(F.struct(*key, "at")).alias("at0")).select(F.xxhash64("passage").alias("a"), "passage", "at0.*")
    once = saved(once, "window_first")
    hits = saved(_search_shards(calm.unionByName(once), window, shard_passages), "hits")
    # a window of a crowded anchor is repeated if it isn't the first of its kind, or if the shard found an earlier one
    new = once.select(*key, "at").join(hits.filter("at >= 0").select(*key, "at"), [*key, "at"], "left_anti")
    late = single.select(*key, "at").join(new, [*key, "at"], "left_anti")
    late = late.groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, cast(at AS int))")).alias("mask"))
    crowd = first.join(crowded, "a", "left_semi").select(*key).join(late, key, "left").select(*key, F.coalesce("mask", F.lit(0)).alias("mask"))
    calm_first = calm.select(*key).join(hits.filter("at < 0").select(*key, "mask"), key, "left").select(*key, F.coalesce("mask", F.lit(0)).alias("mask"))
    masks = calm_first.unionByName(crowd)
    whole = F.expr("shiftleft(1L, cast(pmod(place, 32) AS int)) - 1")
    judged = found.select("chunk", "row", *key).join(masks, key, "left")
    return judged.select("chunk", "row", "place", F.coalesce("mask", whole).alias("mask")).filter("mask != 0")


def drop_repeats(
    docs: DataFrame, window: int = 20, gram: int = GRAM, hot_passages: int = HOT_PASSAGES, shard_passages: int = SHARD_PASSAGES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts
    earlier (smaller doc_id, or earlier in the same document). Null text has no
    words; a null id comes before all others. Rows that repeat id and text count
    as one document (none is removed for the other's sake); rows with one id
    and different texts are different documents, in an arbitrary fixed order. Very long texts are taken whole;
    an empty table gives no rows.
    Only the named columns are read, so extra ones can't clash.
    """
    if not gram <= window <= gram + 30:
        raise ValueError("the window must be from gram to gram + 30 words")
    keyed = _keyed(docs, id_col, text_col)
    return _removed(keyed, repeated_places(keyed, window, gram, hot_passages, shard_passages), window)
