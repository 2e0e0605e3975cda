"""Hard negatives: Hilbert-ordered blocks of candidates with zone maps, read only by the windows that can hold something of them.

Rows are sorted by label and by their place on a Hilbert curve over all dimensions (BITS bits each) and
cut into blocks, the rows of a Parquet table; a block has one label and knows the least and largest value of
every dimension. Interval arithmetic over these gives the least and largest score an anchor can have
in a block, and so which blocks it reads: for positives those of its label that can reach the last of the best found
in its own block, for negatives those of other labels whose scores can fall into one of its windows.

Anchors travel in packs with what they look for; bounds are taken pack by pack of zones, and a block meets
the anchors that asked for it in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .vectors import PACKED, exact_kind, first_of, meet, packed, unpack

BITS = 4  # of each dimension on the curve
BLOCK = 4096  # rows of a block, at most
ANCHORS = 256  # anchors of a pack
ZONES = 256  # blocks of a pack of zones, about
PART = 16  # packs of anchors that meet a block in one task, about

_BLOCKS = "block long, label long, ids binary, vecs binary, lo binary, hi binary, a_ids binary, a_vecs binary, a_floor binary"
_ANCHORS = "anchor_id long, label long, vec binary, floor long"
_WANTS = "block long, part int, ano binary, ids binary, vecs binary, low binary, high binary"
_HITS = "ano long, anchor_id long, high long, vec_id long, score long"
_LEAST, _MOST = -(1 << 62), 1 << 62  # beyond every score


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The places of points (rows of whole numbers under 2**bits) on the Hilbert curve, as rows of bytes that sort like them."""
    x = x.T.astype(np.uint32).copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(hit, p, t).astype(np.uint32)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.uint32), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= t
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # the highest bit of every dimension first
    return np.packbits(planes.astype(np.uint8), axis=0).T


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score of each query (row of q) with any vector between lo and hi (rows: blocks); a little wider than exact."""
    q, lo, hi = (v.astype(np.float64) for v in (q, lo, hi))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, largest = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = 1e-9 * (np.abs(least) + np.abs(largest)) + 0.5
    return least - slack, largest + slack


def floors(ids: np.ndarray, vecs: np.ndarray, mine: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row ``mine`` with the other ids' rows, or _LEAST if there are fewer."""
    out = np.full(len(mine), _LEAST, np.int64)
    kind = exact_kind(*[np.abs(vecs.astype(np.int64)).max(initial=0)] * 2, vecs.shape[1])
    for at in range(0, len(mine), ANCHORS):
        some = mine[at : at + ANCHORS]
        score = (vecs[some].astype(kind) @ vecs.astype(kind).T).astype(np.int64)
        score[ids[some][:, None] == ids[None, :]] = _LEAST
        if score.shape[1] >= k:
            out[at : at + ANCHORS] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return out


def _blocks(data: DataFrame, dim: int, block: int, k: int) -> DataFrame:
    """Sorted by label and curve, cut into blocks of at most ``block`` rows of one label.

    The anchors among a block's rows stand beside it, with their k-th best score in it: what their positives must reach.
    """
    most, n = data.agg(F.max("most"), F.count(F.lit(1))).first()
    width = 2 * int(most or 0) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b["vec"].to_pylist(), dim).astype(np.int64) + int(most or 0)
            at = hilbert(x * (1 << BITS) // width, BITS) if dim else np.zeros((len(x), 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.tobytes() for v in at], pa.binary())], [*b.schema.names, "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, label = TaskContext.get().partitionId() << 32, 0, 0
        held = [np.zeros(0, np.int64), np.zeros((0, dim), PACKED), np.zeros(0, bool)]  # of one label

        def out(rows: int) -> pa.RecordBatch:
            nonlocal held, made
            ids, vecs, mine = (v[:rows] for v in held)
            held, made = [v[rows:] for v in held], made + 1
            mine = np.flatnonzero(mine)
            row = {"ids": ids, "vecs": vecs, "lo": vecs.min(0), "hi": vecs.max(0), "a_ids": ids[mine], "a_vecs": vecs[mine], "a_floor": floors(ids, vecs, mine, k)}
            return pa.RecordBatch.from_pydict({"block": pa.array([base + made]), "label": pa.array([label])} | {c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in row.items()})

        for b in batches:
            labels = b["label"].to_numpy()
            cols = [b["vec_id"].to_numpy(), unpack(b["vec"].to_pylist(), dim), b["is_anchor"].to_numpy(zero_copy_only=False)]
            ends = np.flatnonzero(np.append(labels[1:] != labels[:-1], True)) + 1 if len(labels) else np.zeros(0, np.int64)
            for first, last in zip([0, *ends[:-1]], ends, strict=False):
                if len(held[0]) and label != labels[first]:
                    yield out(block)
                label = int(labels[first])
                held = [np.concatenate([h, c[first:last]]) for h, c in zip(held, cols, strict=True)]
                while len(held[0]) >= block:
                    yield out(block)
        if len(held[0]):
            yield out(block)

    order = ["label", "place", "vec_id"]
    placed = data.select("vec_id", "label", "vec", "is_anchor").mapInArrow(place, "vec_id long, label long, vec binary, is_anchor boolean, place binary")
    run = placed.repartitionByRange(max(1, -(-n // (4 * block))), *order).sortWithinPartitions(*order)
    return saved(run.drop("place").mapInArrow(cut, _BLOCKS), "blocks")


def _anchors(blocks: DataFrame, dim: int) -> DataFrame:
    """One row for each anchor: ano, anchor_id, label, vec, floor."""

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, floor = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_floor"], np.int64)
                vecs = np.frombuffer(r["a_vecs"], PACKED).reshape(len(ids), dim)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), r["label"])), pa.array([v.tobytes() for v in vecs], pa.binary()), pa.array(floor)], ["anchor_id", "label", "vec", "floor"])

    out = blocks.select("label", "a_ids", "a_vecs", "a_floor").mapInArrow(unroll, _ANCHORS)
    return saved(out.withColumn("ano", F.monotonically_increasing_id()), "anchors")


def _asked(blocks: DataFrame, anchors: DataFrame, dim: int, same: bool, n_blocks: int, parts: int) -> DataFrame:
    """Which blocks the windows of each anchor must read: packs of anchors by block.

    ``anchors``: ano, anchor_id, label, vec, low and high (as many windows of whole numbers each). ``same``: read blocks of the anchor's label, else of the others.
    """
    packs = max(1, -(-n_blocks // ZONES))
    zones = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int").alias("zone")).agg(F.collect_list(F.struct("block", "label", "lo", "hi")).alias("z"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ANCHORS):
                s = b.slice(at, ANCHORS)
                cols = {c: s[c].to_numpy() for c in ("ano", "anchor_id", "label")} | {"vecs": unpack(s["vec"].to_pylist(), dim)}
                cols |= {c: s[c].flatten().to_numpy() for c in ("low", "high")}
                yield pa.RecordBatch.from_pydict({c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in cols.items()})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["vecs"], PACKED).reshape(-1, dim)
                ano, ids, label = (np.frombuffer(r[c], np.int64) for c in ("ano", "anchor_id", "label"))
                low, high = (np.frombuffer(r[c], np.int64).reshape(len(q), -1) for c in ("low", "high"))
                lo, hi = (np.frombuffer(b"".join(z[c] for z in r["z"]), PACKED).reshape(-1, dim) for c in ("lo", "hi"))
                of = np.array([z["label"] for z in r["z"]])
                least, largest = bounds(q, lo, hi)
                reads = np.zeros(least.shape, bool)
                for w in range(low.shape[1]):
                    reads |= (largest >= low[:, w, None]) & (least <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]  # padding has low above high
                reads &= (label[:, None] == of[None, :]) == same
                out = [(j, p) for j in range(len(of)) if len(p := np.flatnonzero(reads[:, j]))]
                if out:
                    part = int(ano[0]) % 1_000_003 % parts
                    cols = {"ano": ano, "ids": ids, "vecs": q, "low": low, "high": high}
                    data = {"block": pa.array([r["z"][j]["block"] for j, _ in out], pa.int64()), "part": pa.array([part] * len(out), pa.int32())}
                    yield pa.RecordBatch.from_pydict(data | {c: pa.array([np.ascontiguousarray(v[p]).tobytes() for _, p in out], pa.binary()) for c, v in cols.items()})

    names = ("ano", "anchor_id", "label", "vecs", "low", "high")
    bundled = anchors.select("ano", "anchor_id", "label", "vec", "low", "high").mapInArrow(bundle, ", ".join(f"{c} binary" for c in names))
    met = bundled.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(zones, "zone")
    return saved(met.select(*names, "z").mapInArrow(choose, _WANTS), "wants")


def _read(blocks: DataFrame, wants: DataFrame, dim: int, windows: int, k: int) -> DataFrame:
    """The k best rows of each block for each window of the anchors that read it: ano, anchor_id, high, vec_id, score."""

    def look(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _HITS.split(", ")]
        parts: list[pd.DataFrame] = []
        for _, r in held.iterrows():
            ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vecs"], PACKED).reshape(-1, dim)
            for _, w in wanted.iterrows():
                q, ano, own = np.frombuffer(w["vecs"], PACKED).reshape(-1, dim), np.frombuffer(w["ano"], np.int64), np.frombuffer(w["ids"], np.int64)
                low, high = (np.frombuffer(w[c], np.int64).reshape(-1, windows) for c in ("low", "high"))
                kind = exact_kind(np.abs(q.astype(np.int64)).max(initial=0), np.abs(x.astype(np.int64)).max(initial=0), dim)
                score = q.astype(kind) @ x.astype(kind).T
                for c in range(windows):
                    i, j = np.nonzero((score >= low[:, c, None]) & (score <= high[:, c, None]))
                    other = ids[j] != own[i]
                    i, j = i[other], j[other]
                    keep = first_of(i, got := score[i, j].astype(np.int64), ids[j], k)
                    i, j, got = i[keep], j[keep], got[keep]
                    parts.append(pd.DataFrame({"ano": ano[i], "anchor_id": own[i], "high": high[i, c], "vec_id": ids[j], "score": got}))
        return pd.concat(parts)[names] if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in names})

    found = meet(blocks.select("block", "ids", "vecs"), wants, ["block"], look, _HITS)
    rank = F.row_number().over(W.partitionBy("ano", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Components become floor(scale * x); a row's score is its inner product with the anchor, higher first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label; negatives of a positive
    are the first ``negatives`` rows of other labels with low * p <= 100 * score <= high * p, p the positive's score (for p < 0 there are none while
    low < high). Rows with a null id, label or vector or a null or non-finite component take no part; shorter
    vectors count as filled up with zeros, components beyond +-2^27 are cut to that. ``anchors`` is a condition on the id column.
    Each repeated row counts: as an anchor for itself, as another row only for other ids. Extra columns, whatever their names, are not read. Empty tables, or no anchor: no rows.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    pick = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    data = saved(packed(pick.filter("label IS NOT NULL"), scale, "label", "is_anchor"), "vectors")
    size = data.agg(F.max(F.octet_length("vec"))).first()[0]
    if size is None:
        return spark.createDataFrame([], schema)
    dim = max(1, size // PACKED.itemsize)
    blocks = _blocks(data, dim, block, positives)
    chosen = _anchors(blocks, dim)
    n_blocks, n_anchors = blocks.count(), chosen.count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    parts = max(1, -(-n_anchors // (ANCHORS * PART)))
    wants = _asked(blocks, chosen.withColumns({"low": F.array("floor"), "high": F.array(F.lit(_MOST))}), dim, True, n_blocks, parts)
    best = _read(blocks, wants, dim, 1, positives).select("ano", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    best = saved(best.withColumns({"low": F.ceil(share(low)).cast("long"), "high": F.floor(share(high)).cast("long")}), "positives")
    real = best.filter("low <= high").groupBy("ano").agg(F.collect_set(F.struct("low", "high")).alias("w"))
    pad = lambda c, v: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(v), positives)), 1, positives)
    windows = chosen.join(real, "ano").withColumns({"low": F.col("w.low"), "high": F.col("w.high")}).withColumns({"low": pad("low", _MOST), "high": pad("high", _LEAST)})
    wants = _asked(blocks, windows, dim, False, n_blocks, parts)
    hits = _read(blocks, wants, dim, positives, negatives)
    # windows of one anchor that end alike start alike
    return best.join(hits.select("ano", "high", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["ano", "high"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
