"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Equal n-gram sets are one node from the start, so copies are never paired.

1. A few pivot rounds: in each bucket (one band hash) that holds several components, the
   most central member - the one whose buckets are largest, as those of an original are
   among its edited copies - is the pivot. A node is held against one pivot a round, the most
   central one it hasn't met, so a round makes at most one pair a node; what is linked is
   contracted before the next.
2. Buckets that still hold several components are settled exactly. What such buckets connect
   is a cluster; a cluster of few sets is one task, of a larger one each bucket is, and a
   bucket past the bound is cut into blocks. A task compares by matrix products and returns a
   spanning forest of the components it joins, never its pairs.
3. Links are counted inside each class in the same way: no pair leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import buffers, id_text, saved, slices

PIVOT_ROUNDS = 2  # fewer or more change the work of the exact step after them, not the result
BLOCK = 1024  # sets of a block at most, on average; a task holds two blocks
BLOCK_GRAMS = 1 << 21  # and their n-grams
_NO_ID = -(1 << 63)
SIGNED = "row long, id long, tx long, s1 long, s2 long, n_grams long, bands array<long>"


def banding(threshold: float, target_recall: float, rows_per_band: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find a pair at the threshold with the target probability."""
    hit = threshold**rows_per_band
    return math.ceil(math.log(1 - target_recall) / math.log(1 - hit)), rows_per_band


def shingles(w: words.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of all documents in a row and n_docs+1 places; a text of 1 to n-1 words is one shorter n-gram."""
    counts = np.diff(w.first)
    own = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(own)])
    doc = np.repeat(np.arange(len(counts)), own)
    start = w.first[doc] + np.arange(len(doc)) - first[doc]
    all_ = words.grams(w.hash, n)
    out = np.zeros(len(start), np.uint64)
    full = counts[doc] >= n
    out[full] = all_[start[full]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        h = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = words.grams(h, len(h))[0] ^ np.uint64(len(h))
    return out, first


def unique_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[new], np.searchsorted(d[new], np.arange(len(first)))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = words.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return a, words.mix(a)


def band_hashes(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands hashes of each document with at least one n-gram, from bands * rows minima; blocks of documents bound the memory."""
    a, b = _constants(bands * rows)
    n = len(first) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    starts = first[full]
    with np.errstate(over="ignore"):
        for k in range(bands):
            acc = np.full(len(full), np.uint64(k + 1))
            for r in range(k * rows, (k + 1) * rows):
                least = np.minimum.reduceat((values ^ b[r]) * a[r], starts)
                acc = words.mix(acc * np.uint64(0x9FB21C651E98DF25) + least)
            out[full, k] = acc
    return out


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values, first = shingles(words.split(*buffers(batch.column(3))), n)
                sums = []
                with np.errstate(over="ignore"):
                    # sums over the set: equal sets, equal fingerprints, whatever the order and repeats
                    uv, uf = unique_sets(values, first)
                    for salt in (0x51ED270B, 0xA3B195354A39B70D):
                        total = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(uv ^ np.uint64(salt)))])
                        sums.append((total[uf[1:]] - total[uf[:-1]]).view(np.int64))
                hashes = band_hashes(uv, uf, bands, rows)
                empty = np.diff(uf) == 0
                flat = pa.array(hashes[~empty].ravel().view(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(3)), *map(pa.array, sums), pa.array(np.diff(uf).astype(np.int64)), pa.ListArray.from_arrays(offsets, flat)],
                    names=["row", "id", "tx", "s1", "s2", "n_grams", "bands"],
                )

    return docs.mapInArrow(run, SIGNED)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                uv, uf = unique_sets(*shingles(words.split(*buffers(batch.column(1))), n))
                grams = pa.ListArray.from_arrays(pa.array(uf.astype(np.int32)), pa.array(uv.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["node", "grams"])

    return docs.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the pairs at or above the threshold; both joins read plain tables, so AQE can split a hot pivot."""
    left, right = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "uv")
    both = pairs.join(right, "v").join(left, "u")
    common = F.size(F.array_intersect("gu", "gv"))
    return both.withColumn("common", common).filter(F.col("common") / (F.size("gu") + F.size("gv") - F.col("common")) >= threshold).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component; one saved table a round, about log(longest path) rounds."""
    links = saved(links.select("u", "v"), "links")
    both = saved(links.union(links.select("v", "u")).distinct(), "arcs")
    labels = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("least"))
        met = saved(labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "least").alias("next")), "met")
        jump = met.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = saved(met.join(jump, "next").select("node", F.col("further").alias("label"), (F.col("label") != F.col("further")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("moved").limit(1).count():
            return labels


def _placed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the component each node is in so far."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return saved(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")


def _mixed(placed: DataFrame) -> DataFrame:
    """(h, pivot): the buckets that hold several components, and the most central node of each."""
    top = F.max(F.struct("weight", (-F.col("node")).alias("first")))
    mixed = placed.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b"), top.alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g"))
    return saved(mixed.filter("a != b").select("h", (-F.col("top.first")).alias("pivot"), F.col("top.weight").alias("pivot_weight"), "n", "g"), "mixed")


def _offers(placed: DataFrame, mixed: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(u, v): each node with the most central pivot of its mixed buckets that it hasn't met."""
    offers = placed.join(mixed, "h").filter("node != pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"), "node", "pivot", "pivot_weight")
    if tried is not None:
        offers = offers.join(tried, ["u", "v"], "left_anti")
    best = offers.groupBy("node").agg(F.max(F.struct("pivot_weight", (-F.col("pivot")).alias("first"), "u", "v")).alias("o"))
    return saved(best.select("o.u", "o.v").distinct(), "pairs")


def _dealt(groups: DataFrame, key: str, n: str, g: str) -> DataFrame:
    """``groups`` rows with task, block and own (count pairs inside the block here): one task, or every two blocks of a group past the bound."""
    blocks = F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(g) / BLOCK_GRAMS))
    cut = groups.withColumn("blocks", F.when(blocks <= 2, F.lit(1)).otherwise(blocks))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))
    )
    cut = cut.withColumn("other", F.explode(others))
    task = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    return cut.withColumn("task", task).withColumn("own", (F.col("blocks") == 1) | (F.pmod(F.col("block") + 1, F.col("blocks")) == F.col("other")))


def _settled(placed: DataFrame, mixed: DataFrame, grams: DataFrame, threshold: float) -> DataFrame | None:
    """Links that join the components which buckets still hold apart though two of their members are similar; None without such buckets."""
    left = saved(placed.join(mixed, "h").select("h", "node", "label", "n_grams", "pivot", "n", "g"), "left")
    if not left.limit(1).count():
        return None
    spokes = left.filter("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    clusters = components(spokes).withColumnRenamed("label", "cluster")
    nodes = saved(left.select("node", "label", "n_grams").distinct().join(clusters, "node"), "clustered")
    sizes = saved(nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("cn"), F.sum("n_grams").alias("cg")), "clusters")
    nodes = saved(nodes.join(sizes, "cluster").withColumn("small", (F.col("cn") <= 2 * BLOCK) & (F.col("cg") <= 2 * BLOCK_GRAMS)), "sized")
    whole = nodes.filter("small").select(F.xxhash64("cluster", F.lit(1)).alias("task"), "node", "label")
    apart = left.join(nodes.filter("NOT small").select("node"), "node")
    sent = saved(whole.unionByName(_dealt(apart, "h", "n", "g").select("task", "node", "label")), "sent")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        u, v = forest(similar(pdf["grams"].tolist(), threshold), label)
        return pd.DataFrame({"u": np.minimum(node[u], node[v]), "v": np.maximum(node[u], node[v])})

    return saved(sent.join(grams, "node").groupBy("task").applyInPandas(verify, "u long, v long").distinct(), "more")


def _counted(classes: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(node, n): rows of the other sets at or above the threshold; ``classes`` (label, node, size, n_grams) holds nodes with a link."""
    sizes = saved(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("g")), "class_sizes")
    sent = saved(_dealt(classes.join(sizes, "label"), "label", "n", "g").select("task", "node", "size", "block", "own"), "counted")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        near = similar(pdf["grams"].tolist(), threshold)
        block = pdf["block"].to_numpy()
        near &= (block[:, None] != block[None, :]) | pdf["own"].to_numpy()[:, None]
        return pd.DataFrame({"node": pdf["node"], "n": near @ pdf["size"].to_numpy()})

    return sent.join(grams, "node").groupBy("task").applyInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def similar(sets: list[np.ndarray], threshold: float, columns: int = 4096, rows: int = 256) -> np.ndarray:
    """For each two sets, whether they reach the threshold (never a set with itself).

    Values that many of the sets hold are counted by matrix products, rare ones pair by pair.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    row = np.repeat(np.arange(n), size.astype(np.int64))
    _, column, count = np.unique(np.concatenate(sets) if n else np.zeros(0), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    many = count > max(8, n // 16)
    number = np.cumsum(many) - 1
    dense = many[column]
    r, c = row[dense], number[column[dense]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for at in range(0, int(many.sum()), columns):
        lo, hi = np.searchsorted(c, [at, at + columns])
        part = np.zeros((n, columns), np.float32)
        part[r[lo:hi], c[lo:hi] - at] = 1
        common += part @ part.T
    few = (count > 1) & ~many
    keep = few[column]
    r, c = row[keep], column[keep]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    ahead = 1
    while len(c) > ahead:  # the next, next but one, ... holder of the same value
        same = np.flatnonzero(c[ahead:] == c[:-ahead])
        if not len(same):
            break
        u, v = r[same], r[same + ahead]
        for x, y in ((u, v), (v, u)):
            at, times = np.unique(x * n + y, return_counts=True)
            common.reshape(-1)[at] += times.astype(np.float32)
        ahead += 1
    out = np.zeros((n, n), bool)
    for at in range(0, n, rows):
        inter = common[at : at + rows].astype(np.float64)
        out[at : at + rows] = inter / np.maximum(1, size[at : at + rows, None] + size[None, :] - inter) >= threshold
    np.fill_diagonal(out, False)
    return out


def forest(near: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``near`` that join the labels it connects: one fewer than the labels of each tree."""
    names, group = np.unique(label, return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    us, vs = [], []
    for u in range(len(label)):
        partners = np.flatnonzero(near[u, :u] & (group[:u] != group[u]))
        if not len(partners):
            continue
        _, one = np.unique(group[partners], return_index=True)
        for v in partners[one].tolist():
            a, b = root(int(group[u])), root(int(group[v]))
            if a != b:
                parent[a] = b
                us.append(u), vs.append(v)
    return np.array(us, np.int64), np.array(vs, np.int64)


def near_dup(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.9999,
    id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, class_size, kept, text_hash, and ``row_col`` (a unique number) if there is one.

    ``class_id``: the least doc_id of the documents connected by links between
    word n-gram sets with a Jaccard similarity of at least ``threshold``. ``n_links``:
    how many other rows the document has such a link with; every row of an equal set is one. Texts
    of fewer than n words are one shorter n-gram, very long ones are taken whole; ``kept`` marks one row of each class, that of the
    least doc_id (of several, the first). All texts without words (null, empty) have equal sets. Rows that repeat id and
    text are equal. A null id comes before all others. An empty table gives no rows.
    Only the named columns are read, so extra ones can't clash.
    """
    bands, rows = banding(threshold, target_recall)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    keyed = id_text(docs, id_col, text_col, row.alias("row")).select(
        "row", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("tx"), "text"
    )
    signed = saved(_signed(keyed, n, bands, rows), "signed")
    member = F.struct("row", "id", "tx")
    sets = signed.groupBy("s1", "s2").agg(
        F.min(member).alias("m"), F.min(F.struct("id", "row")).alias("least"), F.count(F.lit(1)).alias("size"),
        F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
    )
    sets = saved(sets.select("s1", "s2", F.col("m.row").alias("node"), "m.id", "m.tx", "least", "size", "n_grams", "bands"), "sets")
    keys = saved(sets.select("node", "n_grams", F.explode("bands").alias("h")), "keys")  # a band hash already differs by band
    sizes = saved(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    members = saved(keys.join(sizes, "h"), "members")
    # the node whose buckets are largest is the most central one: an original rather than one of its edited copies
    central = saved(members.groupBy("node").agg(F.sum("n").alias("weight")), "central")
    members = saved(members.drop("n").join(central, "node"), "members")
    wanted = saved(central.select("node").join(sets.select("node", "id", "tx"), "node"), "wanted")
    # texts of candidates only, by a merge join whatever the size: what one text's node is can't be sent for a corpus
    text = keyed.select("id", "tx", "text").join(wanted.hint("merge"), ["id", "tx"])
    grams = saved(_sets(text, n).dropDuplicates(["node"]), "grams")
    placed, labels, links, tried = _placed(members, None), None, None, None
    for _ in range(PIVOT_ROUNDS):
        pairs = _offers(placed, _mixed(placed), tried)
        found = _verified(pairs, grams, threshold)
        tried = pairs if tried is None else tried.union(pairs)
        links = saved(found if links is None else links.union(found), "links")
        labels = components(links)
        placed = _placed(members, labels)
    more = _settled(placed, _mixed(placed), grams, threshold)
    if more is not None:
        labels = components(links.union(more))
    in_class = saved(sets.select("node", "size", "n_grams").join(labels, "node"), "in_class")
    linked = saved(_counted(in_class, grams, threshold), "linked")
    named = sets.select("node", "s1", "s2", "least", "size").join(labels, "node", "left").join(linked, "node", "left")
    named = named.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("size") - 1)
    named = saved(named.withColumn("label", F.coalesce("label", "node")), "named")
    classes = named.groupBy("label").agg(F.min("least").alias("class"), F.sum("size").alias("class_size"))
    classes = classes.withColumn("class", F.struct(F.col("class.id").alias("class_id"), F.col("class.row").alias("class_row")))
    classes = saved(named.join(saved(classes, "classes"), "label").select("s1", "s2", "class.*", "class_size", "n_links"), "set_classes")
    null_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    out = signed.select("row", "id", "tx", "s1", "s2").join(classes, ["s1", "s2"])
    return out.select(
        null_id("id").alias("doc_id"), null_id("class_id").alias("class_id"), "n_links", "class_size",
        (F.col("row") == F.col("class_row")).alias("kept"), F.col("tx").alias("text_hash"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
