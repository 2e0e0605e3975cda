"""Exact top-k by inner product: best-first search of M-trees.

Inner products become distances in one dimension more: a candidate x gets the component
sqrt(M - |x|^2), M the largest squared length, a query q gets 0; then |q - x|^2 is
|q|^2 + M - 2 q.x, so the nearest are those of the highest product.

The index is an M-tree whose pages are rows of a table. Its top level are cells around pivots
from a bounded sample; a cell of many rows is dealt by a hash to shards of about SHARD rows, so
copies of one vector don't make a group that grows. A shard is a subtree: each page has
a routing object (one of its rows), a covering radius and its distance to the parent's object; leaf
entries are ordered by their distance to the page's object.

A pack of queries searches a shard together: every query takes the page with its least lower bound
next. A child whose stored parent distance already puts it out of reach is dropped before any
distance to it is computed, and of a leaf only the stretch of entries whose stored distances
are within reach is computed. Each query first searches its home shard; the k-th score there bounds
what other cells it visits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .vectors import PACKED, exact_kind, first_of, meet, packed, unpack

SHARD = 8192  # rows of a subtree, about
CELLS = 1024  # pivots at most
SAMPLE = 4096  # rows from which pivots are chosen
PAGE = 256  # entries of a leaf
FAN = 8  # children of a page
PACK = 512  # queries of a pack
PART = 8192  # queries that search one shard in one task, about
_SLACK = 1e-7  # of all distances, against rounding

_PAGES = "cell int, slot int, node int, parent int, leaf boolean, centre binary, radius double, parent_dist double, ids binary, vecs binary, dists binary"
_PACKS = "cell int, slot int, part int, qno binary, ids binary, vecs binary, least binary"
_FOUND = "qno long, query_id long, vec_id long, score long"


def lift(x: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    """Candidates in the space of distances."""
    return np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(0.0, most - norm2.astype(np.float64)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def clusters(x: np.ndarray, n: int, rounds: int = 2) -> np.ndarray:
    """The places of at most n different rows as centres: evenly spaced ones, then those next to their groups' means."""
    chosen = np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(np.int64))
    for _ in range(rounds):
        near = distances(x, x[chosen])
        of = near.argmin(1)
        size = np.bincount(of, minlength=len(chosen))
        mean = np.zeros((len(chosen), x.shape[1]))
        np.add.at(mean, of, x)
        mean = mean[size > 0] / size[size > 0][:, None]
        chosen = np.unique(distances(mean, x).argmin(1))
    return chosen


def build(x: np.ndarray, centre: np.ndarray, page: int = PAGE, fan: int = FAN) -> list[dict]:
    """The pages of an M-tree over the rows of ``x`` (lifted), its root around ``centre``; the first is the root."""
    pages: list[dict] = []
    todo = [(-1, centre, 0.0, np.arange(len(x)))]
    while todo:
        parent, mid, to_parent, rows = todo.pop()
        far = distances(x[rows], mid[None, :])[:, 0]
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        node, leaf = len(pages), len(rows) <= page
        pages.append({"node": node, "parent": parent, "leaf": leaf, "centre": mid, "radius": float(far[-1]) if len(far) else 0.0, "parent_dist": to_parent, "rows": rows if leaf else rows[:0], "dists": far if leaf else far[:0]})
        if leaf:
            continue
        # each seed in turn takes its share of the nearest rows left, so pages are full whatever the rows are
        seeds = clusters(x[rows], min(fan, -(-len(rows) // page)))
        near, left = distances(x[rows[seeds]], x[rows]), np.ones(len(rows), bool)
        share = -(-len(rows) // min(fan, -(-len(rows) // page)))
        turn = 0
        while left.any():
            s, open_ = turn % len(seeds), np.flatnonzero(left)
            own = open_[np.argsort(near[s, open_], kind="stable")[:share]]
            left[own], turn = False, turn + 1
            todo.append((node, x[rows[seeds[s]]], float(distances(mid[None, :], x[rows[seeds[s]]][None, :])[0, 0]), rows[own]))
    return pages


class Tree:
    """A shard's pages in memory."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        pages = pages.sort_values("node")
        self.centre = np.frombuffer(b"".join(pages["centre"]), np.float64).reshape(len(pages), dim + 1)
        self.radius, self.parent_dist = pages["radius"].to_numpy(), pages["parent_dist"].to_numpy()
        self.leaf, parent = pages["leaf"].to_numpy(bool), pages["parent"].to_numpy()
        self.children = {int(p): np.flatnonzero(parent == p) for p in np.unique(parent) if p >= 0}
        sizes = [len(v) // 8 for v in pages["ids"]]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.frombuffer(b"".join(pages["ids"]), np.int64)
        self.dists = np.frombuffer(b"".join(pages["dists"]), np.float64)
        self.vecs = np.frombuffer(b"".join(pages["vecs"]), PACKED).reshape(-1, dim)

    def best_first(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """(row of q, id, score) of each query's k first entries whose score is not under ``least`` (-inf: no bound), and what was computed.

        ``own``: ids that a query may not find; ``most``: M.
        """
        kind = exact_kind(np.abs(q).max(initial=0), np.abs(self.vecs).max(initial=0), q.shape[1])
        qk, entries = q.astype(kind), self.vecs.astype(kind)
        wide = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
        square = (wide * wide).sum(1)
        slack = _SLACK * float(np.sqrt(square.max(initial=0) + most) + 1)
        reach = lambda s: np.sqrt(np.maximum(0.0, np.where(np.isneginf(s), np.inf, square + most - 2 * np.maximum(s, -1e300)))) + slack
        bound = np.full((len(q), len(self.radius)), np.inf)
        dist = np.zeros_like(bound)
        dist[:, 0] = distances(wide, self.centre[:1])[:, 0]
        bound[:, 0] = dist[:, 0] - self.radius[0]
        floor, every = least.astype(np.float64).copy(), np.arange(len(q))
        r = reach(floor)
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # row, id, score
        work = {"entries": 0, "skipped_entries": 0, "skipped_pages": 0}
        while True:
            pick = bound.argmin(1)
            low = bound[every, pick]
            live = np.flatnonzero((low <= r) & (low < np.inf))  # inf: no page is left
            if not len(live):
                break
            pick = pick[live]
            bound[live, pick] = np.inf
            order = np.argsort(pick, kind="stable")
            live, pick = live[order], pick[order]
            starts = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
            found = [top]
            for a, b in zip(starts, [*starts[1:], len(pick)], strict=True):
                node, rows = int(pick[a]), live[a:b]
                here = dist[rows, node]
                if self.leaf[node]:
                    first, last = self.at[node], self.at[node + 1]
                    lo = first + np.searchsorted(self.dists[first:last], here - r[rows]).min()
                    hi = first + np.searchsorted(self.dists[first:last], here + r[rows], "right").max()
                    work["skipped_entries"] += int(last - first - max(0, hi - lo)) * len(rows)
                    if lo >= hi:
                        continue
                    work["entries"] += int(hi - lo) * len(rows)
                    score = qk[rows] @ entries[lo:hi].T
                    i, j = np.nonzero(score >= floor[rows][:, None])
                    ids = self.ids[lo + j]
                    other = ids != own[rows[i]]
                    i, j, ids = i[other], j[other], ids[other]
                    found.append((rows[i], ids, score[i, j].astype(np.int64)))
                else:
                    kids = self.children[node]
                    gap = np.abs(here[:, None] - self.parent_dist[kids]) - self.radius[kids]
                    near = gap <= r[rows][:, None]
                    some = near.any(0)
                    work["skipped_pages"] += int((~near).sum())
                    if not some.any():
                        continue
                    kids, gap, near = kids[some], gap[:, some], near[:, some]
                    d = distances(wide[rows], self.centre[kids])
                    dist[np.ix_(rows, kids)] = d
                    bound[np.ix_(rows, kids)] = np.where(near, np.maximum(d - self.radius[kids], gap), np.inf)
            if len(found) > 1:
                row, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = first_of(row, score, ids, k)
                top = row[keep], ids[keep], score[keep]
                count = np.bincount(top[0], minlength=len(q))
                full = np.flatnonzero(count >= k)
                last = np.cumsum(count) - 1
                floor[full] = np.maximum(floor[full], top[2][last[full]])
                r = reach(floor)
        return *top, work


def _packs(cell: np.ndarray, slot: np.ndarray, part: np.ndarray, pick: list[np.ndarray], cols: dict) -> pa.RecordBatch:
    """One row of packed queries for each (cell, slot, part)."""
    data = {"cell": pa.array(cell, pa.int32()), "slot": pa.array(slot, pa.int32()), "part": pa.array(part, pa.int32())}
    data |= {c: pa.array([np.ascontiguousarray(v[p]).tobytes() for p in pick], pa.binary()) for c, v in cols.items()}
    return pa.RecordBatch.from_pydict(data)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest inner product for each query, ties to the smaller id; all, if fewer.

    Components become floor(scale * x). A row that has the query's id is no candidate for it. Rows with
    a null id, a null vector or a null or non-finite component take no part, as query or candidate;
    shorter vectors count as filled up with zeros; components beyond +-2^27 are cut to that. Each
    repeated row counts: as a candidate it takes a rank, as a query it gives a list. Other columns, whatever their names, are not read.
    Empty tables give no rows.
    """
    columns = lambda df: df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    data = saved(packed(columns(candidates), scale), "vectors")
    asked = saved(packed(columns(queries), scale).withColumn("qno", F.monotonically_increasing_id()), "queries")
    size = F.max(F.octet_length("vec")).alias("size")
    have = data.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2"), size).first()
    want = asked.agg(F.count(F.lit(1)).alias("n"), size).first()
    if not have["n"] or not want["n"]:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most = max(1, max(have["size"], want["size"]) // PACKED.itemsize), float(have["norm2"])
    sample = data.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).select("vec", "norm2").toPandas()
    lifted = lift(unpack(sample["vec"], dim), sample["norm2"].to_numpy(), most)
    pivots = lifted[clusters(lifted, min(CELLS, -(-have["n"] // shard)), 4)]
    parts = -(-want["n"] // PART)

    def cells(x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return distances(lift(x, norm2, most), pivots).argmin(1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(pivots), np.int64)
        for b in batches:
            seen += np.bincount(cells(unpack(b["vec"].to_pylist(), dim), b["norm2"].to_numpy()), minlength=len(pivots))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(pivots)), pa.int32()), "n": pa.array(seen)})

    many = dict(data.select("vec", "norm2").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())  # at most CELLS rows
    slots = np.array([max(1, -(-many.get(c, 0) // shard)) for c in range(len(pivots))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells(unpack(b["vec"].to_pylist(), dim), b["norm2"].to_numpy())
            slot = b["hash"].to_numpy() % slots[cell]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "slot": pa.array(slot, pa.int32()), "vec_id": b["vec_id"], "vec": b["vec"], "norm2": b["norm2"]})

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vecs, ids = unpack(pdf["vec"], dim), pdf["vec_id"].to_numpy()
        pages = build(lift(vecs, pdf["norm2"].to_numpy(), most), pivots[key[0]])
        out = pd.DataFrame(pages)
        out["ids"], out["vecs"] = [ids[r].tobytes() for r in out["rows"]], [vecs[r].tobytes() for r in out["rows"]]
        out["dists"], out["centre"] = [v.tobytes() for v in out["dists"]], [v.tobytes() for v in out["centre"]]
        return out.assign(cell=key[0], slot=key[1])[[c.split()[0] for c in _PAGES.split(", ")]]

    hashed = data.select("vec_id", "vec", "norm2", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 31)).alias("hash"))
    dealt = hashed.mapInArrow(deal, "cell int, slot int, vec_id long, vec binary, norm2 long")
    pages = saved(dealt.groupBy("cell", "slot").applyInPandas(grow, _PAGES), "pages")
    widest = dict(pages.filter("node = 0").groupBy("cell").agg(F.max("radius")).collect())  # at most CELLS rows
    radius = np.array([widest.get(c, -1.0) for c in range(len(pivots))])
    filled = np.flatnonzero(radius >= 0)

    def queries_of(b: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """Slices of a batch: packed columns, distances to the filled pivots, home shard."""
        for at in range(0, b.num_rows, PACK):
            s = b.slice(at, PACK)
            q = unpack(s["vec"].to_pylist(), dim)
            d = distances(np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1), pivots[filled])
            home = filled[d.argmin(1)]
            least = s["least"].to_numpy(zero_copy_only=False).astype(np.float64)
            cols = {"qno": s["qno"].to_numpy(), "ids": s["vec_id"].to_numpy(), "vecs": q, "least": np.where(np.isnan(least), -np.inf, least)}
            yield cols, d, np.stack([home, cols["qno"] % slots[home]])

    def part_of(qno: np.ndarray) -> int:
        return zlib.crc32(qno[:1].tobytes()) % parts

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cols, _, home in queries_of(b):
                where, of = np.unique(home, axis=1, return_inverse=True)
                pick = [np.flatnonzero(of.ravel() == g) for g in range(where.shape[1])]
                yield _packs(where[0], where[1], [part_of(cols["qno"]) for _ in pick], pick, cols)

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cols, d, home in queries_of(b):
                square = (cols["vecs"].astype(np.float64) ** 2).sum(1)
                reach = np.sqrt(np.maximum(0.0, np.where(np.isneginf(cols["least"]), np.inf, square + most - 2 * np.maximum(cols["least"], -1e300))))
                near = d - radius[filled] <= reach[:, None] + _SLACK * (np.sqrt(square + most)[:, None] + 1)
                todo = [(c, s, p) for i, c in enumerate(filled) for s in range(slots[c]) if len(p := np.flatnonzero(near[:, i] & ((home[0] != c) | (home[1] != s))))]
                if todo:
                    cell, slot, pick = zip(*todo, strict=True)
                    yield _packs(cell, slot, [part_of(cols["qno"]) for _ in pick], list(pick), cols)

    def search(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(wanted):
            return pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in _FOUND.split(", ")})
        read = lambda c, kind: np.frombuffer(b"".join(wanted[c]), kind)
        q, qno, own = read("vecs", PACKED).reshape(-1, dim), read("qno", np.int64), read("ids", np.int64)
        row, ids, score, _ = Tree(held, dim).best_first(q, own, read("least", np.float64), most, k)
        return pd.DataFrame({"qno": qno[row], "query_id": own[row], "vec_id": ids, "score": score})

    on = ["cell", "slot"]
    start = saved(asked.select("qno", "vec_id", "vec", F.lit(None).cast("double").alias("least")).mapInArrow(at_home, _PACKS), "packs")
    near = saved(meet(pages, start, on, search, _FOUND), "found")
    least = near.groupBy("qno").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
    rest = saved(asked.join(least, "qno", "left").select("qno", "vec_id", "vec", "least").mapInArrow(elsewhere, _PACKS), "packs")
    found = near.unionByName(meet(pages, rest, on, search, _FOUND))
    rank = F.row_number().over(W.partitionBy("qno", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
