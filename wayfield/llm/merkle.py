"""Merkle manifest of a table: digests, a content-addressed store of its nodes, and proofs found by descending from the root.

Each source's leaves, in the order of doc_id, and then the sources' roots, in the order of the sources, are folded
FAN by FAN. Levels are built LEVELS at a time: a segment is the subtree over FAN ** LEVELS consecutive
nodes, a group of bounded size however large its source is. The store holds a record for each segment: digest -> children
(the digests below it, which with the digits of a rank give every node between).

Proofs go the other way. The request for the root opens its record; its children become requests of
their own, each with the path so far: for every level, nearest first, the digits' unselected siblings. The path of a child
is that of its segment put before what led to the segment, so the collected path is reversed segment by segment. One
request stands for all leaves below it; only the last step has a row for each leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

FAN = 3
LEVELS = 6  # folded in one task: at most FAN ** LEVELS digests
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = 1 << 14  # rows that one task sorts, about
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_ROOT = ["known", "source"]  # of a tree: whether its source is known, and the source


def leaf_digest(values: list[Column]) -> Column:
    """H of the values: '-' for null, else byte count, ':' and value."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(said, values)), 256)


def folded(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level over ``digests``, which come first; every FAN of a level become one of the next."""
    out = [digests]
    for _ in range(levels):
        low = out[-1]
        out.append([sha256("".join(low[i : i + FAN]).encode()).hexdigest() for i in range(0, len(low), FAN)])
    return out


def siblings(levels: list[list[str]], rank: int) -> list[tuple[list[str], int]]:
    """Level by level upwards from the child of this rank: the unselected of its run, and how many stand left of it."""
    out = []
    for low in levels[:-1]:
        first = rank - rank % FAN
        out.append((low[first:rank] + low[rank + 1 : first + FAN], rank % FAN))
        rank //= FAN
    return out


def climb(digest: str, path: list[tuple[list[str], int]]) -> str:
    """The root that a leaf and its path give."""
    for others, left in path:
        digest = sha256("".join([*others[:left], digest, *others[left:]]).encode()).hexdigest()
    return digest


def _coded(path: list[tuple[list[str], int]]) -> str:
    return " ".join(f"{left}{''.join(others)}" for others, left in path)


def _decoded(path: str) -> list[tuple[list[str], int]]:
    return [([w[i : i + 64] for i in range(1, len(w), 64)], int(w[0])) for w in path.split(" ")] if path else []


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _split(digests: str) -> list[str]:
    return [digests[i : i + 64] for i in range(0, len(digests), 64)]


def depth(n: int) -> int:
    """Levels above n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with pos, the row's number in its group by ``order``, and n, the group's size. No task holds a whole group.

    The table is sorted by ranges and saved; a row's number is its place in its range plus the rows of the ranges before.
    """
    n = df.count()
    run = df.repartitionByRange(max(1, -(-n // _ROWS)), *group, *order).sortWithinPartitions(*group, *order)
    run = saved(run.withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("range", F.shiftright("at", 33))
    parts = run.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("many"), F.min("at").alias("first"))
    before = W.partitionBy(*group).orderBy("range")
    skipped = F.coalesce(F.sum("many").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "range", (skipped - F.col("first")).alias("shift"), F.sum("many").over(W.partitionBy(*group)).alias("n"))
    return run.join(parts, [*group, "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _segments(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(root of each tree: tree columns and digest; the records of the store, lowest first).

    ``nodes``: known, source, pos, digest, n (of the tree). A record: known, source, level, pos, digest, n, children.
    """
    span, records = FAN**LEVELS, []

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for children, n in zip(b["children"].to_pylist(), b["n"].to_pylist(), strict=True):
                done.append(folded(_split(children), min(LEVELS, depth(n)))[-1][0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], [*b.schema.names, "digest"])

    level, roots = 0, []
    while True:
        place = F.struct((F.col("pos") % span).alias("i"), "digest")
        packs = nodes.groupBy(*_ROOT, F.floor(F.col("pos") / span).alias("pos"), "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["digest"]), "").alias("children"))
        made = packs.select(*_ROOT, F.lit(level).alias("level"), "pos", "n", "children")
        made = saved(made.mapInArrow(fold, "known boolean, source string, level int, pos long, n long, children string, digest string"), name)
        records.append(made)
        roots.append(made.filter(F.col("n") <= span).select(*_ROOT, "digest"))
        more = made.filter(F.col("n") > span)
        if not more.limit(1).count():
            break
        nodes, level = more.select(*_ROOT, "pos", "digest", F.ceil(F.col("n") / span).alias("n")), level + 1
    root = roots[0]
    for r in roots[1:]:
        root = root.unionByName(r)
    return root, records


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each child of a record as a request: its siblings come before the path that led to the record."""
    kinds = pa.schema([("known", pa.bool_()), ("source", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("path", pa.string())])
    for r in _rows(batches):
        kids = _split(r["children"])
        levels = folded(kids, min(LEVELS, depth(r["n"])))
        paths = [" ".join(filter(None, (_coded(siblings(levels, k)), r["path"]))) for k in range(len(kids))]
        base = r["pos"] * FAN**LEVELS
        data = {"known": [r["known"]] * len(kids), "source": [r["source"]] * len(kids), "pos": list(range(base, base + len(kids))), "digest": kids, "path": paths}
        yield pa.RecordBatch.from_pydict(data, schema=kinds)


_REQUESTS = "known boolean, source string, pos long, digest string, path string"


def _descend(requests: DataFrame, records: list[DataFrame]) -> DataFrame:
    """The lowest records that requests for the roots of trees (known, source, digest, path) come to: known, source, pos, n, children, path.

    A request's record is looked up by its digest; its children are the requests to the level below.
    """
    below: DataFrame | None = None
    for level in range(len(records) - 1, -1, -1):
        tops = records[level].filter(F.col("n") <= FAN**LEVELS).select(*_ROOT, F.lit(0).cast("long").alias("pos"))
        asked = requests.join(tops, _ROOT).select(*_ROOT, "pos", "digest", "path")
        if below is not None:
            asked = asked.unionByName(below)
        store = records[level].groupBy("digest").agg(F.first("children").alias("children"), F.first("n").alias("n"))
        met = asked.join(store, "digest").select(*_ROOT, "pos", "n", "children", "path")
        if level:
            below = saved(met.mapInArrow(_open, _REQUESTS), "requests")
    return met


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    leaf: H of the row's ``fields``; subroot: of its source's tree, leaves by doc_id (null first); root: of the tree over
    the subroots by source (null first, then bytewise). proof_sha256: H of the siblings from the leaf to the root, H of nothing for a
    lone row of a lone source. folded_root: what the leaf of the row as it is found now (``tampered``: its text; default the text itself) gives
    with the original siblings; verified: whether this is the root.

    Rows that repeat a doc_id in a source are leaves of their own, in the order of their digests. Missing values are told from
    empty ones. Texts of any length are only hashed where they lie. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    cols = {c: F.col(c) for c in fields}
    found = cols | ({"text": tampered} if tampered is not None else {})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), leaf_digest(list(cols.values())).alias("leaf"), leaf_digest(list(found.values())).alias("now"))
    leaves = saved(ranked(saved(rows, "leaves"), _ROOT, ["doc_id", "leaf", "now"]), "leaves")
    subroots, records = _segments(leaves.select(*_ROOT, "pos", F.col("leaf").alias("digest"), "n"), "store")
    over = saved(ranked(saved(subroots.select(F.lit(0).alias("tree"), *_ROOT, "digest"), "subroots"), ["tree"], _ROOT), "subroots")
    all_ = [F.lit(True).alias("known"), F.lit("").alias("source")]  # one tree
    top, above = _segments(over.select(*all_, "pos", "digest", "n"), "store")
    first = top.first()
    if first is None:
        return docs.sparkSession.createDataFrame([], _PROOFS)
    root = first["digest"]  # one digest
    start = top.select(*_ROOT, "digest", F.lit("").alias("path"))
    to_sources = saved(_descend(start, above).mapInArrow(_open, _REQUESTS), "requests")
    asked = to_sources.select("pos", "digest", "path").join(over.select("pos", *_ROOT), "pos").select(*_ROOT, "digest", "path")
    segments = _descend(saved(asked, "requests"), records)
    span = FAN**LEVELS
    row = F.struct((F.col("pos") % span).alias("i"), "doc_id", "now")
    packs = leaves.groupBy(*_ROOT, F.floor(F.col("pos") / span).alias("pos")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    met = segments.join(packs, [*_ROOT, "pos"]).join(over.select(*_ROOT, F.col("digest").alias("subroot")), _ROOT)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
        for r in _rows(batches):
            kids = _split(r["children"])
            levels, path = folded(kids, min(LEVELS, depth(r["n"]))), _decoded(r["path"])
            out: dict[str, list] = {c: [] for c in kinds.names}
            for leaf in r["rows"]:
                own = siblings(levels, leaf["i"]) + path
                seen = climb(leaf["now"], own)
                proof = sha256("".join(x for others, _ in own for x in others).encode()).hexdigest()
                for c, v in zip(kinds.names, (leaf["doc_id"], kids[leaf["i"]], r["subroot"], root, proof, seen, seen == root), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return met.select("n", "children", "path", "rows", "subroot").mapInArrow(prove, _PROOFS)
