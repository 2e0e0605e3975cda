"""Top-k search, hard negatives, Merkle proofs and WARC records against brute force, on small tables full of odd rows."""

import hashlib
import io
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.llm import hard_negatives as hn
from wayfield.llm import merkle, top_k, warc

ROWS = "vec_id long, embedding array<float>, label int, rank string, score string, part string, qno string"
NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, n=260, dim=6):
    """Random vectors, a third copies of one, ties, and rows that take no part; extra columns with clashing names."""
    r = random.Random(3)
    rows = []
    for i in range(n):
        v = [0.5] * dim if i % 3 == 0 else [r.gauss(0, 0.3) for _ in range(dim)]
        rows.append((i, v, i % 4, "x", "y", "z", "q"))
    rows += [(1000, None, 1, "", "", "", ""), (1100, [0.1, None, 0.2], 1, "", "", "", ""), (1200, [0.1, NAN, 0.2], 1, "", "", "", ""), (1300, [INF] * dim, 1, "", "", "", "")]
    rows += [(None, [0.5] * dim, 1, "", "", "", ""), (1400, [0.9, 0.9], 2, "", "", "", ""), (1500, [], 3, "", "", "", ""), (1601, [0.4] * dim, None, "", "", "", "")]
    return rows, spark.createDataFrame(rows, ROWS)


def wholes(rows, scale, dim=6):
    good = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]] + [0] * (dim - len(r[1])), r[2]) for r in good]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("shard", [24, 8192])
def test_top_k(spark, shard):
    rows, df = odd_vectors(spark)
    got = sorted(map(tuple, top_k.top_k(df, df.filter("vec_id % 20 = 0"), k=7, shard=shard).collect()))
    good = wholes(rows, 64)
    want = []
    for q, v, _ in good:
        if q % 20 == 0:
            best = sorted((-dot(v, w), i) for i, w, _ in good if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and len({q for q, *_ in want}) == 15


def test_top_k_of_few_rows_and_of_none(spark):
    _, df = odd_vectors(spark)
    few = df.filter("vec_id IN (20, 21, 22)")
    assert sorted((x.query_id, x.rank) for x in top_k.top_k(few, few, k=20).collect()) == [(q, k) for q in (20, 21, 22) for k in (1, 2)]
    assert top_k.top_k(few, few.limit(0)).collect() == [] and top_k.top_k(few.limit(0), few).collect() == []
    twice = few.unionByName(few)
    got = [(x.vec_id, x.rank) for x in top_k.top_k(twice, few.filter("vec_id = 20"), k=20).orderBy("rank").collect()]
    assert [k for _, k in got] == [1, 2, 3, 4] and sorted(i for i, _ in got) == [21, 21, 22, 22]
    empty = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<double>")
    assert [(x.query_id, x.vec_id, x.score) for x in top_k.top_k(empty, empty).orderBy("query_id").collect()] == [(1, 2, 0), (2, 1, 0)]
    big = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert {x.score for x in top_k.top_k(big, big).collect()} == {(1 << 54) - 64 * (1 << 27)}


def test_m_tree_bounds_skip_work():
    r = np.random.default_rng(1)
    x = (r.normal(size=(20, 8))[r.integers(0, 20, 3000)] * 400 + r.normal(size=(3000, 8)) * 8).astype("<i4")  # tight groups
    norm2 = (x.astype(np.int64) ** 2).sum(1)
    lifted = top_k.lift(x, norm2, float(norm2.max()))
    pages = top_k.build(lifted, lifted[0], page=64, fan=8)
    rows = [p["rows"] for p in pages]
    assert sorted(np.concatenate(rows)) == list(range(3000)) and max(map(len, rows)) <= 64
    for p in pages:  # covering radii and parent distances hold
        below = [c for c in pages if c["parent"] == p["node"]]
        assert all(abs(np.linalg.norm(c["centre"] - p["centre"]) - c["parent_dist"]) < 1e-3 for c in below)
        assert not len(p["rows"]) or np.linalg.norm(lifted[p["rows"]] - p["centre"], axis=1).max() <= p["radius"] + 1e-3
    import pandas as pd

    table = pd.DataFrame(pages)
    ids = np.arange(3000)
    table["ids"], table["vecs"] = [ids[v].tobytes() for v in rows], [x[v].tobytes() for v in rows]
    table["dists"], table["centre"] = [v.tobytes() for v in table["dists"]], [v.tobytes() for v in table["centre"]]
    row, found, score, work = top_k.Tree(table, 8).best_first(x[:40], ids[:40], np.full(40, -np.inf), float(norm2.max()), 5)
    for q in range(40):
        best = sorted((-int(x[q].astype(np.int64) @ x[i].astype(np.int64)), i) for i in range(3000) if i != q)[:5]
        assert [(-s, i) for s, i in best] == list(zip(score[row == q], found[row == q]))
    assert work["entries"] < 40 * 3000 / 3 and work["skipped_entries"] + work["skipped_pages"] > 0


def test_hilbert_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hn.hilbert(grid, 3)
    walk = grid[np.lexsort(place.T[::-1])]
    assert np.abs(np.diff(walk, axis=0)).sum(1).max() == 1 and len(np.unique(place, axis=0)) == 512


def test_zone_bounds_hold():
    r = np.random.default_rng(2)
    x, q = r.integers(-50, 50, (30, 5)), r.integers(-9, 9, (20, 5))
    least, largest = hn.bounds(q, x.min(0)[None], x.max(0)[None])
    score = q @ x.T
    assert (score.min(1) >= least[:, 0]).all() and (score.max(1) <= largest[:, 0]).all()


@pytest.mark.parametrize("block", [9, 4096])
def test_hard_negatives(spark, block):
    rows, df = odd_vectors(spark, 400)
    got = sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 50 == 0, block=block).collect()))
    good = [r for r in wholes(rows, 256) if r[2] is not None]
    want = []
    for a, v, label in good:
        if a % 50:
            continue
        by = sorted((-dot(v, w), i, lab) for i, w, lab in good if i != a)
        for p, i, _ in [x for x in by if x[2] == label][:5]:
            fit = [(n, j) for n, j, lab in by if lab != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            want += [(a, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(fit)]
    assert got == sorted(want) and len(want) > 40


def test_hard_negatives_of_nothing(spark):
    _, df = odd_vectors(spark)
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert hn.hard_negatives(df, F.col("vec_id") < 0).collect() == []
    assert hn.hard_negatives(df.filter("label = 1"), F.col("vec_id") % 50 == 0).collect() == []


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, for each leaf the (siblings, place) of every level)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a - a % 3 : a - a % 3 + 3]
            paths[i].append((run[: a % 3] + run[a % 3 + 1 :], a % 3))
            at[i] = a // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, lang, n, t: h(*map(said, (d, s, lang, n, t)))
    groups = {}
    for d, s, lang, n, t in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        now = t.replace("\n", "") if hit and t is not None else t
        groups.setdefault(s, []).append(((d is not None, d or 0), leaf(d, s, lang, n, t), leaf(d, s, lang, n, now), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, one, now, d), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            path = path + top
            seen = now
            for others, k in path:
                seen = h(*others[:k], seen, *others[k:])
            out.append((d, one, trees[s][0], root, h(*[x for others, _ in path for x in others]), seen, seen == root))
    return out


def test_manifest(spark):
    r = random.Random(7)
    rows = [(i, "hot" if i % 3 else r.choice(["", "é", "z", "a", None, "one"]), "en", i, f"line {i}\nmore\n") for i in range(2300)]
    rows += [(5, "hot", None, None, None), (5, "hot", None, None, None), (None, "hot", "x", 3, "a\nb"), (9, None, None, None, ""), (10, "single", "en", 1, "x" * 200_000 + "\n"), (2, "hot", "de", 2, "same id")]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, known string, pos int").repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.manifest(df, tampered=F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(brute_manifest(rows), key=key) and 500 < sum(x.verified for x in got) < 2000


def test_manifest_of_few(spark):
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, "a")], kinds)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == h("1:1", "-", "-", "-", "1:a") and one.proof_sha256 == h() and one.verified
    assert merkle.manifest(spark.createDataFrame([], kinds)).collect() == []


def test_warc_rows_that_repeat_an_id_in_several_files(spark, tmp_path):
    for k in range(4):
        rows = [(i, "u", f"body {i}") for i in range(5)] + [(100 + k * 50 + i, "u", f"own {k} {i}") for i in range(50)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/pages")
    pages = spark.read.parquet(f"file://{tmp_path}/pages")
    for limit in ("-1", "10m"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = [(x.page_id, x.record_type) for x in warc.warc_round_trip(pages).collect()]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert [got.count((i, "response")) for i in range(5)] == [1] * 5 and [got.count((i, "revisit")) for i in range(5)] == [3] * 5
        assert len(got) == 220 and all(kind == "response" for i, kind in got if i >= 100)


def record(kind, block, *lines):
    head = ["WARC/1.0", f"warc-type: {kind}", "WARC-RECORD-ID: <urn:uuid:12345678-0000-4000-8000-1234567890ab>", "Warc-Date: 2024-01-01T00:00:00Z", f"content-length: {len(block)}", *lines]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_records_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 3\r\n\r\nabc"
    sha = hashlib.sha1(b"abc")
    kinds = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", http, "Content-Type: application/http;", " msgtype=response", f"WARC-Payload-Digest: sha1:{sha.hexdigest()}", "WARC-Target-URI: http://a/"),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", "Content-Type: application/http"),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{warc.base32_sha1(b'abc')}"),
        record("metadata", b"", "WARC-Payload-Digest: md5:whatever"),
    ]
    out = io.BytesIO()
    warc.write_archive(kinds, out)
    got = [warc.parse_record(raw) for _, raw in warc.read_frames(io.BytesIO(out.getvalue()), 11)]
    assert [x["record_type"] for x in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata"] and {x["page_id"] for x in got} == {None}
    assert got[2]["payload"] == b"abc" and got[2]["payload_digest"] == got[4]["payload_digest"] == warc.base32_sha1(b"abc") and got[2]["url"] == "http://a/"
    assert got[0]["record_id"] == "<urn:uuid:12345678-0000-4000-8000-1234567890ab>" and got[4]["payload"] is None
    for bad in (record("response", http.replace(b"3", b"4", 1), "Content-Type: application/http"), record("response", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32), record("revisit", b""), record("resource", b"x")[:-1], b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n"):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
