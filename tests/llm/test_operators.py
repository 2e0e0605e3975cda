"""Corpus operators against brute force, round trips and held-out accuracy, on small hand-made tables and sf0.001."""

import base64
import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wayfield.llm import exact_dedup as exact_dedup_module
from wayfield.llm import chunks, lm_scoring, near_dup, packing, substring_dedup, toxicity, warc, words
from wayfield.llm.common import saved
from wayfield.llm.decontamination import align, contaminated
from wayfield.llm.exact_dedup import exact_dedup
from wayfield.llm.fm_index import FMIndex, earlier, suffix_order
from wayfield.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, Vocabulary, scan
from wayfield.llm.packing import ByteIds, best_fit, pack_documents
from wayfield.llm.token_counts import PieceCounts, byte_batches, count_tokens, parts

SP, BPE = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, row long, key string"
SPACED = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim".split()


def edge_docs(spark):
    """Nulls, empty and blank texts, repeated rows and ids, ties, one long text, and extra columns with clashing names."""
    r = random.Random(2)
    long = " ".join(r.choice(LONG) + str(r.randint(0, 99)) for _ in range(20_000))
    same = " ".join(LONG * 3)
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, same), (6, same), (7, same + " tail"), (None, same), (None, None), (8, long), (9, long), (10, "Released under the MIT License."), (10, "other text of this id"), (5, same), (11, "é中🙂 ▁x  y"), (12, "a" * 3000)]
    rows = [(d, t, None, "src0", None, 1.0, "x", 5, "k") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return edge_docs(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def noise(n, seed=1):
    r = random.Random(seed)
    alphabet = list("ab thequ.,'s  \n\t 12é中▁ß　 ") + ["<|endoftext|>", "<s>", "</s>", "'ll", " the", "  ", "🙂", "\x00", "\r\n", "\x1c", "\x85"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_words_match_regex():
    texts = noise(3000)
    for classes, lower, pattern in ((words.SPACED, False, SPACED), (words.ALNUM, True, re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"))):
        from wayfield.llm.common import buffers

        w = words.split(*buffers(pa.array(texts)), classes, lower)
        for i, t in enumerate(texts):
            assert [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])] == pattern.findall(t.translate(LOWER) if lower else t)
        assert all(words.hash_word(w.word(j).decode()) == int(w.hash[j]) for j in range(0, len(w), 50))


def test_token_counts(spark, docs, edge, none):
    c = PieceCounts(SP)
    texts = noise(3000)
    assert c.safe and c.counts(texts) == [len(c.sp.encode(t)) for t in texts]
    assert "".join(parts(" a b" * 1000, 100)) == " a b" * 1000 and len(list(parts(" a b" * 1000, 100))) > 30
    for df in (docs, edge):
        want = collections.Counter((d, len(t.encode()), len(c.sp.encode(t)), len(c.sp.encode(t)) > 4096) for d, t in rows_of(df))
        assert collections.Counter(map(tuple, count_tokens(df, SP).collect())) == want
    assert count_tokens(none, SP).count() == 0


def test_byte_ids_match_the_library(docs):
    b = ByteIds(BPE)
    for t in noise(3000, 3) + noise(50, 4) + [t for _, t in rows_of(docs)]:
        assert b.ids(t) == b.encode(t)
    found = list({w for t in noise(3000, 5) for w in t.split(" ")} | {"a\n", "\u3000", "\n b", "", " c"})
    b = ByteIds(BPE)
    b.learn(found)  # in one call, joined where that is safe
    assert all(b[w] == b.encode(" " + w) for w in found)


class Spy:
    """The library, and the texts that it was given."""

    def __init__(self, tok):
        self.tok, self.seen = tok, []

    def encode(self, text, **k):
        self.seen.append(text)
        return self.tok.encode(text, **k)

    def encode_batch_fast(self, texts, **k):
        self.seen += texts
        return self.tok.encode_batch_fast(texts, **k)


def test_signs_after_a_word_are_taken_apart(docs, monkeypatch):
    """A word goes to the library once, whatever signs follow it and in whichever text; what a clearing forgets is not asked again."""
    b = ByteIds(BPE)
    b.tok = spy = Spy(b.tok)
    texts = ["go zebrafish, zebrafish. zebrafish's", "go zebrafish!? \u00e9l\u00e9phant; zebrafish'", "go \u00e9l\u00e9phant \u00e9l\u00e9phant,,", ""]
    assert list(b.ids_of(texts)) == [np.array(spy.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen = " ".join(spy.seen)
    assert seen.count("zebrafish") == 2 and seen.count("\u00e9l\u00e9phant") == 1  # zebrafish's is a word of its own
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    spy.seen.clear()
    list(b.ids_of(texts))
    assert not spy.seen
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 40)
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 300)
    odd = ["go  zebrafish(", " zebrafish)", "a" * 100 + ", b", "a" * 100 + ", " + "a" * 100, "<|endoftext|>, x<|endoftext|>", "\u00d7, \u00aa, \u01c5! 1st, 'll, x'll, _a, a_ a-b-"]
    texts = noise(3000, 6) + odd + [t for _, t in rows_of(docs)]
    for enc in (b, ByteIds(BPE)):
        assert list(enc.ids_of(texts)) == [enc.encode(t) for t in texts]
        assert all(len(w) <= 64 for w in enc)


def test_calls_are_balanced_by_bytes():
    texts = ["\u00e9" * 60, "a" * 100, "b", "\u4e2d" * 50, "c" * 500]
    assert list(byte_batches(texts, 200)) == [[texts[0]], texts[1:3], [texts[3]], [texts[4]]]


def check_packing(df, pieces, window=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for d, t in rows_of(df):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), window):
            p = ids[at : at + window]
            want[d, at, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= window
    return len(by)


def test_packing(spark, docs, edge, none):
    n = check_packing(docs, pack_documents(docs, BPE).collect())
    total = pack_documents(docs, BPE).agg(F.sum("length")).first()[0]
    assert n <= math.ceil(total / 2048) + 2
    check_packing(edge, pack_documents(edge, BPE).collect())
    assert pack_documents(none, BPE).count() == 0


def test_best_fit_takes_the_tightest():
    r = np.random.default_rng(3)
    lengths = np.sort(r.integers(1, 65, 400))[::-1]
    seq, off = best_fit(lengths, 64)
    left: dict[int, int] = {}
    for length, s, o in zip(lengths.tolist(), seq.tolist(), off.tolist(), strict=True):
        fits = [v for v in left.values() if v >= length]
        if fits:
            assert left[s] == min(fits)
        else:
            assert s not in left
        assert o == 64 - left.get(s, 64)
        left[s] = left.get(s, 64) - length


def test_exact_dedup(spark, docs, edge, none):
    for df in (docs, edge, docs.repartition(90)):
        groups = collections.defaultdict(list)
        for d, t in rows_of(df):
            groups[hashlib.sha256(t.encode()).hexdigest()].append(d)
        got = exact_dedup(df).collect()
        assert len(got) == df.count()
        kept = collections.Counter(r.text_sha256 for r in got if r.kept)
        assert all(kept[h] == 1 for h in groups)
        for r in got:
            ids = [d for d in groups[r.text_sha256] if d is not None]
            assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == max(ids, default=None)
    least = exact_dedup(docs, keep="smallest").filter("group_size > 1 AND kept").collect()
    assert least and all(r.doc_id == r.keep_id for r in least)
    assert exact_dedup(none).count() == 0


def test_runs_of_digests_are_sorted_and_merge_level_by_level(spark, monkeypatch):
    levels: list = []
    monkeypatch.setattr(exact_dedup_module, "saved", lambda df, label="t": levels.append((label, saved(df, label), df)) or levels[-1][1])
    n = 600
    df = spark.range(n * 3).select((F.col("id") % 700).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"))
    got = exact_dedup(df.repartition(n)).collect()
    assert len(got) == n * 3 and sum(r.kept for r in got) == 50 and all(r.group_size == n * 3 // 50 for r in got)
    runs = [x for x in levels if x[0].startswith("run")]
    assert [x[0] for x in runs] == ["run0", "run1", "run2", "run3", "run4"]
    key = F.concat_ws(" ", F.lpad(F.col("run").cast("string"), 9, "0"), "digest")
    for k, (_, table, plan) in enumerate(runs):
        assert table.agg(F.max("run")).first()[0] == (n - 1) >> (3 * k)
        assert table.groupBy("run", "digest").count().filter("count > 1").count() == 0
        by_file: dict[str, list[str]] = {}
        for r in table.select(F.input_file_name().alias("f"), key.alias("k"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect():
            by_file.setdefault(r.f, []).append(r.k)
        assert all(x == sorted(x) for x in by_file.values())
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" in text and "Python" not in text and "Arrow" not in text


def test_suffix_order_and_backward_search():
    r = np.random.default_rng(1)
    text = r.integers(1, 4, 300)
    text[[50, 120, 200, 299]] = 0
    order = suffix_order(np.where(text == 0, np.cumsum(text == 0) - 1, text + 4))
    key = lambda i: [(0, int((text[:j] == 0).sum())) if text[j] == 0 else (1, int(text[j])) for j in range(i, 300)]
    assert order.tolist() == sorted(range(300), key=key)
    index = FMIndex(text)
    ends = np.array([e for e in range(5, 300) if (text[e - 5 : e] > 0).all()])
    matched, low, high = index.search(text, ends, 5)
    assert (matched == 5).all()
    for e, lo, hi, again in zip(ends, low, high, earlier(low), strict=True):
        places = [i for i in range(296) if (text[i : i + 5] == text[e - 5 : e]).all()]
        assert hi - lo == len(places) and again == (e - 5 > places[0])


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = SPACED.findall(t)
        gone = [0] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [1] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot,chunk", [(4096, 4 << 20), (2, 5000)])
def test_substring_dedup(spark, docs, none, monkeypatch, hot, chunk):
    monkeypatch.setattr(chunks, "CHUNK_TEXT", chunk)
    r = random.Random(6)
    line = " ".join(f"common{i}" for i in range(30))
    own = [(1000 + i, " ".join([*(f"w{r.randint(0, 9999)}" for _ in range(40)), line, *(f"v{r.randint(0, 9999)}" for _ in range(40)), "x " * 50])) for i in range(12)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*own, (2000, None), (2001, "")], "doc_id long, text string"))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.drop_repeats(df, hot_passages=hot, shard_passages=300).collect()}
    assert got == brute_repeats(rows_of(df))


def test_substring_dedup_edges(spark, edge, none):
    got = substring_dedup.drop_repeats(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[6].n_removed == by[6].n_words > 0 and by[7].n_removed == by[7].n_words - 1 and by[9].n_removed == by[9].n_words and by[8].n_removed == 0
    assert substring_dedup.drop_repeats(none).count() == 0


def jaccard_classes(rows):
    """Class and number of links of each document, from all pairs."""
    sets, parent, links = {}, {}, collections.Counter()
    for d, t in rows:
        w = t.split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
                links.update((a, b))
    return {d: (root(d), links[d]) for d in ids}


def family(n, edits, first=5000, seed=9):
    """One original and its copies with up to ``edits`` edits in 120 words."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"b{k}" for k in range(120)]
        for _ in range(0 if i == 0 else r.randint(1, edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_near_dup(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*family(40, 5), (6000, None), (6001, " "), (6002, "two words"), (6003, "two  words")], "doc_id long, text string"))
    got = {x.doc_id: x for x in near_dup.near_dup(df).collect()}
    want = jaccard_classes(rows_of(df))
    assert {d: (x.class_id, x.n_links) for d, x in got.items()} == want
    assert {d for d, x in got.items() if x.kept} == {c for c, _ in want.values()}


def test_near_dup_work_grows_with_the_family(spark, monkeypatch):
    made, known = collections.defaultdict(list), near_dup.saved

    def counted(df, label="t"):
        out = known(df, label)
        made[label].append(out.count())
        return out

    monkeypatch.setattr(near_dup, "saved", counted)
    rows = {}
    for n in (400, 800):
        made.clear()
        near_dup.near_dup(spark.createDataFrame(family(n, 3), "doc_id long, text string")).count()
        rows[n] = {k: max(v) for k, v in made.items()}
    assert all(rows[800][k] <= 2.3 * max(rows[400].get(k, 0), 30) for k in rows[800])


def test_near_dup_edges(spark, edge, none):
    got = near_dup.near_dup(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[5].class_id == by[6].class_id == by[7].class_id and by[8].class_id == by[9].class_id != by[5].class_id
    assert by[1].class_id == by[2].class_id == by[3].class_id
    assert near_dup.near_dup(none).count() == 0
    assert near_dup.banding(0.8, 0.9999, 6) == (31, 6)


def test_similar_and_forest_against_brute_force():
    r = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([r.integers(0, 30, 25), [100 + k // 3, 200 + k // 5]])) for k in range(60)]
    want = [[i != j and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.6 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    near = near_dup.similar(sets, 0.6, columns=7, rows=11)
    assert near.tolist() == want and near.any()
    label = r.integers(0, 9, 60)
    joined = near_dup.forest(near, label)
    whole = [(label[i], label[j]) for i, j in zip(*np.nonzero(near), strict=True)]
    assert union(9, whole) == union(9, [(label[i], label[j]) for i, j in zip(*joined, strict=True)])
    assert len(joined[0]) == 9 - len(set(union(9, whole)))


def union(n, pairs):
    at = list(range(n))
    for a, b in pairs:
        x, y = at[a], at[b]
        at = [min(x, y) if k in (x, y) else k for k in at]
    return at


def lm_model(train, order=3):
    """(counts of words, probability of a word after some words), by the formulas."""
    c = collections.Counter(x for w in train for x in [*w, None])
    z = sum(c.values()) + 0.5 * (len(c) + 1)
    seen = collections.Counter(tuple(s[i : i + n]) for w in train for s in [[None, *w, None]] for n in range(2, order + 1) for i in range(len(s) - n + 1))
    after = collections.Counter()
    for g, n in seen.items():
        after[g[:-1]] += n

    def p(h, w):
        if not h:
            return (c[w] + 0.5) / z
        return (seen[(*h, w)] + lm_scoring.MU * p(h[1:], w)) / (after[h] + lm_scoring.MU)

    return c, p


def lm_brute(rows, order=3):
    toks = [(d, SPACED.findall(t.translate(LOWER))) for d, t in rows]
    c, p = lm_model([w for d, w in toks if d is None or zlib.crc32(str(d).encode()) % 5 != 1], order)
    out = []
    for d, w in toks:
        s = [None, *w, None]
        base = sum(math.log10(p((), x)) for x in s[1:])
        score = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        out.append((d, len(s) - 1, sum(c[x] > 0 for x in s[1:]), sum(c.values()), round(base, 5), round(score, 5)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "keys"), [(8 << 20, 1 << 20), (5000, 100)])
def test_lm_scores(spark, docs, edge, none, monkeypatch, chunk, keys):
    monkeypatch.setattr(chunks, "CHUNK_TEXT", chunk)
    monkeypatch.setattr(chunks, "BUCKET_KEYS", keys)
    for df in (docs, edge):
        got = lm_scoring.lm_scores(df).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got), key=str) == lm_brute(rows_of(df))
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_without_training_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    r = lm_scoring.lm_scores(spark.createDataFrame([(held, " two words ")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_lm_learns_the_whole_corpus(spark):
    """A held-out copy of one training text stands out, however much other text there is."""
    rand, held = random.Random(3), [d for d in range(4000) if zlib.crc32(str(d).encode()) % 5 == 1]
    texts = {d: " ".join(rand.choice(LONG) + str(rand.randint(0, 30)) for _ in range(60)) for d in range(4000)}
    texts[held[7]] = texts[next(d for d in range(4000) if d not in set(held))]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).filter("held_out").collect()}
    assert max(got, key=got.get) == held[7] and got[held[7]] > sorted(got.values())[-2] + 0.5


def test_lm_notices_other_rows(spark):
    def other(pdfs):
        for pdf in pdfs:
            yield pdf.assign(text=[str(random.random()) for _ in range(len(pdf))])

    changing = spark.range(50).selectExpr("id AS doc_id", "'' AS text").mapInPandas(other, "doc_id long, text string")
    with pytest.raises(Exception, match="other rows"):
        lm_scoring.lm_scores(changing).count()


def test_lm_state_sums_to_one():
    c, p = lm_model([t.split() for t in ("a b a c a b d a b a", "b b a")])
    for state in ((), ("a",), ("a", "b"), (None,), ("never", "seen")):
        assert abs(sum(p(state, w) for w in [*c, "unknown"]) - 1) < 1e-12


def test_automaton_walked_by_hand(monkeypatch):
    """States, arcs and failure arcs of two texts, followed one by one; stretches of any length give the same."""
    texts = ["a b a c a b d", "b b a", "x", "", "a b x a b d a c"]
    learnt = np.array([True, True, False, False, False])
    chunk = lm_scoring.Chunk(pa.array(texts), 3)
    word_n, gram_n = chunk.counts(learnt)
    got = chunk.scores(word_n, gram_n, int(word_n.sum()), int((word_n > 0).sum()))[3]
    model = lm_scoring.Automaton(chunk, np.concatenate([[0], word_n, gram_n]).astype(float), int(word_n.sum()) + 0.5 * ((word_n > 0).sum() + 1))
    arcs = {(k >> 32, k & 0xFFFFFFFF): (n, w) for k, n, w in zip(model.arc.tolist(), model.next.tolist(), model.weight.tolist(), strict=True) if k >= 0}
    starts = chunk.nodes(1)
    trained = [[None, *t.split(), None] for t in texts[:2]]
    assert len(arcs) == sum(len({tuple(s[i : i + n]) for s in trained for i in range(len(s) - n + 1)}) for n in (2, 3))
    fell = 0
    for d, t in enumerate(texts):
        state, total = int(starts[chunk.first[d]]), 0.0
        for w in starts[chunk.first[d] + 1 : chunk.first[d + 1]].tolist():
            while state and (state, w) not in arcs:
                total += model.back[state]
                state, fell = int(model.fail[state]), fell + 1
            if state:
                state, value = arcs[state, w]
            else:
                state, value = int(model.root_next[w]), model.root[w]
            total += value
        assert abs(total - got[d]) < 1e-9, t
    assert fell > 5
    _, p = lm_model([t.split() for t in texts[:2]])
    s = [None, *texts[4].split(), None]
    assert abs(got[4] - sum(math.log10(p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))) < 1e-9
    for lane in (2, 3, 5):
        monkeypatch.setattr(lm_scoring, "LANE", lane)
        assert np.allclose(chunk.scores(word_n, gram_n, int(word_n.sum()), int((word_n > 0).sum()))[3], got)


def test_word_hashes_of_patterned_words():
    """Thue-Morse words and their complements, which meet in any polynomial modulo 2**64, and words that differ in one byte, order of blocks or length."""
    several = []
    for n in (1024, 2048, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        several += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    several += ["a" * n for n in range(1, 70)] + ["12345678abcdefgh", "abcdefgh12345678", "x" * 8 + "\0", "x" * 8 + "\0\0"]
    found = {words.hash_word(w) for w in several}
    assert len(found) == len(several)
    w = words.split(np.frombuffer(" ".join(several).encode(), np.uint8), np.array([0, len(" ".join(several).encode())]))
    assert w.hash.tolist() == [words.hash_word(x) for x in several]


def test_license_words_are_compared_by_bytes():
    v = Vocabulary(PHRASES, TEMPLATES)
    text = "the mit licence license licensee gnu"
    w = words.split(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), words.ALNUM)
    at, which = v.find(w)
    assert [v.names[k] for k in which] == [x for x in text.split() if x in v.number] and "license" in v.number
    w.hash[:] = words.hash_word("license")  # as if all words shared a hash
    at, which = v.find(w)
    assert [w.word(i) for i in at] == [b"license"]


def test_warc_archive_round_trip():
    pages = [(i, f"http://x/{i}", ("<p>" + "text " * i).encode()) for i in range(40)]
    records = [warc.build_record(i, u, p, warc.base32_sha1(p), None, False) for i, u, p in pages]
    records.append(warc.build_record(99, None, pages[3][2], warc.base32_sha1(pages[3][2]), 3, True))
    out = io.BytesIO()
    warc.write_archive(records, out)
    assert out.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little")
    for chunk in (7, 1 << 20):
        frames = list(warc.read_frames(io.BytesIO(out.getvalue()), chunk))
        assert [raw for _, raw in frames] == records
    rows = [warc.parse_record(raw) for _, raw in frames]
    assert [r["payload"] for r in rows[:-1]] == [p for _, _, p in pages]
    assert rows[-1]["record_type"] == "revisit" and rows[-1]["refers_to"] == 3 and rows[-1]["payload_bytes"] == len(pages[3][2])
    with pytest.raises(warc.BadRecord):
        warc.parse_record(records[5].replace(b"text", b"tent", 1))
    with pytest.raises(warc.BadRecord):
        warc.parse_record(records[5][:-1])
    with pytest.raises(warc.BadRecord):
        list(warc.read_frames(io.BytesIO(out.getvalue()[:-3])))


def test_warc_table(spark):
    rows = [(3, "u", "same"), (1, "u", "same"), (1, "u", "same"), (2, None, None), (4, "u", ""), (None, "u", "same"), (5, "a\nb", "é" * 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = collections.Counter([
        (3, 4, sha("same"), "revisit", 1), (1, 4, sha("same"), "response", None), (1, 4, sha("same"), "revisit", 1), (None, 4, sha("same"), "revisit", 1),
        (2, 0, sha(""), "response", None), (4, 0, sha(""), "revisit", 2), (5, 20, sha("é" * 10), "response", None),
    ])
    assert got == want
    assert {r.record_type for r in warc.warc_round_trip(df, revisit_from=100).collect()} == {"response"}
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    long = "<p>long page</p>" * 300_000
    r = warc.warc_round_trip(spark.createDataFrame([(7, "u", long), (8, "u", long)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in r] == [(len(long), sha(long), "response", None), (len(long), sha(long), "revisit", 7)]


def brute_scan(t):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    t = t.translate(LOWER)
    w, hits, labels, best = pattern.findall(t), [], set(), 0.0
    for p, label in PHRASES.items():
        q = p.split()
        hits += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    for label, template in TEMPLATES:
        k = set(template.split())
        span = math.ceil(len(template.split()) / THRESHOLD - 1e-9)
        for i in range(len(w)):
            common = len(k & set(w[i : i + span]))
            if common >= math.ceil(THRESHOLD * len(k) - 1e-9):
                labels.add(label)
                best = max(best, common / len(k))
    base = {x for _, x in hits}
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if hits else best


def test_license_scan(spark, docs, edge, none):
    extra = spark.createDataFrame([(9000, "x\nLicensed under CC BY-NC 4.0.\nThe MIT license; mit License"), (9001, " ".join(TEMPLATES[2][1].split()[:-1])), (9002, "mit\nlicense"), (9003, "license mit"), (9004, "x " * 7 + TEMPLATES[4][1].replace(" ", "\n") + " y" * 9), (9005, " ".join(f"released w{i} v{i} under the u{i} t{i} bsd license" for i in range(400)))], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(extra), edge):
        got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in scan(df).collect())
        assert got == collections.Counter((d, *brute_scan(t)) for d, t in rows_of(df))
    got = {r.doc_id: r for r in scan(extra).collect()}
    assert [(b.template, b.first, b.last) for b in got[9004].blocks if b.template == 4] == [(4, 7, 9)] and got[9005].labels == ""
    assert scan(none).count() == 0


def brute_alignment(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    r = np.random.default_rng(5)
    items, texts = r.integers(1, 5, (30, 9)).astype(np.uint64), r.integers(1, 5, (30, 17)).astype(np.uint64)
    lengths = r.integers(1, 10, 30)
    score, end = align(items, lengths, texts)
    for k in range(30):
        item = items[k, : lengths[k]].tolist()
        assert score[k] == brute_alignment(item, texts[k].tolist()) == brute_alignment(item, texts[k, : end[k]].tolist())


def test_decontamination(spark, docs, edge, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    r = random.Random(3)
    planted = []
    for i, t in items:
        w = t.split()
        for j in range(len(w)):
            if r.random() < 0.15:
                w[j] = "edited"
        planted.append((7000 + i, "some words before it " * 6 + " ".join(w) + " and after it" * 6))
    clean = [(8000 + k, " ".join(f"q{r.randint(0, 50)}" for _ in range(300))) for k in range(10)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(planted + clean, "doc_id long, text string"))
    got = {(x.doc_id, x.item_id): x for x in contaminated(df, bench).collect()}
    exact = {(d, i) for d, t in rows_of(docs) for i, x in items if x in t}
    assert exact and exact <= set(got) and all(got[k].score == 1 for k in exact)
    assert sum((7000 + i, i) in got for i, _ in items) >= 0.95 * len(items)
    assert not any(d >= 8000 for d, _ in got)
    blocks = {(x.doc_id, x.item_id) for x in contaminated(df, bench, items_per_block=7).collect()}
    assert blocks == set(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d")], "item_id long, text string")
    assert contaminated(edge, odd).count() == 0 and contaminated(none, bench).count() == 0 and contaminated(docs, odd.limit(0)).count() == 0


def test_decontamination_finds_every_alignment(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(25)]
    items = [(i if i else None, " ".join(r.choice(common) if r.random() < 0.4 else f"i{r.randint(0, 400)}" for _ in range(n))) for i, n in enumerate([17, 40, 17, 40, 17, 40])]
    items += [(50, "solo pair"), (51, "three word item")]
    docs = [(900, "only solo here"), (901, "a solo pair here"), (902, "pair solo")]
    for rate in (0.15, 0.25, 0.3, 0.35):
        for i, (_, t) in enumerate(items[:6]):
            for k in range(6):
                w = [x for v in t.split() for x in (([v], [f"e{r.randint(0, 99)}"], [v, r.choice(common)], [])[r.randint(1, 3) if r.random() < rate else 0])]
                docs.append((len(docs), " ".join([*r.choices(common, k=30), *w, *r.choices(common, k=30)])))
    got = {(x.doc_id, x.item_id): x.score for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in items:
        a = t.split()
        for d, u in docs:
            score = brute_alignment(a, u.split()) / (2 * len(a))
            if score >= (0.4 if len(a) >= 3 else 1):
                want[d, i] = score
    assert got == pytest.approx(want) and (901, 50) in got and sum(i is None for _, i in got) > 10


def test_network_gradients():
    m = toxicity.Model(3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    text = pa.array(["the idiot went home again", "a b c", "plain words of this text here"])
    w = toxicity.text_words(text)
    number, hashes, one = toxicity.distinct_words(w)
    _, begin, size = toxicity.windows(w.first)

    def logits():
        x, rows = m.inputs(w, hashes, one)
        out, back = m.run(m.gates(x), number, begin, size, keep=True)
        return out, x, rows, back

    weight = np.array([0.3, -0.7, 0.5])
    out, x, rows, back = logits()
    g = m.gradients(x, rows, back, weight, hashes)
    for name, at in (("U0", (1, 5)), ("W1", (2, 7)), ("b0", (20,)), ("A", (3, 1)), ("a", (2,)), ("o", (9,)), ("c", (0,)), ("U1", (0, 20))):
        kept = m.p[name][at]
        up = []
        for d in (1e-2, -1e-2):
            m.p[name][at] = kept + d
            up.append(float(logits()[0] @ weight))
        m.p[name][at] = kept
        assert (up[0] - up[1]) / 2e-2 == pytest.approx(float(np.asarray(g[name])[at]), rel=2e-2, abs=2e-5)


def test_toxicity_held_out(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")  # the fit and the measure need labelled rows only
    got = toxicity.toxicity(docs, labels)  # production parameters
    rows = got.join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    hit = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) >= 0.8 and np.mean(false) <= 0.05, (np.mean(hit), np.mean(false))
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert toxicity.toxicity(edge, labels.limit(0)).count() == edge.count()


def test_network_is_trained_in_a_task(spark, monkeypatch):
    """The driver gets the parameters alone, and they are those of a training on the same rows in order of id."""
    r, driver, train = random.Random(8), os.getpid(), toxicity.train
    rows = [(i, " ".join(r.choices(LONG, k=12) + ["vile"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(90)]
    learnt = [x for x in sorted(rows) if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    want = train([t for _, t, _ in learnt], np.array([y for _, _, y in learnt], np.float32))

    def in_a_task(*sample):
        assert os.getpid() != driver
        return train(*sample)

    monkeypatch.setattr(toxicity, "train", in_a_task)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.fit(docs, labels)
    assert list(got.p) == list(want.p) and all(np.array_equal(got.p[k], v) for k, v in want.p.items())


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        doc, begin, size = toxicity.windows(np.array([0, n]))
        covered = {i for b, s in zip(begin, size, strict=True) for i in range(b, b + s)}
        assert covered == set(range(n)) and (doc == 0).all() and len(doc) >= 1


@pytest.fixture(scope="module")
def very_long(spark):
    """A text of over 3 MB, its copy with one word more, and a short one; they hold a passage that repeats, a notice and a benchmark item at their very end."""
    r = random.Random(12)
    passage = " ".join(f"passage{i}" for i in range(30))
    item = "the quick zebra explains nine green theorems to every patient lobster"
    long = " ".join(f"{r.choice(LONG)}{r.randint(0, 9999)}" for _ in range(320_000)) + f" {passage} released under the mit license {item}"
    return spark.createDataFrame([(1, long), (2, long + " tail"), (3, f"short one {passage}")], "doc_id long, text string"), long, item


def test_very_long_texts(spark, very_long):
    df, long, item = very_long
    assert len(long) > 3_000_000
    w = long.split()
    one = lambda d: {r.doc_id: r for r in d.collect()}
    assert one(count_tokens(df, SP))[1].n_tokens == len(PieceCounts(SP).sp.encode(long))
    got = one(substring_dedup.drop_repeats(df))
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed, got[3].n_removed) == (len(w), 0, len(w), 30)
    got = one(lm_scoring.lm_scores(df))
    assert got[1].n_tokens == len(w) + 1 and got[1].score < 0
    got = one(scan(df))
    assert got[1].n_words == len(w) and got[1].base_labels == "mit" and got[1].first_word == len(w) - 13
    got = one(near_dup.near_dup(df))
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_links == got[2].n_links == 1 and got[3].class_id == 3
    got = [r for r in contaminated(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()]
    assert {(r.doc_id, r.first_word, r.score) for r in got} == {(1, len(w) - 11, 1.0), (2, len(w) - 11, 1.0)}
    assert one(exact_dedup(df))[1].text_sha256 == hashlib.sha256(long.encode()).hexdigest()
    check_packing(df, pack_documents(df, BPE).collect())


def test_toxicity_forward_pass_against_plain_loops():
    """Scores by loops over windows, words, n-grams and steps; the toxic word may stand glued at the end of a long run."""
    m = toxicity.Model(5)
    texts = ["", "a", "some plain words here", "x" * 40 + "idiot", " ".join(f"w{i % 9}" for i in range(75)), "幹" * 30]
    got = toxicity.score_texts(m, pa.array(texts))
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        h = words.hashed(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
        marked, rows = [1, *word, 2], []
        for n in toxicity.CHAR_GRAMS:
            for i in range(len(marked) - n + 1):
                v = 0
                for c in marked[i : i + n]:
                    v = (v * 0x100000001B3 + c) % (1 << 64)
                mixed = words.mix(np.array([(v + n * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]
                rows.append(int(mixed % np.uint64(toxicity.CHAR_ROWS)))
        return m.p["word"][int(h % np.uint64(toxicity.WORD_ROWS))] + (m.p["char"][rows].mean(axis=0) if rows else 0)

    def logit(ws):
        xs, hs, n = [vector(x) for x in ws], [], toxicity.HIDDEN
        for d in (0, 1):
            h, out = np.zeros(n), []
            for x in xs if d == 0 else xs[::-1]:
                g = x @ m.p[f"W{d}"] + m.p[f"b{d}"]
                zr = sig(g[: 2 * n] + h @ m.p[f"U{d}"][:, : 2 * n])
                h = h + (1 - zr[:n]) * (np.tanh(g[2 * n :] + (zr[n:] * h) @ m.p[f"U{d}"][:, 2 * n :]) - h)
                out.append(h)
            hs.append(out if d == 0 else out[::-1])
        H = np.array([np.concatenate(x) for x in zip(*hs, strict=True)])
        e = np.exp(np.tanh(H @ m.p["A"]) @ m.p["a"])
        return (e / e.sum()) @ H @ m.p["o"] + m.p["c"][0]

    for t, score in zip(texts, got, strict=True):
        ws = []
        for x in re.findall(rb"[a-z0-9\x80-\xff]+", t.translate(LOWER).encode()):
            at = 0
            while len(x) - at > toxicity.LONGEST_WORD:
                ws.append(x[at : at + toxicity.LONGEST_WORD])
                at += toxicity.WORD_STEP
            ws.append(x[max(0, len(x) - toxicity.LONGEST_WORD) :] if at else x)
        last = max(0, len(ws) - toxicity.WINDOW)
        starts = sorted({min(k, last) for k in range(0, last + toxicity.STRIDE, toxicity.STRIDE)})
        want = max((logit(ws[s : s + toxicity.WINDOW]) for s in starts), default=m.p["c"][0]) if ws else m.p["c"][0]
        assert score == pytest.approx(sig(want), abs=1e-4)
