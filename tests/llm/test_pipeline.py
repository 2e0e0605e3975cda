"""Each pipeline stage on its own input, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import DATA
from tests.llm.test_operators import check_packing, edge_docs, jaccard_classes, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dup", "decontamination", "packing"]


def test_toxic_documents_go(spark):
    r = random.Random(1)
    words = [f"plain{i}" for i in range(200)]
    rows = [(i, " ".join([*r.choices(words, k=30), *(["vile", "rotten"] if i % 4 == 0 else [])]), i % 4 == 0) for i in range(400)]
    folder = P.saved(spark.range(1)).inputFiles()[0].rpartition("/")[0] + "-sf"
    docs = spark.createDataFrame([(i, t, "en", "s", None, 7) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    spark.createDataFrame([(i, 0, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = P.drop_toxic(spark, docs, folder)
    assert left.schema == docs.schema
    kept, clean = set(ids(left)), {i for i, _, y in rows if not y}
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept - clean) <= 5


def test_exact_copies(spark, docs):
    out = P.drop_exact_copies(spark, docs, DATA)
    best = {}
    for d, t in rows_of(docs):
        best[t] = max(d, best.get(t, d))
    assert sorted(ids(out)) == sorted(best.values()) and out.columns == docs.columns


def test_near_copies(spark, docs):
    out = P.drop_near_copies(spark, docs, DATA)
    assert sorted(ids(out)) == sorted({c for c, _ in jaccard_classes(rows_of(docs)).values()}) and out.columns == docs.columns


def test_repeated_rows_and_null_ids_stay_once(spark):
    texts = [f"text {i} of its own with some words {i * 7}" for i in range(5)]
    rows = [(d, t) for i, t in enumerate(texts) for d in (i, i, None, None, None)] + [(None, "only null ids here")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stage_row_", F.lit("taken")).repartition(3)
    for stage in (P.drop_exact_copies, P.drop_near_copies):
        out = stage(spark, df, DATA)
        assert out.columns == df.columns
        assert collections.Counter(r.text for r in out.collect()) == collections.Counter({t: 1 for _, t in rows}), stage


def test_contaminated(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    out = set(ids(P.drop_contaminated(spark, docs, DATA)))
    bad = {d for d, t in rows_of(docs) if any(x in t for x in items)}
    assert bad and not bad & out and len(out) >= docs.count() - len(bad) - 2
    one = next(t for t in (r.text for r in docs.collect()) if t and any(x in t for x in items))
    odd = spark.createDataFrame([(1, one, 2), (1, "a text of the same id", 3), (None, one, 4), (None, None, 5)], "doc_id long, text string, stage_row_ long")
    assert [r.stage_row_ for r in P.drop_contaminated(spark, odd, DATA).orderBy("stage_row_").collect()] == [3, 5]


def test_packed(spark, docs):
    check_packing(docs.limit(60), P.pack(spark, docs.limit(60), DATA).collect())


def test_odd_rows_pass_every_stage(spark):
    odd = edge_docs(spark)
    for name, stage in P.STAGES:
        out = stage(spark, odd, DATA)
        n = out.count()
        assert n >= 1, name
        if name != "packing":
            assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), DATA).count() == 0, name


def test_run_is_its_stages(spark):
    out = P.run(spark, DATA)
    per = collections.Counter(r.sequence_id for r in out.collect())
    assert per and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
