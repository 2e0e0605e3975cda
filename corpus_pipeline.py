"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, extra ones included, whatever their names. Toxicity and contamination are decided where a
row lies. The two deduplication stages decide by id and text: of rows that repeat both one
stays, whichever, as no operator tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm import toxicity
from wayfield.llm.common import saved, table
from wayfield.llm.decontamination import clean_rows
from wayfield.llm.exact_dedup import digests, tree_merge
from wayfield.llm.near_dup import near_dup
from wayfield.llm.packing import pack_documents
from wayfield.llm.queries import tokenizer_file

TOXIC_FROM = 0.3
NO_ID = -(1 << 63)


def chosen(docs: DataFrame, mark: Column, keep: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, mark) in ``keep``: its texts are shuffled once, rows that repeat both are merged before."""
    own, ident = (free(docs, c) for c in ("text_mark_", "id_mark_"))
    rows = docs.withColumn(own, mark).withColumn(ident, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).dropDuplicates([ident, own])
    keep = keep.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(ident), F.col("mark").alias(own)).distinct()
    return rows.join(keep, [ident, own], "left_semi").select(*docs.columns)


def free(docs: DataFrame, name: str) -> str:
    """``name``, with more underscores where a column has it."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC_FROM go; map only.

    Null and empty texts are scored as a text without words, very long ones whole, repeated rows alike. An empty
    table stays empty; without labels of both kinds the score is a constant, under the limit unless all are toxic.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_column(docs, model, docs.schema, docs.columns.index("text"), [], keep_below=TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays.

    Null text equals empty text; a row with an id goes before one without; of rows that repeat
    id and text one stays. An empty table stays empty.
    """
    merged = tree_merge(saved(digests(docs), "digests"), "largest").filter("row = keep_row")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return chosen(docs, digest, merged.select("doc_id", F.col("digest").alias("mark")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row with the least doc_id stays.

    All texts without words are one class; a null id comes before all others; of rows that
    repeat id and text one stays. An empty table stays empty.
    """
    kept = near_dup(docs).filter("kept").select("doc_id", F.col("text_hash").alias("mark"))
    return chosen(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), kept)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go; map only.

    Texts without words hold none; repeated rows are judged alike. An empty table stays empty.
    """
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 2048 tokens; null text is the end id alone, an empty table gives no piece."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # the network, the banded join and the tokenizer have no SQL form; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
