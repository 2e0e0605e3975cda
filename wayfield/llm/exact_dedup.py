"""Exact dedup by a tree-merge of sorted digest runs (DataFrame operations only).

The rows of an input partition are a run. Level 0 brings each run to one entry per digest, sorted; each further
level exchanges 2**FAN_BITS runs and merges them into one sorted run (FAN_BITS binomial rounds at a
time): the aggregates of a level keep structs, so Spark sorts the exchanged runs by digest and reduces neighbours, and
writes what it merged in this order. Of each digest the identifier that stays and the count are
kept. The decision then goes back down the same tree, so no join has more
than 2**FAN_BITS children of one digest, or at the bottom the rows of one partition: a text
that makes up a third of all rows never meets in one task.

A digest is SHA-256 of the text together with its byte length and a second,
independent hash; entries merge only if all three agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved

FAN_BITS = 3
KEY = ["digest", "n_bytes", "second"]


def levels_above(n_runs: int, fan_bits: int = FAN_BITS) -> int:
    """Number of levels until one run is left."""
    return max(1, math.ceil(math.log2(max(2, n_runs)) / fan_bits))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, digest, n_bytes, second (the key), and a row number (``row_col`` if there is one) that breaks ties of repeated ids."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return id_text(docs, id_col, text_col, row.alias("row")).select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("second"), "row",
    )


def tree_merge(rows: DataFrame, keep: str = "smallest", fan_bits: int = FAN_BITS) -> DataFrame:
    """``rows`` (doc_id, KEY, row; saved already, ``row`` from monotonically_increasing_id) with keep_id, keep_row and group_size of each row's group.

    ``keep``: "smallest" or "largest" doc_id of a group stays; of rows that
    repeat this id, the first by row number. Null ids come after all others.
    """
    rows = rows.withColumn("run", F.shiftright("row", 33))  # the partition that numbered the row
    levels = levels_above((rows.agg(F.max("run")).first()[0] or 0) + 1, fan_bits)
    sign = F.lit(1 if keep == "smallest" else -1).cast("long")
    best = F.struct(F.col("doc_id").isNull().alias("none"), (sign * F.col("doc_id")).alias("rank"), "row", "doc_id")
    level = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    up = [saved(level, "run0")]
    for k in range(1, levels + 1):
        merged = up[-1].withColumn("run", F.shiftright("run", fan_bits)).groupBy("run", *KEY)
        level = merged.agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        if k == levels:
            level = level.filter("size > 1")  # groups of one need no way down
        up.append(saved(level, f"run{k}"))
    down = up[-1]
    for k in range(levels - 1, -1, -1):
        child = up[k].select(*KEY, "run").withColumn("parent", F.shiftright("run", fan_bits))
        down = child.join(down.withColumnRenamed("run", "parent"), [*KEY, "parent"]).drop("parent")
    out = rows.join(down, [*KEY, "run"], "left")
    alone = F.col("size").isNull()
    return out.select(
        "doc_id", "row", *KEY,
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.when(alone, F.col("row")).otherwise(F.col("best.row")).alias("keep_row"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
    )


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; null counts as empty. Of a
    group the row with the largest (or smallest) id is kept; of repeated rows
    with that id, exactly one. A very long text is a digest like any other; only the
    two named columns are read. An empty table gives no rows.
    """
    rows = saved(digests(docs, id_col, text_col), "digests")
    return tree_merge(rows, keep).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256")
    )
