"""A sink for streams in update mode: rows replace those of the same key, epoch by epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

COMPACT_EVERY = 32  # epochs after which the table is written as a whole again


def _folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The epochs of the whole tables, and the single epochs; a folder without a mark of success doesn't count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    number = lambda kind: sorted(int(n.partition("=")[2]) for n in done if n.startswith(f"{kind}="))
    return number("base"), number("epoch")


def write_epoch(batch: DataFrame, epoch: int, path: str, keys: list[str], compact_every: int = COMPACT_EVERY) -> None:
    """Adds one epoch. An epoch that is replayed replaces what it wrote before, so the table is the same however often it comes."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    if compact_every and (epoch + 1) % compact_every == 0:
        compact(batch.sparkSession, path, keys, epoch)


def compact(spark: SparkSession, path: str, keys: list[str], epoch: int) -> None:
    """Writes the table as it is after an epoch; readers use it in place of all epochs up to that one."""
    read_upserted(spark, path, keys, upto=epoch).write.mode("overwrite").parquet(f"{path}/base={epoch}")


def read_upserted(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The last row of every key, after the last epoch or after ``upto``."""
    bases, epochs = _folders(spark, path)
    base = max((b for b in bases if upto is None or b < upto), default=-1)
    parts = [f"base={base}"] * (base >= 0) + [f"epoch={e}" for e in epochs if e > base and (upto is None or e <= upto)]
    if not parts:
        raise FileNotFoundError(f"no epoch at {path}")
    out = None
    for no, name in enumerate(parts):
        rows = spark.read.parquet(f"{path}/{name}").withColumn("_epoch", F.lit(no).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    last = W.partitionBy(*keys).orderBy(F.desc("_epoch"))
    return out.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", "_epoch")


def upsert_stream(state: DataFrame, path: str, keys: list[str], checkpoint: str, compact_every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Starts a stream in update mode into the table at ``path``; with the same checkpoint it goes on where it stopped. ``trigger``: as of writeStream.trigger, by default all that is there."""
    write = lambda batch, epoch: write_epoch(batch, epoch, path, keys, compact_every)
    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
