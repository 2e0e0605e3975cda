"""The nearest open gate of every start, by the cost fields towards the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .routes import code


def gate_ranks(starts: DataFrame, gates: DataFrame, field: DataFrame) -> DataFrame:
    """(map_id, cell, gate, name, length, cost, rank) of each distinct start cell and every gate it reaches: by length, then list order."""
    g = gates.filter("status = 'ok'").select("map_id", F.col("id").alias("gate"), "name", "gate_order", code(F.col("snap_row"), F.col("snap_col")).alias("source"))
    cells = starts.select("map_id", code(F.col("snap_row"), F.col("snap_col")).alias("cell")).filter("cell IS NOT NULL").distinct()
    rank = F.row_number().over(W.partitionBy("map_id", "cell").orderBy("length", "gate_order"))
    return cells.join(field, ["map_id", "cell"]).join(g, ["map_id", "source"]).withColumn("rank", rank).select("map_id", "cell", "gate", "name", "source", "length", "cost", "rank")


def nearest_open_gate(starts: DataFrame, gates: DataFrame, field: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, map_id, gate, name, length_px, cost, status): per start the gate with the shortest cost-optimal path.

    ``starts``: key, map_id, snap_row, snap_col. ``gates``: map_id, id, name,
    gate_order, snap_row, snap_col, status; gates off the road net are
    skipped. ``field``: reversed, towards the gates' cells. Ties go to the first
    gate of the list. Distinct start cells are decided once.
    """
    g = gates.filter("status = 'ok'").select("map_id", "id", "name", "gate_order", code(F.col("snap_row"), F.col("snap_col")).alias("source"))
    at = starts.withColumn("cell", code(F.col("snap_row"), F.col("snap_col")))
    cells = at.filter("cell IS NOT NULL").select("map_id", "cell").distinct()
    best = (
        cells.join(field, ["map_id", "cell"]).join(g, ["map_id", "source"])
        .groupBy("map_id", "cell").agg(F.min(F.struct("length", "gate_order", "id", "name", "cost", "source")).alias("b"))
    )
    out = at.join(best, ["map_id", "cell"], "left")
    status = F.when(F.col("cell").isNull(), "no_road").when(F.col("b").isNull(), "no_gate").otherwise("ok")
    return out.select(key, "map_id", F.col("b.id").alias("gate"), F.col("b.name").alias("name"), F.col("b.length").alias("length_px"), F.col("b.cost").alias("cost"), status.alias("status"))
