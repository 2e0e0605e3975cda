"""Map preparation: clearance, components, main-road score, edges with costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import grid as G
from ..storage import saved


def clearance(cells: DataFrame) -> DataFrame:
    """``cells`` with clearance: 4-neighbour steps to the nearest blocked cell, by two passes of running windows.

    Down the columns the distance to the nearest blocked row, then along the
    rows the least of those plus the column distance. Blocked is 0; the edge doesn't block.
    """
    far = F.lit(1 << 20)
    column = W.partitionBy("map_id", "col").orderBy("row")
    blocked = F.when(~F.col("walkable"), F.col("row"))
    up = F.last(blocked, ignorenulls=True).over(column.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(blocked, ignorenulls=True).over(column.rowsBetween(0, W.unboundedFollowing))
    v = F.least(F.coalesce(F.col("row") - up, far), F.coalesce(down - F.col("row"), far))
    line = W.partitionBy("map_id", "row").orderBy("col")
    left = F.min(F.col("v") - F.col("col")).over(line.rowsBetween(W.unboundedPreceding, 0)) + F.col("col")
    right = F.min(F.col("v") + F.col("col")).over(line.rowsBetween(0, W.unboundedFollowing)) - F.col("col")
    out = cells.withColumn("v", v).withColumn("clearance", F.least(left, right, F.lit(P.NO_BLOCK)).cast("int"))
    return out.drop("v")


def label_components(cells: DataFrame) -> DataFrame:
    """``cells`` (map_id, row, col; walkable ones only) with comp: the least run number of their 8-neighbour component.

    Cells are contracted to horizontal runs; touching runs of adjacent rows are
    edges; labels fall to the least one that any of their runs meets and jump along labels until none changes.
    """
    line = W.partitionBy("map_id", "row").orderBy("col")
    runs_of = cells.withColumn("start", F.col("col") - F.row_number().over(line))
    runs_of = runs_of.withColumn("from", F.min("col").over(W.partitionBy("map_id", "row", "start")))
    runs_of = saved(runs_of.drop("start"), "cells")
    runs = runs_of.groupBy("map_id", "row", "from").agg(F.max("col").alias("to"))
    runs = saved(runs.withColumn("run", F.col("row").cast("long") * (1 << 20) + F.col("from")), "runs")
    lower = runs.select("map_id", (F.col("row") - 1).alias("row"), F.col("from").alias("f2"), F.col("to").alias("t2"), F.col("run").alias("v"))
    touch = runs.join(lower, ["map_id", "row"]).filter((F.col("f2") <= F.col("to") + 1) & (F.col("t2") >= F.col("from") - 1))
    touch = touch.select("map_id", F.col("run").alias("u"), "v")
    arcs = saved(touch.union(touch.select("map_id", "v", "u")), "arcs")
    labels = runs.select("map_id", "run", F.col("run").alias("comp"))
    while True:
        near = arcs.join(labels.select("map_id", F.col("run").alias("v"), "comp"), ["map_id", "v"]).groupBy("map_id", "u").agg(F.min("comp").alias("least"))
        met = labels.join(near.withColumnRenamed("u", "run"), ["map_id", "run"], "left")
        met = saved(met.select("map_id", "run", "comp", F.least("comp", F.coalesce("least", "comp")).alias("least")), "met")
        # the run that names a label falls to the least that any run of the label has met, so whole labels merge, not run after run
        hook = met.groupBy("map_id", F.col("comp").alias("run")).agg(F.min("least").alias("hook"))
        met = met.join(hook, ["map_id", "run"], "left").select("map_id", "run", "comp", F.least("least", F.coalesce("hook", "least")).alias("next"))
        jump = met.select("map_id", F.col("run").alias("next"), F.col("next").alias("further"))
        moved = met.join(jump, ["map_id", "next"]).select("map_id", "run", F.col("further"), (F.col("comp") != F.col("further")).alias("moved"))
        moved = saved(moved, "labels")
        labels = moved.select("map_id", "run", F.col("further").alias("comp"))
        if not moved.filter("moved").limit(1).count():
            break
    named = runs.select("map_id", "row", "from", "run").join(labels, ["map_id", "run"]).drop("run")
    return runs_of.join(named, ["map_id", "row", "from"]).drop("from")


def component_ranks(labels: DataFrame) -> DataFrame:
    """(map_id, comp, n, rank): components of each map by size, of equal ones that with the first cell first."""
    size = labels.groupBy("map_id", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "col")).alias("first"))
    rank = F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("n"), "first"))
    return size.withColumn("rank", rank).select("map_id", "comp", "n", "rank")


def reachable_mask(labels: DataFrame) -> DataFrame:
    """(map_id, comp): the largest component of each map; of equal ones that with the first cell."""
    return component_ranks(labels).filter("rank = 1").select("map_id", "comp", "n")


def main_road_score(cells: DataFrame, least: int = P.MAIN_MIN_CLEARANCE, reference: int = P.MAIN_COMPONENT_REFERENCE) -> DataFrame:
    """(map_id, row, col, main_score): by the size of the component of cells with enough clearance; 32-bit."""
    wide = label_components(cells.filter(F.col("walkable") & (F.col("clearance") >= least)).select("map_id", "row", "col"))
    size = wide.groupBy("map_id", "comp").agg(F.count(F.lit(1)).alias("n"))
    score = F.least(F.lit(1.0), F.log1p("n") / F.log1p(F.lit(float(reference)))).cast("float")
    return wide.join(size, ["map_id", "comp"]).select("map_id", "row", "col", score.alias("main_score"))


def cell_features(cells: DataFrame) -> DataFrame:
    """All features of every cell: clearance, component_id (null if blocked), reachable, main_score."""
    base = saved(clearance(cells), "clearance")
    labels = saved(label_components(base.filter("walkable").select("map_id", "row", "col")), "components")
    best = reachable_mask(labels).select("map_id", F.col("comp").alias("best"))
    score = main_road_score(base)
    out = base.join(labels.withColumnRenamed("comp", "component_id"), ["map_id", "row", "col"], "left")
    out = out.join(best, "map_id", "left").join(score, ["map_id", "row", "col"], "left")
    return out.select(
        "map_id", "row", "col", "walkable", "manual_main", "clearance", "component_id",
        F.coalesce(F.col("component_id") == F.col("best"), F.lit(False)).alias("reachable"),
        F.coalesce("main_score", F.lit(0).cast("float")).alias("main_score"),
    )


def grid_layer_stats(cells: DataFrame, top: int = 10) -> DataFrame:
    """Counts of walkable and main-road cells and the sizes of the largest components of main-road cells, per map."""
    counts = cells.groupBy("map_id").agg(F.count_if("walkable").alias("road_cells"), F.coalesce(F.sum("manual_main"), F.lit(0)).alias("main_cells"))
    labels = label_components(cells.filter("manual_main = 1").select("map_id", "row", "col"))
    size = labels.groupBy("map_id", "comp").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("n"), "comp"))
    largest = size.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("map_id").agg(F.sort_array(F.collect_list("n"), False).alias("sizes"))
    return counts.join(largest, "map_id", "left").select("map_id", "road_cells", "main_cells", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("largest"))


def expand_neighbors(features: DataFrame, max_gap: int = P.MAX_GAP_CELLS) -> DataFrame:
    """Directed edges between road cells (row, col) -> (row2, col2): 8 neighbours, and rays over up to ``max_gap`` blocked cells.

    Of the road cells on one ray only the nearest is joined. A diagonal step
    between two blocked cells is allowed.
    """
    road = features.filter("walkable").select("map_id", "row", "col")
    rays = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc])
    reach = road.select("map_id", "row", "col", F.explode(rays).alias("d"), F.lit(0).alias("z"))
    reach = reach.select("map_id", "row", "col", "d.dr", "d.dc", F.explode(F.sequence(F.lit(0), F.lit(max_gap))).alias("gap_cells"))
    reach = reach.withColumn("row2", F.col("row") + F.col("dr") * (F.col("gap_cells") + 1)).withColumn("col2", F.col("col") + F.col("dc") * (F.col("gap_cells") + 1))
    hit = reach.join(road.select("map_id", F.col("row").alias("row2"), F.col("col").alias("col2")), ["map_id", "row2", "col2"])
    if max_gap:
        first = F.row_number().over(W.partitionBy("map_id", "row", "col", "dr", "dc").orderBy("gap_cells"))
        hit = hit.withColumn("rank", first).filter("rank = 1")
    base = G.step_base_cost(F.col("dr"), F.col("dc")) * (F.col("gap_cells") + 1)
    return hit.select("map_id", "row", "col", "row2", "col2", base.alias("base_cost"), "gap_cells")


def attach_cell_features(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Edges with what the entered cell (and, of the left one, the main-road flag) adds to the cost."""
    entered = features.select("map_id", F.col("row").alias("row2"), F.col("col").alias("col2"), "clearance", F.col("main_score").cast("double"), "manual_main")
    left = features.select("map_id", "row", "col", F.col("manual_main").alias("manual_left"))
    return edges.join(entered, ["map_id", "row2", "col2"]).join(left, ["map_id", "row", "col"])


def build_edges(features: DataFrame, max_gap: int = P.MAX_GAP_CELLS, bias: float = P.ROAD_BIAS, gap_penalty: float = P.GAP_PENALTY) -> DataFrame:
    """Edges with base_cost, gap_cells and move_cost."""
    e = attach_cell_features(expand_neighbors(features, max_gap), features)
    factor = G.road_width_cost_factor(F.col("clearance"), F.col("main_score"), F.col("manual_main"), bias)
    penalty = G.main_road_departure_penalty(F.col("manual_left"), F.col("manual_main"), F.col("base_cost"), bias)
    cost = G.move_cost(F.col("base_cost"), factor, penalty, F.col("gap_cells"), gap_penalty)
    return e.select("map_id", "row", "col", "row2", "col2", "base_cost", "gap_cells", cost.alias("move_cost"))
