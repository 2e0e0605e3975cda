"""Snapping points to the nearest reachable road cell, by a ring-distance transform of the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import grid as G
from ..storage import saved


def ring_distance(features: DataFrame, maps: DataFrame, max_cells: int = P.MAX_SNAP_CELLS) -> DataFrame:
    """(map_id, row, col, ring): the Chebyshev distance of every cell of the maps to the nearest reachable road cell, null beyond ``max_cells``.

    Two passes of windows: down the columns the distance to the nearest such cell, then along the rows the
    least of the larger of that and the column distance, over the ``max_cells`` columns to both sides.
    """
    axis = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    grid = maps.select("map_id", "grid_width", F.explode(axis("grid_height")).alias("row")).select("map_id", "row", F.explode(axis("grid_width")).alias("col"))
    road = features.filter("walkable AND reachable").select("map_id", "row", "col", F.col("row").alias("hit"))
    cells = grid.join(road, ["map_id", "row", "col"], "left")
    column = W.partitionBy("map_id", "col").orderBy("row")
    up = F.last("hit", ignorenulls=True).over(column.rowsBetween(W.unboundedPreceding, 0))
    down = F.first("hit", ignorenulls=True).over(column.rowsBetween(0, W.unboundedFollowing))
    far = F.lit(max_cells + 1)
    cells = cells.withColumn("v", F.least(F.coalesce(F.col("row") - up, far), F.coalesce(down - F.col("row"), far)))
    near = F.collect_list(F.struct("col", "v")).over(W.partitionBy("map_id", "row").orderBy("col").rowsBetween(-max_cells, max_cells))
    ring = F.array_min(F.transform(near, lambda c: F.greatest(F.abs(c["col"] - F.col("col")), c["v"])))
    return cells.withColumn("ring", ring).select("map_id", "row", "col", F.when(F.col("ring") <= max_cells, F.col("ring")).alias("ring"))


def snap_rings(features: DataFrame, maps: DataFrame, max_cells: int = P.MAX_SNAP_CELLS) -> DataFrame:
    """(map_id, o_row, o_col, ring_cells): for every cell near a road, the reachable road cells of the least ring around it that has any.

    Made once a map. The 8 r cells of that ring alone are looked up, by an equi-join.
    """
    d = ring_distance(features, maps, max_cells).filter("ring IS NOT NULL").select("map_id", F.col("row").alias("o_row"), F.col("col").alias("o_col"), "ring")
    r = F.col("ring")
    side = lambda lo, hi, at: F.transform(F.sequence(lo, hi), at)
    step = lambda a, b: F.struct(a.cast("int").alias("dr"), b.cast("int").alias("dc"))
    around = F.concat(
        side(-r, r, lambda i: step(-r, i)), side(-r, r, lambda i: step(r, i)), side(1 - r, r - 1, lambda i: step(i, -r)), side(1 - r, r - 1, lambda i: step(i, r))
    )
    at = d.select("map_id", "o_row", "o_col", F.explode(F.when(r == 0, F.array(step(F.lit(0), F.lit(0)))).otherwise(around)).alias("d"))
    at = at.select("map_id", "o_row", "o_col", (F.col("o_row") + F.col("d.dr")).alias("row"), (F.col("o_col") + F.col("d.dc")).alias("col"))
    road = features.filter("walkable AND reachable").select("map_id", "row", "col")
    cell = F.struct(F.col("row").alias("r_row"), F.col("col").alias("r_col"))
    return at.join(road, ["map_id", "row", "col"]).groupBy("map_id", "o_row", "o_col").agg(F.collect_list(cell).alias("ring_cells"))


def _placed(points: DataFrame, rings: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """Each point, one row, with its cell and that cell's ring."""
    m = maps.select("map_id", "cell_size", "grid_width", "grid_height")
    row, col = G.pixel_to_cell(F.col("y"), F.col("cell_size"), F.col("grid_height")), G.pixel_to_cell(F.col("x"), F.col("cell_size"), F.col("grid_width"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    placed = points.join(m, "map_id").select(key, "map_id", "x", "y", "cell_size", F.when(ok, row).alias("o_row"), F.when(ok, col).alias("o_col"))
    return placed.join(rings, ["map_id", "o_row", "o_col"], "left")


def _measured(cells: str = "ring_cells") -> Column:
    """The ring's cells with their distances from the raw pixel."""

    def measure(c: Column) -> Column:
        sx, sy = G.cell_center(c["r_col"], F.col("cell_size")), G.cell_center(c["r_row"], F.col("cell_size"))
        return F.struct(F.hypot(sx - F.col("x"), sy - F.col("y")).alias("distance"), c["r_row"].alias("r_row"), c["r_col"].alias("r_col"), sx.alias("sx"), sy.alias("sy"))

    return F.transform(cells, measure)


def snap_ranks(points: DataFrame, features: DataFrame, maps: DataFrame, max_cells: int = P.MAX_SNAP_CELLS, key: str = "point_id", rings: DataFrame | None = None) -> DataFrame:
    """(key, map_id, snap_row, snap_col, distance, rank): the cells of a point's winning ring by distance, row and column; rank 1 is what it snaps to."""
    near = _placed(points, snap_rings(features, maps, max_cells) if rings is None else rings, maps, key)
    s = near.select(key, "map_id", F.posexplode(F.array_sort(_measured())).alias("at", "s"))
    return s.select(key, "map_id", F.col("s.r_row").alias("snap_row"), F.col("s.r_col").alias("snap_col"), "s.distance", (F.col("at") + 1).alias("rank"))


def snap_to_road(points: DataFrame, features: DataFrame, maps: DataFrame, max_cells: int = P.MAX_SNAP_CELLS, key: str = "point_id", rings: DataFrame | None = None) -> DataFrame:
    """``points`` (key, map_id, x, y) with snap_row, snap_col, snap_x, snap_y, distance and status ('ok', 'no_road', 'bad_point').

    From the point's (clamped) cell the least Chebyshev ring that holds a
    reachable road cell wins; in it the least distance from the raw pixel, ties
    by row and column. A point meets one row: that of its cell in ``rings`` (see snap_rings; made here if it isn't given).
    """
    near = _placed(points, saved(snap_rings(features, maps, max_cells), "rings") if rings is None else rings, maps, key)
    out = near.withColumn("s", F.array_min(_measured()))
    status = F.when(F.col("o_row").isNull(), "bad_point").when(F.col("s").isNull(), "no_road").otherwise("ok")
    return out.select(
        key, "map_id", "x", "y", F.col("s.r_row").alias("snap_row"), F.col("s.r_col").alias("snap_col"),
        F.col("s.sx").alias("snap_x"), F.col("s.sy").alias("snap_y"), F.col("s.distance").alias("distance"), status.alias("status"),
    )
