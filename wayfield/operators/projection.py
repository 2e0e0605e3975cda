"""Affine projections fitted from control points, and location fixes projected with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import grid as G
from ..functions import text

FEW, SINGULAR = "too few control points", "control points are collinear or too close"


def fit_projectors(points: DataFrame, least: int = P.MIN_CONTROL_POINTS, pivot: float = P.PIVOT_LIMIT) -> DataFrame:
    """One least-squares projector per map, in closed form on offsets from the mean.

    map_id, ready, reason, n_points, lng0, lat0, ax, bx, cx, ay, by, cy; the
    coefficients are null where ready is false.
    """
    mean = points.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_points"), *[F.avg(c).alias(f"{c}0") for c in ("lng", "lat", "x", "y")])
    off = points.join(mean, "map_id").select("map_id", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in ("lng", "lat", "x", "y")])
    sums = [("uu", "lng", "lng"), ("vv", "lat", "lat"), ("uv", "lng", "lat"), ("ux", "lng", "x"), ("vx", "lat", "x"), ("uy", "lng", "y"), ("vy", "lat", "y")]
    s = off.groupBy("map_id").agg(*[F.sum(F.col(a) * F.col(b)).alias(name) for name, a, b in sums])
    d = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    p1 = F.greatest(F.abs("uu"), F.abs("uv"))
    enough = F.col("n_points") >= least
    sound = (p1 >= pivot) & (F.abs(d) / p1 >= pivot)
    ready = enough & F.coalesce(sound, F.lit(False))
    coefficient = lambda n: F.when(ready, n / d)
    a = lambda t: coefficient(F.col(f"u{t}") * F.col("vv") - F.col(f"v{t}") * F.col("uv"))
    b = lambda t: coefficient(F.col(f"v{t}") * F.col("uu") - F.col(f"u{t}") * F.col("uv"))
    return mean.join(s, "map_id").select(
        "map_id", ready.alias("ready"), F.when(~enough, FEW).when(~ready, SINGULAR).alias("reason"), "n_points", "lng0", "lat0",
        a("x").alias("ax"), b("x").alias("bx"), F.when(ready, F.col("x0")).alias("cx"), a("y").alias("ay"), b("y").alias("by"), F.when(ready, F.col("y0")).alias("cy"),
    )


def project_fixes(fixes: DataFrame, projectors: DataFrame, maps: DataFrame) -> DataFrame:
    """Fixes with a finite place, projected, corrected and marked: x, y, accuracy, inside_map, status. Batch or stream.

    status: tracking, off_map, or uncalibrated where the map has no ready
    projector. The model side has one row a map; Spark broadcasts it while it is small.
    """
    model = maps.select("map_id", "map_width", "map_height", "dx", "dy").join(projectors, "map_id", "left")
    rows = fixes.filter(text.finite(F.col("longitude")) & text.finite(F.col("latitude"))).join(model, "map_id", "left")
    u, v = F.col("longitude") - F.col("lng0"), F.col("latitude") - F.col("lat0")
    x = text.pixel_correction(F.col("ax") * u + F.col("bx") * v + F.col("cx"), F.col("dx"))
    y = text.pixel_correction(F.col("ay") * u + F.col("by") * v + F.col("cy"), F.col("dy"))
    out = rows.withColumn("x", x).withColumn("y", y)
    inside = F.coalesce(G.inside_map(F.col("x"), F.col("y"), F.col("map_width"), F.col("map_height")), F.lit(False))
    status = F.when(~F.coalesce("ready", F.lit(False)), "uncalibrated").when(inside, "tracking").otherwise("off_map")
    return out.select(
        "map_id", "user_id", "event_id", "ts", "longitude", "latitude", "x", "y",
        text.fix_accuracy(F.col("horizontal_accuracy"), F.col("accuracy")).alias("accuracy"), inside.alias("inside_map"), status.alias("status"),
    )


def busiest_cells(fixes: DataFrame, maps: DataFrame, top: int = 20) -> DataFrame:
    """The cells of each map that hold most fixes inside it."""
    from pyspark.sql import Window as W

    m = maps.select("map_id", "cell_size", "grid_width", "grid_height")
    at = fixes.filter("inside_map").join(m, "map_id").select(
        "map_id", G.pixel_to_cell(F.col("y"), F.col("cell_size"), F.col("grid_height")).alias("row"), G.pixel_to_cell(F.col("x"), F.col("cell_size"), F.col("grid_width")).alias("col")
    )
    n = at.groupBy("map_id", "row", "col").agg(F.count(F.lit(1)).alias("n_fixes"))
    rank = F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("n_fixes"), "row", "col"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= top)
