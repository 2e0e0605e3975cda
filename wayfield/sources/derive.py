"""Site tables derived from the star-schema tables by integer formulas, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GRID = 96
SIZE = 16
SPAN = GRID * SIZE
OPEN_GATES = 7


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maps(spark: SparkSession, sf_dir: str, size: int = GRID) -> DataFrame:
    return _t(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("map_id"), F.lit(SIZE).alias("cell_size"), F.lit(size).alias("grid_width"), F.lit(size).alias("grid_height"),
        F.lit(float(size * SIZE)).alias("map_width"), F.lit(float(size * SIZE)).alias("map_height"), F.lit(0.0).alias("north_offset"),
        F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"),
    )


def cells(spark: SparkSession, sf_dir: str, size: int = GRID) -> DataFrame:
    """map_id, row, col, walkable, manual_main (null for map 4, which has no main-road layer)."""
    h = (
        _t(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 5).cast("int").alias("map_id"), (F.col("l_orderkey") % size).cast("int").alias("row"), (F.col("l_partkey") % size).cast("int").alias("col"))
        .agg(((F.sum("l_linenumber") + F.count(F.lit(1))) % 10).alias("h"))
    )
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    grid = maps(spark, sf_dir, size).select("map_id", F.explode(axis).alias("row")).select("map_id", "row", F.explode(axis).alias("col"))
    r, c = F.col("row"), F.col("col")
    street = ((r % 12 < 4) | (c % 16 < 4)) & (F.coalesce("h", F.lit(9)) >= 1)
    patch = (r % 12).between(6, 8) & (c % 16).between(8, 11)
    main = F.col("walkable") & ((r % 12).isin(1, 2) | (c % 32).isin(1, 2))
    out = grid.join(h, ["map_id", "row", "col"], "left").select("map_id", "row", "col", (street | patch).alias("walkable"))
    return out.withColumn("manual_main", F.when(F.col("map_id") != 4, main.cast("int")))


def road_grid_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per map: a text of 0 and 1 per row."""
    lines = cells(spark, sf_dir).groupBy("map_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.col("walkable").cast("int").cast("string").alias("v")))).alias("v"))
    lines = lines.select("map_id", "row", F.array_join("v.v", "").alias("line"))
    docs = lines.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("v"))
    size = [F.lit(SIZE).alias("cell_size"), F.lit(SPAN).alias("image_width"), F.lit(SPAN).alias("image_height"), F.lit(GRID).alias("grid_width"), F.lit(GRID).alias("grid_height")]
    return docs.select("map_id", *size, F.col("v.line").alias("rows"))


def main_road_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As road_grid_docs for the main-road layer; that of map 4 lacks its last row, so it doesn't count."""
    c = cells(spark, sf_dir).withColumn("v", F.coalesce("manual_main", F.lit(1)).cast("string"))
    lines = c.groupBy("map_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("v")).select("map_id", "row", F.array_join("v.v", "").alias("line"))
    docs = lines.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("v")).select("map_id", F.col("v.line").alias("rows"))
    return docs.select("map_id", F.when(F.col("map_id") == 4, F.slice("rows", 1, GRID - 1)).otherwise(F.col("rows")).alias("rows"))


TYPES = ["landscape", "square", "bridge", "sports", "dining", "service", "building", "gate", "dormitory"]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = ((k * 37) % SPAN).cast("double"), ((k * 101) % SPAN).cast("double")
    return (
        _t(spark, sf_dir, "part")
        .select(
            (k % 5).cast("int").alias("map_id"),
            F.concat(F.lower(F.regexp_replace("p_name", " ", "_")), F.lit("_"), k.cast("string")).alias("id"),
            F.when(k % 2 == 0, F.concat("p_name", F.lit(" / "), "p_brand")).otherwise(F.col("p_name")).alias("name"),
            F.get(F.array(*map(F.lit, TYPES)), ((F.col("p_size") * 7 + k) % 9).cast("int")).alias("type"),
            F.struct(x.alias("x"), y.alias("y")).alias("center"),
            F.when(k % 10 == 0, F.struct((x + 24).alias("x"), y.alias("y"))).alias("access"),
            F.array().cast("array<array<array<double>>>").alias("polygons"),
            k.alias("part"),
        )
    )


def open_gates(spark: SparkSession, sf_dir: str, most: int = OPEN_GATES) -> DataFrame:
    """The first ``most`` gates of each map, in list order: a site opens a list of so many, however many it has."""
    g = places(spark, sf_dir).filter((F.col("type") == "gate") & (F.col("part") % 3 == 0))
    g = g.withColumn("gate_order", F.row_number().over(W.partitionBy("map_id").orderBy("part")))
    return g.filter(F.col("gate_order") <= most).select("map_id", "id", "gate_order")


def tour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which dormitories a tour passes and which buildings are key ones: map_id, id, list."""
    p = places(spark, sf_dir)
    dorms = p.filter((F.col("type") == "dormitory") & (F.col("part") % 4 == 0)).select("map_id", "id", F.lit("dorm").alias("list"))
    keys = p.filter((F.col("type") == "building") & (F.col("part") % 2 == 0)).select("map_id", "id", F.lit("key").alias("list"))
    return dorms.unionByName(keys)


def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they come from a file; map 4 has two points only."""
    k = F.col("n_nationkey").cast("long")
    lng, lat = F.lit(113.40) + (k * 37) % 100 / 10000, F.lit(23.04) + (k * 53) % 100 / 10000
    return (
        _t(spark, sf_dir, "nation")
        .filter((F.col("n_regionkey") != 4) | (k < 10))
        .select(
            F.col("n_regionkey").alias("map_id"), F.col("n_name").alias("id"), lng.alias("lng"), lat.alias("lat"),
            (170000 * (lng - 113.40) - 60 + ((k * 29) % 7 - 3)).alias("x"), (-170000 * (lat - 23.04) + 1640 + ((k * 31) % 7 - 3)).alias("y"),
        )
    )


def location_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _t(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(n % 211 == 0, "reset").when(n % 223 == 0, "stop").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "compass").otherwise("fix")
    return e.select(
        (F.col("user_id") % 5).cast("int").alias("map_id"), "user_id", "event_id", "ts", kind.alias("kind"),
        (F.lit(113.40) + (n * 7919) % 10000 / 1e6).alias("longitude"),
        F.when(n % 97 != 0, F.lit(23.04) + (n * 104729) % 10000 / 1e6).alias("latitude"),
        F.when(n % 13 == 0, 0.0).otherwise(F.col("value")).alias("horizontal_accuracy"), F.lit(50.0).alias("accuracy"),
        F.when(kind == "compass", ((n * 31) % 360).cast("double")).alias("direction"),
    )


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request an order, between 40 much used points of each map."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda k, m: ((k % 40) * m % SPAN).cast("string")
    text = F.when(o % 7 == 0, F.concat(F.lit(" "), (c % 1000).cast("string"), F.lit(" "))).when(o % 7 == 1, "").otherwise(F.concat(F.lit("_"), (c % 1000).cast("string")))
    return _t(spark, sf_dir, "orders").select(
        o.alias("request_id"), (c % 5).cast("int").alias("map_id"), c.alias("user_id"),
        F.when(o % 101 == 0, "").when(o % 103 == 0, "north").otherwise(at(o, 389)).alias("start_x"), at(o, 613).alias("start_y"),
        at(c, 389).alias("goal_x"), at(c, 613).alias("goal_y"), text.alias("place_text"), F.lit(None).cast("string").alias("place_id"),
    )


def spread_starts(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """One start a request, all over a grid of ``size`` cells: request_id, map_id, x, y."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda m: ((o * m) % (size * SIZE)).cast("double")
    return _t(spark, sf_dir, "orders").select(o.alias("request_id"), (c % 5).cast("int").alias("map_id"), at(389).alias("x"), at(613).alias("y"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts: the words of part names, the ends of ids, names in capitals and with an inner space, an empty and an unknown text."""
    p = _t(spark, sf_dir, "part")
    texts = F.array(F.concat(F.lit("_"), F.col("p_partkey").cast("string")), F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")), F.regexp_replace("p_name", "^(..)", "$1 "), F.lit(""), F.lit("no such place"))
    return p.select(F.explode(F.concat(F.split("p_name", " "), texts)).alias("keyword")).distinct()


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return _t(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("map_id"), ((n * 13) % 750).cast("double").alias("screen_x"), ((n * 17) % 1334).cast("double").alias("screen_y"),
        ((n % 5 + 1) / 4).alias("scale"), ((n % 7) * 20 - 60).cast("double").alias("offset_x"), ((n % 11) * 20 - 100).cast("double").alias("offset_y"),
    )
