"""Sources: typed tables from documents and files; and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def grid_cells(docs: DataFrame) -> DataFrame:
    """One row per cell. The width is that of the first row; a map with rows of other widths has status 'ragged' and null flags."""
    width = F.length(F.get("rows", F.lit(0)))
    ragged = F.exists("rows", lambda r: F.length(r) != width)
    lines = docs.select("map_id", ragged.alias("ragged"), F.posexplode("rows").alias("row", "line"))
    cells = lines.select("map_id", "ragged", "row", F.posexplode(F.split("line", "")).alias("col", "v")).filter("v != ''")
    walkable = F.when(~F.col("ragged"), F.col("v") == "1")
    return cells.select("map_id", "row", "col", walkable.alias("walkable"), F.when(F.col("ragged"), "ragged").otherwise("ok").alias("status"))


def read_road_grid(spark: SparkSession, path: str) -> DataFrame:
    return grid_cells(read_json(spark, path, schemas.ROAD_GRID_DOCS))


def main_road_layer(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """``cells`` with manual_main: 1 where the layer says so and the cell is walkable; null for maps without a layer of the grid's shape."""
    shape = cells.groupBy("map_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    good = docs.join(shape, "map_id").filter((F.size("rows") == F.col("height")) & ~F.exists("rows", lambda r: F.length(r) != F.col("width")))
    marks = good.select("map_id", F.posexplode("rows").alias("row", "line"))
    marks = marks.select("map_id", "row", F.posexplode(F.split("line", "")).alias("col", "v")).filter("v != ''")
    out = cells.join(marks, ["map_id", "row", "col"], "left")
    mark = F.when(F.col("v").isNotNull(), ((F.col("v") == "1") & F.col("walkable")).cast("int"))
    return out.select(*[c for c in cells.columns if c != "manual_main"], mark.alias("manual_main"))


def read_main_road_layer(spark: SparkSession, cells: DataFrame, path: str) -> DataFrame:
    return main_road_layer(cells, read_json(spark, path, schemas.MAIN_ROAD_DOCS))


def normalise_places(raw: DataFrame) -> DataFrame:
    """Coerced, with the defaults name -> id, type -> 'place', access -> null, polygons -> []."""
    number = lambda c: F.col(c).try_cast("double")
    point = lambda c: F.struct(number(f"{c}.x").alias("x"), number(f"{c}.y").alias("y"))
    filled = lambda c, d: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), d)
    pid = F.coalesce(F.col("id").cast("string"), F.lit("undefined"))
    return raw.select(
        "map_id", pid.alias("id"), filled("name", pid).alias("name"), filled("type", F.lit("place")).alias("type"), point("center").alias("center"),
        F.when(F.col("access").isNotNull(), point("access")).alias("access"), F.coalesce("polygons", F.array().cast("array<array<array<double>>>")).alias("polygons"),
    )


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return normalise_places(read_json(spark, path, schemas.RAW_PLACES))


def clean_control_points(df: DataFrame) -> DataFrame:
    """Coerced control points whose four numbers are finite."""
    cols = ["lng", "lat", "x", "y"]
    out = df.select("map_id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), *[F.col(c).cast("string").try_cast("double").alias(c) for c in cols])
    for c in cols:
        out = out.filter(text.finite(F.col(c)))
    return out


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Location and compass events from Parquet, as a batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.LOCATION_EVENTS).parquet(path)


def clean_headings(events: DataFrame, maps: DataFrame) -> DataFrame:
    """Compass readings with a finite direction, as unit vectors of the map."""
    rows = events.filter((F.col("kind") == "compass") & text.finite(F.col("direction"))).join(maps.select("map_id", "north_offset"), "map_id")
    x, y = text.heading_vector(F.col("direction"), F.col("north_offset"))
    return rows.select("map_id", "user_id", "event_id", "ts", "direction", x.alias("head_x"), y.alias("head_y"))


def typed_requests(requests: DataFrame) -> DataFrame:
    """The text fields of route requests as numbers."""
    cols = ["start_x", "start_y", "goal_x", "goal_y"]
    return requests.select("request_id", "map_id", "user_id", *[text.js_number(F.col(c)).alias(c) for c in cols], "place_text", "place_id")


def write_table(df: DataFrame, path: str, partition_by: str | None = "map_id", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
