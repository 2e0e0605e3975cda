"""Schemas of the input tables; reading never infers one."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

ROAD_GRID_DOCS = T.StructType(
    [
        T.StructField("map_id", T.IntegerType()),
        T.StructField("cell_size", T.IntegerType()),
        T.StructField("image_width", T.IntegerType()),
        T.StructField("image_height", T.IntegerType()),
        T.StructField("grid_width", T.IntegerType()),
        T.StructField("grid_height", T.IntegerType()),
        T.StructField("rows", T.ArrayType(T.StringType())),
    ]
)
MAIN_ROAD_DOCS = T.StructType([T.StructField("map_id", T.IntegerType()), T.StructField("rows", T.ArrayType(T.StringType()))])
RAW_PLACES = T.StructType(
    [
        T.StructField("map_id", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("center", T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])),
        T.StructField("access", T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())])),
        T.StructField("polygons", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
    ]
)
RAW_CONTROL_POINTS = T.StructType([T.StructField("map_id", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("id", "lng", "lat", "x", "y")])
LOCATION_EVENTS = T.StructType(
    [
        T.StructField("map_id", T.IntegerType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("horizontal_accuracy", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("direction", T.DoubleType()),
    ]
)
ROUTE_REQUESTS = T.StructType(
    [T.StructField("request_id", T.LongType()), T.StructField("map_id", T.IntegerType()), T.StructField("user_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("start_x", "start_y", "goal_x", "goal_y", "place_text", "place_id")]
)
