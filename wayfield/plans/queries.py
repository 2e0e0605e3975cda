"""Registered queries: one per operator of the map library, over the given tables or data derived from them."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from .. import schemas
from ..functions import grid as G
from ..functions import text as X
from ..operators import exits, grid, places, projection, routes, snap, tours
from ..sources import derive, readers
from ..storage import kept, saved, shared_folder
from ..streaming import location, sinks

SIZE = derive.SIZE
LARGE = 384  # cells a side of the larger maps, which take several tiles
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r4(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 4).alias(name) if name else F.round(c, 4)


def prepared(spark: SparkSession, sf_dir: str, size: int = derive.GRID, upto: str = "edges") -> dict[str, DataFrame]:
    """Map preparation up to a part: cells, features, the rings of cells, edges, and the net of the edges. Kept in the session's shared folder while their files are there."""
    base = f"{shared_folder(spark)}/prepared-{zlib.crc32(sf_dir.encode()):x}-{size}"
    build = {
        "cells": lambda: derive.cells(spark, sf_dir, size), "features": lambda: grid.cell_features(got["cells"]),
        "rings": lambda: snap.snap_rings(got["features"], derive.maps(spark, sf_dir, size)), "edges": lambda: grid.build_edges(got["features"]),
        "inner": lambda: routes.net_arcs(got["edges"], SIZE)[0], "outer": lambda: routes.net_arcs(got["edges"], SIZE)[1], "spans": lambda: routes.tile_spans(got["inner"], got["outer"]),
    }
    got: dict[str, DataFrame] = {}
    for name in list(build)[: list(build).index(upto) + 1]:
        got[name] = kept(spark, f"{base}-{name}", build[name])
    return got


def snapped(spark: SparkSession, sf_dir: str, points: DataFrame, size: int = derive.GRID) -> DataFrame:
    """snap_to_road over the prepared maps."""
    p = prepared(spark, sf_dir, size, "rings")
    return snap.snap_to_road(points, p["features"], derive.maps(spark, sf_dir, size), rings=p["rings"])


def net_of(spark: SparkSession, sf_dir: str, size: int = derive.GRID) -> routes.RoadNet:
    p = prepared(spark, sf_dir, size, "spans")
    return routes.RoadNet(p["inner"], p["outer"], p["spans"], routes.TILE)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derive.location_events(spark, sf_dir).filter("kind = 'fix'")
    return projection.project_fixes(events, projectors(spark, sf_dir), derive.maps(spark, sf_dir))


def projectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.fit_projectors(readers.clean_control_points(derive.control_points(spark, sf_dir)))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every user's fixes in time order, as paths: route_id, seq, row, col."""
    m = derive.maps(spark, sf_dir).select("map_id", "cell_size", "grid_width", "grid_height")
    f = fixes(spark, sf_dir).filter("inside_map").join(m, "map_id")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return f.select(
        F.col("user_id").alias("route_id"), seq.alias("seq"), G.pixel_to_cell(F.col("y"), F.col("cell_size"), F.col("grid_height")).alias("row"),
        G.pixel_to_cell(F.col("x"), F.col("cell_size"), F.col("grid_width")).alias("col"),
    )


def snapped_gates(spark: SparkSession, sf_dir: str, size: int = derive.GRID) -> DataFrame:
    g = places.gates_of(derive.open_gates(spark, sf_dir), derive.places(spark, sf_dir)).withColumn("point_id", F.concat_ws("|", "map_id", "id"))
    s = snapped(spark, sf_dir, g, size)
    return saved(g.select("point_id", "id", "name", "gate_order").join(s, "point_id").drop("point_id"), "gates")


def gate_field(spark: SparkSession, sf_dir: str, gates: DataFrame | None = None, size: int = derive.GRID) -> DataFrame:
    gates = snapped_gates(spark, sf_dir, size) if gates is None else gates
    ends = gates.filter("status = 'ok'").select("map_id", F.col("snap_row").alias("row"), F.col("snap_col").alias("col"))
    return routes.cost_fields(ends, None, SIZE, reverse=True, net=net_of(spark, sf_dir, size))


def exit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest open gate of each distinct start of a request: route_id, map_id, ends, gate, name, length, cost."""
    gates = snapped_gates(spark, sf_dir)
    field = gate_field(spark, sf_dir, gates)
    r = snapped_requests(spark, sf_dir).select("map_id", F.col("start_row").alias("snap_row"), F.col("start_col").alias("snap_col")).distinct()
    best = exits.gate_ranks(r, gates, field).filter("rank = 1")
    at = lambda c: (F.floor(F.col(c) / (1 << 20)), F.col(c) % (1 << 20))
    (sr, sc), (gr, gc) = at("cell"), at("source")
    return saved(best.withColumns({"route_id": F.concat_ws("|", "map_id", "cell"), "start_row": sr, "start_col": sc, "goal_row": gr, "goal_col": gc}), "exits")


def exit_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    best = exit_routes(spark, sf_dir)
    cells = routes.route_cells(best, routes.find_routes(best, net_of(spark, sf_dir))).join(best.select("route_id", "map_id"), "route_id")
    return best, routes.route_stats(cells, prepared(spark, sf_dir)["edges"], SIZE)


def snapped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request ends snapped to the road net: request_id, map_id, start_row.., goal_col. Distinct points are snapped once, requests meet them by place."""
    r = saved(readers.typed_requests(derive.route_requests(spark, sf_dir)).select("request_id", "map_id", "start_x", "start_y", "goal_x", "goal_y"), "requests")
    ends = [r.select("map_id", F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in ("start", "goal")]
    points = saved(ends[0].unionByName(ends[1]).distinct().withColumn("point_id", F.monotonically_increasing_id()), "points")
    s = saved(snapped(spark, sf_dir, points).select("map_id", "x", "y", "snap_row", "snap_col", "snap_x", "snap_y"), "ends")
    for n in ("start", "goal"):
        at = s.select(F.col("map_id").alias("of"), F.col("x").alias("px"), F.col("y").alias("py"), *[F.col(f"snap_{c}").alias(f"{n}_at_{c}") for c in ("row", "col", "x", "y")])
        r = r.join(at, (F.col("map_id") == F.col("of")) & F.col(f"{n}_x").eqNullSafe(F.col("px")) & F.col(f"{n}_y").eqNullSafe(F.col("py"))).drop("of", "px", "py")
    return r.select("request_id", "map_id", *[F.col(f"{n}_at_{c}").alias(f"{n}_{c}") for n in ("start", "goal") for c in ("row", "col", "x", "y")])


def routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, routes.Found]:
    """The snapped requests, their distinct pairs of ends, and the routes of these."""
    r = snapped_requests(spark, sf_dir)
    pairs = r.filter("start_row IS NOT NULL AND goal_row IS NOT NULL").select("map_id", "start_row", "start_col", "goal_row", "goal_col").distinct()
    pairs = saved(pairs, "pairs")
    return r, pairs, routes.find_routes(pairs, net_of(spark, sf_dir))


# ---- sources and sinks


@query
def src1_read_road_grid(spark, sf_dir):
    return readers.grid_cells(derive.road_grid_docs(spark, sf_dir)).select("map_id", "row", "col", "walkable", "status")


@query
def src2_main_road_layer(spark, sf_dir):
    cells = derive.cells(spark, sf_dir).drop("manual_main")
    return readers.main_road_layer(cells, derive.main_road_docs(spark, sf_dir))


@query
def src3_read_places(spark, sf_dir):
    p = readers.normalise_places(derive.places(spark, sf_dir))
    return p.select("map_id", "id", "name", "type", F.col("center.x").alias("center_x"), F.col("center.y").alias("center_y"), F.col("access.x").alias("access_x"), F.col("access.y").alias("access_y"), F.size("polygons").alias("n_polygons"))


@query
def src4_control_points(spark, sf_dir):
    return readers.clean_control_points(derive.control_points(spark, sf_dir)).select("map_id", "id", *[F.round(c, 6).alias(c) for c in ("lng", "lat", "x", "y")])


@query
def src5_location_fixes(spark, sf_dir):
    return derive.location_events(spark, sf_dir).filter("kind = 'fix'").select("map_id", "user_id", "event_id", "ts", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "horizontal_accuracy")


@query
def src6_compass(spark, sf_dir):
    return derive.location_events(spark, sf_dir).filter("kind = 'compass'").select("map_id", "user_id", "event_id", "ts", "direction")


@query
def src7_route_requests(spark, sf_dir):
    t = readers.typed_requests(derive.route_requests(spark, sf_dir))
    return t.select("request_id", "map_id", "user_id", F.isnan("start_x").alias("bad_start"), F.nanvl("start_x", F.lit(None)).alias("start_x"), "start_y", "goal_x", "goal_y", "place_text")


@query
def snk1_write_features(spark, sf_dir):
    """Writes cells partitioned by map and counts what is read back."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    readers.write_table(derive.cells(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("map_id").cast("int").alias("map_id")).agg(F.count(F.lit(1)).alias("cells"), F.count_if("walkable").alias("road_cells"))


# ---- filters


@query
def fil1_finite_fixes(spark, sf_dir):
    e = derive.location_events(spark, sf_dir).filter("kind = 'fix'")
    return e.filter(X.finite(F.col("longitude")) & X.finite(F.col("latitude"))).select("event_id", "user_id")


@query
def fil2_inside_map(spark, sf_dir):
    return fixes(spark, sf_dir).filter("inside_map").select("event_id", "map_id", r4("x", "x"), r4("y", "y"))


@query
def fil3_is_road(spark, sf_dir):
    t = derive.taps(spark, sf_dir).select("event_id", "map_id", F.floor(F.col("screen_y") / SIZE).cast("int").alias("row"), F.floor(F.col("screen_x") / SIZE).cast("int").alias("col"))
    inside = t.filter(G.in_bounds(F.col("row"), F.col("col"), F.lit(derive.GRID), F.lit(derive.GRID)))
    return inside.join(derive.cells(spark, sf_dir).filter("walkable").select("map_id", "row", "col"), ["map_id", "row", "col"], "left_semi").select("event_id", "map_id", "row", "col")


@query
def fil4_search_places(spark, sf_dir):
    return places.search_places(derive.keywords(spark, sf_dir), derive.places(spark, sf_dir))


@query
def fil5_open_gates(spark, sf_dir):
    return places.gates_of(derive.open_gates(spark, sf_dir), derive.places(spark, sf_dir)).select("map_id", "id", "name", "gate_order")


def _candidates(spark, sf_dir):
    weighted = tours.candidate_weights(derive.places(spark, sf_dir), derive.open_gates(spark, sf_dir), derive.tour_lists(spark, sf_dir))
    points = weighted.filter("weight > 0").select("map_id", "id", F.col("anchor.x").alias("x"), F.col("anchor.y").alias("y"), F.concat_ws("|", "map_id", "id").alias("point_id"))
    s = snapped(spark, sf_dir, points)
    s = points.select("point_id", "id").join(s, "point_id")
    return tours.tour_candidates(weighted, s, derive.maps(spark, sf_dir))


@query
def fil6_tour_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("map_id", "id", "type", "weight", "snap_row", "snap_col", "zone")


@query
def fil7_validate_requests(spark, sf_dir):
    t = readers.typed_requests(derive.route_requests(spark, sf_dir))
    n = F.col("request_id")
    t = t.withColumns({
        "pending_start": n % 37 == 0, "confirmed_text": F.when(n % 11 == 0, F.lit("old")).otherwise(X.trim(F.col("place_text"))),
        "confirmed_key": F.when(n % 17 == 0, "0.00,0.00").otherwise(X.point_key(F.col("goal_x"), F.col("goal_y"))),
    })
    return places.validate_requests(t).select("request_id", "status")


# ---- scalars


@query
def sc1_pixel_to_cell(spark, sf_dir):
    t = derive.taps(spark, sf_dir)
    f = lambda c: G.pixel_to_cell(F.col(c) * 3 - 200, F.lit(SIZE), F.lit(derive.GRID))
    return t.select("event_id", f("screen_y").alias("row"), f("screen_x").alias("col"))


@query
def sc2_cell_center(spark, sf_dir):
    return derive.cells(spark, sf_dir).select("map_id", "row", "col", G.cell_center(F.col("col"), F.lit(SIZE)).cast("double").alias("x"), G.cell_center(F.col("row"), F.lit(SIZE)).cast("double").alias("y"))


@query
def sc3_cell_id(spark, sf_dir):
    c = derive.cells(spark, sf_dir).withColumn("cell_id", G.cell_id(F.col("row"), F.col("col"), F.lit(derive.GRID)))
    return c.select("map_id", "cell_id", G.cell_row(F.col("cell_id"), F.lit(derive.GRID)).alias("row"), G.cell_col(F.col("cell_id"), F.lit(derive.GRID)).alias("col"))


@query
def sc4_project(spark, sf_dir):
    return fixes(spark, sf_dir).select("event_id", r4("x", "x"), r4("y", "y"))


@query
def sc5_pixel_correction(spark, sf_dir):
    f = fixes(spark, sf_dir).filter("x IS NOT NULL")
    d = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(2.5))
    return f.select("event_id", r4(X.pixel_correction(F.col("x"), d), "x"))


@query
def sc6_screen_to_map(spark, sf_dir):
    t = derive.taps(spark, sf_dir)
    f = lambda v, o: G.clamp(G.screen_to_map(F.col(v), F.col(o), F.col("scale")), 0.0, float(derive.SPAN))
    return t.select("event_id", r4(f("screen_x", "offset_x"), "x"), r4(f("screen_y", "offset_y"), "y"))


@query
def sc7_fix_accuracy(spark, sf_dir):
    e = derive.location_events(spark, sf_dir).filter("kind = 'fix'")
    return e.select("event_id", X.fix_accuracy(F.col("horizontal_accuracy"), F.col("accuracy")).alias("accuracy"))


@query
def sc8_heading_vector(spark, sf_dir):
    h = readers.clean_headings(derive.location_events(spark, sf_dir), derive.maps(spark, sf_dir))
    return h.select("event_id", (r4("head_x") + 0.0).alias("head_x"), (r4("head_y") + 0.0).alias("head_y"))


@query
def sc9_step_base_cost(spark, sf_dir):
    e = grid.expand_neighbors(derive.cells(spark, sf_dir))
    return e.groupBy("map_id", r4("base_cost", "base_cost")).agg(F.count(F.lit(1)).alias("steps"))


@query
def sc10_cost_factor(spark, sf_dir):
    c = prepared(spark, sf_dir)["features"].filter("walkable")
    return c.select("map_id", "row", "col", r4(G.road_width_cost_factor(F.col("clearance"), F.col("main_score").cast("double"), F.col("manual_main")), "factor"))


@query
def sc11_departure_penalty(spark, sf_dir):
    c = derive.cells(spark, sf_dir)
    e = grid.expand_neighbors(c).join(c.select("map_id", "row", "col", F.col("manual_main").alias("a")), ["map_id", "row", "col"])
    e = e.join(c.select("map_id", F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("manual_main").alias("b")), ["map_id", "row2", "col2"])
    p = G.main_road_departure_penalty(F.col("a"), F.col("b"), F.col("base_cost"))
    return e.groupBy("map_id", r4(p, "penalty")).agg(F.count(F.lit(1)).alias("steps"))


@query
def sc12_step_direction(spark, sf_dir):
    w = W.partitionBy("route_id").orderBy("seq")
    t = tracks(spark, sf_dir)
    return t.select("route_id", "seq", G.step_direction(F.col("row") - F.lag("row").over(w)).alias("d_row"), G.step_direction(F.col("col") - F.lag("col").over(w)).alias("d_col")).filter("d_row IS NOT NULL")


@query
def sc13_js_number(spark, sf_dir):
    r = derive.route_requests(spark, sf_dir)
    v = X.js_number(F.col("start_x"))
    return r.select("request_id", F.isnan(v).alias("bad"), F.when(~F.isnan(v), v).alias("value"))


@query
def sc14_point_key(spark, sf_dir):
    p = derive.places(spark, sf_dir)
    return p.select("id", X.point_key(F.col("center.x") * 0.005, -F.col("center.y") * 0.005).alias("key"))


@query
def sc15_split_name(spark, sf_dir):
    return derive.places(spark, sf_dir).select("id", X.primary_name(F.col("name")).alias("primary_name"), X.secondary_name(F.col("name")).alias("secondary_name"))


@query
def sc16_destination_texts(spark, sf_dir):
    i, n = F.col("id"), F.col("name")
    return derive.places(spark, sf_dir).select("id", X.destination_input(i, n).alias("typed"), X.option_title(i, n).alias("title"), X.option_subtitle(i, n).alias("subtitle"), X.picker_label(i, n).alias("label"))


@query
def sc17_edge_key(spark, sf_dir):
    w = W.partitionBy("route_id").orderBy("seq")
    t = tracks(spark, sf_dir).withColumns({"r0": F.lag("row").over(w), "c0": F.lag("col").over(w)}).filter("r0 IS NOT NULL")
    return t.select("route_id", "seq", G.edge_key(F.col("r0"), F.col("c0"), F.col("row"), F.col("col")).alias("edge"))


@query
def sc18_tour_zone(spark, sf_dir):
    size = F.lit(float(derive.SPAN))
    return derive.places(spark, sf_dir).select("id", G.tour_zone(F.col("center.x"), F.col("center.y"), size, size).alias("zone"))


@query
def sc19_candidate_weight(spark, sf_dir):
    return tours.candidate_weights(derive.places(spark, sf_dir), derive.open_gates(spark, sf_dir), derive.tour_lists(spark, sf_dir)).select("map_id", "id", "weight")


@query
def sc20_tour_score(spark, sf_dir):
    w = tours.candidate_weights(derive.places(spark, sf_dir), derive.open_gates(spark, sf_dir), derive.tour_lists(spark, sf_dir)).filter("weight > 0")
    d = F.hypot(F.col("anchor.x") - 700, F.col("anchor.y") - 700)
    return w.select("map_id", "id", r4(G.tour_score(F.col("weight"), d, F.col("anchor.x") > 700, F.col("type").isin(*P.BOOSTED_TYPES)), "score"))


@query
def sc21_place_anchor(spark, sf_dir):
    a = F.coalesce("access", "center")
    return derive.places(spark, sf_dir).select("id", a["x"].alias("x"), a["y"].alias("y"))


@query
def sc22_route_start(spark, sf_dir):
    live = location.location_state(derive.location_events(spark, sf_dir), projectors(spark, sf_dir), derive.maps(spark, sf_dir))
    r = readers.typed_requests(derive.route_requests(spark, sf_dir))
    sure = r.filter("user_id % 3 = 0").groupBy("map_id", "user_id").agg(F.max("goal_x").alias("x"), F.max("goal_y").alias("y"))
    return places.route_starts(r, live, sure).select("request_id", "map_id", r4("x", "x"), r4("y", "y"), "source")


@query
def sc23_straight_line(spark, sf_dir):
    w = W.partitionBy("route_id").orderBy("seq")
    t = tracks(spark, sf_dir).withColumns({"r0": F.lag("row").over(w), "c0": F.lag("col").over(w)}).filter("r0 IS NOT NULL")
    return t.select("route_id", "seq", r4(G.straight_line_cells(F.col("r0"), F.col("c0"), F.col("row"), F.col("col")), "cells"))


@query
def sc24_stop_names(spark, sf_dir):
    p = derive.places(spark, sf_dir).filter("type IN ('gate', 'square')")
    names = F.sort_array(F.collect_list(X.primary_name(F.col("name"))))
    return p.groupBy("map_id", "type").agg(X.stop_names(names).alias("stop_names"))


@query
def sc25_summaries(spark, sf_dir):
    """What is said of the route from each start to its nearest gate, and of this gate."""
    best, stats = exit_stats(spark, sf_dir)
    both = best.join(stats, "route_id")
    return both.select(
        "route_id", X.route_summary(F.col("n_cells"), F.col("length_px"), F.col("gap_cells")).alias("route_summary"),
        X.exit_summary(F.col("gate"), F.col("name"), F.col("length_px")).alias("exit_summary"),
    )


# ---- joins


@query
def j1_snap_to_road(spark, sf_dir):
    points = fixes(spark, sf_dir).filter("inside_map").select(F.col("event_id").alias("point_id"), "map_id", "x", "y")
    s = snapped(spark, sf_dir, points)
    return s.select("point_id", "map_id", "snap_row", "snap_col", r4("distance", "distance"), "status")


@query
def j2_expand_neighbors(spark, sf_dir):
    return grid.expand_neighbors(derive.cells(spark, sf_dir)).groupBy("map_id", "row", "col").agg(F.count(F.lit(1)).alias("degree"))


@query
def j3_gap_edges(spark, sf_dir):
    return grid.expand_neighbors(derive.cells(spark, sf_dir), max_gap=2).filter("gap_cells > 0").select("map_id", "row", "col", "row2", "col2", "gap_cells", r4("base_cost", "base_cost"))


@query
def j4_edge_costs(spark, sf_dir):
    e = prepared(spark, sf_dir)["edges"]
    return e.groupBy("map_id", "row", "col").agg(F.count(F.lit(1)).alias("edges"), r4(F.sum("move_cost"), "move_cost"))


@query
def j5_resolve_places(spark, sf_dir):
    return places.resolve_places(derive.route_requests(spark, sf_dir), derive.places(spark, sf_dir))


@query
def j6_starts_to_gates(spark, sf_dir):
    g = places.gates_of(derive.open_gates(spark, sf_dir), derive.places(spark, sf_dir)).select("map_id", F.col("id").alias("gate"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    s = fixes(spark, sf_dir).filter("inside_map").select("event_id", "map_id", "x", "y")
    return s.join(g, "map_id").select("event_id", "gate", r4(F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")), "distance"))


@query
def j7_place_lookup(spark, sf_dir):
    wanted = derive.open_gates(spark, sf_dir)
    return wanted.join(places.dedup_places(derive.places(spark, sf_dir)), ["map_id", "id"], "left").select("map_id", "id", "name", "type")


@query
def j8_fixes_projector(spark, sf_dir):
    return fixes(spark, sf_dir).groupBy("map_id", "status").agg(F.count(F.lit(1)).alias("fixes"))


@query
def j9_location_heading(spark, sf_dir):
    s = location.location_state(derive.location_events(spark, sf_dir), projectors(spark, sf_dir), derive.maps(spark, sf_dir))
    return s.filter("inside_map AND heading IS NOT NULL").select("user_id", r4("x", "x"), r4("y", "y"), "heading")


# ---- aggregates


@query
def agg1_fit_projector(spark, sf_dir):
    return projectors(spark, sf_dir).select("map_id", "ready", "n_points", *[F.round(c, 2).alias(c) for c in ("ax", "bx", "cx", "ay", "by", "cy")])


@query
def agg2_road_components(spark, sf_dir):
    return prepared(spark, sf_dir)["features"].filter("walkable").groupBy("map_id", "component_id").agg(F.count(F.lit(1)).alias("cells"))


@query
def agg3_reachable_mask(spark, sf_dir):
    return prepared(spark, sf_dir)["features"].filter("reachable").select("map_id", "row", "col")


@query
def agg4_main_road_score(spark, sf_dir):
    return prepared(spark, sf_dir)["features"].filter("main_score > 0").select("map_id", "row", "col", r4(F.col("main_score").cast("double"), "main_score"))


@query
def agg5_route_length(spark, sf_dir):
    return routes.route_lengths(tracks(spark, sf_dir), SIZE).select("route_id", r4("length_px", "length_px"))


@query
def agg6_route_stats(spark, sf_dir):
    """Cells, cost, length and gap cells of the route from each start to its nearest gate, summed along its cells."""
    _, stats = exit_stats(spark, sf_dir)
    return stats.select("route_id", "n_cells", r4("length_px", "length_px"), r4("cost", "cost"), "gap_cells")


@query
def agg7_nearest_open_gate(spark, sf_dir):
    """The flagship: the nearest open gate of every fix inside its map."""
    points = fixes(spark, sf_dir).filter("inside_map").select(F.col("event_id").alias("point_id"), "map_id", "x", "y")
    s = snapped(spark, sf_dir, points).withColumnRenamed("point_id", "request_id")
    gates = snapped_gates(spark, sf_dir)
    best = exits.nearest_open_gate(s, gates, gate_field(spark, sf_dir, gates))
    return best.select("request_id", "map_id", "gate", r4("length_px", "length_px"), r4("cost", "cost"), "status")


@query
def agg7_large_grid(spark, sf_dir):
    """The same on maps of several tiles, with a start of its own for every request."""
    points = derive.spread_starts(spark, sf_dir, LARGE).withColumnRenamed("request_id", "point_id")
    s = snapped(spark, sf_dir, points, LARGE).withColumnRenamed("point_id", "request_id")
    gates = snapped_gates(spark, sf_dir, LARGE)
    best = exits.nearest_open_gate(s, gates, gate_field(spark, sf_dir, gates, LARGE))
    return best.select("request_id", "map_id", "gate", r4("length_px", "length_px"), r4("cost", "cost"), "status")


def tour_starts(spark, sf_dir):
    """Requests with a start (request_id, map_id, s_row, s_col), and the distinct starts, each a tour of its own."""
    r = snapped_requests(spark, sf_dir).filter("start_row IS NOT NULL")
    at = r.select("map_id", F.col("start_row").alias("snap_row"), F.col("start_col").alias("snap_col"), F.col("start_x").alias("snap_x"), F.col("start_y").alias("snap_y")).distinct()
    wanted = r.select("request_id", "map_id", F.col("start_row").cast("long").alias("s_row"), F.col("start_col").cast("long").alias("s_col"))
    return wanted, saved(at.withColumn("tour_id", F.monotonically_increasing_id()), "starts")


def _tour_stops(spark, sf_dir):
    """The requests of tour_starts, and the stops of each distinct start's tour."""
    r, at = tour_starts(spark, sf_dir)
    return r, saved(tours.select_tour_stops(at, _candidates(spark, sf_dir), key="tour_id"), "stops")


def _tour_legs(spark, sf_dir):
    """The requests of tour_starts, the routed legs of each distinct start's tour, and the routes. Requests meet them by map_id, s_row, s_col."""
    r, stops = _tour_stops(spark, sf_dir)
    nets = prepared(spark, sf_dir)["features"].filter("walkable").select("map_id", "row", "col", F.col("component_id").alias("net"))
    legs = saved(tours.tour_legs(stops, key="tour_id", nets=nets), "legs")
    pairs = legs.select("map_id", "start_row", "start_col", "goal_row", "goal_col").distinct()
    found = routes.find_routes(pairs, net_of(spark, sf_dir))
    done = routes.shortest_routes(pairs, found)
    return r, saved(legs.join(done, ["map_id", "start_row", "start_col", "goal_row", "goal_col"]), "legs"), found


@query
def agg8_composite_route_stats(spark, sf_dir):
    r, legs, _ = _tour_legs(spark, sf_dir)
    t = saved(tours.composite_routes(legs, key="tour_id"), "composite").join(legs.select("tour_id", "map_id", "s_row", "s_col").distinct(), "tour_id")
    t = r.join(saved(t, "tours"), ["map_id", "s_row", "s_col"])
    said = X.tour_summary(F.lit("typed"), F.col("stops"), F.col("length_px"), F.col("skipped"))
    return t.select("request_id", "status", "stops", "skipped", r4("length_px", "length_px"), "gap_cells", "stop_names", said.alias("summary"))


@query
def agg9_edge_visit_counts(spark, sf_dir):
    return routes.edge_visit_counts(tracks(spark, sf_dir))


@query
def agg10_grid_layer_stats(spark, sf_dir):
    return grid.grid_layer_stats(prepared(spark, sf_dir)["cells"])


# ---- windows


@query
def win1_clearance(spark, sf_dir):
    return grid.clearance(derive.cells(spark, sf_dir)).select("map_id", "row", "col", "clearance")


@query
def win2_place_dedup(spark, sf_dir):
    p = derive.places(spark, sf_dir).withColumn("id", F.col("type"))
    return places.dedup_places(p).select("map_id", "id", "part")


@query
def win3_simplify_path(spark, sf_dir):
    return routes.simplify_paths(tracks(spark, sf_dir))


@query
def win4_edge_visit_rank(spark, sf_dir):
    return routes.edge_visits(tracks(spark, sf_dir), 3).select("route_id", "seq", "visit", "colour")


@query
def win5_route_runs(spark, sf_dir):
    return routes.route_runs(routes.edge_visits(tracks(spark, sf_dir), 3))


@query
def win6_segment_annotations(spark, sf_dir):
    s = routes.segment_annotations(routes.simplify_paths(tracks(spark, sf_dir)), SIZE, P.MIN_SEGMENT_PX)
    return s.select("route_id", "seq", "mid_x", "mid_y", r4("bearing", "bearing"))


@query
def win7_busiest_cells(spark, sf_dir):
    return projection.busiest_cells(fixes(spark, sf_dir), derive.maps(spark, sf_dir))


@query
def win7_ranks(spark, sf_dir):
    """The four ranks: components of a map, gates of a start, cells a gate may snap to, and places of a search."""
    gates = snapped_gates(spark, sf_dir)
    p, maps = prepared(spark, sf_dir), derive.maps(spark, sf_dir)
    labels = p["features"].filter("walkable").select("map_id", F.col("component_id").alias("comp"), "row", "col")
    component = grid.component_ranks(labels).select("map_id", F.lit("component").alias("kind"), F.col("comp").cast("string").alias("of"), F.col("n").cast("string").alias("value"), "rank")
    starts = snapped_requests(spark, sf_dir).select("map_id", F.col("start_row").alias("snap_row"), F.col("start_col").alias("snap_col"))
    gate = exits.gate_ranks(starts, gates, gate_field(spark, sf_dir, gates)).select("map_id", F.lit("gate").alias("kind"), F.col("cell").cast("string").alias("of"), F.col("gate").alias("value"), "rank")
    points = places.gates_of(derive.open_gates(spark, sf_dir), derive.places(spark, sf_dir)).withColumn("point_id", F.col("id"))
    snapped = snap.snap_ranks(points, p["features"], maps, rings=p["rings"]).select("map_id", F.lit("snap").alias("kind"), F.col("point_id").alias("of"), F.concat_ws(",", "snap_row", "snap_col").alias("value"), "rank")
    words = derive.keywords(spark, sf_dir).filter("length(keyword) < 4")
    search = places.search_places(words, derive.places(spark, sf_dir)).select("map_id", F.lit("search").alias("kind"), F.col("keyword").alias("of"), F.col("id").alias("value"), "rank")
    return component.unionByName(gate).unionByName(snapped).unionByName(search)


# ---- sorting, sets


@query
def srt1_places_by_id(spark, sf_dir):
    return places.sorted_places(derive.places(spark, sf_dir)).select("map_id", "id", "pos")


@query
def srt2_first_options(spark, sf_dir):
    return places.search_places(derive.keywords(spark, sf_dir), derive.places(spark, sf_dir), limit=P.AMBIGUOUS_LIMIT).select("keyword", "map_id", "rank", "id")


@query
def srt3_best_first_stop(spark, sf_dir):
    c = tours.candidate_weights(derive.places(spark, sf_dir), derive.open_gates(spark, sf_dir), derive.tour_lists(spark, sf_dir)).filter("weight > 0")
    d = F.hypot(F.col("anchor.x") - 700, F.col("anchor.y") - 700)
    score = F.round(G.tour_score(F.col("weight"), d, F.lit(True), F.col("type").isin(*P.BOOSTED_TYPES)), 9)
    rank = F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("score"), "id"))
    return c.withColumn("score", score).withColumn("rank", rank).filter("rank = 1").select("map_id", "id", r4("score", "score"))


@query
def set1_join_legs(spark, sf_dir):
    t = tracks(spark, sf_dir)
    legs = t.select(F.col("route_id").alias("request_id"), F.floor(F.col("seq") / 5).alias("leg_no"), (F.col("seq") % 5).alias("seq"), "row", "col")
    return tours.join_legs(legs)


@query
def set2_id_sets(spark, sf_dir):
    p = derive.places(spark, sf_dir)
    return p.join(derive.tour_lists(spark, sf_dir).select("map_id", "id"), ["map_id", "id"], "left_semi").select("map_id", "id", "type")


# ---- routes and tours


@query
def iter1_shortest_routes(spark, sf_dir):
    r, pairs, found = routed(spark, sf_dir)
    done = saved(routes.shortest_routes(pairs, found), "done")
    r = r.join(done, ["map_id", "start_row", "start_col", "goal_row", "goal_col"], "left")
    return r.select("request_id", "map_id", r4("cost", "cost"), r4("length_px", "length_px"), F.coalesce("status", F.lit("no_road")).alias("status"))


@query
def iter1_route_paths(spark, sf_dir):
    """The cells of every distinct route, simplified."""
    _, pairs, found = routed(spark, sf_dir)
    named = saved(pairs.withColumn("route_id", F.xxhash64(*pairs.columns)), "routes")
    return routes.simplify_paths(routes.route_cells(named, found))


@query
def iter2_cost_field(spark, sf_dir):
    f = gate_field(spark, sf_dir)
    return f.select("map_id", "source", "cell", r4("cost", "cost"))


@query
def iter3_select_tour_stops(spark, sf_dir):
    r, stops = _tour_stops(spark, sf_dir)
    return r.join(stops, ["map_id", "s_row", "s_col"]).select("request_id", "stop_no", "id")


@query
def iter4_composite_tour(spark, sf_dir):
    r, legs, _ = _tour_legs(spark, sf_dir)
    return r.join(legs, ["map_id", "s_row", "s_col"]).select("request_id", "leg_no", "id", r4("length_px", "length_px"), "status")


@query
def iter4_tour_paths(spark, sf_dir):
    """The joined path of every distinct tour, simplified; it has the least request_id that takes it."""
    r, legs, found = _tour_legs(spark, sf_dir)
    first = r.groupBy("map_id", "s_row", "s_col").agg(F.min("request_id").alias("request_id"))
    return routes.simplify_paths(tours.tour_paths(saved(legs.join(first, ["map_id", "s_row", "s_col"]), "tours"), found), key="request_id")


# ---- streams


@query
def st1_project_fixes(spark, sf_dir):
    """Run as a stream in append mode."""
    p, m = saved(projectors(spark, sf_dir), "projectors"), saved(derive.maps(spark, sf_dir), "maps")
    s = run_stream(spark, derive.location_events(spark, sf_dir).filter("kind = 'fix'"), lambda e: projection.project_fixes(e, p, m), "append")
    return s.select("event_id", "user_id", r4("x", "x"), r4("y", "y"), "inside_map", "status")


def time_slices(events: DataFrame, path: str, slices: int) -> None:
    """Writes the events as so many files in the order of their times, one after the other, so that a file stream reads them in this order."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(at.cast("double").alias("at")).approxQuantile("at", [k / slices for k in range(1, slices)], 0.01)
    no = sum(((at > c).cast("int") for c in cuts), F.lit(0))
    for k in range(slices):
        events.filter(F.coalesce(no, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(path)


def run_stream(spark: SparkSession, events: DataFrame, build, mode: str, slices: int = 3, flush: DataFrame | None = None, report: list | None = None) -> DataFrame:
    """Feed a batch of events, in so many files by time, one a trigger, to a stream and return what it has written, with its epoch.

    ``flush``: a last file whose rows only move the watermark on; the builder drops what comes of them. ``report`` gets the progress of every trigger.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    time_slices(events, f"{base}/in", slices)
    if flush is not None:
        flush.coalesce(1).write.mode("append").parquet(f"{base}/in")
    out = f"{base}/out"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/at={epoch}")

    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = build(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if report is not None:
        report.extend(q.recentProgress)
    return spark.read.parquet(out).drop("at")


@query
def st2_user_location_state(spark, sf_dir):
    """Run as a stream in update mode; the last update of each user counts."""
    p, m = saved(projectors(spark, sf_dir), "projectors"), saved(derive.maps(spark, sf_dir), "maps")
    s = run_stream(spark, derive.location_events(spark, sf_dir), lambda e: location.location_state(e, p, m), "update")
    last = W.partitionBy("map_id", "user_id").orderBy(F.desc("epoch"))
    s = s.withColumn("rank", F.row_number().over(last)).filter("rank = 1")
    return s.select("map_id", "user_id", r4("x", "x"), r4("y", "y"), "has_fix", "heading", "status")


@query
def st3_poll_fixes(spark, sf_dir):
    f = fixes(spark, sf_dir).filter("inside_map")
    return location.poll_fixes(f).select("map_id", "user_id", "window_start", "event_id")


@query
def st3_poll_stream(spark, sf_dir):
    """The same as a stream in append mode over several triggers: an interval comes out once the watermark has passed it.

    The files come in the order of time, so no row is late; a last row a day later lets the watermark pass every interval.
    """
    f = fixes(spark, sf_dir).filter("inside_map").select("map_id", "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "x", "y")
    f = saved(f, "fixes")
    end = f.agg(F.max("ts").alias("ts")).select(F.lit(-1).alias("map_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    s = run_stream(spark, f, location.poll_fixes, "append", slices=4, flush=end).filter("map_id >= 0")
    return s.select("map_id", "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_id")


@query
def snk1_upsert_stream(spark, sf_dir):
    """The keyed state of a stream in update mode, upserted by epoch; the stream stops half way and starts again from its checkpoint.

    The events are read as files by read_events.
    """
    p, m = saved(projectors(spark, sf_dir), "projectors"), saved(derive.maps(spark, sf_dir), "maps")
    base = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    names = [f.name for f in schemas.LOCATION_EVENTS]
    events = saved(spark.createDataFrame([], schemas.LOCATION_EVENTS).unionByName(derive.location_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select(*names)), "events")
    half = events.select(F.expr("percentile_approx(unix_micros(ts), 0.5)").alias("c")).first()["c"] or 0
    for part in (F.unix_micros("ts") <= half, F.unix_micros("ts") > half):
        time_slices(events.filter(F.coalesce(part, F.lit(False))), f"{base}/in", 2)
        state = location.location_state(readers.read_events(spark, f"{base}/in", streaming=True), p, m)
        sinks.upsert_stream(state, f"{base}/table", ["map_id", "user_id"], f"{base}/state").awaitTermination()
    s = sinks.read_upserted(spark, f"{base}/table", ["map_id", "user_id"])
    return s.select("map_id", "user_id", r4("x", "x"), r4("y", "y"), "has_fix", "heading", "status")


@query
def st4_status_timeline(spark, sf_dir):
    t = location.status_timeline(derive.location_events(spark, sf_dir), projectors(spark, sf_dir), derive.maps(spark, sf_dir))
    return t.select("user_id", "event_id", r4("x", "x"), r4("y", "y"), "has_fix", "heading", "status")
