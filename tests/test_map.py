"""Hand-worked cases of the map library."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfield import schemas
from wayfield.functions import grid as G
from wayfield.functions import text as X
from wayfield.operators import exits, grid, places, projection, routes, snap, tours
from wayfield.sources import readers
from wayfield.streaming import location, sinks


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def cells_of(spark, rows, map_id=1, main=None):
    data = [(map_id, r, c, v == "1", None if main is None else int(main[r][c])) for r, line in enumerate(rows) for c, v in enumerate(line)]
    return spark.createDataFrame(data, "map_id int, row int, col int, walkable boolean, manual_main int")


def maps_of(spark, height, width, size=16):
    return spark.createDataFrame([(1, size, width, height, float(width * size), float(height * size), 0.0, 0.0, 0.0)],
                                 "map_id int, cell_size int, grid_width int, grid_height int, map_width double, map_height double, north_offset double, dx double, dy double")


@pytest.mark.parametrize("v,n,want", [(2405.0, 261, 150), (710.0, 227, 44), (-5.0, 227, 0), (99999.0, 261, 260)])
def test_pixel_to_cell(spark, v, n, want):
    assert one(spark, G.pixel_to_cell(F.lit(v), F.lit(16), F.lit(n))) == want


def test_cost_factor_and_penalty(spark):
    f = lambda m: one(spark, G.road_width_cost_factor(F.lit(1), F.lit(0.0), F.lit(m).cast("int")))
    assert [round(f(m), 4) for m in (None, 1, 0)] == [3.43, 2.782, 3.808]
    p = lambda a, b: one(spark, G.main_road_departure_penalty(F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(1.0)))
    assert round(p(1, 0), 4) == 6.9525 and round(p(0, 0), 4) == 1.5525 and p(1, 1) == 0 and p(None, None) == 0
    assert round(one(spark, G.tour_score(F.lit(10), F.lit(700.0), F.lit(True), F.lit(True))), 3) == 9.653


@pytest.mark.parametrize("value,want", [("", 0.0), ("  ", 0.0), (" 12.5 ", 12.5), ("1e3", 1000.0), ("-3", -3.0), ("north", None), ("1 2", None), ("NaN", None), ("5d", None)])
def test_js_number(spark, value, want):
    got = one(spark, X.js_number(F.lit(value)))
    assert math.isnan(got) if want is None else got == want


@pytest.mark.parametrize("name,want", [("A / B / C", ("A", "B / C")), (" / ", ("", "")), ("", ("", "")), (None, ("", "")), ("A", ("A", ""))])
def test_split_name(spark, name, want):
    n = F.lit(name).cast("string")
    assert (one(spark, X.primary_name(n)), one(spark, X.secondary_name(n))) == want


@pytest.mark.parametrize("a,b,want", [(0.0, 7.0, 7.0), (None, None, None), (5.0, 7.0, 5.0), (float("nan"), 7.0, 7.0), (0.0, float("inf"), None)])
def test_accuracy(spark, a, b, want):
    assert one(spark, X.fix_accuracy(F.lit(a).cast("double"), F.lit(b).cast("double"))) == want


def test_stop_names(spark):
    names = [f"n{i}" for i in range(13)]
    assert one(spark, X.stop_names(F.array(*map(F.lit, names[:2])))) == "n0 → n1"
    assert one(spark, X.stop_names(F.array(*map(F.lit, names)))).endswith("n11 → 等 13 处")


def test_grid_and_layer(spark):
    docs = spark.createDataFrame([(1, ["101", "011"]), (2, ["10", "111"])], "map_id int, rows array<string>")
    cells = readers.grid_cells(docs)
    assert {(r.row, r.col) for r in cells.filter("map_id = 1 AND walkable").collect()} == {(0, 0), (0, 2), (1, 1), (1, 2)}
    assert {r.status for r in cells.filter("map_id = 2").collect()} == {"ragged"}
    layer = spark.createDataFrame([(1, ["111", "000"])], "map_id int, rows array<string>")
    got = {(r.row, r.col): r.manual_main for r in readers.main_road_layer(cells.filter("map_id = 1"), layer).collect()}
    assert got[0, 0] == 1 and got[0, 1] == 0 and got[1, 1] == 0
    wrong = spark.createDataFrame([(1, ["111"])], "map_id int, rows array<string>")
    assert {r.manual_main for r in readers.main_road_layer(cells.filter("map_id = 1"), wrong).collect()} == {None}


def test_clearance_against_brute_force(spark):
    r = random.Random(5)
    rows = ["".join("1" if r.random() < 0.85 else "0" for _ in range(13)) for _ in range(9)]
    blocked = [(i, j) for i, line in enumerate(rows) for j, v in enumerate(line) if v == "0"]
    for x in grid.clearance(cells_of(spark, rows)).collect():
        assert x.clearance == min(abs(x.row - i) + abs(x.col - j) for i, j in blocked)
    assert {x.clearance for x in grid.clearance(cells_of(spark, ["11", "11"])).collect()} == {32767}


def brute_components(rows):
    left = {(i, j) for i, line in enumerate(rows) for j, v in enumerate(line) if v == "1"}
    out = {}
    while left:
        first = min(left)
        todo = [first]
        left.discard(first)
        while todo:
            i, j = todo.pop()
            out[i, j] = first
            for n in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    todo.append(n)
    return out


def test_components_against_brute_force(spark):
    r = random.Random(8)
    rows = ["".join("1" if r.random() < 0.4 else "0" for _ in range(21)) for _ in range(15)]
    want = brute_components(rows)
    got = grid.label_components(cells_of(spark, rows).filter("walkable").select("map_id", "row", "col")).collect()
    assert {(x.row, x.col): (x.comp >> 20, x.comp & 0xFFFFF) for x in got} == want


def test_equal_components_take_the_first(spark):
    f = grid.cell_features(cells_of(spark, ["11011", "00000", "11011"]))
    assert {(x.row, x.col) for x in f.filter("reachable").collect()} == {(0, 0), (0, 1)}


def features_of(spark, rows, main=None):
    return grid.cell_features(cells_of(spark, rows, main=main))


def test_snap(spark):
    # a blocked cell with four road neighbours: the upper one; a diagonal of ring 1 wins over a nearer cell of ring 2
    f = spark.createDataFrame([(1, 1, 2, True, True), (1, 2, 1, True, True), (1, 2, 3, True, True), (1, 3, 2, True, True)], "map_id int, row int, col int, walkable boolean, reachable boolean")
    p = spark.createDataFrame([("a", 1, 40.0, 40.0), ("n", 1, None, 3.0)], "point_id string, map_id int, x double, y double")
    got = {x.point_id: x for x in snap.snap_to_road(p, f, maps_of(spark, 60, 60)).collect()}
    assert (got["a"].snap_row, got["a"].snap_col, got["a"].distance) == (1, 2, 16.0) and got["n"].status == "bad_point"
    f = spark.createDataFrame([(1, 4, 4, True, True), (1, 5, 7, True, True)], "map_id int, row int, col int, walkable boolean, reachable boolean")
    p = spark.createDataFrame([("b", 1, 95.0, 88.0), ("far", 1, 900.0, 900.0)], "point_id string, map_id int, x double, y double")
    got = {x.point_id: x for x in snap.snap_to_road(p, f, maps_of(spark, 60, 60)).collect()}
    assert (got["b"].snap_row, got["b"].snap_col) == (4, 4) and got["far"].status == "no_road"


def test_edges(spark):
    f = features_of(spark, ["10", "01"])
    assert grid.build_edges(f).count() == 2  # a diagonal between blocked cells is a step
    f = features_of(spark, ["101"])
    assert grid.build_edges(f).count() == 0
    e = grid.build_edges(f, max_gap=1).collect()
    assert len(e) == 2 and e[0].base_cost == 2 and e[0].gap_cells == 1 and e[0].move_cost == pytest.approx(2 * 8 * 3.43)


def dijkstra(edges, source):
    out, heap = {}, [(0.0, source)]
    while heap:
        c, at = heapq.heappop(heap)
        if at in out:
            continue
        out[at] = c
        for to, w in edges.get(at, ()):
            heapq.heappush(heap, (c + w, to))
    return out


def code(cell):
    return cell[0] * (1 << 20) + cell[1]


def random_map(spark, height, width, seed=4, max_gap=0):
    """Edges of a random map with main roads, their graph both ways, and the cells of its largest net."""
    r = random.Random(seed)
    rows = ["".join("1" if r.random() < 0.75 else "0" for _ in range(width)) for _ in range(height)]
    f = features_of(spark, rows, [[int(c % 3 == 0) & int(rows[i][c]) for c in range(width)] for i in range(height)])
    edges = routes.saved(grid.build_edges(f, max_gap), "edges")
    go, back = {}, {}
    for e in edges.collect():
        a, b = code((e.row, e.col)), code((e.row2, e.col2))
        go.setdefault(a, []).append((b, e.move_cost))
        back.setdefault(b, []).append((a, e.move_cost))
    return edges, go, back, sorted((x.row, x.col) for x in f.filter("reachable").collect())


PAIRS = "route_id int, map_id int, start_row int, start_col int, goal_row int, goal_col int"


@pytest.mark.parametrize("tile,region,max_gap", [(5, 2, 0), (7, 16, 2), (64, 16, 0)])
def test_fields_and_routes_against_dijkstra(spark, tile, region, max_gap):
    edges, go, back, road = random_map(spark, 15, 18, max_gap=max_gap)
    net = routes.road_net(edges, 16, tile)
    sources = spark.createDataFrame([(1, *road[0]), (1, *road[len(road) // 2])], "map_id int, row int, col int")
    for reverse, graph in ((False, go), (True, back)):
        field = routes.cost_fields(sources, None, 16, reverse, net=net, region=region).collect()
        for s in {x.source for x in field}:
            want, got = dijkstra(graph, s), {x.cell: x.cost for x in field if x.source == s}
            assert set(want) == set(got) and all(abs(want[k] - got[k]) < 1e-7 * max(1, want[k]) for k in want)
    r = random.Random(1)
    ends = [(*r.choice(road), *r.choice(road)) for _ in range(12)] + [(*road[0], *road[0]), (*road[0], *road[1]), (None, None, 1, 1), (*road[0], 99, 99)]
    pairs = spark.createDataFrame([(k, 1, *p) for k, p in enumerate(ends)], PAIRS)
    found = routes.find_routes(pairs, net, region)
    done = {x.route_id: x for x in routes.shortest_routes(pairs, found).collect()}
    cells = {}
    for x in routes.route_cells(pairs, found).orderBy("route_id", "seq").collect():
        cells.setdefault(x.route_id, []).append((x.row, x.col))
    for k, p in enumerate(ends[:-2]):
        cost, path = dijkstra(go, code(p[:2]))[code(p[2:])], cells[k]
        assert done[k].status == "ok" and done[k].cost == pytest.approx(cost, rel=1e-7) and path[0] == p[:2] and path[-1] == p[2:]
        assert sum(dict(go[code(a)])[code(b)] for a, b in zip(path, path[1:])) == pytest.approx(cost, rel=1e-7)
    assert [done[k].status for k in (14, 15)] == ["no_road", "no_route"] and not {14, 15} & set(cells)


def test_rounds_write_open_regions_only_and_goals_end_searches(spark):
    edges, _, _, road = random_map(spark, 8, 60, seed=9)
    net = routes.road_net(edges, 16, 4)
    whole, aimed = [], []
    routes.cost_fields(spark.createDataFrame([(1, *road[0])], "map_id int, row int, col int"), None, 16, net=net, region=2, report=whole).count()
    assert len(whole) > 5 and max(x["regions"] for x in whole[:2] + whole[-2:]) <= 3  # a front that goes along the map, 8 regions wide
    near = min(road, key=lambda c: max(abs(c[0] - road[0][0]), abs(c[1] - road[0][1] - 6)))
    routes.find_routes(spark.createDataFrame([(1, 1, *road[0], *near)], PAIRS), net, 2, aimed)
    assert len(aimed) < len(whole) and sum(x["rows"] for x in aimed) < sum(x["rows"] for x in whole) / 2


def path_of(spark, points, key=1):
    return spark.createDataFrame([(key, i, r, c) for i, (r, c) in enumerate(points)], "route_id long, seq int, row int, col int")


def test_paths(spark):
    keep = lambda pts: [(x.row, x.col) for x in routes.simplify_paths(path_of(spark, pts)).orderBy("seq").collect()]
    assert keep([(0, 0), (0, 1), (0, 2)]) == [(0, 0), (0, 2)]
    assert keep([(0, 0), (0, 1), (1, 1)]) == [(0, 0), (0, 1), (1, 1)]
    assert keep([(0, 0), (0, 1)]) == [(0, 0), (0, 1)]
    v = routes.edge_visits(path_of(spark, [(0, 0), (0, 1), (0, 0), (0, 1)]), 3)
    assert [x.colour for x in v.orderBy("seq").collect()] == [0, 1, 2]
    assert routes.route_runs(v).count() == 3
    assert routes.route_lengths(path_of(spark, [(0, 0), (1, 1)]), 16).first().length_px == pytest.approx(16 * math.sqrt(2))
    s = routes.segment_annotations(path_of(spark, [(0, 0), (0, 6), (0, 7)]), 16, 96.0).collect()
    assert len(s) == 1 and s[0].bearing == 0


def test_nearest_gate_ties_and_skips(spark):
    f = features_of(spark, ["11111"])
    gates = spark.createDataFrame([(1, "b", "B", 2, 0, 4, "ok"), (1, "a", "A", 1, 0, 0, "ok"), (1, "c", "C", 3, None, None, "no_road")],
                                  "map_id int, id string, name string, gate_order int, snap_row long, snap_col long, status string")
    src = gates.filter("status = 'ok'").select("map_id", F.col("snap_row").alias("row"), F.col("snap_col").alias("col"))
    field = routes.cost_fields(src, routes.saved(grid.build_edges(f)), 16, reverse=True)
    starts = spark.createDataFrame([(1, 1, 0, 2), (2, 1, 0, 3), (3, 1, None, None)], "request_id long, map_id int, snap_row long, snap_col long")
    got = {x.request_id: (x.gate, x.status) for x in exits.nearest_open_gate(starts, gates, field).collect()}
    assert got == {1: ("a", "ok"), 2: ("b", "ok"), 3: (None, "no_road")}


def test_places(spark):
    p = spark.createDataFrame([(1, "ab", "Ab / x", 1), (1, "abc", "Abc", 2), (1, "zz", "Hall  one", 3), (1, "zz", "Late", 4)], "map_id int, id string, name string, part int")
    assert {(x.id, x.part) for x in places.dedup_places(p).collect()} == {("ab", 1), ("abc", 2), ("zz", 4)}
    p = p.filter("part < 4")
    r = spark.createDataFrame([(1, 1, "ab", None), (2, 1, "AB", None), (3, 1, "  ", None), (4, 1, "hall", None), (5, 1, "none", None), (6, 1, "x", "abc"), (7, 1, "ab", "gone")],
                              "request_id long, map_id int, place_text string, place_id string")
    got = {x.request_id: (x.place, x.status, x.candidates) for x in places.resolve_places(r, p).collect()}
    assert got == {1: ("ab", "ok", None), 2: (None, "ambiguous", "ab, abc"), 3: (None, "empty", None), 4: ("zz", "ok", None), 5: (None, "not_found", None), 6: ("abc", "ok", None), 7: (None, "not_found", None)}
    k = spark.createDataFrame([("hallone",), ("",)], "keyword string")
    found = [(x.keyword, x.id) for x in places.search_places(k, p).orderBy("keyword", "rank").collect()]
    assert found == [("", "ab"), ("", "abc"), ("", "zz"), ("hallone", "zz")]


def test_places_that_share_an_id(spark):
    p = spark.createDataFrame([(1, "g1", "North gate", 1, (1.0, 1.0), None), (1, "g1", "Northern gate", 2, (2.0, 2.0), (3.0, 3.0)), (1, "g2", "South", 3, (4.0, 4.0), None)],
                              "map_id int, id string, name string, part int, center struct<x:double,y:double>, access struct<x:double,y:double>")
    r = spark.createDataFrame([(1, 1, "g1", None), (2, 1, "nor", None), (3, 1, None, "g1"), (4, 1, "northern", None)], "request_id long, map_id int, place_text string, place_id string")
    got = sorted(tuple(x) for x in places.resolve_places(r, p).select("request_id", "place", "status", "candidates").collect())
    assert got == [(1, "g1", "ok", None), (2, None, "ambiguous", "g1, g1"), (3, "g1", "ok", None), (4, "g1", "ok", None)]
    open_ = spark.createDataFrame([(1, "g1", 1), (1, "gone", 2)], "map_id int, id string, gate_order int")
    assert [tuple(x) for x in places.gates_of(open_, p).collect()] == [(1, "g1", "Northern gate", 1, 3.0, 3.0)]
    found = places.search_places(spark.createDataFrame([("north",), ("",)], "keyword string"), p).orderBy("keyword", "rank").collect()
    assert [(x.keyword, x.rank, x.id, x.title) for x in found] == [("", 1, "g1", "North gate"), ("", 2, "g1", "Northern gate"), ("", 3, "g2", "South"), ("north", 1, "g1", "North gate"), ("north", 2, "g1", "Northern gate")]


def test_places_in_the_order_of_readers(spark):
    ids = ["Ab", "a1", "aB", "a_1", "ab"]
    p = spark.createDataFrame([(1, i, "N", k) for k, i in enumerate([*ids, "ab"])], "map_id int, id string, name string, part int")
    got = places.sorted_places(p).orderBy("pos").collect()
    assert [x.id for x in got] == ["a_1", "a1", "ab", "ab", "aB", "Ab"] and [x.part for x in got if x.id == "ab"] == [4, 5]


@pytest.mark.parametrize("v,want", [(1.005, "1.00"), (0.125, "0.13"), (-0.125, "-0.13"), (2.675, "2.67"), (1234567.895, "1234567.90"), (0.0, "0.00"), (-0.001, "-0.00"), (9.995, "9.99"), (float("nan"), "NaN"), (1e13, "10000000000000.00")])
def test_two_decimals_of_the_binary_value(spark, v, want):
    assert one(spark, X.fixed_two(F.lit(v))) == want


@pytest.mark.parametrize("value,want", [("0x10", 16.0), ("0b101", 5.0), (" 0o17 ", 15.0), ("0xg", None), ("-0x1", None), ("0x", None)])
def test_js_number_bases(spark, value, want):
    got = one(spark, X.js_number(F.lit(value)))
    assert math.isnan(got) if want is None else got == want


def test_snap_against_all_cells(spark):
    r = random.Random(12)
    rows = ["".join("1" if r.random() < 0.04 else "0" for _ in range(40)) for _ in range(33)]
    f = cells_of(spark, rows).withColumn("reachable", F.col("walkable") & (F.col("col") < 25))
    road = [(i, j) for i, line in enumerate(rows) for j, v in enumerate(line) if v == "1" and j < 25]
    pts = [(k, 1, r.uniform(-60, 700), r.uniform(-60, 600)) for k in range(120)]
    p = spark.createDataFrame(pts, "point_id int, map_id int, x double, y double")
    want = {}
    for k, _, x, y in pts:
        o = (min(max(int(y // 16), 0), 32), min(max(int(x // 16), 0), 39))
        ring = min(max(abs(o[0] - i), abs(o[1] - j)) for i, j in road)
        near = sorted((math.hypot((j + 0.5) * 16 - x, (i + 0.5) * 16 - y), i, j) for i, j in road if max(abs(o[0] - i), abs(o[1] - j)) == ring)
        want[k] = [(i, j) for _, i, j in near] if ring <= 9 else []
    m = maps_of(spark, 33, 40)
    got = {x.point_id: (x.snap_row, x.snap_col) for x in snap.snap_to_road(p, f, m, max_cells=9).collect()}
    assert got == {k: (v[0] if v else (None, None)) for k, v in want.items()} and any(not v for v in want.values())
    ranks = {}
    for x in snap.snap_ranks(p, f, m, max_cells=9).orderBy("point_id", "rank").collect():
        ranks.setdefault(x.point_id, []).append((x.snap_row, x.snap_col))
    assert ranks == {k: v for k, v in want.items() if v}
    rings = routes.saved(snap.snap_rings(f, m, 9))
    plan = snap.snap_to_road(p, f, m, 9, rings=rings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # the map's sizes, and one row of rings a point


def test_upserts_survive_replay_and_restart(spark, tmp_path):
    path, kinds = f"file://{tmp_path}/t", "k int, v string"
    rows = lambda *r: spark.createDataFrame(list(r), kinds)
    read = lambda: sorted(map(tuple, sinks.read_upserted(spark, path, ["k"]).collect()))
    sinks.write_epoch(rows((1, "a"), (2, "b")), 0, path, ["k"], 3)
    sinks.write_epoch(rows((2, "c"), (3, "d")), 1, path, ["k"], 3)
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert read() == want
    for _ in range(2):  # replayed, as after a crash between write and commit; it is the third epoch, so the table is compacted
        sinks.write_epoch(rows((1, "e")), 2, path, ["k"], 3)
        assert read() == [(1, "e"), *want[1:]]
    (tmp_path / "t" / "epoch=3").mkdir()  # begun, never finished
    assert read() == [(1, "e"), *want[1:]] and any("base=2" in x.name for x in (tmp_path / "t").iterdir())
    with pytest.raises(FileNotFoundError):
        sinks.read_upserted(spark, f"file://{tmp_path}/none", ["k"])


def test_projector(spark):
    pts = [(1, "a", 0.0, 0.0, 5.0, 7.0), (1, "b", 1.0, 0.0, 7.0, 7.0), (1, "c", 0.0, 1.0, 5.0, 10.0), (2, "a", 0.0, 0.0, 1.0, 1.0), (2, "b", 1.0, 1.0, 1.0, 1.0),
           (3, "a", 0.0, 0.0, 1.0, 1.0), (3, "b", 1.0, 1.0, 1.0, 1.0), (3, "c", 2.0, 2.0, 1.0, 1.0)]
    m = {x.map_id: x for x in projection.fit_projectors(spark.createDataFrame(pts, "map_id int, id string, lng double, lat double, x double, y double")).collect()}
    assert m[1].ready and (m[1].ax, m[1].bx, m[1].ay, m[1].by) == pytest.approx((2, 0, 0, 3), abs=1e-9)
    assert not m[2].ready and m[2].reason == projection.FEW and not m[3].ready and m[3].reason == projection.SINGULAR


def test_tour(spark):
    import numpy as np

    order = tours.pick_stops((0.0, 0.0), np.array([100.0, 100.0, 900.0]), np.zeros(3), np.array([5.0, 5.0, 5.0]), np.array([0, 0, 1]), 32)
    assert order[0] == 0 and sorted(order) == [0, 1, 2]  # of equal scores the first
    legs = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 1, 0, 1), (1, 2, 0, 0, 1), (1, 2, 1, 0, 2)], "request_id long, leg_no int, seq int, row int, col int")
    assert [(x.seq, x.col) for x in tours.join_legs(legs).orderBy("seq").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_validation(spark):
    t = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0, None), (2, float("nan"), 1.0, 2.0, 2.0, None), (3, 1.0, 1.0, float("nan"), 2.0, None), (4, 1.0, 1.0, None, None, "hall"), (5, 1.0, 1.0, None, None, " ")],
                              "request_id long, start_x double, start_y double, goal_x double, goal_y double, place_text string")
    assert {x.request_id: x.status for x in places.validate_requests(t).collect()} == {1: "ok", 2: "missing_start", 3: "bad_goal", 4: "ok", 5: "missing_destination"}


def test_equal_costs_do_not_depend_on_tiles(spark):
    """One graph of equal costs, full of ties: every value of the field is the same for any tile size."""
    r = random.Random(6)
    rows = ["".join("1" if r.random() < 0.85 else "0" for _ in range(13)) for _ in range(11)]
    f = features_of(spark, rows)
    edges = routes.saved(grid.build_edges(f).withColumn("move_cost", F.lit(1.0)), "edges")
    road = sorted((x.row, x.col) for x in f.filter("reachable").collect())
    sources = spark.createDataFrame([(1, *road[0]), (1, *road[-1])], "map_id int, row int, col int")
    fields = [sorted(map(tuple, routes.cost_fields(sources, edges, 16, tile=t).collect())) for t in (4, 64)]
    assert fields[0] == fields[1] and len(fields[0]) >= 2 * len(road)


def test_route_stats(spark):
    f = features_of(spark, ["110", "011", "001"])
    edges = routes.saved(grid.build_edges(f), "edges")
    cost = {(e.row, e.col, e.row2, e.col2): e.move_cost for e in edges.collect()}
    path = spark.createDataFrame([("a", 1, i, r, c) for i, (r, c) in enumerate([(0, 0), (0, 1), (1, 2)])] + [("b", 1, 0, 0, 0), ("c", 1, 0, 0, 0), ("c", 1, 1, 2, 2)], "route_id string, map_id int, seq int, row int, col int")
    got = {x.route_id: x for x in routes.route_stats(path, edges, 16).collect()}
    assert (got["a"].n_cells, got["a"].gap_cells) == (3, 0) and got["a"].cost == pytest.approx(cost[0, 0, 0, 1] + cost[0, 1, 1, 2])
    assert got["a"].length_px == pytest.approx(16 + 16 * math.sqrt(2)) and (got["b"].n_cells, got["b"].cost, got["b"].length_px) == (1, 0, 0) and got["c"].cost is None


def test_ranks(spark):
    labels = spark.createDataFrame([(1, 7, 0, 5), (1, 7, 0, 6), (1, 3, 2, 0), (1, 3, 2, 1), (1, 9, 4, 4)], "map_id int, comp long, row int, col int")
    assert [(x.comp, x.rank) for x in grid.component_ranks(labels).orderBy("rank").collect()] == [(7, 1), (3, 2), (9, 3)]
    f = features_of(spark, ["10101", "00000", "11111"])
    m = spark.createDataFrame([(1, 16, 5, 3)], "map_id int, cell_size int, grid_width int, grid_height int")
    near = snap.snap_ranks(spark.createDataFrame([(1, 1, 40.0, 24.0)], "point_id int, map_id int, x double, y double"), f, m).orderBy("rank").collect()
    assert [(x.snap_row, x.snap_col) for x in near] == [(2, 2), (2, 1), (2, 3)]


def test_containing(spark):
    r = random.Random(8)
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randint(0, 12)))) for i in range(80)]
    needles = ["a", "ab", "abc", "a b", "cab ", "zzz", "bcabca", "é"]
    got = {(x.needle, x.id) for x in places.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "id long, text string")).collect()}
    assert got == {(n, i) for n in needles for i, t in texts if n in t} and got


def test_search_broadcasts_no_texts(spark):
    """Substrings are many times their texts: no join of a search may send them through the driver."""
    texts = spark.createDataFrame([(i, f"red_pin_{i}") for i in range(50)], "id long, text string")
    plan = places.meeting(spark.createDataFrame([("_1",)], "needle string"), texts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_resolving_broadcasts_no_places(spark):
    p = spark.createDataFrame([(1, f"red_pin_{i}", "Red", i) for i in range(50)], "map_id int, id string, name string, part int")
    r = spark.createDataFrame([(1, 1, "_49", None), (2, 1, "red", None), (3, 1, "d\nr", None)], "request_id long, map_id int, place_text string, place_id string")
    found = places.resolve_places(r, p, limit=1)
    assert found._jdf.queryExecution().executedPlan().toString().count("Window") == 0  # places are ranked before, not beside the requests
    assert sorted(tuple(x) for x in found.select("request_id", "place", "status", "candidates").collect()) == [(1, "red_pin_49", "ok", None), (2, None, "ambiguous", "red_pin_0"), (3, None, "not_found", None)]


def test_numbers_meet_few_texts(spark):
    """The pairs a search checks grow with what it finds, not with the square of the numbers in ids."""
    texts = spark.createDataFrame([(i, f"red_pin_{i}") for i in range(20000)], "id long, text string")
    needles = texts.select(F.concat(F.lit("_"), F.col("id").cast("string")).alias("needle"))
    met, found = places.meeting(needles, texts).count(), places.containing(needles, texts).count()
    assert found == sum(str(i).startswith(str(k)) for i in range(20000) for k in {int(str(i)[:n]) for n in range(1, 6)}) and met < 4 * found


def test_equal_places_are_picked_in_order(spark):
    """Candidates of one cell, gain and zone count as one place, and no more than a tour can hold of them go on."""
    import numpy as np

    x, zone = np.array([100.0, 900.0]), np.array([0, 1])
    one_by_one = tours.pick_stops((0.0, 0.0), x[[0, 1, 0, 1, 0]], np.zeros(5), np.full(5, 5.0), zone[[0, 1, 0, 1, 0]], 4)
    assert tours.pick_stops((0.0, 0.0), x, np.zeros(2), np.full(2, 5.0), zone, 4, [np.array([0, 2, 4]), np.array([1, 3])]) == one_by_one
    found = [(1, f"c{i:03d}", "C", "dining", 5, i % 2, 7, 16.0 * (i % 2), 0.0, "ok", "0-0", i + 1) for i in range(300)]
    candidates = spark.createDataFrame(found, "map_id int, id string, name string, type string, weight int, snap_row long, snap_col long, snap_x double, snap_y double, snap_status string, zone string, pos int")
    starts = spark.createDataFrame([(1, 1, 0, 7, 0.0, 0.0)], "request_id long, map_id int, snap_row long, snap_col long, snap_x double, snap_y double")
    got = [s.id for s in tours.select_tour_stops(starts, candidates, max_stops=5).orderBy("stop_no").collect()]
    assert got == ["c001", "c003", "c005", "c007", "c009"]
    assert tours.held(candidates.withColumn("gain", F.lit(1.0)), 5).count() == 10


def test_requests_share_their_points(spark):
    """Distinct points are snapped, requests meet them by place; a request's bad start and repeated points change nothing."""
    from wayfield.plans import queries as Q

    from .conftest import DATA

    r = Q.snapped_requests(spark, DATA)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "ring_cells" not in plan and r.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    starts, points = Q.tour_starts(spark, DATA)[1], r.select("map_id", "start_row", "start_col").filter("start_row IS NOT NULL").distinct()
    assert starts.count() == points.count() < r.count()


def test_tour_status_and_path(spark):
    net = routes.road_net(grid.build_edges(features_of(spark, ["11111"])), 16)
    legs = spark.createDataFrame([(1, 1, 1, "p", "P / x", 0, 0, 0, 3), (1, 1, 2, "q", "", 0, 3, 0, 1), (2, 1, 1, "p", "P", 0, 0, 0, 0), (3, 1, 1, "p", "P", 0, 0, 9, 9)],
                                 "request_id long, map_id int, leg_no int, id string, name string, start_row int, start_col int, goal_row int, goal_col int")
    found = routes.find_routes(legs, net)
    done = routes.saved(routes.shortest_routes(legs, found), "legs")
    got = {x.request_id: (x.status, x.stops, x.skipped, x.stop_names) for x in tours.composite_routes(done).collect()}
    assert got == {1: ("ok", 2, 0, "P → q"), 2: ("no_path", 1, 0, "P"), 3: ("no_stop", 0, 1, "")}
    path = [(x.seq, x.col) for x in tours.tour_paths(done, found).filter("request_id = 1").orderBy("seq").collect()]
    assert path == list(enumerate([0, 1, 2, 3, 2, 1]))


def test_tour_stays_on_a_failed_leg(spark):
    """Two nets, a blocked column between: the stops of the other one are skipped, unless a gap may be crossed."""
    f = routes.saved(features_of(spark, ["111011"]), "features")
    stops = spark.createDataFrame([(1, 1, k, i, i, 0, 0, 0, c) for k, i, c in ((1, "a", 2), (2, "far", 4), (3, "b", 1), (4, "edge", 5), (5, "c", 2))] + [(2, 1, 1, "off", "off", 9, 9, 0, 1)],
                                  "request_id long, map_id int, stop_no int, id string, name string, s_row long, s_col long, snap_row long, snap_col long")
    for max_gap, cursors, skipped in ((0, [0, 2, 2, 1, 1], 2), (1, [0, 2, 4, 1, 5], 0)):
        edges = routes.saved(grid.build_edges(f, max_gap), "edges")
        legs = routes.saved(tours.tour_legs(stops, nets=tours.join_nets(f, edges)), "legs")
        assert [x.start_col for x in legs.filter("request_id = 1").orderBy("leg_no").collect()] == cursors
        done = routes.shortest_routes(legs, routes.find_routes(legs, routes.road_net(edges, 16)))
        got = {x.request_id: (x.status, x.stops, x.skipped, x.gap_cells) for x in tours.composite_routes(done).collect()}
        assert got == {1: ("ok", 5 - skipped, skipped, 0 if not max_gap else 4), 2: ("no_stop", 0, 1, 0)}


def test_summaries(spark):
    r = spark.range(1).select(
        X.route_summary(F.lit(12), F.lit(150.5), F.lit(0)).alias("a"), X.tour_summary(F.lit("x"), F.lit(3), F.lit(99.4), F.lit(0)).alias("b"),
        X.tour_summary(F.lit("x"), F.lit(3), F.lit(99.4), F.lit(2)).alias("c"), X.exit_summary(F.lit("g1"), F.lit(" / "), F.lit(7.0)).alias("d"),
    ).first()
    assert r.a == "12 个网格点，约 151px，跨 0 个假断点" and r.b == "智能观光路线：从x出发，途经 3 处，约 99px" and r.c == r.b + "，跳过 2 处不可达点" and r.d == "最近离开路线：g1，约 7px"


def test_file_readers(spark, tmp_path):
    import json

    def write(name, *docs):
        (tmp_path / name).write_text("\n".join(map(json.dumps, docs)))
        return f"file://{tmp_path}/{name}"

    cells = readers.read_road_grid(spark, write("grid.json", {"map_id": 1, "cell_size": 16, "rows": ["10", "11"]}, {"map_id": 2, "rows": ["1", "11"]}))
    assert {(x.row, x.col, x.walkable) for x in cells.filter("map_id = 1").collect()} == {(0, 0, True), (0, 1, False), (1, 0, True), (1, 1, True)}
    assert {x.status for x in cells.filter("map_id = 2").collect()} == {"ragged"}
    layer = readers.read_main_road_layer(spark, cells.filter("map_id = 1"), write("main.json", {"map_id": 1, "rows": ["11", "01"]}))
    assert sorted((x.row, x.col, x.manual_main) for x in layer.collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)]
    p = readers.read_places(spark, write("places.json", {"map_id": 1, "id": "a", "center": {"x": "1.5", "y": "2"}}, {"map_id": 1, "id": "b", "name": "B", "type": "gate", "access": {"x": 3, "y": 4}})).orderBy("id").collect()
    assert (p[0].name, p[0].type, p[0].access, p[0].polygons, p[0].center.x) == ("a", "place", None, [], 1.5) and (p[1].name, p[1].access.x) == ("B", 3.0)
    events = spark.createDataFrame([(1, 1, 1, None, "fix", 1.0, 2.0, None, None, None)], schemas.LOCATION_EVENTS)
    events.write.parquet(f"file://{tmp_path}/events")
    assert readers.read_events(spark, f"file://{tmp_path}/events").count() == 1 and readers.read_events(spark, f"file://{tmp_path}/events", streaming=True).isStreaming


def test_poll_stream_drops_late_rows(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, 0) + dt.timedelta(seconds=s)
    kinds = "map_id int, user_id long, event_id long, ts timestamp, x double, y double"
    parts = [[(1, 1, 1, at(0), 1.0, 1.0), (1, 1, 2, at(3), 2.0, 2.0), (1, 1, 3, at(2000), 3.0, 3.0)], [(1, 1, 4, at(1), 4.0, 4.0), (1, 1, 5, at(4000), 5.0, 5.0)]]
    for rows in parts:  # the second file's first row is older than the watermark
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    q = location.poll_fixes(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(x.window_start, x.event_id) for x in spark.read.parquet(out).orderBy("window_start").collect()]
    assert [e for _, e in got] == [2, 3]


def test_tour_stops_against_brute_force(spark):
    r = random.Random(5)
    found = [(1, f"c{i:02d}", f"C{i}", r.choice(["square", "dining"]), r.randint(1, 9), i, i + 1, 16.0 * r.randint(0, 60), 16.0 * r.randint(0, 60), "ok", f"{r.randint(0, 3)}-{r.randint(0, 3)}", i + 1) for i in range(14)]
    found += [(2, "bad", "Bad", "square", 5, None, None, None, None, "no_road", "0-0", 1)]
    candidates = spark.createDataFrame(found, "map_id int, id string, name string, type string, weight int, snap_row long, snap_col long, snap_x double, snap_y double, snap_status string, zone string, pos int")
    begin = [(10, 1, 3, 4, 100.0, 200.0), (11, 1, 50, 50, 800.0, 10.0), (12, 2, 0, 0, 0.0, 0.0), (13, 1, None, None, None, None)]
    starts = spark.createDataFrame(begin, "request_id long, map_id int, snap_row long, snap_col long, snap_x double, snap_y double")
    want = {}
    for request, map_id, row, col, x, y in begin:
        left = [c for c in found if c[0] == map_id and row is not None and (c[5], c[6]) != (row, col)] if map_id == 1 else []
        seen, order = set(), []
        while left and len(order) < 5:
            score = lambda c: c[4] * (1.0 if c[10] in seen else 1.45) * (1.2 if c[3] == "square" else 1.0) / (max(80.0, math.hypot(c[7] - x, c[8] - y)) / 700 + 1) ** 0.85  # noqa: B023, E731
            best = max(left, key=score)
            left.remove(best)
            seen.add(best[10])
            order.append(best[1])
            x, y = best[7], best[8]
        if order:
            want[request] = order
    got = {}
    for s in tours.select_tour_stops(starts, candidates, max_stops=5).orderBy("request_id", "stop_no").collect():
        got.setdefault(s.request_id, []).append(s.id)
    assert got == want and len(want) == 2
