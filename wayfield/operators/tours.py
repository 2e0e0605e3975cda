"""Sightseeing tours: weighted candidates, greedy stops, composite routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import grid as G
from ..functions import text
from ..storage import saved
from .routes import Found, route_cells


STARTS = 256  # distinct starts of a map that meet its candidates together


def candidate_weights(places: DataFrame, open_gates: DataFrame, lists: DataFrame) -> DataFrame:
    """``places`` with weight; the id lists are keyed per map and joined."""
    flag = lambda df, name: df.select("map_id", "id", F.lit(True).alias(name)).distinct()
    p = places.join(flag(open_gates, "is_open"), ["map_id", "id"], "left")
    p = p.join(flag(lists.filter("list = 'dorm'"), "is_dorm"), ["map_id", "id"], "left").join(flag(lists.filter("list = 'key'"), "is_key"), ["map_id", "id"], "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    weight = G.tour_candidate_weight(F.col("type"), has("is_open"), has("is_dorm"), has("is_key"))
    return p.select("map_id", "id", "name", "type", F.coalesce("access", "center").alias("anchor"), weight.alias("weight"))


def tour_candidates(weighted: DataFrame, snapped: DataFrame, maps: DataFrame) -> DataFrame:
    """Candidates of positive weight with their snapped cell and zone; ``snapped``: map_id, id and the columns of snap_to_road."""
    c = weighted.filter("weight > 0").join(snapped.select("map_id", "id", "snap_row", "snap_col", "snap_x", "snap_y", F.col("status").alias("snap_status")), ["map_id", "id"])
    c = c.join(maps.select("map_id", "map_width", "map_height"), "map_id")
    zone = G.tour_zone(F.col("snap_x"), F.col("snap_y"), F.col("map_width"), F.col("map_height"))
    pos = F.row_number().over(W.partitionBy("map_id").orderBy("id"))
    return c.select("map_id", "id", "name", "type", "weight", "snap_row", "snap_col", "snap_x", "snap_y", "snap_status", zone.alias("zone"), pos.alias("pos"))


def held(candidates: DataFrame, max_stops: int) -> DataFrame:
    """``candidates`` without those no tour can reach: of equal ones (cell, gain, zone) the first ``max_stops``. So many a map are left as it has cells, however many places lie on them."""
    equal = W.partitionBy("map_id", "snap_row", "snap_col", "snap_x", "snap_y", "gain", "zone").orderBy("pos")
    return candidates.withColumn("_nth", F.row_number().over(equal)).filter(F.col("_nth") <= max_stops).drop("_nth")


def pick_stops(start: tuple[float, float], x: np.ndarray, y: np.ndarray, gain: np.ndarray, zone: np.ndarray, most: int, members: list[np.ndarray] | None = None) -> list[int]:
    """Greedy order of stops: the best score next; of equal ones the first candidate.

    ``members``: the candidates (ascending numbers) of each place, which are equal in all that counts; without it each place is one.
    """
    members = [np.array([k]) for k in range(len(x))] if members is None else members
    head, used = np.array([m[0] for m in members], np.int64), [0] * len(members)
    left, seen = np.ones(len(x), bool), np.zeros(int(zone.max(initial=-1)) + 1, bool)
    cx, cy = start
    out: list[int] = []
    while len(out) < most and left.any():
        far = np.maximum(P.TOUR_FLOOR, np.hypot(x - cx, y - cy))
        score = gain * np.where(seen[zone], 1.0, P.ZONE_BOOST) / np.power(far / P.TOUR_SCALE + 1, P.TOUR_POWER)
        score = np.where(left, score, -np.inf)
        best = np.flatnonzero(score == score.max())
        k = int(best[np.argmin(head[best])])
        out.append(int(head[k]))
        used[k] += 1
        if used[k] < len(members[k]):
            head[k] = members[k][used[k]]
        else:
            left[k] = False
        seen[zone[k]] = True
        cx, cy = x[k], y[k]
    return out


def select_tour_stops(starts: DataFrame, candidates: DataFrame, max_stops: int = P.MAX_STOPS, key: str = "request_id") -> DataFrame:
    """(key, stop_no, id, snap_row, snap_col) for every start (key, map_id, snap_row, snap_col, snap_x, snap_y).

    A candidate on the start's own cell is left out. Distinct starts go in blocks of about STARTS, and each block meets
    the candidates of its map (a gazetteer, not user data; of equal ones no more than a tour can hold, see held) once: no row of a start and a candidate is made.
    A map with a candidate off the road net has no tour.
    """
    bad = candidates.filter("snap_status != 'ok'").select("map_id").distinct()
    good = candidates.join(bad, "map_id", "left_anti").withColumn("gain", F.col("weight") * F.when(F.col("type").isin(*P.BOOSTED_TYPES), P.TYPE_BOOST).otherwise(1.0))
    at = starts.filter("snap_row IS NOT NULL").select("map_id", F.col("snap_row").alias("s_row"), F.col("snap_col").alias("s_col"), F.col("snap_x").alias("s_x"), F.col("snap_y").alias("s_y")).distinct()
    blocks = at.groupBy("map_id").agg(F.ceil(F.count(F.lit(1)) / STARTS).alias("blocks"))
    at = saved(at.join(blocks, "map_id").withColumn("block", F.pmod(F.xxhash64("s_row", "s_col"), "blocks")).drop("blocks"), "starts")
    cols = ["map_id", "id", "name", "snap_row", "snap_col", "snap_x", "snap_y", "gain", "zone", "pos"]
    shared = held(good.select(*cols), max_stops).join(at.select(F.col("map_id").alias("m"), F.col("block").alias("block")).distinct().withColumnRenamed("m", "map_id"), "map_id")
    kinds = "map_id int, s_row long, s_col long, id string, name string, snap_row long, snap_col long, stop_no long"

    def choose(key: tuple, begin: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        spot = pdf.groupby(["snap_row", "snap_col", "snap_x", "snap_y", "gain", "zone"], sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(spot, kind="stable")
        members = np.split(order, np.flatnonzero(np.diff(spot[order])) + 1) if len(order) else []
        at = pdf.loc[[m[0] for m in members]]
        zone, place = pd.factorize(at["zone"])[0], [at[c].to_numpy(np.float64) for c in ("snap_x", "snap_y", "gain")]
        row, col = at["snap_row"].to_numpy(), at["snap_col"].to_numpy()
        parts = []
        for s_row, s_col, x, y in begin[["s_row", "s_col", "s_x", "s_y"]].itertuples(index=False):
            other = np.flatnonzero((row != s_row) | (col != s_col))
            order = pick_stops((x, y), *(v[other] for v in place), zone[other], max_stops, [members[k] for k in other]) if len(other) else []
            out = pdf.loc[order, ["id", "name", "snap_row", "snap_col"]]
            parts.append(out.assign(map_id=key[0], s_row=s_row, s_col=s_col, stop_no=np.arange(1, len(order) + 1)))
        names = [c.split()[0] for c in kinds.split(", ")]
        return pd.concat(parts)[names] if parts else pd.DataFrame({c: [] for c in names})

    stops = at.groupBy("map_id", "block").cogroup(shared.groupBy("map_id", "block")).applyInPandas(choose, kinds)
    s = starts.select(key, "map_id", F.col("snap_row").cast("long").alias("s_row"), F.col("snap_col").cast("long").alias("s_col"))
    return s.join(stops, ["map_id", "s_row", "s_col"]).select(key, "map_id", "stop_no", "id", "name", "s_row", "s_col", "snap_row", "snap_col")


def tour_legs(stops: DataFrame, key: str = "request_id", nets: DataFrame | None = None) -> DataFrame:
    """One leg per stop, from the last stop before it that was reached, or the start.

    ``nets``: map_id, row, col, net: cells of one net reach each other (road components, see join_nets where gaps may be crossed). A leg to a stop of another net
    fails, and the next one begins where it began. Without nets every stop is reached.
    """
    w = W.partitionBy(key).orderBy("stop_no").rowsBetween(W.unboundedPreceding, -1)
    reached = F.lit(True)
    if nets is not None:
        at = lambda row, col, name: nets.select("map_id", F.col("row").cast("long").alias(row), F.col("col").cast("long").alias(col), F.col("net").alias(name))
        stops = stops.join(at("s_row", "s_col", "_from"), ["map_id", "s_row", "s_col"], "left").join(at("snap_row", "snap_col", "_to"), ["map_id", "snap_row", "snap_col"], "left")
        reached = F.coalesce(F.col("_from") == F.col("_to"), F.lit(False))
    last = F.last(F.when(reached, F.struct("snap_row", "snap_col")), ignorenulls=True).over(w)
    legs = stops.withColumn("_at", F.coalesce(last, F.struct(F.col("s_row").alias("snap_row"), F.col("s_col").alias("snap_col"))))
    return legs.select(
        key, "map_id", F.col("stop_no").alias("leg_no"), "id", "name", F.col("_at.snap_row").alias("start_row"), F.col("_at.snap_col").alias("start_col"),
        F.col("snap_row").alias("goal_row"), F.col("snap_col").alias("goal_col"), "s_row", "s_col",
    )


def join_nets(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, row, col, net): road components, those that edges over gaps join taken together. Only components travel, not cells."""
    cells = features.filter("walkable").select("map_id", "row", "col", F.col("component_id").alias("comp"))
    ends = edges.filter("gap_cells > 0").join(cells, ["map_id", "row", "col"]).withColumnRenamed("comp", "a")
    ends = ends.join(cells.withColumnsRenamed({"row": "row2", "col": "col2", "comp": "b"}), ["map_id", "row2", "col2"]).filter("a != b").select("map_id", "a", "b").distinct()
    arcs = saved(ends.unionByName(ends.select("map_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "arcs")
    nets = saved(cells.select("map_id", F.col("comp").alias("a"), F.col("comp").alias("net")).distinct(), "nets")
    while True:
        offer = arcs.join(nets, ["map_id", "a"]).groupBy("map_id", F.col("b").alias("a")).agg(F.min("net").alias("least"))
        met = nets.join(offer, ["map_id", "a"], "left").withColumn("less", F.least("net", "least"))
        # and on to the net of the net, so long chains take few rounds
        further = nets.select("map_id", F.col("a").alias("less"), F.col("net").alias("further"))
        moved = saved(met.join(further, ["map_id", "less"]).select("map_id", "a", F.col("further").alias("net"), (F.col("further") != F.col("net")).alias("moved")), "nets")
        nets = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    return cells.join(nets.withColumnRenamed("a", "comp"), ["map_id", "comp"]).select("map_id", "row", "col", "net")


def composite_routes(legs: DataFrame, key: str = "request_id") -> DataFrame:
    """Stops included, legs skipped, length, gap cells and status of each tour; ``legs`` carry status, length_px, gap_cells (see shortest_routes).

    status: 'no_stop' if no leg has a route, 'no_path' if all its stops lie on the start's cell, else 'ok'.
    """
    ok = F.col("status") == "ok"
    names = F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("leg_no", "name", "id")))), lambda s: text.place_label(s["id"], s["name"]))
    length = F.coalesce(F.sum(F.when(ok, F.col("length_px"))), F.lit(0.0))
    status = F.when(F.count_if(ok) == 0, "no_stop").when(length == 0, "no_path").otherwise("ok")
    return legs.groupBy(key).agg(
        status.alias("status"), F.count_if(ok).alias("stops"), F.count_if(~ok).alias("skipped"), length.alias("length_px"),
        F.coalesce(F.sum(F.when(ok, F.col("gap_cells"))), F.lit(0)).alias("gap_cells"), text.stop_names(names).alias("stop_names"),
    )


def join_legs(cells: DataFrame, key: str = "request_id") -> DataFrame:
    """One path per tour from the cells of its legs (key, leg_no, seq, row, col): the first cell of every leg but the first goes."""
    first = F.min("leg_no").over(W.partitionBy(key))
    kept = cells.withColumn("first", first).filter("leg_no = first OR seq > 0")
    seq = F.row_number().over(W.partitionBy(key).orderBy("leg_no", "seq")) - 1
    return kept.select(key, seq.alias("seq"), "row", "col")


def tour_paths(legs: DataFrame, found: Found, key: str = "request_id") -> DataFrame:
    """(key, seq, row, col): the joined path of each tour; ``legs`` as tour_legs gives them, with the status of their routes.

    Distinct legs are walked once, whatever the number of tours that share them.
    """
    ends = ["map_id", "start_row", "start_col", "goal_row", "goal_col"]
    good = legs.filter("status = 'ok'").select(key, "leg_no", *ends)
    cells = route_cells(good.select(*ends).distinct().withColumn("leg", F.xxhash64(*ends)), found, key="leg")
    walked = good.withColumn("leg", F.xxhash64(*ends)).select(key, "leg_no", "leg").join(cells, "leg")
    return join_legs(walked.select(key, "leg_no", "seq", "row", "col"), key)
