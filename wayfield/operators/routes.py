"""Least-cost fields and routes over the road graph, and measures along paths.

The graph is cut into square tiles. For each tile a table says what it costs to go from every cell where
roads enter it to every cell where they leave it (``road_net``, made once a map). Searches run on
these border cells only:

- ``border_costs`` relaxes them by regions of REGION x REGION tiles in rounds: a round settles the regions that were
  offered better costs, writes these alone, and hands on what improved at their borders. A map of one region takes one
  round.
- ``cost_fields`` fills the inside of the tiles once, from the final costs at their borders.
- ``shortest_routes`` (one start, one goal) needs no field: the costs inside the start's tile, the border costs and the
  costs inside the goal's tile meet at the cells where the goal's tile is entered. Searches stop where cost plus the straight line to the
  goals, at the net's least cost a cell, exceeds the best route found.
- ``route_cells`` walks the border cells of a route backwards region by region, then the cells of each
  crossed tile.

User volume never touches this: requests join the routes of their distinct ends.

Costs and lengths are added up as whole numbers of UNIT, so equal routes are equal
whatever the order of their steps and the tile size: the least cost wins, then the
lesser length, then fewer gap cells, then the lesser cell before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grid as G
from ..storage import saved

TILE = 32
REGION = 16  # tiles a side of a region: 512 cells
SOURCES = 64  # sources of a map that are settled together
UNIT = 1e-9
_KEY = ["map_id", "r_row", "r_col", "block"]
_VALUE = ["cost", "length", "gap_cells", "next"]
_ROWS = "source long, cell long, cost long, length long, gap_cells long, next long, changed boolean"
_SHIFT = 1 << 20
_FAR = np.iinfo(np.int64).max >> 1
_COMPACT = 8  # rounds after which what they wrote is written together


def code(row, col):
    """One number for a cell, of any grid under 2**20 columns."""
    return row.cast("long") * _SHIFT + col


def _square(cell: str, size: int, row: str, col: str) -> dict[str, Column]:
    """The square of ``size`` cells a side that a cell lies in."""
    return {row: F.floor(F.floor(F.col(cell) / _SHIFT) / size).cast("int"), col: F.floor((F.col(cell) % _SHIFT) / size).cast("int")}


def settle(state: pd.DataFrame, edges: pd.DataFrame, goals: pd.DataFrame | None = None, least: float = 0.0) -> pd.DataFrame:
    """Costs of some cells and sources to convergence over the given edges.

    ``state``: known values of (source, cell), several a cell are reduced to the least; those ``changed`` are spread.
    ``edges``: src, dst, move_cost, px (both in units), gap_cells. All sources go on together,
    those cells first whose costs are about the least. ``goals`` (source, cell, tail, goal): what is left from a cell to a goal;
    a value is not spread once its cost and the straight line (``least`` units a cell) to the box around its source's goals exceed
    the greatest of what these cost so far.
    """
    cells, where = np.unique(np.concatenate([state["cell"], edges["src"], edges["dst"]]), return_inverse=True)
    known, src, dst = np.split(where, [len(state), len(state) + len(edges)])
    sources, of = np.unique(state["source"].to_numpy(), return_inverse=True)
    n = len(cells)
    at = of * n + known
    best = {c: np.full(len(sources) * n, _FAR) for c in _VALUE}
    fresh = state["changed"].to_numpy(bool)
    # the least value of a place counts, of equal ones that which has been spread already
    order = np.lexsort((fresh, *(state[c] for c in reversed(_VALUE)), at))
    first = order[np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))] if len(order) else order
    for c, v in best.items():
        v[at[first]] = state[c].to_numpy()[first]
    cost, length, gap, following = best.values()
    changed = np.zeros(len(cost), bool)
    changed[at[first]] = fresh[first]
    active = at[first][fresh[first]]
    order = np.argsort(src, kind="stable")
    dst, (w, px, g) = dst[order], (edges[c].to_numpy(np.int64)[order] for c in ("move_cost", "px", "gap_cells"))
    begin = np.searchsorted(src[order], np.arange(n + 1))
    ahead = 2 * int(w.mean()) if len(w) else 0
    hopeful = _bound(cells, sources, goals, least, cost)
    while len(active):
        soon = cost[active] <= cost[active].min() + ahead
        now, later = active[soon], active[~soon]
        now = now[hopeful(now)]
        cell = now % n
        many = begin[cell + 1] - begin[cell]
        e = np.repeat(begin[cell] - np.cumsum(many) + many, many) + np.arange(many.sum())
        origin = np.repeat(now, many)
        to = origin - origin % n + dst[e]
        new = (cost[origin] + w[e], length[origin] + px[e], gap[origin] + g[e], cells[origin % n])
        good = new[0] <= cost[to]
        to, new = to[good], [x[good] for x in new]
        was = [v[to].copy() for v in (cost, length, gap, following)]
        # one value after the other: where it falls, those after it start anew; where it doesn't, the candidate must equal it
        for k, v in enumerate((cost, length, gap, following)):
            np.minimum.at(v, to, new[k])
            fell = to[v[to] < was[k]]
            for rest in (length, gap, following)[k:]:
                rest[fell] = _FAR
            was[k + 1 :] = [np.where(v[to] < was[k], _FAR, x) for x in was[k + 1 :]]
            good = new[k] == v[to]
            to, new, was = to[good], [x[good] for x in new], [x[good] for x in was]
        moved = to[(new[0] != was[0]) | (new[1] != was[1]) | (new[2] != was[2]) | (new[3] != was[3])]
        changed[moved] = True
        active = np.unique(np.concatenate([later, moved]))
    there = np.flatnonzero(cost < _FAR)
    return pd.DataFrame({"source": sources[there // n], "cell": cells[there % n], **{c: v[there] for c, v in best.items()}, "changed": changed[there]})


def _bound(cells: np.ndarray, sources: np.ndarray, goals: pd.DataFrame | None, least: float, cost: np.ndarray):
    """Which places can still lie on a route that is no worse than the best known ones to all goals of their source."""
    if goals is None:
        return lambda places: np.ones(len(places), bool)
    n = len(cells)
    row, col = cells // _SHIFT, cells % _SHIFT
    goals = goals[goals["source"].isin(sources)]
    s = np.searchsorted(sources, goals["source"])
    g_row, g_col = goals["goal"].to_numpy() // _SHIFT, goals["goal"].to_numpy() % _SHIFT
    box = []
    for v, reduce, start in ((g_row, np.minimum, _FAR), (g_row, np.maximum, -1), (g_col, np.minimum, _FAR), (g_col, np.maximum, -1)):
        b = np.full(len(sources), start, np.int64)
        reduce.at(b, s, v)
        box.append(b)
    here = goals["cell"].isin(cells).to_numpy()
    place = np.zeros(len(goals), np.int64)
    place[here] = s[here] * n + np.searchsorted(cells, goals["cell"].to_numpy()[here])
    tail = goals["tail"].to_numpy()
    pair, of = np.unique(np.stack([s, goals["goal"].to_numpy()]), axis=1, return_inverse=True)
    of = of.ravel()

    def hopeful(places: np.ndarray) -> np.ndarray:
        reach = np.full(pair.shape[1], _FAR)
        np.minimum.at(reach, of, np.where(here, np.minimum(_FAR, cost[place] + tail), np.where(goals["cell"].to_numpy() < 0, tail, _FAR)))
        most = np.full(len(sources), -1, np.int64)
        np.maximum.at(most, pair[0], reach)
        s, c = places // n, places % n
        down = np.maximum(0, np.maximum(box[0][s] - row[c], row[c] - box[1][s]))
        side = np.maximum(0, np.maximum(box[2][s] - col[c], col[c] - box[3][s]))
        return cost[places] + np.floor(np.hypot(down, side) * least).astype(np.int64) <= most[s]

    return hopeful


@dataclass
class RoadNet:
    """A road graph cut into tiles. ``inner``: edges within a tile (with t_row, t_col), ``outer``: between tiles,
    ``spans``: the cost from each cell where a tile is entered to each where it is left. All: map_id, src, dst, move_cost, px, gap_cells in units."""

    inner: DataFrame
    outer: DataFrame
    spans: DataFrame
    tile: int

    def turned(self) -> RoadNet:
        """The same net with every edge the other way round."""
        turn = lambda df: df.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in df.columns])
        return RoadNet(turn(self.inner), turn(self.outer), turn(self.spans), self.tile)

    def least(self) -> float:
        """Units of cost that a cell of straight line takes at least, over all edges; a little less, for the rounding of costs."""
        line = F.hypot((F.floor(F.col("src") / _SHIFT) - F.floor(F.col("dst") / _SHIFT)).cast("double"), (F.col("src") % _SHIFT - F.col("dst") % _SHIFT).cast("double"))
        got = self.inner.select("src", "dst", "move_cost").unionByName(self.outer.select("src", "dst", "move_cost")).agg(F.min(F.col("move_cost") / line)).first()[0]
        return max(0.0, (got or 0.0) * (1 - 1e-9))


def net_arcs(edges: DataFrame, cell_size: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(inner, outer): the edges in whole units, within a tile and between tiles."""
    px = F.hypot((F.col("row2") - F.col("row")).cast("double"), (F.col("col2") - F.col("col")).cast("double")) * cell_size
    units = lambda c: F.round(c / UNIT).cast("long")
    arcs = edges.select("map_id", code(F.col("row"), F.col("col")).alias("src"), code(F.col("row2"), F.col("col2")).alias("dst"), units(F.col("move_cost")).alias("move_cost"), units(px).alias("px"), F.col("gap_cells").cast("long").alias("gap_cells"))
    arcs = arcs.withColumns(_square("src", tile, "t_row", "t_col") | _square("dst", tile, "d_row", "d_col"))
    same = (F.col("t_row") == F.col("d_row")) & (F.col("t_col") == F.col("d_col"))
    return arcs.filter(same).drop("d_row", "d_col"), arcs.filter(~same).drop("t_row", "t_col", "d_row", "d_col")


def tile_spans(inner: DataFrame, outer: DataFrame, tile: int = TILE) -> DataFrame:
    """The border-to-border table of every tile, each solved by itself. One cell that is both kinds has no span to itself."""
    enter = outer.select("map_id", F.col("dst").alias("cell"), F.lit(True).alias("enter"))
    ends = enter.unionByName(outer.select("map_id", F.col("src").alias("cell"), F.lit(False).alias("enter"))).distinct().withColumns(_square("cell", tile, "t_row", "t_col"))
    kinds = "map_id int, t_row int, t_col int, src long, dst long, move_cost long, px long, gap_cells long"

    def cross(key: tuple, border: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
        a, b = (border.loc[border["enter"] == k, "cell"].to_numpy() for k in (True, False))
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in kinds.split(", ")})
        got = settle(_starts(a), roads)
        got = got[got["cell"].isin(b) & (got["cell"] != got["source"])]
        named = got.rename(columns={"source": "src", "cell": "dst", "cost": "move_cost", "length": "px"})
        return named.assign(map_id=key[0], t_row=key[1], t_col=key[2])[[c.split()[0] for c in kinds.split(", ")]]

    on = ["map_id", "t_row", "t_col"]
    return ends.groupBy(*on).cogroup(inner.groupBy(*on)).applyInPandas(cross, kinds)


def _starts(cells: np.ndarray) -> pd.DataFrame:
    zero = np.zeros(len(cells), np.int64)
    return pd.DataFrame({"source": cells, "cell": cells, "cost": zero, "length": zero, "gap_cells": zero, "next": zero - 1, "changed": zero == 0})


def road_net(edges: DataFrame, cell_size: int, tile: int = TILE) -> RoadNet:
    """The net of a road graph (``edges`` as build_edges gives them); its tables are saved."""
    inner, outer = (saved(x, "arcs") for x in net_arcs(edges, cell_size, tile))
    return RoadNet(inner, outer, saved(tile_spans(inner, outer, tile), "spans"), tile)


def _inside(rows: DataFrame, net: RoadNet, schema: str = _ROWS) -> DataFrame:
    """``rows`` (map_id, block and what settle takes) settled inside their tiles: map_id, block, t_row, t_col and the settled rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    head = ["map_id", "t_row", "t_col", "block"]

    def fill(key: tuple, mine: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({c: [] for c in [*head, *names]})
        return settle(mine, roads).assign(**dict(zip(head, key, strict=True)))[[*head, *names]]

    placed = rows.withColumns(_square("cell", net.tile, "t_row", "t_col"))
    roads = net.inner.join(placed.select(*[F.col(c).alias(c) for c in head]).distinct(), ["map_id", "t_row", "t_col"]).select(*head, "src", "dst", "move_cost", "px", "gap_cells")
    return placed.groupBy(*head).cogroup(roads.groupBy(*head)).applyInPandas(fill, f"map_id int, t_row int, t_col int, block long, {schema}")


def _offers(border: DataFrame, outer: DataFrame) -> DataFrame:
    """What cells where a tile is left (map_id, block, source, cell, values) offer to those beyond: the least value for each."""
    beyond = outer.select("map_id", F.col("src").alias("cell"), F.col("dst").alias("to"), "move_cost", "px", F.col("gap_cells").alias("g"))
    value = F.struct((F.col("cost") + F.col("move_cost")).alias("cost"), (F.col("length") + F.col("px")).alias("length"), (F.col("gap_cells") + F.col("g")).alias("gap_cells"), F.col("cell").alias("next"))
    best = border.join(beyond, ["map_id", "cell"]).groupBy("map_id", "block", "source", F.col("to").alias("cell")).agg(F.min(value).alias("o"))
    return best.select("map_id", "block", "source", "cell", "o.*")


def blocks_of(sources: DataFrame) -> DataFrame:
    """Distinct sources (map_id, row, col) as map_id, source, block: those of a map that are settled together."""
    start = saved(sources.select("map_id", code(F.col("row"), F.col("col")).alias("source")).distinct(), "sources")
    blocks = start.groupBy("map_id").agg(F.ceil(F.count(F.lit(1)) / SOURCES).alias("blocks"))
    return start.join(blocks, "map_id").select("map_id", "source", F.pmod(F.xxhash64("source"), "blocks").alias("block"))


def _at_source(start: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return start.select("map_id", "block", "source", F.col("source").alias("cell"), zero.alias("cost"), zero.alias("length"), zero.alias("gap_cells"), F.lit(-1).cast("long").alias("next"), F.lit(True).alias("changed"))


def border_costs(near: DataFrame, net: RoadNet, region: int = REGION, goals: DataFrame | None = None, report: list | None = None) -> DataFrame:
    """(map_id, block, source, cell, cost, length, gap_cells, next) of the border cells that the sources reach.

    ``near``: the settled insides of the sources' own tiles. ``next`` is the border cell before: over one edge from another
    tile, or over one span within a tile (-1: within the source's own tile). ``goals`` (map_id, block, source, cell, tail, goal) let searches stop early, see settle; cell -1 holds what a goal
    costs at most. ``report`` gets a row for each round: regions open, rows written.
    """
    size = net.tile * region
    links = net.spans.drop("t_row", "t_col").unionByName(net.outer)
    links = saved(links.withColumns(_square("src", size, "r_row", "r_col") | _square("dst", size, "d_row", "d_col")), "links")
    same = (F.col("r_row") == F.col("d_row")) & (F.col("r_col") == F.col("d_col"))
    arcs = ["src", "dst", "move_cost", "px", "gap_cells"]
    inner, outer = links.filter(same).select("map_id", "r_row", "r_col", *arcs), links.filter(~same).select("map_id", *arcs)
    exits = net.outer.select("map_id", F.col("src").alias("cell")).distinct()
    names = [c.split()[0] for c in _ROWS.split(", ")]
    aimed = goals is not None
    least = net.least() if aimed else 0.0
    first = near.join(exits, ["map_id", "cell"], "left_semi").select("map_id", "block", "source", "cell", "cost", "length", "gap_cells", F.lit(-1).cast("long").alias("next"))
    offers = saved(first.withColumns(_square("cell", size, "r_row", "r_col")), "offers")
    written: list[tuple[DataFrame, DataFrame]] = []  # settled rows and the keys of the regions they are of
    none = F.lit(0).cast("long")
    flags = {"goal": F.lit(-1).cast("long"), "tail": none}

    def relax(key: tuple, mine: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
        is_goal = (mine["goal"] >= 0).to_numpy()
        ends, state = (mine[is_goal] if aimed else None), mine[~is_goal]
        if not len(state):
            return pd.DataFrame({c: [] for c in [*_KEY, *names]})
        return settle(state, roads, ends, least).assign(**dict(zip(_KEY, key, strict=True)))[[*_KEY, *names]]

    def current() -> DataFrame:
        """The last settled rows of every region."""
        out = None
        for k, (rows, _) in enumerate(written):
            later = written[k + 1][1] if k + 1 < len(written) else None
            for _, keys in written[k + 2 :]:
                later = later.unionByName(keys)
            rows = rows if later is None else rows.join(later.distinct(), _KEY, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    while offers.limit(1).count():
        open_ = saved(offers.select(*_KEY).distinct(), "open")
        mine = offers.select(*_KEY, *names[:-1], F.lit(True).alias("changed")).withColumns(flags)
        if written:
            mine = mine.unionByName(current().withColumn("changed", F.lit(False)).join(open_, _KEY, "left_semi").select(*_KEY, *names).withColumns(flags))
        if aimed:
            ends = open_.join(goals, ["map_id", "block"]).select(*_KEY, "source", "cell", *[none.alias(c) for c in _VALUE], F.lit(False).alias("changed"), "goal", "tail")
            mine = mine.unionByName(ends)
        roads = inner.join(open_, ["map_id", "r_row", "r_col"]).select(*_KEY, *arcs)
        settled = saved(mine.groupBy(*_KEY).cogroup(roads.groupBy(*_KEY)).applyInPandas(relax, f"map_id int, r_row int, r_col int, block long, {_ROWS}"), "settled")
        if report is not None:
            report.append({"regions": open_.count(), "rows": settled.count()})
        written.append((settled, open_))
        if len(written) > _COMPACT:
            whole = saved(current(), "settled")
            written[:] = [(whole, saved(whole.select(*_KEY).distinct(), "open"))]
        offers = saved(_offers(settled.filter("changed").drop("r_row", "r_col", "changed"), outer).withColumns(_square("cell", size, "r_row", "r_col")), "offers")
        if aimed and offers.limit(1).count():
            # what each goal costs by now is known to all regions from here on; offers beyond the worst of a source's goals go
            now = settled.join(goals.filter("cell >= 0"), ["map_id", "block", "source", "cell"]).groupBy("map_id", "block", "source", "goal").agg(F.min(F.col("cost") + F.col("tail")).alias("tail"))
            goals = saved(goals.unionByName(now.withColumn("cell", F.lit(-1).cast("long"))), "goals")
            best = goals.groupBy("map_id", "source", "goal").agg(F.coalesce(F.min(F.when(F.col("cell") < 0, F.col("tail"))), F.lit(int(_FAR))).alias("tail"))
            offers = saved(offers.join(best.groupBy("map_id", "source").agg(F.max("tail").alias("limit")), ["map_id", "source"]).filter("cost <= limit").drop("limit"), "offers")
    return (current() if written else offers.withColumn("changed", F.lit(False))).select("map_id", "block", "source", "cell", *_VALUE)


def cost_fields(sources: DataFrame, edges: DataFrame | None, cell_size: int, reverse: bool = False, tile: int = TILE, net: RoadNet | None = None, region: int = REGION, report: list | None = None) -> DataFrame:
    """(map_id, source, cell, cost, length, gap_cells, next) for every reachable cell and each distinct source.

    ``sources``: map_id, row, col. ``next`` is the cell before this one on the
    path from the source; with ``reverse``, the costs are those of going to the
    source, and ``next`` is the cell to go to. The source has next -1. ``net``: the net of the edges, if it is made already.
    """
    net = net or road_net(edges, cell_size, tile)
    net = net.turned() if reverse else net
    start = _at_source(saved(blocks_of(sources), "sources"))
    near = saved(_inside(start, net), "near")
    border = saved(border_costs(near, net, region, report=report), "border")
    into = _offers(border, net.outer).withColumn("changed", F.lit(True)).unionByName(start)
    field = _inside(into, net)
    return field.select("map_id", "source", "cell", (F.col("cost") * UNIT).alias("cost"), (F.col("length") * UNIT).alias("length"), "gap_cells", "next")


@dataclass
class Found:
    """The routes of distinct pairs of ends, and what is needed to walk them."""

    pairs: DataFrame  # map_id, source, goal, cost, length, gap_cells, via: where the goal's tile is entered (null: the route stays in one tile)
    border: DataFrame
    net: RoadNet
    region: int


def find_routes(pairs: DataFrame, net: RoadNet, region: int = REGION, report: list | None = None) -> Found:
    """Least-cost routes of ``pairs`` (map_id, start_row, start_col, goal_row, goal_col; repeated and null ones don't matter), without a field.

    Of equal routes the shorter, then the one with fewer gap cells is taken. ``report``: see border_costs.
    """
    ends = pairs.select("map_id", code(F.col("start_row"), F.col("start_col")).alias("source"), code(F.col("goal_row"), F.col("goal_col")).alias("goal"))
    ends = saved(ends.filter("source IS NOT NULL AND goal IS NOT NULL").distinct(), "pairs")
    cell = lambda c: (F.floor(F.col(c) / _SHIFT).alias("row"), (F.col(c) % _SHIFT).alias("col"))
    start = saved(blocks_of(ends.select("map_id", *cell("source"))), "sources")
    stop = saved(blocks_of(ends.select("map_id", *cell("goal"))), "sources")
    near = saved(_inside(_at_source(start), net), "near")
    last = _inside(_at_source(stop), net.turned()).select("map_id", F.col("source").alias("goal"), "cell", F.col("cost").alias("tail"), F.col("length").alias("tail_length"), F.col("gap_cells").alias("tail_gap"))
    enter = net.outer.select("map_id", F.col("dst").alias("cell")).distinct()
    last = saved(last.join(enter, ["map_id", "cell"], "left_semi"), "tails")
    direct = ends.join(near.select("map_id", "source", F.col("cell").alias("goal"), "cost", "length", "gap_cells"), ["map_id", "source", "goal"])
    direct = saved(direct.withColumn("via", F.lit(None).cast("long")), "direct")
    to_meet = ends.join(last, ["map_id", "goal"])
    known = direct.select("map_id", "source", F.lit(-1).cast("long").alias("cell"), F.col("cost").alias("tail"), "goal")
    goals = to_meet.select("map_id", "source", "cell", "tail", "goal").unionByName(known).join(start, ["map_id", "source"])
    border = saved(border_costs(near, net, region, saved(goals, "goals"), report), "border")
    met = to_meet.join(border.drop("next"), ["map_id", "source", "cell"])
    met = met.select("map_id", "source", "goal", (F.col("cost") + F.col("tail")).alias("cost"), (F.col("length") + F.col("tail_length")).alias("length"), (F.col("gap_cells") + F.col("tail_gap")).alias("gap_cells"), F.col("cell").alias("via"))
    best = direct.unionByName(met).groupBy("map_id", "source", "goal").agg(F.min(F.struct("cost", "length", "gap_cells", "via")).alias("b"))
    return Found(saved(best.select("map_id", "source", "goal", "b.*"), "routes"), border, net, region)


def shortest_routes(pairs: DataFrame, found: Found) -> DataFrame:
    """``pairs`` with status ('ok', 'no_road' where an end is missing, 'no_route'), cost, length_px and gap_cells."""
    p = pairs.withColumn("source", code(F.col("start_row"), F.col("start_col"))).withColumn("goal", code(F.col("goal_row"), F.col("goal_col")))
    out = p.join(found.pairs, ["map_id", "source", "goal"], "left")
    status = F.when(F.col("start_row").isNull() | F.col("goal_row").isNull(), "no_road").when(F.col("cost").isNull(), "no_route").otherwise("ok")
    return out.select(*pairs.columns, (F.col("cost") * UNIT).alias("cost"), (F.col("length") * UNIT).alias("length_px"), "gap_cells", status.alias("status"))


def _border_walk(found: Found) -> DataFrame:
    """(map_id, source, goal, hop, a, b): the steps between border cells of every route, numbered backwards from where the goal's tile is entered."""
    size = found.net.tile * found.region
    key = ["map_id", "r_row", "r_col", "block"]
    blocks = max(1, -(-found.pairs.select("map_id", "source").distinct().count() // SOURCES))
    place = _square("cell", size, "r_row", "r_col") | {"block": F.pmod(F.xxhash64("source"), F.lit(blocks))}  # sources that are walked together
    steps = found.border.withColumns(place).select(*key, "source", "cell", "next")
    at = found.pairs.filter("via IS NOT NULL").select("map_id", "source", "goal", F.lit(0).cast("long").alias("hop"), F.col("via").alias("cell"))
    kinds = "map_id int, source long, goal long, hop long, a long, b long"

    def walk(group: tuple, cursors: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        before = dict(zip(zip(known["source"].tolist(), known["cell"].tolist(), strict=True), known["next"].tolist(), strict=True))
        out = []
        for source, goal, hop, b in cursors[["source", "goal", "hop", "cell"]].itertuples(index=False):
            while (source, b) in before:  # a cell of another region goes on there; -1: the source's tile
                a = before[source, b]
                out.append((group[0], source, goal, hop, a, b))
                hop, b = hop + 1, a
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    whole = None
    at = saved(at, "cursors")
    while at.limit(1).count():
        placed = at.withColumns(place)
        mine = steps.join(placed.select(*[F.col(c).alias(c) for c in key]).distinct(), key, "left_semi")
        hops = saved(placed.groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(walk, kinds), "hops")
        whole = hops if whole is None else whole.unionByName(hops)
        end = hops.groupBy("map_id", "source", "goal").agg(F.max(F.struct("hop", "a")).alias("e")).filter("e.a >= 0")
        at = saved(end.select("map_id", "source", "goal", (F.col("e.hop") + 1).alias("hop"), F.col("e.a").alias("cell")), "cursors")
    return whole if whole is not None else at.select("map_id", "source", "goal", "hop", F.col("cell").alias("a"), F.col("cell").alias("b"))


def _walked(hops: DataFrame, net: RoadNet) -> DataFrame:
    """(map_id, a, b, i, cell): the cells after a up to b of the best way inside their tile, for distinct hops (map_id, a, b)."""
    kinds = "map_id int, a long, b long, i int, cell long"

    def walk(key: tuple, wanted: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
        got = settle(_starts(np.unique(wanted["a"])), roads)
        before = {(s, c): n for s, c, n in zip(got["source"], got["cell"], got["next"], strict=True)}
        out = []
        for a, b in zip(wanted["a"], wanted["b"], strict=True):
            path = [b]
            while path[-1] != a:
                path.append(before[a, path[-1]])
            out += [(key[0], a, b, i, c) for i, c in enumerate(path[-2::-1])]
        return pd.DataFrame(out, columns=[c.split()[0] for c in kinds.split(", ")])

    on = ["map_id", "t_row", "t_col"]
    placed = hops.filter("a != b").withColumns(_square("a", net.tile, "t_row", "t_col"))
    roads = net.inner.join(placed.select(*[F.col(c).alias(c) for c in on]).distinct(), on, "left_semi")
    return placed.groupBy(*on).cogroup(roads.groupBy(*on)).applyInPandas(walk, kinds)


def route_cells(routes: DataFrame, found: Found, key: str = "route_id") -> DataFrame:
    """(key, seq, row, col): the cells of each route of ``routes`` (key, map_id, start_row, start_col, goal_row, goal_col) that was found.

    Border cells are walked backwards by regions; a stretch inside a tile is walked once for all routes that take it.
    """
    ends = ["map_id", "source", "goal"]
    hops = _border_walk(found)
    first = found.pairs.select(*ends, F.lit(1 << 40).alias("hop"), F.col("source").alias("a"), F.lit(None).cast("long").alias("b"), "via")
    # the source's own tile: up to the first border cell, or to the goal itself
    start = hops.filter("a < 0").select(*ends, F.col("b").alias("x"))
    first = first.join(start, ends, "left").select(*ends, "hop", "a", F.coalesce("x", "goal").alias("b"))
    last = found.pairs.filter("via IS NOT NULL").select(*ends, F.lit(-1).cast("long").alias("hop"), F.col("via").alias("a"), F.col("goal").alias("b"))
    steps = saved(first.unionByName(hops.filter("a >= 0")).unionByName(last), "steps")
    tiles = [_square(c, found.net.tile, "row", "col") for c in ("a", "b")]
    inside = (tiles[0]["row"] == tiles[1]["row"]) & (tiles[0]["col"] == tiles[1]["col"])
    steps = steps.withColumn("inside", inside)
    walked = _walked(steps.filter("inside").select("map_id", "a", "b").distinct(), found.net)
    cells = steps.filter("inside").join(walked, ["map_id", "a", "b"]).select(*ends, "hop", "i", "cell")
    cells = cells.unionByName(steps.filter("NOT inside").select(*ends, "hop", F.lit(0).alias("i"), F.col("b").alias("cell")))
    cells = cells.unionByName(found.pairs.select(*ends, F.lit(1 << 41).alias("hop"), F.lit(0).alias("i"), F.col("source").alias("cell")))
    named = routes.select(key, "map_id", code(F.col("start_row"), F.col("start_col")).alias("source"), code(F.col("goal_row"), F.col("goal_col")).alias("goal"))
    seq = F.row_number().over(W.partitionBy(key).orderBy(F.desc("hop"), "i")) - 1
    return named.join(cells, ends).select(key, seq.alias("seq"), F.floor(F.col("cell") / _SHIFT).cast("int").alias("row"), (F.col("cell") % _SHIFT).cast("int").alias("col"))


def route_stats(cells: DataFrame, edges: DataFrame, cell_size: int, key: str = "route_id") -> DataFrame:
    """(key, n_cells, length_px, cost, gap_cells) of each path; ``cells``: key, map_id, seq, row, col, ``edges`` as build_edges gives them.

    A path with a step that is no edge has a null cost.
    """
    w = W.partitionBy(key).orderBy("seq")
    steps = cells.withColumns({"row2": F.col("row"), "col2": F.col("col"), "row": F.lag("row").over(w), "col": F.lag("col").over(w)})
    paid = steps.join(edges.select("map_id", "row", "col", "row2", "col2", "move_cost", F.col("gap_cells").alias("gap")), ["map_id", "row", "col", "row2", "col2"], "left")
    px = F.hypot((F.col("row2") - F.col("row")).cast("double"), (F.col("col2") - F.col("col")).cast("double")) * cell_size
    lost = F.count_if(F.col("row").isNotNull() & F.col("move_cost").isNull())
    return paid.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum(px), F.lit(0.0)).alias("length_px"),
        F.when(lost == 0, F.coalesce(F.sum("move_cost"), F.lit(0.0))).alias("cost"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gap_cells"),
    )


def route_lengths(cells: DataFrame, cell_size: int, key: str = "route_id") -> DataFrame:
    """(key, n_cells, length_px): sum of the distances of successive cell centres."""
    w = W.partitionBy(key).orderBy("seq")
    step = F.hypot((F.col("row") - F.lag("row").over(w)).cast("double"), (F.col("col") - F.lag("col").over(w)).cast("double")) * cell_size
    return cells.withColumn("step", step).groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_px"))


def simplify_paths(cells: DataFrame, key: str = "route_id") -> DataFrame:
    """The first, the last and every cell where the step's direction changes."""
    w = W.partitionBy(key).orderBy("seq")
    sign = lambda c, d: G.step_direction(F.col(c) - F.lag(c).over(w)) if d < 0 else G.step_direction(F.lead(c).over(w) - F.col(c))
    out = cells.withColumns({"r0": sign("row", -1), "r1": sign("row", 1), "c0": sign("col", -1), "c1": sign("col", 1)})
    turn = F.col("r0").isNull() | F.col("r1").isNull() | (F.col("r0") != F.col("r1")) | (F.col("c0") != F.col("c1"))
    return out.filter(turn).select(key, "seq", "row", "col")


def edge_visits(cells: DataFrame, colours: int, key: str = "route_id") -> DataFrame:
    """(key, seq, edge, visit, colour): how often the undirected edge into each cell was passed before, modulo the number of colours."""
    w = W.partitionBy(key).orderBy("seq")
    e = cells.withColumns({"row0": F.lag("row").over(w), "col0": F.lag("col").over(w)}).filter("row0 IS NOT NULL")
    e = e.withColumn("edge", G.edge_key(F.col("row0"), F.col("col0"), F.col("row"), F.col("col")))
    visit = F.row_number().over(W.partitionBy(key, "edge").orderBy("seq")) - 1
    return e.withColumn("visit", visit).select(key, "seq", "edge", "visit", (F.col("visit") % colours).alias("colour"))


def edge_visit_counts(cells: DataFrame, key: str = "route_id") -> DataFrame:
    return edge_visits(cells, 1, key).groupBy(key, "edge").agg(F.count(F.lit(1)).alias("visits"))


def route_runs(visits: DataFrame, key: str = "route_id") -> DataFrame:
    """(key, run, colour, first_seq, last_seq): successive steps of one colour form one line."""
    w = W.partitionBy(key).orderBy("seq")
    change = F.when(F.lag("colour").over(w) == F.col("colour"), 0).otherwise(1)
    runs = visits.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("colour").alias("colour"), (F.min("seq") - 1).alias("first_seq"), F.max("seq").alias("last_seq"))


def segment_annotations(cells: DataFrame, cell_size: int, least: float, key: str = "route_id") -> DataFrame:
    """Midpoint and bearing of every segment of at least ``least`` pixels; ``cells`` is a (simplified) path."""
    w = W.partitionBy(key).orderBy("seq")
    x, y = G.cell_center(F.col("col"), F.lit(cell_size)), G.cell_center(F.col("row"), F.lit(cell_size))
    s = cells.withColumns({"x1": x, "y1": y}).withColumns({"x0": F.lag("x1").over(w), "y0": F.lag("y1").over(w)})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = s.filter(F.hypot(dx, dy) >= least)
    return s.select(key, "seq", ((F.col("x0") + F.col("x1")) / 2).alias("mid_x"), ((F.col("y0") + F.col("y1")) / 2).alias("mid_y"), F.atan2(dy, dx).alias("bearing"), F.hypot(dx, dy).alias("length_px"))

