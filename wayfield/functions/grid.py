"""Column functions over pixels, cells and step costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def pixel_to_cell(v: Column, cell_size: Column, cells: Column) -> Column:
    """Row or column index of a pixel coordinate, clamped into the grid."""
    return clamp(F.floor(v / cell_size), F.lit(0).cast("long"), (cells - 1).cast("long"))


def cell_center(index: Column, cell_size: Column) -> Column:
    return (index + F.lit(0.5)) * cell_size


def cell_id(row: Column, col: Column, width: Column) -> Column:
    return row.cast("long") * width + col


def cell_row(cid: Column, width: Column) -> Column:
    return F.floor(cid / width)


def cell_col(cid: Column, width: Column) -> Column:
    return cid % width


def in_bounds(row: Column, col: Column, height: Column, width: Column) -> Column:
    return (row >= 0) & (row < height) & (col >= 0) & (col < width)


def inside_map(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Both ends belong to the map."""
    return x.between(0, width) & y.between(0, height)


def screen_to_map(v: Column, offset: Column, scale: Column) -> Column:
    return (v - offset) / scale


def step_base_cost(dr: Column, dc: Column) -> Column:
    return F.when((dr != 0) & (dc != 0), F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0))


def road_width_cost_factor(clearance: Column, auto: Column, manual: Column, bias: float = P.ROAD_BIAS) -> Column:
    """Cost of entering a cell per unit of step; ``manual`` is null where the map has no main-road layer."""
    c = F.greatest(F.lit(1), clearance)
    layer = manual.isNotNull()
    m = F.coalesce(manual, F.lit(0)).cast("double")
    narrow = 1 + F.lit(bias * 1.8) / F.pow(c.cast("double"), F.lit(1.7))
    width = F.least(c - 1, F.lit(6)) * F.lit(bias) * F.when(layer, 0.02).otherwise(0.04)
    main = auto * F.lit(bias) * F.when(layer, 0.12).otherwise(0.42)
    missing = F.when(layer, (1 - m) * F.lit(bias) * 0.28).otherwise(0.0)
    return F.greatest(F.lit(1.0), narrow + missing - width - main - m * F.lit(bias) * 0.48)


def main_road_departure_penalty(current: Column, following: Column, base: Column, bias: float = P.ROAD_BIAS) -> Column:
    """What a step off the main road costs on top; ``following`` is null where the map has no layer."""
    leaving = F.when(F.coalesce(current, F.lit(0)) > 0, F.lit(bias * 4)).otherwise(0.0)
    return F.when(following.isNull() | (following > 0), F.lit(0.0)).otherwise(base * F.lit(bias) * 1.15 + leaving)


def move_cost(base: Column, factor: Column, penalty: Column, gap: Column, gap_penalty: float = P.GAP_PENALTY) -> Column:
    return (base * factor + penalty) * F.when(gap > 0, F.lit(gap_penalty)).otherwise(1.0)


def step_direction(delta: Column) -> Column:
    return F.signum(delta.cast("double")).cast("int")


def straight_line_cells(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.hypot((r1 - r2).cast("double"), (c1 - c2).cast("double"))


def edge_key(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """Undirected key: the two "row,col" texts in text order."""
    a, b = F.concat_ws(",", r1, c1), F.concat_ws(",", r2, c2)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def tour_zone(x: Column, y: Column, width: Column, height: Column, zones: int = P.ZONES) -> Column:
    part = lambda v, size: clamp(F.floor(v / (size / F.lit(zones))), F.lit(0).cast("long"), F.lit(zones - 1).cast("long"))
    return F.concat_ws("-", part(y, height), part(x, width))


def tour_candidate_weight(kind: Column, is_open: Column, is_dorm: Column, is_key: Column, weights: dict[str, int] | None = None) -> Column:
    """0 where the place can't be a stop; the three flags say in which id lists it is."""
    table = F.create_map(*[F.lit(x) for pair in (weights or P.TYPE_WEIGHTS).items() for x in pair])
    base = F.coalesce(table[kind], F.lit(0))
    out = ((kind == "dormitory") & ~is_dorm) | ((kind == "gate") & ~is_open) | ((kind == "building") & ~is_key) | (base == 0)
    return F.when(out, 0).when(is_key, base + P.KEY_BONUS).when(is_dorm, base + P.DORM_BONUS).otherwise(base)


def tour_score(weight: Column, distance: Column, new_zone: Column, boosted: Column) -> Column:
    gain = weight * F.when(new_zone, P.ZONE_BOOST).otherwise(1.0) * F.when(boosted, P.TYPE_BOOST).otherwise(1.0)
    return gain / F.pow(F.greatest(F.lit(P.TOUR_FLOOR), distance) / P.TOUR_SCALE + 1, F.lit(P.TOUR_POWER))
