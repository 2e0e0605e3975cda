"""Column functions over names, numbers in text, and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P

_EDGE = r"(?U)^\s+|\s+$"


def trim(c: Column) -> Column:
    """Without the white space at both ends, Unicode's included."""
    return F.regexp_replace(c, _EDGE, "")


def js_number(c: Column) -> Column:
    """Number of a text field: blank is 0, anything that isn't a number is NaN; a null stays null."""
    t = trim(c)
    based = [(r"^0[xX][0-9a-fA-F]{1,15}$", 16), (r"^0[oO][0-7]{1,20}$", 8), (r"^0[bB][01]{1,62}$", 2)]
    plain = t.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$")
    number = F.when(c.isNull(), F.lit(None).cast("double")).when(t == "", 0.0).when(plain, t.try_cast("double"))
    for form, base in based:
        number = number.when(t.rlike(form), F.conv(F.substring(t, 3, 64), base, 10).try_cast("double"))
    return number.otherwise(float("nan"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def fixed_two(x: Column) -> Column:
    """Two decimals of the exact binary value, an exact half away from zero: 1.005 (a little less in binary) is 1.00, 0.125 is 0.13."""
    a = F.abs(x)
    whole = F.floor(a)
    part = F.floor((a - whole) * F.lit(float(1 << 60))).cast("long")  # the digits after the point in steps of 2**-60: no bit that counts is below
    high, low = F.shiftright(part, 30), part.bitwiseAND(F.lit((1 << 30) - 1))
    hundredths = F.shiftright(high * 100 + (1 << 29) + F.shiftright(low * 100, 30), 30)
    cents = whole.cast("long") * 100 + hundredths
    digits = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    large = F.format_string("%.2f", x)
    return F.when(F.isnan(x), "NaN").when(a == float("inf"), F.when(x < 0, "-Infinity").otherwise("Infinity")).when(a < 1e12, digits).otherwise(large)


def point_key(x: Column, y: Column) -> Column:
    return F.concat_ws(",", fixed_two(x.cast("double")), fixed_two(y.cast("double")))


def name_parts(name: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), "/"), trim), lambda p: p != "")


def primary_name(name: Column) -> Column:
    return F.coalesce(F.get(name_parts(name), F.lit(0)), F.lit(""))


def secondary_name(name: Column) -> Column:
    parts = name_parts(name)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " / ")


def destination_input(pid: Column, name: Column) -> Column:
    return F.concat(pid, F.lit(" / "), name)


def option_title(pid: Column, name: Column) -> Column:
    first = primary_name(name)
    return F.when((first != "") & (first != pid), first).otherwise(pid)


def option_subtitle(pid: Column, name: Column) -> Column:
    return F.array_join(F.filter(F.array(pid, secondary_name(name)), lambda p: p != ""), " / ")


def picker_label(pid: Column, name: Column) -> Column:
    return F.concat(pid, F.lit("  "), name)


def stop_names(names: Column, limit: int = P.NAME_LIMIT) -> Column:
    """Names joined by arrows; past the limit the number of all follows."""
    shown = F.array_join(F.slice(names, 1, limit), " → ")
    return F.when(F.size(names) > limit, F.concat(shown, F.lit(" → 等 "), F.size(names).cast("string"), F.lit(" 处"))).otherwise(shown)


def whole_px(length: Column) -> Column:
    """A length without decimals, halves up."""
    return F.round(length).cast("double")


def route_summary(n_cells: Column, length: Column, gap_cells: Column) -> Column:
    return F.format_string(P.ROUTE_TEXT, n_cells.cast("long"), whole_px(length), gap_cells.cast("long"))


def tour_summary(source: Column, stops: Column, length: Column, skipped: Column) -> Column:
    """``source`` says where the tour starts; skipped stops are named only if there are any."""
    said = F.format_string(P.TOUR_TEXT, source, stops.cast("long"), whole_px(length))
    return F.concat(said, F.when(skipped > 0, F.format_string(P.TOUR_SKIPPED_TEXT, skipped.cast("long"))).otherwise(""))


def exit_summary(pid: Column, name: Column, length: Column) -> Column:
    return F.format_string(P.EXIT_TEXT, place_label(pid, name), whole_px(length))


def place_label(pid: Column, name: Column) -> Column:
    """The first part of the name, or the id where there is none."""
    return F.coalesce(F.nullif(primary_name(name), F.lit("")), pid)


def fix_accuracy(horizontal: Column, other: Column) -> Column:
    """The first usable of both accuracies (0 falls through to the second); what isn't finite is null."""
    best = F.when(horizontal.isNull() | (horizontal == 0) | F.isnan(horizontal), other).otherwise(horizontal)
    return F.when(finite(best), best)


def pixel_correction(v: Column, d: Column) -> Column:
    return v + F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0))


def heading_vector(direction: Column, north_offset: Column) -> tuple[Column, Column]:
    a = F.radians(direction - north_offset)
    return F.sin(a), -F.cos(a)
