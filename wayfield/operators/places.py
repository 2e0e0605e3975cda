"""Places: search, lookup by text or id, gates, request validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text
from ..storage import saved

GRAMS = (1, 2, 3, 4, 6, 8)  # lengths of substrings that searches go by


def dedup_places(places: DataFrame, order: str = "part") -> DataFrame:
    """The table that lookups by id use: of places that share an id on a map the last in input order (``order``) is found. Lists and searches keep all."""
    rank = F.row_number().over(W.partitionBy("map_id", "id").orderBy(F.desc(order)))
    return places.withColumn("rank", rank).filter("rank = 1").drop("rank")


def by_id(*more: str) -> list[Column]:
    """The order of place lists: by id as a reader of any language expects it (punctuation, digits, letters; case last), then ``more``."""
    return [F.collate(F.col("id"), "UNICODE"), *map(F.col, more)]


def numbered(places: DataFrame, order: str = "part") -> DataFrame:
    """With copy, the number of a place among those that share its id on a map, in input order."""
    return places.withColumn("copy", F.row_number().over(W.partitionBy("map_id", "id").orderBy(order)))


def sorted_places(places: DataFrame, order: str = "part") -> DataFrame:
    """With pos, the place's number within its map in the order of ids; places of one id stay in input order."""
    return places.withColumn("pos", F.row_number().over(W.partitionBy("map_id").orderBy(*by_id(order))))


def grams(c: Column, lengths: list[int]) -> Column:
    """The distinct substrings of these lengths."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({t[i : i + n] for n in lengths for i in range(len(t) - n + 1)}) if t else [])

    return cut(c)


def meeting(needles: DataFrame, texts: DataFrame, on: list[str] = []) -> DataFrame:  # noqa: B006
    """``needles`` (needle, not empty, and ``on``) with the ``texts`` (text, ``on`` and more) that may contain them.

    No theta join: a needle meets the texts that hold its rarest substring of the greatest length of GRAMS
    it has. A needle with a substring no text has meets none. Lengths no needle asks for are not
    taken of the texts. Both sides grow with their tables, and many times beyond the files they come from: they are merged, never broadcast.
    """
    tasks = needles.sparkSession.sparkContext.defaultParallelism
    size = F.greatest(*[F.when(F.length("needle") >= n, F.lit(n)) for n in GRAMS], F.lit(1))
    needles = saved(needles.select(*on, "needle").distinct().withColumn("size", size).repartition(tasks), "needles")
    texts = saved(texts.repartition(tasks).withColumn("text_no", F.monotonically_increasing_id()), "texts")
    used = sorted(r["size"] for r in needles.select("size").distinct().collect())  # at most len(GRAMS) numbers
    held = saved(texts.select(*on, "text_no", F.explode(grams(F.col("text"), used)).alias("gram")), "grams")
    times = held.groupBy(*on, "gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.explode(grams(F.col("needle"), used)).alias("gram")
    asked = needles.select(*on, "needle", "size", own).filter(F.length("gram") == F.col("size")).join(times.hint("merge"), [*on, "gram"], "left")
    best = asked.groupBy(*on, "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
    near = best.select(*on, "needle", F.col("least.gram").alias("gram")).join(held.hint("merge"), [*on, "gram"]).select("needle", "text_no")
    return near.join(texts.hint("merge"), "text_no").drop("text_no")


def containing(needles: DataFrame, texts: DataFrame, on: list[str] = []) -> DataFrame:  # noqa: B006
    """``needles`` with the ``texts`` that contain them: those of meeting, checked."""
    return meeting(needles, texts, on).filter(F.col("text").contains(F.col("needle")))


def search_places(queries: DataFrame, places: DataFrame, limit: int = P.SEARCH_LIMIT, order: str = "part") -> DataFrame:
    """(keyword, map_id, rank, id, title, subtitle): the first ``limit`` places by id whose id and name hold the keyword.

    Case and white space don't matter; an empty keyword finds all. Distinct keywords are searched once. Places that share an id are all found, in input order.
    """
    packed = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    q = queries.select("keyword").distinct().withColumn("needle", packed(F.col("keyword")))
    p = numbered(places, order)
    p = p.select("map_id", "id", "copy", "name", packed(F.concat_ws(" ", "id", "name")).alias("text"))
    hit = containing(q.filter("needle != ''"), p).select("needle", "map_id", "id", "copy", "name")
    rank = lambda *part: F.row_number().over(W.partitionBy("map_id", *part).orderBy(*by_id("copy")))
    hit = hit.withColumn("rank", rank("needle")).filter(F.col("rank") <= limit)
    every = numbered(places, order).select(F.lit("").alias("needle"), "map_id", "id", "copy", "name").withColumn("rank", rank()).filter(F.col("rank") <= limit)
    out = q.join(hit.unionByName(every).hint("merge"), "needle")
    return out.select("keyword", "map_id", "rank", "id", text.option_title(F.col("id"), F.col("name")).alias("title"), text.option_subtitle(F.col("id"), F.col("name")).alias("subtitle"))


def resolve_places(requests: DataFrame, places: DataFrame, limit: int = P.AMBIGUOUS_LIMIT, order: str = "part") -> DataFrame:
    """(request_id, map_id, place, status, candidates) of requests with a place text or a selected id.

    A selected id wins; then the exact id; then a part of id or name without
    case: one match is it, several are 'ambiguous' (the first ids by id order; places that share an id are several), none is
    'not_found'; blank text is 'empty'. Distinct texts are resolved once.
    """
    r = requests.select("request_id", "map_id", text.trim(F.coalesce("place_text", F.lit(""))).alias("value"), "place_id")
    ids = dedup_places(places, order).select("map_id", F.col("id").alias("exact"))
    wanted = F.coalesce("place_id", "value")
    # distinct texts meet the places, not requests
    named = r.select("map_id", wanted.alias("wanted")).distinct()
    known = named.join(ids.hint("merge"), (named.map_id == ids.map_id) & (named.wanted == ids.exact)).select(named.map_id, "exact")
    known = saved(known, "known").select(F.col("map_id").alias("of"), "exact")
    found_ids = r.join(known, (r.map_id == known.of) & (wanted == known.exact), "left").drop("of")
    asked = found_ids.filter("exact IS NULL AND place_id IS NULL AND value != ''").select("map_id", F.lower("value").alias("needle"))
    p = numbered(places, order).select("map_id", "id", "copy", F.lower("id").alias("low_id"), F.lower("name").alias("low_name"))
    p = p.withColumn("text", F.concat_ws("\n", "low_id", "low_name"))
    hit = containing(asked, p, ["map_id"]).filter("contains(low_id, needle) OR contains(low_name, needle)").select("map_id", "needle", "id", "copy")
    # the first ids by rank, so that no list grows with the number of matches; two tell one match from several
    hit = hit.withColumn("rank", F.row_number().over(W.partitionBy("map_id", "needle").orderBy(*by_id("copy")))).filter(F.col("rank") <= max(2, limit))
    first = F.sort_array(F.collect_list(F.when(F.col("rank") <= limit, F.struct("rank", "id"))))
    found = saved(hit.groupBy("map_id", "needle").agg(F.count(F.lit(1)).alias("n"), F.transform(first, lambda s: s["id"]).alias("first")), "found")
    out = found_ids.withColumn("needle", F.lower("value")).join(found, ["map_id", "needle"], "left")
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("exact").isNotNull(), "ok").when(F.col("place_id").isNotNull(), "not_found").when(F.col("value") == "", "empty")
        .when(n == 1, "ok").when(n > 1, "ambiguous").otherwise("not_found")
    )
    return out.select(
        "request_id", "map_id", F.coalesce("exact", F.when(F.col("place_id").isNull() & (n == 1), F.get("first", F.lit(0)))).alias("place"), status.alias("status"),
        F.when(F.col("exact").isNull() & F.col("place_id").isNull() & (n > 1), F.array_join("first", ", ")).alias("candidates"),
    )


def gates_of(open_gates: DataFrame, places: DataFrame, order: str = "part") -> DataFrame:
    """Open gates that exist, with their anchors, as a lookup by id finds them; list ids without a place are skipped."""
    anchor = F.coalesce("access", "center")
    return open_gates.join(dedup_places(places, order).select("map_id", "id", "name", anchor.alias("anchor")), ["map_id", "id"]).select(
        "map_id", "id", "name", "gate_order", F.col("anchor.x").alias("x"), F.col("anchor.y").alias("y")
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """``requests`` (typed) with status: the first rule that fails, or 'ok'.

    Optional columns say what the user confirmed before: pending_start,
    confirmed_text, confirmed_key; without them only the numbers are checked.
    """
    has = set(requests.columns)
    key = text.point_key(F.col("goal_x"), F.col("goal_y"))
    point = ~text.finite(F.col("goal_x")) | ~text.finite(F.col("goal_y"))
    rules = [(~text.finite(F.col("start_x")) | ~text.finite(F.col("start_y")), "missing_start")]
    if "pending_start" in has:
        rules.insert(0, (F.coalesce("pending_start", F.lit(False)), "missing_start"))
    by_place = F.coalesce(text.trim(F.col("place_text")), F.lit("")) != ""
    rules.append((~by_place & F.col("goal_x").isNull() & F.col("goal_y").isNull(), "missing_destination"))
    if "confirmed_text" in has:
        rules.append((by_place & (text.trim(F.col("place_text")) != F.coalesce("confirmed_text", F.lit(""))), "text_changed"))
    if "confirmed_key" in has:
        rules.append((~by_place & ~point & (key != F.coalesce("confirmed_key", F.lit(""))), "goal_changed"))
    rules.append((~by_place & point, "bad_goal"))
    status = F.lit("ok")
    for rule, name in reversed(rules):
        status = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(status)
    return requests.withColumn("status", status)


def route_starts(requests: DataFrame, live: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(request_id, map_id, x, y, source): the user's live place, else the confirmed start, else the typed one."""
    at = live.filter("inside_map").select("map_id", "user_id", F.struct("x", "y").alias("live"))
    out = requests.join(at, ["map_id", "user_id"], "left")
    if confirmed is None:
        out = out.withColumn("sure", F.lit(None).cast("struct<x:double,y:double>"))
    else:
        out = out.join(confirmed.select("map_id", "user_id", F.struct("x", "y").alias("sure")), ["map_id", "user_id"], "left")
    typed = F.when(text.finite(F.col("start_x")) & text.finite(F.col("start_y")), F.struct(F.col("start_x").alias("x"), F.col("start_y").alias("y")))
    pick = F.coalesce("live", "sure", typed)
    source = F.when(F.col("live").isNotNull(), "live").when(F.col("sure").isNotNull(), "confirmed").when(typed.isNotNull(), "typed")
    return out.select("request_id", "map_id", pick["x"].alias("x"), pick["y"].alias("y"), source.alias("source"))
