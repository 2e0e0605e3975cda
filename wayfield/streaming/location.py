"""Location and heading of every user: a keyed aggregate for streams, a running window for batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text
from ..operators.projection import project_fixes

_LOCATING = ("start", "tracking_begun", "reset")
_FAILED = ("error", "permission_denied")


def mark_events(events: DataFrame, projectors: DataFrame, maps: DataFrame) -> DataFrame:
    """Each event with what it sets: location, last_fix, heading and status as wrapped structs, null where it sets nothing.

    A wrapped null ("set to nothing") differs from an event that leaves the value alone. Batch or stream.
    """
    fixes = project_fixes(events.filter("kind = 'fix'"), projectors, maps)
    fixes = fixes.withColumns({"kind": F.lit("fix"), "direction": F.lit(None).cast("double")})
    rest = events.filter("kind != 'fix' AND (kind != 'compass' OR direction IS NOT NULL)").filter((F.col("kind") != "compass") | text.finite(F.col("direction")))
    rest = rest.select("map_id", "user_id", "event_id", "ts", "longitude", "latitude", *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "accuracy")],
                       F.lit(False).alias("inside_map"), F.lit(None).cast("string").alias("status"), "kind", "direction")
    e = fixes.unionByName(rest)
    here = F.when(F.col("inside_map"), F.struct("x", "y", F.col("longitude").alias("lng"), F.col("latitude").alias("lat"), "accuracy"))
    fix, reset = F.col("kind") == "fix", F.col("kind") == "reset"
    wrap = lambda cond, value: F.when(cond, F.struct(value.alias("v")))
    status = (
        F.when(F.col("kind").isin(*_LOCATING), "locating").when(F.col("kind").isin(*_FAILED), "failed").when(F.col("kind") == "stop", "idle")
        .when(fix & F.col("inside_map"), "tracking").when(fix, "failed")
    )
    at = F.struct(F.col("longitude").alias("lng"), F.col("latitude").alias("lat"))
    return e.select(
        "map_id", "user_id", "event_id", "ts", "kind",
        wrap(fix | reset, here).alias("location"), wrap(fix | reset, F.when(fix, at)).alias("last_fix"),
        wrap((F.col("kind") == "compass") | reset, F.col("direction")).alias("heading"), wrap(status.isNotNull(), status).alias("state"),
    )


def _order() -> Column:
    return F.struct("ts", "event_id")


def location_state(events: DataFrame, projectors: DataFrame, maps: DataFrame) -> DataFrame:
    """One row per (map_id, user_id): the last event that sets a column gives its value. For a stream: update mode.

    The order is (ts, event_id), so late events find their place and no watermark is needed.
    """
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), _order()))
    s = mark_events(events, projectors, maps).groupBy("map_id", "user_id").agg(*[last(c).alias(c) for c in ("location", "last_fix", "heading", "state")], F.max(_order()).alias("latest"))
    return _flat(s, F.col("latest.event_id"))


def _flat(s: DataFrame, event_id: Column) -> DataFrame:
    here, fix = F.col("location.v"), F.col("last_fix.v")
    return s.select(
        "map_id", "user_id", event_id.alias("event_id"), here["x"].alias("x"), here["y"].alias("y"), here["accuracy"].alias("accuracy"),
        here.isNotNull().alias("inside_map"), fix.isNotNull().alias("has_fix"), F.col("heading.v").alias("heading"), F.coalesce(F.col("state.v"), F.lit("idle")).alias("status"),
    )


def status_timeline(events: DataFrame, projectors: DataFrame, maps: DataFrame) -> DataFrame:
    """The state after every event (batch): its last row per user equals location_state."""
    w = W.partitionBy("map_id", "user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    m = mark_events(events, projectors, maps)
    return _flat(m.select("map_id", "user_id", "event_id", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("location", "last_fix", "heading", "state")]), F.col("event_id"))


def poll_fixes(fixes: DataFrame, every: str = P.POLL, late: str = "10 minutes") -> DataFrame:
    """One fix per user and interval, the last of each. For a stream: append mode; later rows than the watermark go."""
    f = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    last = F.max_by(F.struct("event_id", "x", "y"), _order())
    g = f.groupBy(F.window("ts", every).alias("w"), "map_id", "user_id").agg(last.alias("l"))
    return g.select("map_id", "user_id", F.col("w.start").alias("window_start"), "l.event_id", "l.x", "l.y")
