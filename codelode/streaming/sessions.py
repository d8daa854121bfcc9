"""Session windows over an event log, in batch and as a stream.

A window opens with a query and closes with the session's next query, its first stop, or
two hours without either. Files opened or changed inside belong to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IDLE = "2 hours"


def windows(events: DataFrame) -> DataFrame:
    """(session, start, end): the windows of (session, action, time, path) events, action one of query, opened, changed, stop.

    The end is the next query (not inside), else the first stop after the
    start (inside), else two hours later, whichever is first. Repeated queries of one time are one.
    """
    marks = events.filter(F.col("action").isin("query", "stop") & F.col("session").isNotNull() & F.col("time").isNotNull()).select("session", "action", "time").distinct()
    w = Window.partitionBy("session").orderBy("time", "action").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("action") == "query", F.col("time")), ignorenulls=True).over(w)
    stop = F.first(F.when(F.col("action") == "stop", F.col("time")), ignorenulls=True).over(w)
    rows = marks.withColumn("_q", nxt).withColumn("_s", stop).filter("action = 'query'")
    idle = F.col("time") + F.expr(f"interval {IDLE}")
    return rows.select("session", F.col("time").alias("start"), F.least("_q", "_s", idle).alias("end"))


def records(events: DataFrame) -> DataFrame:
    """(session, start, end, opened, changed): how many different files each window opened and changed; windows without any make no record.

    Events are put behind the last query of their session by one sort, not by a range join.
    """
    rows = events.filter(F.col("session").isNotNull() & F.col("time").isNotNull()).select("session", "action", "time", "path").distinct()
    rank = F.when(F.col("action") == "query", 0).otherwise(1)
    w = Window.partitionBy("session").orderBy("time", rank).rowsBetween(Window.unboundedPreceding, 0)
    tagged = rows.withColumn("start", F.last(F.when(F.col("action") == "query", F.col("time")), ignorenulls=True).over(w)).filter(F.col("action").isin("opened", "changed") & F.col("start").isNotNull())
    inside = tagged.join(windows(events), ["session", "start"]).filter(F.col("time") <= F.col("end"))
    out = inside.groupBy("session", "start", "end").agg(
        F.countDistinct(F.when(F.col("action") == "opened", F.col("path"))).alias("opened"), F.countDistinct(F.when(F.col("action") == "changed", F.col("path"))).alias("changed")
    )
    return out


def once_per_query(queries: DataFrame, delay: str = "24 hours") -> DataFrame:
    """A stream of (session, query, time) with each (session, query) once within ``delay``; state is dropped by the watermark."""
    return queries.withWatermark("time", delay).dropDuplicatesWithinWatermark(["session", "query"])


def idle_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of (session, start, end, events) for sessions closed by two idle hours."""
    return (
        events.withWatermark("time", delay).groupBy("session", F.session_window("time", IDLE).alias("w")).agg(F.count("*").alias("events"))
        .select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )
