"""Logs of what sessions do: events, look-ups and their records, with bounded retention and records made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.operators.joins import salted_join

#: Seconds after which an open window closes; within which a query belongs to a command; days that events and look-ups are kept.
IDLE, TOLERANCE, EVENT_HOURS, LOOKUP_DAYS = 7200, 120, 24, 90
#: Bounded memory of what was shown: newest sessions, and keys of each.
SESSIONS, KEYS = 20, 500


def query_hash(text: Column, key: str) -> Column:
    """A keyed hash of a query without its white space, so a log tells equal queries apart without holding them."""
    return F.substring(F.sha2(F.concat(F.lit(key), F.lit("\x1f"), F.trim(F.regexp_replace(text, r"\s+", " "))), 256), 1, 24)


def query_sessions(queries: DataFrame, commands: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """``queries`` (query_key, time) with the ``session`` of the newest command (query_key, time, session) of the same key not after it and at most ``tolerance`` seconds before; null if there is none."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(seconds(c) / tolerance)
    q = queries.withColumn("_id", F.monotonically_increasing_id())
    c = commands.select("query_key", F.col("time").alias("_t"), "session", F.explode(F.array(bucket("time"), bucket("time") + 1)).alias("_b"))
    near = q.withColumn("_b", bucket("time")).join(c, ["query_key", "_b"]).filter((F.col("_t") <= F.col("time")) & (seconds("time") - seconds("_t") <= tolerance))
    best = near.groupBy("_id").agg(F.max(F.struct("_t", "session"))["session"].alias("session"))
    return q.join(best, "_id", "left").drop("_id")


def kept_events(events: DataFrame, now, hours: int = EVENT_HOURS) -> DataFrame:
    """Events of the last hours."""
    return events.filter(F.col("time") >= F.lit(now) - F.expr(f"interval {hours} hours"))


def appended_lookups(log: DataFrame, rows: DataFrame, now, limit: int = 1_000_000, days: int = LOOKUP_DAYS) -> DataFrame:
    """A look-up log with new rows; past ``limit`` rows those older than ``days`` days are dropped."""
    both = log.unionByName(rows)
    return both if both.count() <= limit else both.filter(F.col("at") >= F.lit(now) - F.expr(f"interval {days} days"))


def session_records(events: DataFrame, now) -> DataFrame:
    """(session, start, end, opened, changed, ignored, outcome, record_id) of closed windows in which a shown or other file was opened or changed.

    ``events`` has session, action (query, opened, changed, stop), time, path and shown (array, of queries). A window begins with a query and ends before the session's next one, with the first stop, or after ``IDLE`` seconds;
    one without any of these is open and makes no record yet. ``opened`` and ``changed`` are in the order first seen; ``ignored`` are the first five shown files that were neither, where something was changed. The id comes
    from session and start, so a record made again is the same.
    """
    e = events.filter("session is not null and time is not null").select("session", "action", "time", "path", "shown").distinct()
    marks = e.filter("action in ('query', 'stop')").groupBy("session", "action", "time").agg(F.max("shown").alias("shown"))
    w = Window.partitionBy("session").orderBy("time", F.when(F.col("action") == "query", 0).otherwise(1)).rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("action") == "query", F.col("time")), ignorenulls=True).over(w)
    stop = F.first(F.when(F.col("action") == "stop", F.col("time")), ignorenulls=True).over(w)
    idle = F.col("time") + F.expr(f"interval {IDLE} seconds")
    windows = marks.withColumn("_next", nxt).withColumn("_stop", stop).filter("action = 'query'").select("session", F.col("time").alias("start"), F.least("_next", "_stop", idle).alias("end"), F.when(F.col("_next") <= F.least("_stop", idle), True).otherwise(F.col("_next").isNotNull() & (F.col("_next") <= idle) & (F.col("_stop").isNull() | (F.col("_next") <= F.col("_stop")))).alias("_open"), "shown")
    windows = windows.filter(F.col("end") <= F.lit(now))
    carried = Window.partitionBy("session").orderBy("time", F.when(F.col("action") == "query", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    acts = e.withColumn("start", F.last(F.when(F.col("action") == "query", F.col("time")), ignorenulls=True).over(carried)).filter("action in ('opened', 'changed') and start is not null and path is not null")
    first = acts.groupBy("session", "start", "action", "path").agg(F.min("time").alias("at"))
    inside = first.join(windows, ["session", "start"]).filter(F.when(F.col("_open"), F.col("at") < F.col("end")).otherwise(F.col("at") <= F.col("end")))
    names = lambda a: F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == a, F.struct("at", "path")))), lambda x: x["path"])  # noqa: E731  # the files of one window
    out = inside.groupBy("session", "start", "end").agg(names("opened").alias("opened"), names("changed").alias("changed"), F.max("shown").alias("shown"))
    left = F.slice(F.array_except(F.coalesce("shown", F.array().cast("array<string>")), F.array_union("opened", "changed")), 1, 5)
    rid = F.substring(F.sha2(F.concat_ws("\x1f", "session", F.col("start").cast("string")), 256), 1, 24)
    return out.select("session", "start", "end", "opened", "changed", F.when(F.size("changed") > 0, left).otherwise(F.array().cast("array<string>")).alias("ignored"), F.lit("unknown").alias("outcome"), rid.alias("record_id"))


def new_records(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose id is not known yet."""
    return records.join(known.select("record_id").distinct(), "record_id", "left_anti")


def first_shown(events: DataFrame) -> DataFrame:
    """(session, key, time): each key of a session at its first time, for the newest ``SESSIONS`` sessions and the newest ``KEYS`` keys of each."""
    first = events.filter("session is not null and key is not null").groupBy("session", "key").agg(F.min("time").alias("time"))
    last = first.groupBy("session").agg(F.max("time").alias("_t")).orderBy(F.desc("_t"), "session").limit(SESSIONS)
    rows = first.join(F.broadcast(last.select("session")), "session")  # SESSIONS rows
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("time"), "key"))).filter(F.col("_p") <= KEYS).drop("_p")


def was_shown(asked: DataFrame, shown: DataFrame, hours: int = EVENT_HOURS) -> DataFrame:
    """(session, path, time, shown): whether each asked file (session, path, time) was shown in its session before, within the hours."""
    s = shown.groupBy("session", "path").agg(F.sort_array(F.collect_set("time")).alias("_ts"))  # the times one file was shown in one session
    hit = F.exists("_ts", lambda t: (t <= F.col("time")) & (t >= F.col("time") - F.expr(f"interval {hours} hours")))
    return asked.join(s, ["session", "path"], "left").select("session", "path", "time", F.coalesce(hit, F.lit(False)).alias("shown"))


def notes(events: DataFrame, most: int = 5) -> DataFrame:
    """(session, query, files): each session's last query and the files it touched since, newest first: what a summary of the session keeps."""
    last = events.filter("action = 'query'").groupBy("session").agg(F.max(F.struct("time", "query")).alias("q"))
    touched = events.filter("action in ('opened', 'changed') and path is not null").groupBy("session", "path").agg(F.max("time").alias("time"))
    rows = salted_join(touched, last.select("session", F.col("q.time").alias("_t")), ["session"], ["path"]).filter("time >= _t")
    top = rows.withColumn("_p", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("time"), "path"))).filter(F.col("_p") <= most)
    files = top.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "path"))), lambda x: x["path"]).alias("files"))
    return last.select("session", "q.query").join(files, "session", "left")


def ranged_reads(rows: DataFrame) -> DataFrame:
    """(session, rel_path, whole, read, saved): tokens of a file, of the lines asked for (``offset`` from one, ``limit`` lines) and their difference, a quarter of a token for each sign, halves to the even."""
    lines = F.split("content", "\n")
    part = F.array_join(F.slice(lines, F.greatest(F.col("offset"), F.lit(1)), F.greatest(F.col("limit"), F.lit(0))), "\n")
    whole, read = F.bround(F.char_length("content") / 4).cast("bigint"), F.bround(F.char_length(part) / 4).cast("bigint")
    return rows.select("session", "rel_path", whole.alias("whole"), read.alias("read"), F.greatest(whole - read, F.lit(0)).alias("saved"))


def stable_pending(polls: DataFrame) -> DataFrame:
    """(poll, refresh): whether the set of pending paths (poll, path) is not empty and the same as at the poll before: a refresh waits until changes have settled."""
    sets = polls.groupBy("poll").agg(F.array_sort(F.collect_set("path")).alias("s"))  # the pending paths of one poll
    before = F.lag("s").over(Window.orderBy("poll"))  # one row a poll
    return sets.select("poll", (F.coalesce(before == F.col("s"), F.lit(False)) & (F.size("s") > 0)).alias("refresh"))
