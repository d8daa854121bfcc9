"""Search in a root's history, and what became of files that are named but not there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.query import is_file_name, mentions, plain_tokens, words
from codelode.operators.joins import salted_join
from codelode.operators.lookup import best_of, bm25

WORD = {"A": "added", "D": "deleted", "R": "renamed", "M": "modified", "T": "retyped"}


def commit_table(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(root_id, id, sha, commit_date, subject, body, paths, files): the newest delivery of each commit with its files as (status, path, old_path), in order."""
    c = commits.filter("root_id is not null and sha is not null and id is not null")
    last = c.groupBy("root_id", "sha").agg(F.max(F.struct("id", "commit_date", "subject", "body")).alias("c")).select("root_id", "sha", "c.*")
    f = commit_files.filter("path is not null").select("commit_id", F.struct("status", "path", "old_path").alias("f")).distinct().groupBy(F.col("commit_id").alias("id")).agg(F.array_sort(F.collect_list("f")).alias("files"))  # the files of one commit
    rows = last.join(f, "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<status:string,path:string,old_path:string>>")))
    text = F.concat_ws(" ", F.transform("files", lambda x: F.concat_ws(" ", x["path"], x["old_path"])))
    return rows.withColumn("paths", plain_tokens(F.concat_ws(" ", text)))


def _phrase(tokens: list[str]):
    """Whether the tokens follow each other in ``paths``."""
    return F.contains(F.concat(F.lit(" "), F.array_join("paths", " "), F.lit(" ")), F.lit(" " + " ".join(tokens) + " "))


def search(table: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(root_id, place, sha, id, subject, files, rank): commits for a query. Paths in it must stand in a commit's paths as they are; other words count by BM25 over
    subject and body, where a word counts all that begin with it. Equal ranks go to the newer commit."""
    paths = [m for m in mentions(text) if "/" in m or is_file_name(m)]
    rest = text
    for p in paths:
        rest = rest.replace(p, " ")
    terms, rows = words(rest), table
    hit = F.lit(False)
    for p in paths:
        hit = hit | _phrase([t for t in re.split(r"[^a-z0-9]+", p.lower()) if t])
    rows = rows.withColumn("_subject", plain_tokens(F.coalesce("subject", F.lit("")))).withColumn("_body", plain_tokens(F.coalesce("body", F.lit(""))))
    found = None
    if terms:
        found = bm25(rows, "root_id", {"_subject": 2.0, "_body": 1.0}, terms).select("root_id", "sha", "rank")
    if paths:
        named = rows.filter(hit).select("root_id", "sha", F.lit(100.0).alias("rank"))
        found = named if found is None else found.unionByName(named)
    if found is None:
        return table.limit(0).select("root_id", F.lit(0).alias("place"), "sha", "id", "subject", "files", F.lit(0.0).alias("rank"))
    ranks = found.groupBy("root_id", "sha").agg(F.round(F.sum("rank"), 6).alias("rank"))
    out = table.join(ranks, ["root_id", "sha"])
    return best_of(out, ["root_id"], [F.desc("rank"), F.desc("id")], limit, "sha").select("root_id", "place", "sha", "id", "subject", "files", "rank")


def lost_mentions(commits: DataFrame, commit_files: DataFrame, paths: DataFrame, text: str, most: int = 2) -> DataFrame:
    """(root_id, name, change, path, new_path, sha): names a query writes out that no file of a root has, with the newest commit that deleted or renamed such a file; at most ``most`` names of each root."""
    names = [m for m in dict.fromkeys(mentions(text)) if is_file_name(m)]
    if not names:
        return commits.limit(0).select("root_id", F.lit("").alias("name"), F.lit("").alias("change"), F.lit("").alias("path"), F.lit("").alias("new_path"), "sha")
    ends = lambda p, n: (p == n) | p.endswith("/" + n)
    gone = commit_files.filter("(status = 'D' and path is not null) or (status = 'R' and old_path is not null)")
    gone = gone.select("commit_id", F.when(F.col("status") == "D", "deleted").otherwise("renamed").alias("change"), F.when(F.col("status") == "D", F.col("path")).otherwise(F.col("old_path")).alias("path"), F.when(F.col("status") == "R", F.col("path")).alias("new_path"))
    which = F.filter(F.array(*[F.when(ends(F.col("path"), n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    hit = gone.select("*", F.explode(which).alias("name")).join(commits.select(F.col("id").alias("commit_id"), "root_id", "sha").filter("root_id is not null").distinct(), "commit_id")
    have = paths.select("root_id", F.explode(F.filter(F.array(*[F.when(ends(F.col("rel_path"), n), F.lit(n)) for n in names]), lambda x: x.isNotNull())).alias("name")).distinct()
    last = hit.join(have, ["root_id", "name"], "left_anti").groupBy("root_id", "name").agg(F.max(F.struct("commit_id", "change", "path", "new_path", "sha")).alias("m"))
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("name"))  # as many rows as the query has names
    return last.withColumn("_p", place).filter(F.col("_p") <= most).select("root_id", "name", "m.change", "m.path", "m.new_path", "m.sha")


def usage(preflights: DataFrame, commits: DataFrame, slack: int = 1) -> DataFrame:
    """(session, at, commit, overlap) of each commit's best earlier look-up: among those of its session from a second after its parent to a second after it (seconds), the one with
    most shown files changed, then the newest. ``preflights`` has session, at and top (array), ``commits`` session, commit, parent_at, at and changed (array).

    Both sides are cut into days, so a look-up meets the commits of its own days alone; a commit whose parent is old is met over all days in between.
    """
    day = 86_400
    c = commits.select("session", "commit", (F.col("parent_at") + slack).alias("_lo"), (F.col("at") + slack).alias("_hi"), "changed")
    c = c.filter("_lo <= _hi").withColumn("_day", F.explode(F.sequence(F.floor(F.col("_lo") / day), F.floor(F.col("_hi") / day))))
    p = preflights.select("session", F.col("at"), "top").withColumn("_day", F.floor(F.col("at") / day))
    rows = p.join(c, ["session", "_day"]).filter((F.col("at") >= F.col("_lo")) & (F.col("at") <= F.col("_hi")))
    n = F.size(F.array_intersect("top", "changed"))
    best = rows.groupBy("session", "commit").agg(F.max(F.struct(n.alias("overlap"), "at")).alias("m"))
    return best.select("session", "m.at", "commit", "m.overlap")


def unchanged(old: DataFrame, new: DataFrame, keys: list[str], identity: list[str], scan_at, guard_seconds: int = 2) -> DataFrame:
    """(keys, reuse): whether a file's parsed rows may be used again: its identity is equal and its last change is older than the scan by the guard, as a change within it could be missed."""
    o = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in identity])
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    late = F.col("mtime") < F.lit(scan_at) - F.expr(f"interval {guard_seconds} seconds")
    return salted_join(new, o.withColumn("_had", F.lit(True)), keys, keys, "left").select(*keys, (F.coalesce("_had", F.lit(False)) & same & F.coalesce(late, F.lit(False))).alias("reuse"))
