"""Queries of reports, samples, privacy and feedback over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions import privacy as P
from codelode.operators import chunks, extraction
from codelode.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"select count(*) filter (where regexp_matches(rel_path, '{P.SECRET_PATH}')) secret, count(*) filter (where regexp_matches(rel_path, '{P.IGNORED_PART}')) ignored, count(*) paths from (select distinct root_id, rel_path from files where rel_path is not null)")
def private_paths(spark, sf):
    rows = table(spark, sf, "files").select("root_id", "rel_path").distinct().filter("rel_path is not null")
    return rows.agg(F.count(F.when(P.secret_path(F.col("rel_path")), 1)).alias("secret"), F.count(F.when(P.ignored_path(F.col("rel_path")), 1)).alias("ignored"), F.count("*").alias("paths"))


_HIDE = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '{P.KEY_BLOCK}', '{P.MARK}', 'g'), '{P.TOKENS}', '{P.MARK}', 'g'), '{P.ADDRESS}', '\\1{P.MARK}\\2', 'g'), "
    + "'" + P.HEADER.replace("'", "''") + f"', '\\1{P.MARK}', 'g')"
)


@query(f"select distinct file_id, {_HIDE} content from contents where content is not null and {_HIDE} <> content")
def hidden_secrets(spark, sf):
    """Texts in which a standalone secret was replaced."""
    c = table(spark, sf, "contents").filter("content is not null").select("file_id", "content", P.hide_standalone(F.col("content")).alias("out"))
    return c.filter("out <> content").select("file_id", F.col("out").alias("content")).distinct()


@query("""
select distinct file_id, unnest(json_keys(cast(content as json))) "key" from contents
where regexp_matches(rel_path, '\\.json$') and json_valid(content) and json_type(content) = 'OBJECT'""")
def json_keys(spark, sf):
    """Top-level keys of JSON files that hold an object."""
    c = table(spark, sf, "contents").filter(F.col("rel_path").rlike(r"\.json$") & F.col("content").isNotNull()).select("file_id", "content").distinct()
    return c.select("file_id", F.explode(F.json_object_keys("content")).alias("key")).distinct()


@query("""
with f as (select distinct root_id, rel_path, case when contains(rel_path, '/') then regexp_extract(rel_path, '^([^/]+)/', 1) else '.' end folder from files where rel_path is not null and root_id is not null),
n as (select root_id, folder, count(*) files from f group by 1, 2)
select root_id, folder, files, place from (select *, row_number() over (partition by root_id order by files desc, folder) place from n) where place <= 8""")
def folder_map(spark, sf):
    """The eight largest top folders of each root."""
    folder = F.when(F.col("rel_path").contains("/"), F.regexp_extract("rel_path", r"^([^/]+)/", 1)).otherwise(".")
    f = table(spark, sf, "files").filter("rel_path is not null and root_id is not null").select("root_id", "rel_path", folder.alias("folder")).distinct()
    n = f.groupBy("root_id", "folder").agg(F.count("*").alias("files"))
    place = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("files"), "folder"))  # one row a folder
    return n.withColumn("place", place).filter("place <= 8")


@query("""
with f as (select commit_id, count(distinct path) files, count(distinct path) filter (where status <> 'A') edited, count(distinct path) filter (where not regexp_matches(path, '(^|/)[^/]*(lock|manifest)[^/]*$')) real from commit_files where path is not null group by 1),
c as (select distinct id, root_id, sha, subject from commits where sha is not null)
select c.root_id, count(*) filter (where files between 1 and 30 and edited > 0 and real > 0 and not regexp_matches(lower(coalesce(subject, '')), '^(release|bump|merge)')) usable,
  count(*) filter (where files > 30) large, count(*) filter (where edited = 0) additions, count(*) filter (where real = 0) manifests from c join f on c.id = f.commit_id group by 1""")
def usable_commits(spark, sf):
    """How many commits of each root would do as tasks, and how many are passed over for which reason."""
    p = F.col("path")
    f = table(spark, sf, "commit_files").filter("path is not null").groupBy("commit_id").agg(
        F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.col("status") != "A", p)).alias("edited"), F.countDistinct(F.when(~p.rlike(r"(^|/)[^/]*(lock|manifest)[^/]*$"), p)).alias("real")
    )
    c = table(spark, sf, "commits").filter("sha is not null").select("id", "root_id", "sha", "subject").distinct().join(f, F.col("id") == F.col("commit_id"))
    good = F.col("files").between(1, 30) & (F.col("edited") > 0) & (F.col("real") > 0) & ~F.lower(F.coalesce("subject", F.lit(""))).rlike("^(release|bump|merge)")
    count = lambda x: F.count(F.when(x, 1))
    return c.groupBy("root_id").agg(count(good).alias("usable"), count(F.col("files") > 30).alias("large"), count(F.col("edited") == 0).alias("additions"), count(F.col("real") == 0).alias("manifests"))


@query("""
select id, sha256(id) place from (select distinct id from tasks where id is not null and split_name <> 'train') t
where id not in (select id from tasks where split_name = 'train' and id is not null) order by sha256(id), id limit 100""")
def task_sample(spark, sf):
    """A fixed sample of a hundred evaluation ids that training has not, by the order of their hashes."""
    t = table(spark, sf, "tasks").filter("id is not null")
    held = t.filter("split_name <> 'train'").select("id").distinct().join(t.filter("split_name = 'train'").select("id").distinct(), "id", "left_anti")
    return held.withColumn("place", F.sha2("id", 256)).orderBy("place", "id").limit(100)


@query()
def importing_files(spark, sf):
    """How many files of its root import each file."""
    c = table(spark, sf, "contents")
    found = extraction.resolve_imports(extraction.imports(c), c.select("root_id", "rel_path"))
    return found.groupBy("root_id", "target").agg(F.countDistinct("rel_path").alias("importers"))


@query("""
select user_id, count(*) filter (where event_type = 'purchase') changed, count(*) filter (where event_type = 'error') errors, quantile_disc(value, 0.5) median_value, quantile_disc(value, 0.95) p95_value,
  round(count(*) filter (where event_type = 'purchase') / nullif(count(*) filter (where event_type = 'click'), 0), 6) rate
from events where ts >= (select max(ts) from events) - interval 90 day group by 1""")
def recent_usage(spark, sf):
    """Each session's counts, medians and rates of the last 90 days of the log; a rate without a base is null."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).first()[0]
    e = e.filter(F.col("ts") >= F.lit(last) - F.expr("interval 90 days"))
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    pct = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")  # noqa: E731  # one session's distinct values
    return e.groupBy("user_id").agg(kind("purchase").alias("changed"), kind("error").alias("errors"), pct(0.5).alias("median_value"), pct(0.95).alias("p95_value"), F.round(kind("purchase") / F.nullif(kind("click"), F.lit(0)), 6).alias("rate"))


@query("""
with t as (select split_name, repo, count(distinct task_key) tasks, count(distinct task_key) filter (where base is null) without_base from tasks group by 1, 2)
select split_name, repo, sum(tasks)::bigint tasks, sum(without_base)::bigint without_base, round(sum(without_base) / sum(tasks), 6) share from t group by grouping sets ((split_name, repo), (split_name), ())""")
def task_summary(spark, sf):
    """Tasks and those without a base, for each split and repo, each split, and all."""
    t = table(spark, sf, "tasks").groupBy("split_name", "repo").agg(F.countDistinct("task_key").alias("n"), F.countDistinct(F.when(F.col("base").isNull(), F.col("task_key"))).alias("m"))
    return t.rollup("split_name", "repo").agg(F.sum("n").alias("tasks"), F.sum("m").alias("without_base"), F.round(F.sum("m") / F.sum("n"), 6).alias("share"))


@query("""
with p as (select distinct root_id, rel_path, part_kind, part_number, status, truncated, cut from document_parts)
select coalesce(status, 'unknown') state, part_kind, count(*) parts, count(*) filter (where truncated) shortened from p group by 1, 2""")
def document_states(spark, sf):
    p = table(spark, sf, "document_parts").select("root_id", "rel_path", "part_kind", "part_number", "status", "truncated", "cut").distinct()
    return p.groupBy(F.coalesce("status", F.lit("unknown")).alias("state"), "part_kind").agg(F.count("*").alias("parts"), F.count(F.when(F.col("truncated"), 1)).alias("shortened"))


@query()
def built_chunks(spark, sf):
    """The chunk table built from the texts at hand."""
    return chunks.semantic_chunks(table(spark, sf, "contents"))
