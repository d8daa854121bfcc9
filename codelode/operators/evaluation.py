"""Retrieval metrics and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.operators.joins import salted_join


def ndcg(ranked: DataFrame, by: str, k: int) -> DataFrame:
    """(by, ndcg): over rows with ``place`` (from one) and ``grade``; gain 2^grade - 1, discount log2(place + 1).

    ``ideal`` is the place by falling grade. Null where no grade is above zero.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    d = F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1.0)))
    i = F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)))
    return ranked.groupBy(by).agg(F.round(d / F.nullif(i, F.lit(0.0)), 6).alias("ndcg"))


def recall(ranked: DataFrame, by: str, k: int, least: int = 2) -> DataFrame:
    """(by, recall, reciprocal_rank, hit): share of rows of grade ``least`` and above within k places, and the first one's place."""
    good = F.col("grade") >= least
    found = F.sum((good & (F.col("place") <= k)).cast("int"))
    return ranked.groupBy(by).agg(
        F.round(found / F.nullif(F.sum(good.cast("int")), F.lit(0)), 6).alias("recall"), F.round(1.0 / F.min(F.when(good, F.col("place"))), 6).alias("reciprocal_rank"), (found > 0).alias("hit")
    )


def nearest_rank(rows: DataFrame, by: str, value: str, fraction: float) -> DataFrame:
    """(by, value): the nearest-rank percentile."""
    return rows.groupBy(by).agg(F.expr(f"percentile_disc({fraction}) within group (order by {value})").alias(value))


def share(part: Column, whole: Column) -> Column:
    """A share, null where the whole is zero."""
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def nearest_rank_ranges(rows: DataFrame, by: str, value: str, fraction: float, ranges: int = 1024) -> DataFrame:
    """``nearest_rank`` for groups of any size: a histogram of ``ranges`` equal ranges finds the one that holds the rank, and only its values are sorted.

    No task sees more than the values of one range of one group. Values must be numbers; nulls count nothing.
    """
    v = F.col(value).cast("double")
    r = rows.filter(F.col(value).isNotNull())
    ends = r.groupBy(by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(ranges - 1), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * ranges))).otherwise(0)
    placed = salted_join(r, ends, [by], [value]).withColumn("_r", at)
    hist = placed.groupBy(by, "_r").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``ranges`` rows a group
    want = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("_n")))
    hit = hist.withColumn("_before", before).filter((F.col("_before") < want) & (F.col("_before") + F.col("_c") >= want)).select(by, "_r", (want - F.col("_before")).alias("_k"))
    inside = salted_join(placed, hit, [by, "_r"], [value]).groupBy(by, value).agg(F.count("*").alias("_c"), F.max("_k").alias("_k"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_u", upto).filter(F.col("_u") >= F.col("_k")).groupBy(by).agg(F.min(value).alias(value))


def gold_ranks(ranked: DataFrame, gold: DataFrame, by: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(by, gold, first, all_in_<k>, recall_<k>, missed) of rankings (by, path, place) against gold paths (by, path): a path counts at its first place; ``missed`` are gold paths without one."""
    place = ranked.groupBy(by, "path").agg(F.min("place").alias("place"))
    rows = gold.select(by, "path").distinct().join(place, [by, "path"], "left")
    inside = lambda k: F.sum(F.coalesce((F.col("place") <= k).cast("int"), F.lit(0)))
    cols = [x for k in ks for x in ((inside(k) == F.count("*")).alias(f"all_in_{k}"), F.round(inside(k) / F.count("*"), 6).alias(f"recall_{k}"))]
    return rows.groupBy(by).agg(F.count("*").alias("gold"), F.min("place").alias("first"), *cols, F.sum(F.col("place").isNull().cast("int")).alias("missed"))


def summary(scores: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, instances, metric...): means in per cent over all instances that have the metric, for each group and (null group) all; flags count as one and zero."""
    return scores.rollup(group).agg(F.count("*").alias("instances"), *[F.round(100 * F.avg(F.col(m).cast("double")), 4).alias(m) for m in metrics])


def task_cost(ranked: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """(by, first, cost): the first gold place of rankings (by, path, place, tokens) and the tokens read in order up to the last gold path found; null cost where none is."""
    g = gold.select(by, "path", F.lit(True).alias("_g")).distinct()
    rows = ranked.join(g, [by, "path"], "left").withColumn("_upto", F.sum("tokens").over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by).agg(F.min(F.when(F.col("_g"), F.col("place"))).alias("first"), F.max(F.when(F.col("_g"), F.col("_upto"))).alias("cost"))


def walk(ranked: DataFrame, gold: DataFrame, by: str, fallback: DataFrame | None = None, budget: int = 10, search_cost: int = 0) -> DataFrame:
    """(by, reads, tokens, located): reading in order, at most ``budget`` files, until all gold paths are read; a ``fallback`` ranking goes on where the first ends. Paths are read once."""
    rows = ranked.select(by, "path", "place", "tokens", F.lit(0).alias("_list"))
    if fallback is not None:
        rows = rows.unionByName(fallback.select(by, "path", "place", "tokens", F.lit(1).alias("_list")))
    first = rows.groupBy(by, "path").agg(F.min(F.struct("_list", "place", "tokens")).alias("m")).select(by, "path", "m.*")
    w = Window.partitionBy(by).orderBy("_list", "place", "path")
    read = first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget).join(gold.select(by, "path", F.lit(1).alias("_g")).distinct(), [by, "path"], "left")
    total = gold.select(by, "path").distinct().groupBy(by).agg(F.count("*").alias("_total"))
    run = Window.partitionBy(by).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("_found", F.coalesce(F.sum("_g").over(run), F.lit(0))).withColumn("_cost", F.sum("tokens").over(run)).join(total, by)
    done = F.min(F.when(F.col("_found") == F.col("_total"), F.struct("_n", "_cost")))
    out = read.groupBy(by).agg(done.alias("d"), F.max(F.struct("_n", "_cost")).alias("all"))
    return out.select(by, F.coalesce("d._n", "all._n").alias("reads"), (F.coalesce("d._cost", "all._cost") + search_cost).alias("tokens"), F.col("d").isNotNull().alias("located"))


def grep_ranked(texts: DataFrame, words: list[str], by: list[str]) -> DataFrame:
    """(by, path, distinct_words, hits): texts (by, path, content) by how many of the words they hold in any case, then by how often; texts with none are left out."""
    low = F.lower("content")
    n = F.array(*[F.regexp_count(low, F.lit(r"(?<![a-z0-9_])\Q" + w.lower() + r"\E(?![a-z0-9_])")) for w in words])
    rows = texts.select(*by, "path", n.alias("n"))
    return rows.select(*by, "path", F.size(F.filter("n", lambda x: x > 0)).alias("distinct_words"), F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("hits")).filter("distinct_words > 0")


def merged_windows(anchors: DataFrame, by: list[str], line: str, width: int) -> DataFrame:
    """(by, start, end): lines within ``width`` of the anchors, touching stretches as one: islands by a running maximum."""
    rows = anchors.select(*by, F.greatest(F.lit(1), F.col(line) - width).alias("_a"), (F.col(line) + width).alias("_e")).distinct()
    w = Window.partitionBy(*by).orderBy("_a", "_e")
    rows = rows.withColumn("_top", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_a") <= F.col("_top") + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_run").agg(F.min("_a").alias("start"), F.max("_e").alias("end")).drop("_run")


def sampled(ids: DataFrame, key: str, without: list[DataFrame], most: int) -> DataFrame:
    """The ``most`` first ids by the order of their hashes that are in none of the other tables: the same in every run."""
    rows = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    for other in without:
        rows = rows.join(other.select(key).distinct(), key, "left_anti")
    return rows.withColumn("place", F.sha2(key, 256)).orderBy("place", key).limit(most)


def shard(ids: DataFrame, key: str, number: int, of: int) -> DataFrame:
    """Shard ``number`` (from one) of ``of``: every of-th id of the sorted ids."""
    if not 1 <= number <= of:
        raise ValueError("the number of a shard lies between one and their count")
    rows = ids.select(key).distinct()
    place = rows.rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex().toDF(f"{key} {rows.schema[key].dataType.simpleString()}, place bigint")  # numbers in order without one task for all
    return place.filter(F.col("place") % of == number - 1).select(key)


def merge_shards(parts: list[DataFrame], key: str) -> DataFrame:
    """All shards' rows; a key in two of them is an error."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    again = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"key in several shards: {again[0][0]!r}")
    return rows


def newest_of(rows: DataFrame, by: str, order: list[str], most: int, key: str) -> DataFrame:
    """The ``most`` newest rows of each group by falling ``order``, ties by key; cut in salted parts first."""
    from codelode.operators.lookup import best_of

    return best_of(rows, [by], [*[F.desc(c) for c in order], F.asc(key)], most, key)


def patch_paths(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, status, path, old_path): the files a diff modifies, adds, deletes or renames."""
    parts = F.filter(F.split(patch, r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))
    p = patches.select(key, F.explode(parts).alias("p"))
    old, new = F.regexp_extract("p", r"^diff --git a/(\S+) b/", 1), F.regexp_extract("p", r"^diff --git a/\S+ b/(\S+)", 1)
    status = F.when(F.col("p").rlike(r"(?m)^new file mode"), "A").when(F.col("p").rlike(r"(?m)^deleted file mode"), "D").when(old != new, "R").otherwise("M")
    return p.select(key, status.alias("status"), new.alias("path"), F.when(old != new, old).alias("old_path"))


def patch_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, path, start, end): the new side's line ranges of a diff's hunks; a hunk that only deletes is the line before it."""
    parts = F.filter(F.split(patch, r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))
    p = patches.select(key, F.explode(parts).alias("p"))
    p = p.select(key, F.regexp_extract("p", r"^diff --git a/\S+ b/(\S+)", 1).alias("path"), F.explode(F.regexp_extract_all("p", F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), 1)).alias("h"))
    start, n = F.split("h", ",")[0].cast("int"), F.coalesce(F.get(F.split("h", ","), F.lit(1)).cast("int"), F.lit(1))
    return p.select(key, "path", start.alias("start"), (start + F.greatest(n, F.lit(1)) - 1).alias("end"))


def dense_cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; zero where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def best_by_group(vectors: DataFrame, group: str, vector: str, query: list[float], most: int = 30) -> DataFrame:
    """(group, similarity, place): the groups of vectors by their most similar vector to a query; ties by group."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.col(vector).isNotNull()).select(group, F.round(dense_cosine(F.col(vector), q), 6).alias("similarity")).groupBy(group).agg(F.max("similarity").alias("similarity"))
    return rows.orderBy(F.desc("similarity"), group).limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("similarity"), group)))  # ``most`` rows


def checked(values: dict[str, float], floors: dict[str, float], ceilings: dict[str, float]) -> dict[str, bool]:
    """Whether each value keeps its floor or ceiling; a value that is missing does not."""
    out = {k: values.get(k) is not None and values[k] >= f for k, f in floors.items()}
    return out | {k: values.get(k) is not None and values[k] <= c for k, c in ceilings.items()}
