"""Reranking by what earlier queries led to, and bounded expansion of scores along edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.query import FILE_ENDINGS, Query, terms_of
from codelode.operators.joins import salted_join

# Fixed values of the feedback contract: what a path's role is worth, by how a record went; shares of the top score; the decay of unused suggestions.
FACT, OPENED, IGNORED = 1.0, 0.4, -0.3
OUTCOME = {"passed": 1.0, "partial": 0.6, "unknown": 0.6, "failed": 0.3, "blocked": 0.3}
SHARE, DECAY, UNUSED_RECORDS, NO_ROWS_TOP = 0.5, 0.8, 3, 100
KINDS = ("suggested", "opened", "changed", "missed", "ignored")


def past_terms(text: Column) -> Column:
    """The terms of a past query: as those of a query, without endings of file names."""
    bare = F.regexp_replace(text, r"(?i)(?<=\w)\.(" + "|".join(sorted(FILE_ENDINGS, key=lambda e: (-len(e), e))) + r")\b", "")
    return terms_of(F.regexp_replace(bare, "[_/-]", " "))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two term arrays with two terms in common, or with one and one array inside the other; else zero."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    inside = (both == F.size(F.array_distinct(a))) | (both == F.size(F.array_distinct(b)))
    return F.when((both >= 2) | ((both >= 1) & inside), both / all_).otherwise(0.0)


def signals(records: DataFrame, text: str, keys: tuple[str, ...] = ("root_id",)) -> DataFrame:
    """(keys, rel_path, weight, unused, helped) of past records similar to a query.

    ``records`` has the keys, query, outcome and arrays suggested, opened, changed, missed and ignored (null counts as empty). A path counts once
    for each record with its largest evidence; the weight sums similarity squared times evidence. ``unused`` are paths that three records and more suggested in vain and none touched;
    ``helped`` counts records in which a path was touched. Paths outside the repository (``external:``) count nothing.
    """
    q = Query(text)
    mine = F.array(*map(F.lit, q.terms)) if q.terms else F.array().cast("array<string>")
    empty = F.array().cast("array<string>")
    rows = records.select(*keys, "query", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), *[F.coalesce(k, empty).alias(k) for k in KINDS])
    rows = rows.withColumn("_sim", similarity(past_terms(F.col("query")), mine)).filter("_sim > 0")
    how = F.coalesce(F.create_map(*[F.lit(x) for kv in OUTCOME.items() for x in kv])[F.col("outcome")], F.lit(OUTCOME["unknown"]))
    used = F.array_union(F.array_union("changed", "opened"), "missed")
    vain = F.when((F.size("changed") > 0) | (F.size("opened") > 0), F.array_except("suggested", used)).otherwise(empty)
    every = F.array_union(F.array_union(used, F.col("ignored")), vain)
    has = lambda c, p: F.array_contains(c, p)
    one = F.transform(F.filter(every, lambda p: ~p.startswith("external:")), lambda p: F.struct(
        p.alias("rel_path"),
        F.greatest(F.when(has("changed", p) | has("missed", p), FACT), F.when(has("opened", p), F.lit(OPENED) * how), F.when(has("ignored", p), IGNORED), F.lit(None).cast("double")).alias("e"),
        has(used, p).alias("used"), has(vain, p).alias("vain"),
    ))
    flat = rows.select(*keys, "_sim", F.explode(one).alias("x")).select(*keys, "_sim", "x.*")
    out = flat.groupBy(*keys, "rel_path").agg(
        F.round(F.coalesce(F.sum(F.col("_sim") * F.col("_sim") * F.col("e")), F.lit(0.0)), 6).alias("weight"),
        ((F.sum(F.col("vain").cast("int")) >= UNUSED_RECORDS) & (F.max(F.col("used").cast("int")) == 0)).alias("unused"), F.sum(F.col("used").cast("int")).alias("helped"), F.count("e").alias("_e"),
    )
    return out.filter("_e > 0 or unused").drop("_e")


def apply(rows: DataFrame, found: DataFrame, keys: list[str] | tuple[str, ...] = ("root_id", "rel_path")) -> DataFrame:
    """(keys, score): rows with whole scores after feedback; the last key is the path, those before it the group.

    With the group's top score: a positive weight adds half of it times the weight (one at most), a negative one takes a quarter, unused suggestions keep 0.8;
    a path that has no row enters at its gain. ``found`` must hold indexed paths alone. Scores stay at least one.
    """
    by = list(keys[:-1])
    tops = rows.groupBy(*by).agg(F.max("score").alias("_top"))
    both = rows.select(*keys, "score").join(found.select(*keys, "weight", "unused"), list(keys), "full_outer")
    both = salted_join(both, tops, by, [keys[-1]], "left") if by else both.withColumn("_k", F.lit(1)).join(F.broadcast(tops.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")  # without a group there is one top score
    top, w = F.coalesce("_top", F.lit(NO_ROWS_TOP)), F.col("weight")
    s = F.col("score")
    gain = F.bround(F.lit(SHARE) * F.least(w, F.lit(1.0)) * top).cast("int")
    moved = F.when(w > 0, s + gain).when(w < 0, F.greatest(F.lit(1), s + F.bround(F.lit(SHARE) * F.greatest(w, F.lit(-1.0)) * top * 0.5).cast("int"))).otherwise(s)
    moved = F.when(F.col("unused"), F.greatest(F.lit(1), F.bround(moved * DECAY).cast("int"))).otherwise(moved)
    score = F.when(w.isNull(), s).when(s.isNull(), F.when(w > 0, gain)).otherwise(F.greatest(F.lit(1), moved))
    return both.select(*keys, score.cast("int").alias("score")).filter("score > 0")


def stats(records: DataFrame, key: str = "root_id") -> DataFrame:
    """(key, outcome, records, suggested, opened, changed, missed, ignored): how records went and how many paths they name; a null key or outcome stands for the sum."""
    sizes = [F.sum(F.coalesce(F.when(F.col(k).isNotNull(), F.size(k)), F.lit(0))).alias(k) for k in KINDS]
    return records.withColumn("outcome", F.coalesce("outcome", F.lit("unknown"))).rollup(key, "outcome").agg(F.count("*").alias("records"), *sizes)


def newest(records: DataFrame, limit: int) -> DataFrame:
    """The newest records by (created_at, id); a total order, so the cut is the same in any order of input."""
    return records.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def not_recorded(records: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Records of which none of the same keys is known yet."""
    return records.join(known.select(*keys).distinct(), keys, "left_anti")


def compared(off: DataFrame, on: DataFrame, by: str, k: int = 5) -> DataFrame:
    """(by, helped, hurt, pushed_out) of two rankings (by, path, place, gold): whether the best gold place got better or worse, and whether a gold path left the first ``k``."""
    both = off.select(by, "path", F.col("place").alias("a"), "gold").join(on.select(by, "path", F.col("place").alias("b"), F.col("gold").alias("_g")), [by, "path"], "full_outer")
    gold = F.coalesce("gold", "_g", F.lit(False))
    agg = both.groupBy(by).agg(F.min(F.when(gold, F.col("a"))).alias("a"), F.min(F.when(gold, F.col("b"))).alias("b"), F.max(F.coalesce(gold & (F.col("a") <= k) & (F.col("b").isNull() | (F.col("b") > k)), F.lit(False))).alias("pushed_out"))
    inf = F.lit(2**31 - 1)
    return agg.select(by, (F.coalesce("b", inf) < F.coalesce("a", inf)).alias("helped"), (F.coalesce("b", inf) > F.coalesce("a", inf)).alias("hurt"), "pushed_out")


def spread(scores: DataFrame, edges: DataFrame, factors: tuple[float, ...] = (0.35, 0.15)) -> DataFrame:
    """(id, score): scores passed on to nodes without one, over one and two hops of undirected edges, the best of what reaches a node times its hop's factor."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    known, frontier = scores.select("id", "score"), scores.select("id", F.col("score").alias("base"))
    for factor in factors:
        nxt = salted_join(both, frontier.withColumnRenamed("id", "source"), ["source"], ["target"]).groupBy("target").agg(F.max("base").alias("base")).select(F.col("target").alias("id"), "base")
        nxt = nxt.join(known.select("id"), "id", "left_anti")
        known = known.unionByName(nxt.select("id", F.round(F.col("base") * factor, 6).alias("score")))
        frontier = nxt
    return known
