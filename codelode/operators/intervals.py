"""Range and as-of joins by sorting: no pair of rows is built that is not in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, bucket_seconds: int = 7 * 86_400) -> DataFrame:
    """``left`` with ``value`` of the newest right row of the same ``by`` not after it; null if there is none.

    Both sides are sorted together by (by, bucket of time) and the last value is carried on, into a
    bucket from those before it, so a hot ``by`` is spread over its buckets and no
    pairs are built. Of equal times the greater value counts.
    """
    cols = left.columns
    kind, row = right.schema[value].dataType, left.select(F.struct(*cols).alias("_row")).schema["_row"].dataType

    def bucket(t: str):
        return F.floor(F.unix_micros(t) / (bucket_seconds * 1_000_000))

    l2 = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.struct(*cols).alias("_row"))
    r2 = right.filter(F.col(right_time).isNotNull()).select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(row).alias("_row"))
    both = l2.unionByName(r2).withColumn("_b", bucket("_t"))
    ends = both.groupBy("_by", "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_end"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    carried = ends.select("_by", "_b", F.last("_end", ignorenulls=True).over(before)["_v"].alias("_in"))
    w = Window.partitionBy("_by", "_b").orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    joined = last.join(carried.withColumnsRenamed({"_by": "_cb", "_b": "_cbk"}), F.col("_by").eqNullSafe(F.col("_cb")) & F.col("_b").eqNullSafe(F.col("_cbk")), "left")
    return joined.select("_row.*", F.coalesce("_last", "_in").alias(value))


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """``points`` with the ``key`` of the innermost span (``line_start`` to ``line_end``) of the same ``by`` that holds it.

    Spans are cut into buckets of 64 lines and joined on (by, bucket), so a point
    meets only the spans that touch its bucket. The innermost is that with the largest
    start, then the smallest end, then the smallest key. Spans without bounds hold nothing.
    """
    size = 64
    s = spans.filter("line_start is not null and line_end is not null").select(
        by, F.col("line_start").alias("_a"), F.col("line_end").alias("_e"), F.col(key).alias("_k"),
        F.explode(F.sequence(F.floor(F.col("line_start") / size), F.floor(F.col("line_end") / size))).alias("_bucket"),
    ).filter("_a <= _e")
    p = points.withColumn("_bucket", F.floor(F.col(at) / size)).withColumn("_id", F.monotonically_increasing_id())
    hit = p.join(s, [by, "_bucket"]).filter((F.col(at) >= F.col("_a")) & (F.col(at) <= F.col("_e")))
    best = hit.groupBy("_id").agg(F.min(F.struct((-F.col("_a")).alias("a"), "_e", "_k")).alias("b")).select("_id", F.col("b._k").alias(key))
    return p.join(best, "_id", "left").drop("_id", "_bucket")


def filled_spans(symbols: DataFrame, by: str) -> DataFrame:
    """Symbols with a missing ``line_end`` filled by the next symbol's start less one; the last one's stays missing."""
    nxt = F.lead("line_start").over(Window.partitionBy(by).orderBy("line_start", "name"))
    return symbols.withColumn("line_end", F.coalesce("line_end", F.when(nxt.isNotNull(), F.greatest(F.col("line_start"), nxt - 1))))
