"""Freshness: what changed between two states of a file table, and bounded logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: list[str], digest: str, old_at: str | None = None, new_at: str | None = None) -> DataFrame:
    """(key, status): added, removed or changed keys; equal ones have no row. Of several rows the newest counts, by ``old_at`` and ``new_at``; null digests are equal to each other."""

    def last(at: str | None):
        return F.max(F.struct(F.col(at).alias("_at") if at else F.lit(0).alias("_at"), F.col(digest).alias("_d")))["_d"]

    a = old.groupBy(*key).agg(last(old_at).alias("_old")).withColumn("_a", F.lit(True))
    b = new.groupBy(*key).agg(last(new_at).alias("_new")).withColumn("_b", F.lit(True))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full_outer").select(*key, status.alias("status")).filter("status is not null")


def newest(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The ``limit`` rows of each ``by`` with the largest ``order`` (unique in it): (by, order), without sorting a hot group in one task.

    Orders are first cut to the ``limit`` largest in each of several salted parts.
    """
    salted = rows.select(by, order).distinct().withColumn("_s", F.pmod(F.xxhash64(order), F.lit(32)))
    part = salted.groupBy(by, "_s").agg(F.slice(F.sort_array(F.collect_set(order), asc=False), 1, limit).alias("v"))
    return part.groupBy(by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("v")), asc=False), 1, limit).alias("v")).select(by, F.explode("v").alias(order))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a table that does not depend on the order or partitioning of its rows.

    Each row is hashed; the sums of four 32-bit parts of the hashes are joined, so repeated rows count.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = rows.agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.concat_ws("-", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]).alias("digest"))


def health(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(root_id, files, covered, status): whether each root's files have chunks - missing, stale or current."""
    have = chunks.filter("file_id is not null").select("root_id", "file_id").distinct().withColumn("_c", F.lit(1))
    rows = files.select("root_id", "file_id").distinct().join(have, ["root_id", "file_id"], "left")
    out = rows.groupBy("root_id").agg(F.count("*").alias("files"), F.count("_c").alias("covered"))
    return out.withColumn("status", F.when(F.col("covered") == 0, "missing").when(F.col("covered") < F.col("files"), "stale").otherwise("current"))
