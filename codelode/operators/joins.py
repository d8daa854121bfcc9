"""Joins that stay spread when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of the small side, so that one hot key is joined in as many tasks.
COPIES = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", copies: int = COPIES) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``, where ``right`` has few rows of each key (one, as a rule).

    Every right row is repeated ``copies`` times under a salt and a left row takes the salt of its
    ``spread`` columns, so the left rows of one key meet in as many tasks whichever join Spark picks. ``how`` is
    inner, left, left_semi or left_anti; null keys match nothing.
    """
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    own = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(copies)).cast("int"))
    return own.join(salted, [*keys, "_salt"], how).drop("_salt")
