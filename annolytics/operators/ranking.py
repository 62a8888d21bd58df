"""First rows, over the whole table or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALTS = 256


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows in a fixed order."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.orderBy(*order).limit(n)


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, descending: bool = False
) -> DataFrame:
    """The first `k` rows of every group with their `rank`.

    The rows of a group are ranked within salted parts first, so that no task sorts a group whole
    and at most `k` rows of each part are ranked together, whatever `k` is.
    """
    if k < 1:
        raise ValueError("k must be at least 1")

    def ranked(keys: Sequence[str | Column]) -> Column:
        by = [F.desc(c) if descending else F.asc(c) for c in order]
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*by))

    part = F.pmod(F.xxhash64(*order), F.lit(_SALTS))
    leading = df.withColumn("__rank", ranked([*group, part])).where(F.col("__rank") <= k).drop("__rank")
    return leading.withColumn("rank", ranked(group)).where(F.col("rank") <= k)
