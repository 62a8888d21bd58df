"""Running totals and positions over groups of any size.

A plain window over a group sorts that whole group in one task.  Here the order is cut into coarse
and fine buckets: totals of the buckets are summed up first, and only the rows of one fine bucket
are ever ordered together.  The result is the same as the plain window's.

For numbers the cuts come from the data: a quantile sketch of every large group, merged from the sketches
of the tasks, so that buckets hold about equally many rows wherever the values lie and however close.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.session import cut_lineage

_COARSE, _FINE, _STEPS, _CUTS, _VALUE = "__coarse", "__fine", "__steps", "__cuts", "__value"
COARSE_CUTS, FINE_CUTS = 16, 16  # a large group has up to 256 fine buckets
LARGE = 4_096  # rows of a group that one task may order


def hash_buckets(hexadecimal: Column) -> tuple[Column, Column]:
    """Buckets of a lower-case hex digest, in text order."""
    return F.substring(hexadecimal, 1, 3), F.substring(hexadecimal, 1, 5)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of the same names, in which null equals null."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys), F.lit(True))
    return left.join(renamed, same, how).drop(*(f"__right_{k}" for k in keys))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    buckets: tuple[Column, Column],
    measures: Sequence[str],
) -> DataFrame:
    """Add `<m>_upto` (sum of `m` from the first row of the group to this one) and `<m>_total`.

    `buckets` must not decrease along `order`, and `order` must identify a row within its group.
    Nulls in the group, the order or the buckets are values like any other; they come first.
    """
    group = list(group)
    rows = df.withColumns({_COARSE: buckets[0], _FINE: buckets[1]})

    fine = rows.groupBy(*group, _COARSE, _FINE).agg(*(F.sum(m).alias(m) for m in measures))
    coarse = fine.groupBy(*group, _COARSE).agg(*(F.sum(m).alias(m) for m in measures))

    def before(keys: list[str], by: str) -> Window:
        return (
            Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        )

    over_coarse = before(group, _COARSE)
    coarse = coarse.select(
        *group,
        _COARSE,
        *(F.coalesce(F.sum(m).over(over_coarse), F.lit(0)).alias(f"__{m}_c") for m in measures),
        *(F.sum(m).over(Window.partitionBy(*group)).alias(f"{m}_total") for m in measures),
    )
    over_fine = before([*group, _COARSE], _FINE)
    fine = fine.select(
        *group,
        _COARSE,
        _FINE,
        *(F.coalesce(F.sum(m).over(over_fine), F.lit(0)).alias(f"__{m}_f") for m in measures),
    )
    fine = join_on(fine, coarse, [*group, _COARSE])

    within = (
        Window.partitionBy(*group, _COARSE, _FINE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumns({f"__{m}_w": F.sum(m).over(within) for m in measures})
    joined = join_on(rows, fine, [*group, _COARSE, _FINE])
    return joined.select(
        *df.columns,
        *(
            (F.col(f"__{m}_c") + F.col(f"__{m}_f") + F.col(f"__{m}_w")).alias(f"{m}_upto")
            for m in measures
        ),
        *(f"{m}_total" for m in measures),
    )


def value_cuts(df: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """The columns of `group`, `__cuts`, rising values that part a large group into about equal shares, and
    `__steps`, the last of every FINE_CUTS of them.  Groups of up to LARGE rows have no row: they are not cut."""
    count = COARSE_CUTS * FINE_CUTS
    number = value.cast("double")
    found = df.groupBy(*group).agg(
        F.count("*").alias("__rows"),
        F.percentile_approx(
            F.when(~F.isnan(number), number), [i / count for i in range(1, count)], 8 * count
        ).alias(_CUTS),
    )
    cuts = found.where(F.col("__rows") > LARGE).select(*group, F.array_distinct(_CUTS).alias(_CUTS))
    return cuts.withColumn(_STEPS, F.filter(_CUTS, lambda _, i: i % FINE_CUTS == FINE_CUTS - 1))


def _below(steps: Column, cuts: Column, value: Column) -> tuple[Column, Column]:
    """Coarse and fine number of the cuts below a value: the steps are looked at, then the cuts between two."""
    coarse = F.size(F.filter(steps, lambda c: c < value))
    near = F.slice(cuts, coarse * FINE_CUTS + 1, F.lit(FINE_CUTS))
    return coarse, F.size(F.filter(near, lambda c: c < value))


def ordered_totals(
    df: DataFrame, group: Sequence[str], value: Column, measures: Sequence[str], ties: Sequence[Column] = ()
) -> DataFrame:
    """`running_totals` along a number and then `ties`, cut where the data's own quantiles lie.

    Null values come first and NaN last.  Rows of one value stay in one bucket, so a value should not be
    repeated without bound: count equal ones before.
    """
    cuts = cut_lineage(value_cuts(df, group, value))
    valued = join_on(df.withColumn(_VALUE, value.cast("double")), cuts, group, "left")
    none = F.array().cast("array<double>")
    coarse, fine = _below(F.coalesce(_STEPS, none), F.coalesce(_CUTS, none), F.col(_VALUE))
    found = running_totals(
        valued.withColumns({"__c": coarse, "__f": fine}).drop(_STEPS, _CUTS, _VALUE),
        group,
        [value, *ties],
        (F.col("__c"), F.col("__f")),
        measures,
    )
    return found.drop("__c", "__f")


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Percentiles with linear interpolation, one column per entry of `fractions`.

    Equal values are counted together before anything is ordered, so a group is never held by one
    task.  Null values are ignored.
    """
    group = list(group)
    counts = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    )
    ranked = ordered_totals(counts, group, F.col(value), ["n"])
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value)))

    picks = []
    for name, fraction in fractions.items():
        position = F.lit(fraction) * (F.col("n_total") - 1)
        picks += [
            at(F.floor(position)).alias(f"__{name}_lo"),
            at(F.ceil(position)).alias(f"__{name}_hi"),
            F.max(position - F.floor(position)).alias(f"__{name}_part"),
        ]
    picked = ranked.groupBy(*group).agg(*picks)
    return picked.select(
        *group,
        *(
            (
                F.col(f"__{name}_lo")
                + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * F.col(f"__{name}_part")
            ).alias(name)
            for name in fractions
        ),
    )
