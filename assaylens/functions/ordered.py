"""Ordered aggregates that never need one task to hold a whole group.

Everything here works on *value counts*: tables with one row for each (keys, value). Ties
collapse to a single row before any ordering happens. A group that still has more distinct
values than ``assaylens.groupRows`` is cut into value ranges; each range is a window of its
own and the totals of the ranges before it are added afterwards. Missing keys and values are kept:
missing keys form a group, and a missing value comes before the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylens.session import lookup, materialise

GROUP_ROWS = 1_000_000

_COMBINE = {
    "sum": (F.sum, lambda own, before: own + F.coalesce(before, F.lit(0))),
    "min": (F.min, lambda own, before: F.least(own, before)),
    "max": (F.max, lambda own, before: F.greatest(own, before)),
}


def group_rows(spark: SparkSession) -> int:
    """Largest group that may be ordered by one window."""
    return int(spark.conf.get("assaylens.groupRows", str(GROUP_ROWS)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: dict[str, tuple[str, str]],
    descending: bool = False,
    largest: int | None = None,
) -> DataFrame:
    """Add running aggregates, from the first value up to and including the current one.

    *df* holds one row for each (keys, order) and should be a materialised table, since it
    is read more than once. *aggs* maps an output column to (sum | min | max, column).
    *largest* is an upper bound of the group size, when one is known.
    """
    keys = list(keys)
    limit = group_rows(df.sparkSession)
    if largest is None or largest > limit:
        largest = largest_group(df, keys)
    by = F.col(order).desc() if descending else F.col(order).asc()
    if largest <= limit:
        upto = _upto(keys, by)
        return df.select(
            "*", *[_COMBINE[kind][0](col).over(upto).alias(out) for out, (kind, col) in aggs.items()]
        )

    # dealt by range of (keys, order): as many ranges as the rows need, whatever the group
    parts = max(2, ceil(2 * df.count() / limit))
    placed = df.repartitionByRange(parts, *keys, order).withColumn("_range", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    totals = placed.groupBy(*keys, "_range").agg(
        *[_COMBINE[kind][0](col).alias(f"_t_{out}") for out, (kind, col) in aggs.items()]
    )
    range_by = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = Window.partitionBy(*keys).orderBy(range_by).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        "_range",
        *[_COMBINE[kind][0](f"_t_{out}").over(earlier).alias(f"_b_{out}") for out, (kind, _) in aggs.items()],
    )
    inside = _upto([*keys, "_range"], by)
    own = placed.select(
        "*", *[_COMBINE[kind][0](col).over(inside).alias(f"_o_{out}") for out, (kind, col) in aggs.items()]
    )
    return null_safe_join(own, before, [*keys, "_range"]).select(
        *df.columns,
        *[
            _COMBINE[kind][1](F.col(f"_o_{out}"), F.col(f"_b_{out}")).alias(out)
            for out, (kind, _) in aggs.items()
        ],
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on *keys* in which missing keys equal each other; the keys come from *left*."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def _upto(keys: Sequence[str], by: Column):
    return (
        Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def mid_ranks(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    n: str,
    out: str,
    descending: bool = False,
    largest: int | None = None,
) -> DataFrame:
    """Average rank of each value (ties share the mean of their positions)."""
    ranked = running(counts, keys, value, {"_cum": ("sum", n)}, descending, largest)
    return ranked.withColumn(
        out, F.col("_cum").cast("double") - (F.col(n).cast("double") - 1) / 2
    ).drop("_cum")


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    descending: bool = False,
    largest: int | None = None,
) -> DataFrame:
    """Average-tie rank of every row of the materialised *df* within its group."""
    keys = list(keys)
    limit = group_rows(df.sparkSession)
    if largest is None or largest > limit:
        largest = largest_group(df, keys)
    if largest <= limit:
        by = F.col(value).desc() if descending else F.col(value).asc()
        first = F.rank().over(Window.partitionBy(*keys).orderBy(by))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        return df.withColumn(out, first + (ties - 1) / 2)
    counts = materialise(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "ties")
    ranks = mid_ranks(counts, keys, value, "_n", out, descending).drop("_n")
    return null_safe_join(df, ranks, [*keys, value])


def quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    n: str,
    fractions: dict[str, float],
    largest: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row for each group.

    *counts* is a materialised value-count table without missing values, *largest* an upper
    bound of its groups when one is known.
    """
    keys = list(keys)
    totals = lookup(counts.groupBy(*keys).agg(F.sum(n).alias("_total")), "totals", largest)
    placed = null_safe_join(running(counts, keys, value, {"_cum": ("sum", n)}, largest=largest), totals, keys)

    def at(position: Column) -> Column:
        covers = (F.col("_cum") - F.col(n) <= position) & (position < F.col("_cum"))
        return F.max(F.when(covers, F.col(value)))

    picks = []
    for name, fraction in fractions.items():
        position = (F.col("_total") - 1) * F.lit(float(fraction))
        picks.append(at(F.floor(position)).alias(f"_lo_{name}"))
        picks.append(at(F.ceil(position)).alias(f"_hi_{name}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_part_{name}"))
    return placed.groupBy(*keys).agg(*picks).select(
        *keys,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")
            ).alias(name)
            for name in fractions
        ],
    )
