"""Exact ranks, equal-count bins and percentiles of keys of any size: no task sorts a whole key.

Rows are dealt by ranges of the whole order, with ties, so a piece is a fair share however skewed keys or values are; a
row's rank is its place in its piece plus the counts of the pieces before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stored
from .days import KEY
from .series import at_ranks

Names = Sequence[str]


def ranked(df: DataFrame, by: Names, order: Names, rank: str = "rank", count: str = "n") -> DataFrame:
    """Adds a row's rank (from 1) in its key by `order`, which has no ties, and the number of the key's rows. A null key is one like others.

    The pieces are stored once in the session's shared folder, so ranks and rows are of one and the same division.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(KEY, F.struct(*by)).repartitionByRange(pieces, KEY, *order).withColumn("__piece", F.spark_partition_id())
    dealt = stored(dealt)
    counts = dealt.groupBy(KEY, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    over = W.partitionBy(KEY).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(KEY, "__piece", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(KEY)).alias(count))
    place = F.row_number().over(W.partitionBy(KEY, "__piece").orderBy(*order))
    return dealt.join(before, [KEY, "__piece"]).withColumn(rank, F.col("__before") + place).drop(KEY, "__piece", "__before")


def equal_bins(df: DataFrame, by: Names, order: Names, bins: int = 5, to: str = "bin") -> DataFrame:
    """Adds the number (from 0) of the bin that cuts the ordered key into nearly equal runs."""
    return ranked(df, by, order, "__rank", "__n").withColumn(to, F.floor((F.col("__rank") * bins - 1) / F.col("__n")).cast("int")).drop("__rank", "__n")


def percentiles(df: DataFrame, by: Names, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, a column for each of `quantiles`): exact, between the two neighbouring values where the place isn't whole; null without values."""
    places: dict[str, Callable[[Column], Column]] = {}
    for name, q in quantiles.items():
        places |= {f"{name}__lo": lambda n, q=q: F.floor(F.lit(q) * (n - 1)), f"{name}__hi": lambda n, q=q: F.ceil(F.lit(q) * (n - 1))}
    found = at_ranks(df, by, value, places, count="__n")

    def one(name: str, q: float) -> Column:
        at, low, high = F.lit(q) * (F.col("__n") - 1), F.col(f"{name}__lo"), F.col(f"{name}__hi")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.select(*by, *(one(name, q) for name, q in quantiles.items()))


def medians(df: DataFrame, by: Names, value: str, to: str = "median") -> DataFrame:
    return percentiles(df, by, value, {to: 0.5})


def bin_drift(df: DataFrame, by: Names, order: Names, ratio: str = "ratio", bins: int = 5) -> DataFrame:
    """(by, drift_pct): spread of the bins' mean ratios, in percent of the key's median ratio."""
    means = equal_bins(df, by, order, bins).groupBy(*by, "bin").agg(F.avg(ratio).alias("__m"))
    spread = means.groupBy(*by).agg((F.max("__m") - F.min("__m")).alias("__spread"))
    middle = medians(df, by, ratio, "__med")
    both = spread.withColumn(KEY, F.struct(*by)).join(middle.select(F.struct(*by).alias(KEY), "__med"), KEY)
    return both.select(*by, F.try_divide(F.col("__spread") * 100, F.col("__med")).alias("drift_pct"))
