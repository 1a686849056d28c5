"""Stored summaries of a key and day (or hour) that merge to any range: sketches of values and identifiers, and integrals.

A summary is made once from a day's points and kept; a question about thirty days then reads thirty rows a key. Merging
is associative, so it's the same whether days are merged one by one, by months or all at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import SITE
from ..functions import time as T

Names = Sequence[str]

#: The size of a quantile sketch. Beyond so many values a rank is off by rank_error(k) at most, at 99 % of all questions.
KLL = 800
#: log2 of the registers of a sketch of distinct values: about 1.6 % standard error, next to none for a few hundred values.
HLL = 12


def rank_error(k: int = KLL) -> float:
    """The published bound of this family of sketches on the error of a normalised rank."""
    return 2.446 / k**0.9433


# -- sketches ---------------------------------------------------------------------------------


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def sketch_days(df: DataFrame, by: Names, values: Names = (), distinct: Names = (), tz: str = SITE.tz, k: int = KLL, lg: int = HLL, time: str = "time") -> DataFrame:
    """(by, local_day, <v>_n, <v>_kll for each value, <d>_hll for each column of `distinct`): a row a key and day.

    Null and not finite values are left out. Sketches of tasks merge before the shuffle, so a day of one key may have any number of points.
    """
    kept = {v: _finite(F.col(v).cast("double")) for v in values}
    made = [F.count(x).alias(f"{v}_n") for v, x in kept.items()] + [F.kll_sketch_agg_double(x, k).alias(f"{v}_kll") for v, x in kept.items()]
    made += [F.hll_sketch_agg(F.col(d).cast("string"), lg).alias(f"{d}_hll") for d in distinct]
    return df.withColumn("local_day", T.local_day(F.col(time), tz)).groupBy(*by, "local_day").agg(*made)


def merge_sketches(summaries: DataFrame, by: Names, k: int = KLL) -> DataFrame:
    """One row for each `by`, from any rows of sketch_days or of this function: days to a range, or late points to their day."""
    found = []
    for c in summaries.columns:
        if c in by:
            continue
        if c.endswith("_n"):
            found.append(F.sum(c).alias(c))
        elif c.endswith("_kll"):
            found.append(F.kll_merge_agg_double(c, k).alias(c))
        elif c.endswith("_hll"):
            found.append(F.hll_union_agg(c).alias(c))
    return summaries.groupBy(*by).agg(*found)


def sketched_quantile(value: str, q: float) -> Column:
    """A quantile from a merged sketch; null if it has seen no value."""
    return F.when(F.col(f"{value}_n") > 0, F.kll_sketch_get_quantile_double(f"{value}_kll", F.lit(q)))


def sketched_distinct(name: str) -> Column:
    """The number of different values, estimated."""
    return F.hll_sketch_estimate(f"{name}_hll")


# -- integrals --------------------------------------------------------------------------------


def _hour(time: str, tz: str) -> Column:
    """Hours since the local midnight: days of 23 or 25 hours have as many."""
    return F.floor((F.unix_seconds(time) - F.unix_seconds(T.day_start(T.local_day(F.col(time), tz), tz))) / 3600).cast("int")


def _between(t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    return (v0 + v1) / 2 * ((F.unix_micros(t1) - F.unix_micros(t0)) / 1e6)


def integral_hours(df: DataFrame, by: Names, value: str = "value", tz: str = SITE.tz, time: str = "time") -> DataFrame:
    """(by, local_day, hour, first_t, first_v, last_t, last_v, area, n): trapezoids inside an hour, and its ends for what lies between hours."""
    points = df.filter(F.col(value).isNotNull()).withColumns({"local_day": T.local_day(F.col(time), tz), "hour": _hour(time, tz)})
    w = W.partitionBy(*by, "local_day", "hour").orderBy(time)
    area = _between(F.lag(time).over(w), F.lag(value).over(w), F.col(time), F.col(value))
    point = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    found = points.withColumn("__area", area).groupBy(*by, "local_day", "hour").agg(F.min(point).alias("a"), F.max(point).alias("b"), F.coalesce(F.sum("__area"), F.lit(0.0)).alias("area"), F.count(F.lit(1)).alias("n"))
    return found.select(*by, "local_day", "hour", F.col("a.t").alias("first_t"), F.col("a.v").alias("first_v"), F.col("b.t").alias("last_t"), F.col("b.v").alias("last_v"), "area", "n")


def integral_days(hours: DataFrame, by: Names) -> DataFrame:
    """(by, local_day, area, n) from summaries of hours, or of parts of hours that don't overlap: at most 25 rows and a few a key and day."""
    w = W.partitionBy(*by, "local_day").orderBy("first_t")
    gap = F.coalesce(_between(F.lag("last_t").over(w), F.lag("last_v").over(w), F.col("first_t"), F.col("first_v")), F.lit(0.0))
    return hours.withColumn("__area", F.col("area") + gap).groupBy(*by, "local_day").agg(F.sum("__area").alias("area"), F.sum("n").alias("n"))


def integral_between(hours: DataFrame, points: DataFrame, by: Names, start: datetime, stop: datetime, value: str = "value", tz: str = SITE.tz, time: str = "time") -> DataFrame:
    """(by, local_day, area, n) of the points of [start, stop): whole hours from their summaries, the two cut ones from points."""
    begins = T.day_start(F.col("local_day"), tz) + F.make_dt_interval(hours=F.col("hour"))
    # The last hour of a day isn't shorter than others, but an hour's end may lie beyond its day; both count as whole only if nothing of the hour is cut.
    whole = hours.filter((begins >= T.instant(start)) & (begins + F.expr("INTERVAL 1 HOUR") <= T.instant(stop)))
    inside = points.filter((F.col(time) >= T.instant(start)) & (F.col(time) < T.instant(stop)))
    at = T.day_start(T.local_day(F.col(time), tz), tz) + F.make_dt_interval(hours=_hour(time, tz))
    near = (F.col(time) < T.instant(start) + F.expr("INTERVAL 1 HOUR")) | (F.col(time) >= T.instant(stop) - F.expr("INTERVAL 1 HOUR"))  # reaches the scan
    cut = inside.filter(near & ((at < T.instant(start)) | (at + F.expr("INTERVAL 1 HOUR") > T.instant(stop))))
    return integral_days(whole.unionByName(integral_hours(cut, by, value, tz, time)), by)


def refresh_hours(hours: DataFrame, points: DataFrame, late: DataFrame, by: Names, value: str = "value", tz: str = SITE.tz, time: str = "time") -> DataFrame:
    """The summaries after late points came: hours that they touch are made anew from `points` (which has them), all others stay as stored."""
    touched = late.filter(F.col(value).isNotNull()).select(*by, T.local_day(F.col(time), tz).alias("local_day"), _hour(time, tz).alias("hour")).distinct()
    keys = [*by, "local_day", "hour"]
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in keys]
    placed = points.withColumns({"local_day": T.local_day(F.col(time), tz), "hour": _hour(time, tz)})
    again = placed.join(touched, same(placed, touched), "left_semi").drop("local_day", "hour")
    return hours.join(touched, same(hours, touched), "left_anti").unionByName(integral_hours(again, by, value, tz, time))
