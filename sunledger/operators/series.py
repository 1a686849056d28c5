"""Generic time-series operators: ranges, filters, windows, differences, integrals.

Frames have a timestamp column (`time` unless named) and key columns that identify a series. Ranges are
half-open. Every ordered window orders by time explicitly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..config import SITE, Site
from ..functions import text as X
from ..functions import time as T
from ..functions.light import all_present, any_at_least, spectrum_sum
from .days import in_parts, with_neighbours, without_parts

Names = Sequence[str]


# -- projections, filters, predicates --------------------------------------------------------


def time_range(df: DataFrame, start: str | datetime, stop: str | datetime, as_of: datetime, tz: str = SITE.tz, time: str = "time") -> DataFrame:
    """Rows in [start, stop); the comparison with literals prunes files and partitions."""
    low, high = (T.resolve_time(x, as_of, tz) if isinstance(x, str) else x for x in (start, stop))
    return df.filter((F.col(time) >= T.instant(low)) & (F.col(time) < T.instant(high)))


def select_series(df: DataFrame, fields: Names | None = None, measurement: str | None = None, **tags: str) -> DataFrame:
    """Rows of a measurement, of some fields, with some tags."""
    out = df
    if measurement is not None:
        out = out.filter(F.col("measurement") == measurement)
    if fields is not None:
        out = out.filter(F.col("field").isin(*fields))
    for tag, value in tags.items():
        out = out.filter(F.col(tag) == value)
    return out


def production_only(df: DataFrame, devices: Names = (), fields: Names = ()) -> DataFrame:
    """Leaves out devices and fields by name; rows without a device or field stay."""
    out = df
    for column, names in (("device", devices), ("field", fields)):
        if names:
            out = out.filter(~F.coalesce(F.col(column).isin(*names), F.lit(False)))
    return out


def gate_fields_at(df: DataFrame, as_of: datetime, fields: Names = ("lux", "lux_ref"), site: Site = SITE) -> DataFrame:
    """Drops light fields unless the evaluation time lies in the lamp window."""
    return df.filter(~F.col("field").isin(*fields) | T.in_local_window(T.instant(as_of), site.tz, site.lamp_start, site.lamp_end))


def unsaturated(df: DataFrame, limit: float = C.FULL_SCALE) -> DataFrame:
    """Rows with a clear reading that is neither flagged nor at full scale."""
    return df.filter(F.col("clear").isNotNull() & (F.col("saturated") == 0) & (F.col("clear") < limit))


#: Reject reasons in the order in which they apply.
REASONS = ("partial", "saturated", "clamp", "below_min", "nonpositive", "kept")


def classify_minutes(df: DataFrame, lux_min: float, lux_max: float, saturation: float = C.FULL_SCALE) -> DataFrame:
    """Adds `reason` (exclusive, first that applies), s, ppfd and ratio; s and ratio are null where undefined."""
    s = spectrum_sum()
    complete = F.col("lux").isNotNull() & all_present()
    reason = (
        F.when(~complete, "partial").when(any_at_least(saturation), "saturated").when(F.col("lux") >= lux_max, "clamp").when(F.col("lux") < lux_min, "below_min").when(s <= 0, "nonpositive").otherwise("kept")
    )
    ppfd = F.col("lux") / C.LUX_PER_PPFD
    return df.withColumns({"reason": reason, "s": s, "ppfd": ppfd, "ratio": F.try_divide(ppfd, s)})


def clean_readings(df: DataFrame) -> DataFrame:
    """NaN, infinite and negative light readings become missing; Pa to hPa, ohm to kilohm."""

    def finite(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))

    changes = {c: finite(c) for c in ("temp", "hum") if c in df.columns}
    changes |= {c: finite(c) / k for c, k in (("pressure", 100.0), ("gas", 1000.0)) if c in df.columns}
    changes |= {c: F.when(F.col(c) >= 0, finite(c)) for c in ("lux", "lux_ref") if c in df.columns}
    return df.withColumns(changes)


def validate_ids(df: DataFrame, device: str = "device", uid: str | None = "uid", quality: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): identifiers by pattern, the uid upper-cased first."""
    ok = F.col(device).rlike(X.DEVICE_ID)
    out = df
    if uid:
        out = out.withColumn(uid, F.upper(uid))
        ok = ok & F.col(uid).rlike(X.TAG_UID)
    if quality:
        ok = ok & F.col(quality).rlike(X.QUALITY)
    flagged = out.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("__ok").drop("__ok"), flagged.filter("NOT __ok").drop("__ok")


def label_quality(df: DataFrame, empty_g: float = 30.0) -> DataFrame:
    return df.withColumn("quality", F.when(F.col("weight_g") < empty_g, "empty").otherwise("ok"))


def valid_weights(df: DataFrame, not_plants: Names = ("tare-ref", "unknown")) -> DataFrame:
    return df.filter((F.col("quality") == "ok") & ~F.col("plant_id").isin(*not_plants))


# -- windows and aggregates -------------------------------------------------------------------


def mean(c: str) -> Column:
    return F.avg(c)


AGGREGATES: dict[str, Callable[[str], Column]] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def aggregate_window(
    df: DataFrame, every: str, fn: str | Callable[[str], Column], by: Names, value: str = "value", tz: str = SITE.tz, create_empty: bool = False, start: datetime | None = None, stop: datetime | None = None, time: str = "time"
) -> DataFrame:
    """One row a key and window: sub-day windows labelled window_start/window_stop, day windows local_day.

    `fn` is a name of AGGREGATES or a function from a column name to an aggregate. With create_empty
    every key has every window of [start, stop), counts being 0 and other aggregates null there.
    """
    aggregate = (AGGREGATES[fn] if isinstance(fn, str) else fn)(value).alias(value)
    if every.endswith("d"):
        if every != "1d":
            raise ValueError("calendar windows are single local days")
        out = df.withColumn("local_day", T.local_day(F.col(time), tz)).groupBy(*by, "local_day").agg(aggregate)
        label, grid = ["local_day"], None
        if create_empty:
            bounds = F.sequence(T.local_day(T.instant(start), tz), T.local_day(T.instant(stop) - F.expr("INTERVAL 1 MICROSECOND"), tz))
            grid = df.select(*by).distinct().withColumn("local_day", F.explode(bounds))
    else:
        step = T.seconds_of(every)
        begin = F.floor(F.unix_seconds(time) / step).cast("long") * step
        out = df.withColumn("window_start", F.timestamp_seconds(begin)).groupBy(*by, "window_start").agg(aggregate)
        label, grid = ["window_start"], None
        if create_empty:
            low = int(start.timestamp()) // step * step
            bounds = F.sequence(F.lit(low), F.lit(int(stop.timestamp()) - 1), F.lit(step))
            grid = df.select(*by).distinct().withColumn("__at", F.explode(bounds)).select(*by, F.timestamp_seconds("__at").alias("window_start"))
    if grid is not None:
        out = grid.join(out, [*by, *label], "left")
        if fn == "count":
            out = out.withColumn(value, F.coalesce(value, F.lit(0)))
    if label == ["window_start"]:
        out = out.withColumn("window_stop", F.timestamp_seconds(F.unix_seconds("window_start") + T.seconds_of(every)))
    return out


def ingest_completeness(df: DataFrame, by: Names, interval_s: int, start: datetime, stop: datetime, tz: str = SITE.tz) -> DataFrame:
    """Points a key and local day, and their share of what the interval promises over that day's real length."""
    counted = aggregate_window(df.withColumn("n", F.lit(1)), "1d", "count", by, "n", tz, True, start, stop)
    length = F.unix_seconds(T.day_start(F.date_add("local_day", 1), tz)) - F.unix_seconds(T.day_start(F.col("local_day"), tz))
    return counted.withColumn("completeness", F.col("n") * F.lit(float(interval_s)) / length)


def at_ranks(df: DataFrame, by: Names, value: str, places: dict[str, Callable[[Column], Column]], count: str | None = None) -> DataFrame:
    """(by, a column for each of `places`, and the number of values as `count`): the values at given indices (from 0) of a sorted key.

    A place is a function from the number of values. Null if a key has no values. Counts of narrow value ranges (0.025 % wide) show in
    which range an index lies, so only the distinct values of that range are put in order and no task gets a whole key.
    """
    x = F.col("__v")
    place = F.when(F.isnan(x), F.lit(1 << 40)).when(x == 0, F.lit(0)).otherwise((F.signum(x) * (F.floor(F.log(F.least(F.abs(x), F.lit(1.7976931348623157e308))) * 4096) + (1 << 24))).cast("long"))
    own = df.select(F.struct(*by).alias("__k"), F.col(value).alias(value), F.col(value).cast("double").alias("__v")).withColumn("__r", F.when(x.isNotNull(), place))
    ordered = W.partitionBy("__k").orderBy("__r")
    ranges = own.filter(x.isNotNull()).groupBy("__k", "__r").agg(F.count(F.lit(1)).alias("__n"))
    ranges = ranges.withColumns({"__end": F.sum("__n").over(ordered.rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum("__n").over(W.partitionBy("__k"))})
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("__q"), at(F.col("__all")).cast("long").alias("__at")) for name, at in places.items())))
    hits = ranges.withColumn("__w", wanted).select("__k", "__r", "__w.__q", (F.col("__w.__at") - (F.col("__end") - F.col("__n"))).alias("__at"), "__n").filter("__at >= 0 AND __at < __n").drop("__n")
    counts = own.join(hits, ["__k", "__r"]).groupBy("__k", "__q", "__at", value).agg(F.count(F.lit(1)).alias("__n"))
    end = F.sum("__n").over(W.partitionBy("__k", "__q").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    found = counts.withColumn("__end", end).filter("__at < __end AND __at >= __end - __n").groupBy("__k").agg(*(F.max(F.when(F.col("__q") == name, F.col(value))).alias(name) for name in places))
    keys = own.groupBy("__k").agg(F.count("__v").alias(count or "__n"))
    return keys.join(found, "__k", "left").select("__k.*", *places, *([count] if count else []))


def rank_quantiles(df: DataFrame, by: Names, value: str, quantiles: dict[str, float]) -> DataFrame:
    """A column each of `quantiles`: the value at index floor(q * (n - 1)) of the sorted group; null if a group has no values."""
    return at_ranks(df, by, value, {name: lambda n, q=q: F.floor(F.lit(q) * (n - 1)) for name, q in quantiles.items()})


def variation(value: str) -> Column:
    """Population standard deviation over mean; 0 with fewer than two values or a zero mean."""
    return F.when((F.count(value) < 2) | (F.avg(value) == 0), F.lit(0.0)).otherwise(F.try_divide(F.stddev_pop(value), F.avg(value)))


def _steps(value: str, time: str, w) -> Column:
    dt = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    return (F.col(value) + F.lag(value).over(w)) / 2 * dt, dt


def integral(df: DataFrame, by: Names, value: str = "value", tz: str = SITE.tz, unit_s: float = 1.0, max_gap_s: float | None = None, time: str = "time") -> DataFrame:
    """Trapezoids between neighbours inside one local day, summed a key and day; one point gives 0.

    Partitioned by key and day, so the sort is bounded by a day whatever the length of a series.
    """
    present = df.filter(F.col(value).isNotNull()).withColumn("local_day", T.local_day(F.col(time), tz))
    w = W.partitionBy(*by, "local_day").orderBy(time)
    area, dt = _steps(value, time, w)
    if max_gap_s is not None:
        area = F.when(dt <= max_gap_s, area)
    return present.withColumn("__area", area).groupBy(*by, "local_day").agg((F.coalesce(F.sum("__area"), F.lit(0.0)) / unit_s).alias(value), F.count(F.lit(1)).alias("n"))


def running_integral(df: DataFrame, by: Names, value: str = "value", tz: str = SITE.tz, unit_s: float = 1.0, to: str = "running", time: str = "time") -> DataFrame:
    """Adds what has accumulated since the local midnight at each sample."""
    present = df.filter(F.col(value).isNotNull()).withColumn("local_day", T.local_day(F.col(time), tz))
    w = W.partitionBy(*by, "local_day").orderBy(time)
    area, _ = _steps(value, time, w)
    return present.withColumn("__area", F.coalesce(area, F.lit(0.0))).withColumn(to, F.sum("__area").over(w.rowsBetween(W.unboundedPreceding, 0)) / unit_s).drop("__area")


def counter_increase(df: DataFrame, series: Names, by: Names, start: datetime, stop: datetime, value: str = "counter", time: str = "time") -> DataFrame:
    """Growth of counters in [start, stop), by group; a fall is a restart and adds nothing."""
    inside = df.filter((F.col(time) >= T.instant(start)) & (F.col(time) < T.instant(stop)))
    step = F.col(value) - F.lag(value).over(W.partitionBy(*series).orderBy(time))
    return inside.withColumn("__d", step).groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("__d") >= 0, F.col("__d"))), F.lit(0.0)).alias("increase"))


def fit_origin(df: DataFrame, x: str, y: str, by: Names) -> DataFrame:
    """Least squares through the origin: slope, n and uncentred R2, residuals summed in a second pass."""
    sums = df.groupBy(*by).agg(F.sum(F.col(x) * F.col(y)).alias("__xy"), F.sum(F.col(x) * F.col(x)).alias("__xx"))
    slope = sums.select(*by, F.try_divide("__xy", "__xx").alias("slope"))
    miss = F.col(y) - F.col("slope") * F.col(x)
    return (
        df.join(slope, list(by))
        .groupBy(*by)
        .agg(F.first("slope").alias("slope"), F.count(F.lit(1)).alias("n"), F.sum(miss * miss).alias("__res"), F.sum(F.col(y) * F.col(y)).alias("__tot"))
        .withColumn("r2", 1 - F.try_divide("__res", "__tot"))
        .drop("__res", "__tot")
    )


def pivot_fields(df: DataFrame, keys: Names, fields: Names, value: str = "value") -> DataFrame:
    """Fields to columns by conditional aggregates: one shuffle, and the columns are known beforehand."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col("field") == f, F.col(value))).alias(f) for f in fields))


# -- ordered windows ----------------------------------------------------------------------------


def latest_per(df: DataFrame, keys: Names, order: Names = ("time",)) -> DataFrame:
    """The last row of each key, ties by the later order columns; a map-side combined aggregate, no sort."""
    row = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")


def difference(df: DataFrame, by: Names, value: str = "value", order: Names = ("time",)) -> DataFrame:
    """Value minus the one before, stamped at the later row; the first row of a key goes."""
    found = with_neighbours(df, by, (value,), order, before="__before", time=order[0])
    return found.withColumn(value, F.col(value) - F.col(f"__before.{value}")).filter(F.col(value).isNotNull()).select(*df.columns)


def daily_min(df: DataFrame, by: Names, value: str = "value", tz: str = SITE.tz) -> DataFrame:
    return aggregate_window(df, "1d", "min", by, value, tz)


def day_over_day(df: DataFrame, by: Names, value: str = "value", tz: str = SITE.tz) -> DataFrame:
    """Each local day's lowest value and its change against the day before that has one."""
    daily = daily_min(df, by, value, tz)
    return daily.withColumn("change", F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy("local_day")))


def tail_n(df: DataFrame, by: Names, n: int, order: Names = ("time",)) -> DataFrame:
    """The last n rows of each key."""
    w = W.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def silent_gaps(df: DataFrame, by: Names, minutes: float, as_of: datetime, time: str = "time") -> DataFrame:
    """(by, gap_start, gap_stop, minutes): every stretch without a point that lasts longer than allowed, up to as_of."""
    found = with_neighbours(df.select(*by, time), by, (time,), (time,), after="__after", time=time).filter(F.col(time) < T.instant(as_of))
    gaps = found.select(*by, F.col(time).alias("gap_start"), F.coalesce(F.col(f"__after.{time}"), T.instant(as_of)).alias("gap_stop"))
    return gaps.withColumn("minutes", (F.unix_micros("gap_stop") - F.unix_micros("gap_start")) / 6e7).filter(F.col("minutes") > minutes)


def rolling_stats(df: DataFrame, by: Names, n: int = 24, value: str = "grams", time: str = "time") -> DataFrame:
    """Adds mean, min, max, range, count and time span (s) over the last n samples."""
    parts, names = in_parts(df, by, n - 1, (time,), time)
    w = W.partitionBy(*names).orderBy(time).rowsBetween(1 - n, 0)
    found = parts.withColumns(
        {
            "mean_g": F.avg(value).over(w), "min_g": F.min(value).over(w), "max_g": F.max(value).over(w), "samples": F.count(value).over(w),
            "span_s": (F.unix_micros(time) - F.min(F.unix_micros(time)).over(w)) / 1e6,
        }
    )
    return without_parts(found).withColumn("range_g", F.col("max_g") - F.col("min_g"))


def state_changes(df: DataFrame, by: Names, state: str, order: Names = ("time",)) -> DataFrame:
    """Rows whose state differs from the one before."""
    found = with_neighbours(df, by, (state,), order, before="__before", time=order[0])
    return found.filter(F.col("__before").isNull() | ~F.col(f"__before.{state}").eqNullSafe(F.col(state))).select(*df.columns)


def state_intervals(df: DataFrame, by: Names, state: str, end: datetime | None = None, order: Names = ("time",), time: str = "time") -> DataFrame:
    """(by, state, start, stop): how long each state lasts; the last one ends at `end`, or is open."""
    found = with_neighbours(df.select(*dict.fromkeys([*by, state, time, *order])), by, (time,), order, after="__after", time=time)
    stop = F.coalesce(F.col(f"__after.{time}"), T.instant(end) if end else F.lit(None).cast("timestamp"))
    return found.select(*by, F.col(state), F.col(time).alias("start"), stop.alias("stop"))


def baseline_drift(df: DataFrame, by: Names, value: str, n: int = 7, order: Names = ("time",)) -> DataFrame:
    """Adds the median of the n rows before, and the relative change against it."""
    parts, names = in_parts(df, by, n, order, order[0])
    w = W.partitionBy(*names).orderBy(*order).rowsBetween(-n, -1)
    values = F.sort_array(F.collect_list(value).over(w))  # at most n values; the median of a frame has no other form
    low, high = (F.get(values, F.floor((F.size(values) - k) / 2).cast("int")) for k in (1, 0))
    found = without_parts(parts.withColumn("baseline", (low + high) / 2))
    return found.withColumn("drift", F.try_divide(F.col(value) - F.col("baseline"), F.col("baseline")))
