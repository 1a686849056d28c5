"""Calibration of the spectrum sensor against lux: fits, gates, one row a window whatever happens."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..config import SITE, Site
from ..functions import light as L
from ..functions import solar
from ..functions import time as T
from ..operators import series as S
from ..operators.joins import pair_stats, state_held

#: Gates: usable minutes, brightness span, drift.
MIN_MINUTES, MIN_SPAN, MAX_DRIFT = 20, 2.0, 30.0
METRICS = ("cal_ols", "cal_med", "r2", "drift_pct", "spread_pct")


def cal_windows(days: DataFrame, mode: str = "pre-lamp", site: Site = SITE, span_min: int = 120, half_min: int = 15) -> DataFrame:
    """Adds window_mode, start and stop to rows with a local_day."""
    if mode == "pre-lamp":
        start, stop = T.pre_lamp_window(F.col("local_day"), site, span_min)
    elif mode == "noon":
        # Once a day, not once a device; the aggregate also keeps the optimizer from carrying the whole formula through every later predicate.
        noons = solar.with_solar_noon(days.select("local_day").distinct(), "local_day", site).groupBy("local_day").agg(F.max("noon").alias("noon"))
        days = days.join(noons, "local_day")
        start, stop = F.col("noon") - F.expr(f"INTERVAL {half_min} MINUTE"), F.col("noon") + F.expr(f"INTERVAL {half_min} MINUTE")
    else:
        raise ValueError(f"no such mode: {mode}")
    return days.withColumns({"window_mode": F.lit(mode), "start": start, "stop": stop}).drop("noon")


def window_minutes(air: DataFrame, spectrum: DataFrame, windows: DataFrame, saturation: str = "mean") -> DataFrame:
    """(device, start, minute, lux, channels): one-minute means, both series aligned by one aggregate.

    A window is matched by device and UTC day, then by its bounds. saturation="raw" tests the largest
    reading of a minute against full scale instead of the mean, by putting it in the channel.
    """
    days = F.explode(F.sequence(F.to_date("start"), F.to_date("stop")))
    keyed = windows.select("device", "start", "stop", days.alias("__day"))
    parts = air.select("device", "time", "lux", *(F.lit(None).cast("double").alias(c) for c in C.CHANNELS)).unionByName(
        spectrum.filter("mode = 'ambient'").select("device", "time", F.lit(None).cast("double").alias("lux"), *C.CHANNELS)
    )
    inside = parts.withColumn("__day", F.to_date("time")).join(keyed, ["device", "__day"]).filter("time >= start AND time < stop")

    def channel(c: str):
        return F.when(F.max(c) >= C.FULL_SCALE, F.max(c)).otherwise(F.avg(c)) if saturation == "raw" else F.avg(c)

    return inside.groupBy("device", "start", F.date_trunc("minute", "time").alias("minute")).agg(F.avg("lux").alias("lux"), *(channel(c).alias(c) for c in C.CHANNELS))


def fit_rows(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], lux_min: float, lux_max: float = 45000.0, saturation: float = C.FULL_SCALE, bins: int = 5) -> DataFrame:
    """Reject counts, fit, spread and drift of each group of rows with lux and channels. One row a group.

    Everything hangs on one shuffle by the keys: slope, rank and bin means are windows inside it, the rest one aggregate.
    """
    judged = S.classify_minutes(rows, lux_min, lux_max, saturation).repartition(*keys)
    own = W.partitionBy(*keys, "__kept")
    staged = (
        judged.withColumn("__kept", F.col("reason") == "kept")
        .withColumn("__slope", F.try_divide(F.sum(F.col("s") * F.col("ppfd")).over(own), F.sum(F.col("s") * F.col("s")).over(own)))
        .withColumn("__bin", F.floor((F.row_number().over(own.orderBy(*order)) * bins - 1) / F.count(F.lit(1)).over(own)))
        .withColumn("__mean", F.avg("ratio").over(W.partitionBy(*keys, "__kept", "__bin")))
        .withColumn("__miss", F.col("ppfd") - F.col("__slope") * F.col("s"))
    )

    def kept(c: str | Column) -> Column:
        return F.when(F.col("__kept"), c if isinstance(c, Column) else F.col(c))

    found = staged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in S.REASONS), F.min(kept("lux")).alias("lux_lo"), F.max(kept("lux")).alias("lux_hi"),
        F.median(kept("ratio")).alias("cal_med"), F.max(kept("__slope")).alias("cal_ols"), F.sum(kept(F.col("__miss") * F.col("__miss"))).alias("__res"), F.sum(kept(F.col("ppfd") * F.col("ppfd"))).alias("__tot"),
        (F.max(kept("__mean")) - F.min(kept("__mean"))).alias("__drift"), F.sort_array(F.collect_list(kept("ratio"))).alias("__ratios"),
    )

    def rank(q: float) -> Column:
        return F.get("__ratios", F.floor(F.lit(q) * (F.size("__ratios") - 1)).cast("int"))

    metrics = {"r2": 1 - F.try_divide("__res", "__tot"), "drift_pct": F.try_divide(F.col("__drift") * 100, F.col("cal_med")), "spread_pct": F.try_divide((rank(0.9) - rank(0.1)) * 100, F.col("cal_med"))}
    return found.withColumns(metrics).drop("__res", "__tot", "__drift", "__ratios")


def judge(fits: DataFrame) -> DataFrame:
    """Applies the gates: metrics appear only where there are enough minutes and brightness span; valid is 0 or 1."""
    span = F.try_divide(F.col("lux_hi"), F.greatest(F.col("lux_lo"), F.lit(1e-9)))
    enough = F.coalesce((F.col("n_kept") >= MIN_MINUTES) & (span >= MIN_SPAN), F.lit(False))
    out = fits.withColumns({m: F.when(enough, F.col(m)) for m in METRICS})
    verdict = F.when(F.col("n_kept") < MIN_MINUTES, "insufficient").when(~enough, "narrow").when(F.col("drift_pct") > MAX_DRIFT, "drifting").otherwise("ok")
    return out.withColumn("outcome", verdict).withColumn("valid", F.when(F.col("outcome") == "ok", 1.0).otherwise(0.0))


def calibrate_window(air: DataFrame, spectrum: DataFrame, windows: DataFrame, lux_min: float = 3000.0, lux_max: float = 45000.0, saturation: str = "mean") -> DataFrame:
    """A judged fit for every window (device, start, stop), also where there is nothing to fit."""
    minutes = window_minutes(air, spectrum, windows, saturation)
    fits = fit_rows(minutes, ("device", "start"), ("lux", "minute"), lux_min, lux_max)
    counts = [c for c in fits.columns if c.startswith("n_")]
    every = windows.join(fits, ["device", "start"], "left").fillna(0, counts)
    return judge(every)


def ppfd_cal_daily(air: DataFrame, spectrum: DataFrame, light: DataFrame, days: DataFrame, mode: str = "pre-lamp", lux_min: float = 300.0, site: Site = SITE, ref_min: float = 500.0) -> DataFrame:
    """One row a device and local day, stamped with the window's start, so that a repeat overwrites it.

    `days` has device, location and local_day. Before the lamp starts it is off by schedule; at noon that is verified
    from the lamp's changes, and days too dark five minutes before the lamp would be switched off are skipped.
    """
    windows = cal_windows(days, mode, site)
    if mode == "noon":
        ref = air.select(F.col("device").alias("__device"), F.col("time").alias("__time"), "lux_ref")
        probe = F.col("start") - F.expr("INTERVAL 120 MINUTE")
        early = probe - F.expr("INTERVAL 5 MINUTE")
        # Equal on device and hour (of either end), then the range.
        hours = F.explode(F.array_distinct(F.array(F.date_trunc("hour", early), F.date_trunc("hour", probe))))
        near = windows.withColumn("__hour", hours).join(
            ref.withColumn("__at", F.date_trunc("hour", "__time")), (F.col("device") == F.col("__device")) & (F.col("__hour") == F.col("__at")) & (F.col("__time") >= early) & (F.col("__time") < probe), "left"
        )
        floor = F.coalesce(F.median("lux_ref") >= ref_min, F.lit(False))
        windows = near.groupBy(*windows.columns).agg(F.when(floor, 0.0).otherwise(1.0).alias("skipped"))
        windows = state_held(windows, light, ("location",), "on", 0.0).withColumn("lamp_off_ok", F.when((F.col("skipped") == 0) & F.col("held"), 1.0).otherwise(0.0)).drop("held")
    else:
        windows = windows.withColumns({"skipped": F.lit(0.0), "lamp_off_ok": F.lit(1.0)})
    fitted = calibrate_window(air, spectrum, windows, lux_min)
    done = F.col("skipped") == 0
    none = {c: F.when(done, F.col(c)) for c in (*METRICS, "lux_lo", "lux_hi")} | {"n_kept": F.when(done, F.col("n_kept")).otherwise(0), "valid": F.when(done, F.col("valid")).otherwise(0.0)}
    return fitted.withColumns(none).withColumn("time", F.col("start")).select("device", "window_mode", "local_day", "time", "n_kept", *METRICS, "lux_lo", "lux_hi", "valid", "skipped", "lamp_off_ok")


def cal_adoption(ppfd_cal: DataFrame, current: float, days: int = 5, stable_pct: float = 5.0, deviates_pct: float = 10.0) -> DataFrame:
    """Proposes the median of the last `days` valid fits a device where they agree and leave the current factor."""
    last = S.tail_n(ppfd_cal.filter("valid = 1 AND cal_ols IS NOT NULL"), ("device",), days, ("time",))
    found = last.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.median("cal_ols").alias("proposed"), F.min("cal_ols").alias("__lo"), F.max("cal_ols").alias("__hi"))
    spread = F.try_divide((F.col("__hi") - F.col("__lo")) * 100, F.col("proposed"))
    off = F.abs(F.col("proposed") / current - 1) * 100
    return found.withColumns({"spread_pct": spread, "off_pct": off}).withColumn("propose", (F.col("n") >= days) & (F.col("spread_pct") <= stable_pct) & (F.col("off_pct") > deviates_pct)).drop("__lo", "__hi")


def pair_meter(readings: DataFrame, air: DataFrame, spectrum: DataFrame, cal: float, half: timedelta = timedelta(minutes=2), least: int = 3, max_cv: float = 0.25) -> DataFrame:
    """Meter readings (device, time, ppfd, ...) with the means of co-timed samples; -1 where they don't pair."""
    lux = pair_stats(readings, air.select("device", "time", "lux", "lux_ref"), ("device",), half, ("lux", "lux_ref"), ("lux",))
    names = list(readings.columns)
    cv = F.when((F.col("n_lux") < 2) | (F.col("avg_lux") == 0), F.lit(0.0)).otherwise(F.try_divide("dev_lux", "avg_lux"))
    stats = lux.select(*names, "n_lux", F.col("avg_lux").alias("lux_at"), F.col("avg_lux_ref").alias("lux_ref_at"), cv.alias("lux_cv"))
    full = L.all_present()
    clipped = L.any_at_least(C.FULL_SCALE)
    samples = spectrum.filter((F.col("mode") == "ambient") & full & ~clipped).select("device", "time", *C.CHANNELS, L.spectrum_ppfd(cal).alias("sample_ppfd"))
    spec = pair_stats(readings.select("device", "time"), samples, ("device",), half, ("sample_ppfd", *C.CHANNELS))
    spec = spec.select("device", "time", F.col("n_sample_ppfd").alias("n"), F.col("avg_sample_ppfd").alias("spec_ppfd_at"), *(F.col(f"avg_{c}").alias(c) for c in C.CHANNELS))
    both = stats.join(spec, ["device", "time"]).select(*names, "n_lux", "lux_at", "lux_ref_at", "lux_cv", "n", "spec_ppfd_at", *C.CHANNELS)
    paired = (F.col("n") >= least) & (F.col("n_lux") >= 1) & (F.coalesce("lux_cv", F.lit(0.0)) <= max_cv)
    marked = both.withColumn("paired", F.when(paired, 1.0).otherwise(0.0))
    return marked.withColumns({c: F.when(F.col("paired") == 1, F.coalesce(c, F.lit(-1.0))).otherwise(-1.0) for c in ("spec_ppfd_at", "lux_at", "lux_ref_at", *C.CHANNELS)}).withColumn("cal_at", F.lit(cal))


def drift_diagnostics(air: DataFrame, spectrum: DataFrame, light: DataFrame, tz: str = SITE.tz) -> DataFrame:
    """(device, local_day): dark floor of the spectrum, lux / lux_ref with the lamp off, spectrum sum / lux, clear / lux.

    `air` and `spectrum` share device and time of a message; `air` carries the lamp's location.
    """
    from ..operators.joins import asof_join

    off = asof_join(air.select("device", "location", "time", "lux", "lux_ref"), light, ("location",), ("on",), timedelta(days=7)).filter("on = 0")
    day = T.local_day(F.col("time"), tz).alias("local_day")
    lamp_off = off.groupBy("device", day).agg(F.median(F.try_divide("lux", "lux_ref")).alias("lux_over_ref"))
    both = spectrum.filter("mode = 'ambient'").join(air.select("device", "time", "lux"), ["device", "time"])
    optics = both.groupBy("device", day).agg(F.min("clear").alias("dark_floor"), F.median(F.try_divide(L.spectrum_sum(), F.col("lux"))).alias("spectrum_over_lux"), F.median(F.try_divide("clear", "lux")).alias("clear_over_lux"))
    return optics.join(lamp_off, ["device", "local_day"], "full_outer")


def as_points(cal: DataFrame) -> DataFrame:
    """The lines that a store would get for these rows, every number as a float."""
    from ..sources.line_protocol import to_line_protocol

    return to_line_protocol(cal, "ppfd_cal", ("device", "window_mode"), ("n_kept", *METRICS, "lux_lo", "lux_hi", "valid", "skipped", "lamp_off_ok"), precision="ns")

