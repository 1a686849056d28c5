"""Light: daily integrals, photon flux, the lamp's hours and share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site
from ..functions import light as L
from ..functions import time as T
from ..operators import series as S
from ..operators.joins import asof_join


def dli_lux(air: DataFrame, tz: str = SITE.tz) -> DataFrame:
    """(device, local_day, dli, n): moles a square metre and local day, from lux."""
    flux = air.filter(F.col("lux").isNotNull()).select("device", "time", L.lux_to_ppfd(F.col("lux")).alias("ppfd"))
    return S.integral(flux, ("device",), "ppfd", tz).select("device", "local_day", L.micromoles_to_moles(F.col("ppfd")).alias("dli"), "n")


def ppfd_series(spectrum: DataFrame, cal: float) -> DataFrame:
    """(device, time, ppfd) of unsaturated ambient spectra."""
    return S.unsaturated(spectrum.filter("mode = 'ambient'")).select("device", "time", L.spectrum_ppfd(cal).alias("ppfd")).filter("ppfd IS NOT NULL")


def dli_spectrum(spectrum: DataFrame, cal: float, tz: str = SITE.tz) -> DataFrame:
    return S.integral(ppfd_series(spectrum, cal), ("device",), "ppfd", tz).select("device", "local_day", L.micromoles_to_moles(F.col("ppfd")).alias("dli"), "n")


def running_dli(air: DataFrame, tz: str = SITE.tz) -> DataFrame:
    """Today's integral so far at each sample: what the evening top-up sees."""
    flux = air.filter(F.col("lux").isNotNull()).select("device", "time", L.lux_to_ppfd(F.col("lux")).alias("ppfd"))
    return S.running_integral(flux, ("device",), "ppfd", tz, 1e6, "dli")


def lamp_window_medians(air: DataFrame, spectrum: DataFrame, site: Site = SITE) -> DataFrame:
    """Median lux and clear a device and local day inside the lamp window."""
    window = T.in_local_window(F.col("time"), site.tz, site.lamp_start, site.lamp_end)
    lux = S.aggregate_window(air.filter(window), "1d", "median", ("device",), "lux", site.tz)
    clear = S.aggregate_window(S.unsaturated(spectrum.filter("mode = 'ambient'")).filter(window), "1d", "median", ("device",), "clear", site.tz)
    return lux.join(clear, ["device", "local_day"], "full_outer")


def lamp_daily(states: DataFrame, end: datetime, tz: str = SITE.tz) -> DataFrame:
    """(location, local_day, on_hours, last_off): intervals of the lamp cut at local midnight."""
    spans = S.state_intervals(states, ("location",), "on", end).filter("stop IS NOT NULL AND stop > start")
    days = F.sequence(T.local_day(F.col("start"), tz), T.local_day(F.col("stop") - F.expr("INTERVAL 1 MICROSECOND"), tz))
    cut = spans.filter("on = 1").withColumn("local_day", F.explode(days))
    low = F.greatest(F.col("start"), T.day_start(F.col("local_day"), tz))
    high = F.least(F.col("stop"), T.day_start(F.date_add("local_day", 1), tz))
    hours = cut.groupBy("location", "local_day").agg((F.sum((F.unix_micros(high) - F.unix_micros(low)) / 3.6e9)).alias("on_hours"))
    offs = spans.filter((F.col("on") == 1) & (F.col("stop") < T.instant(end))).withColumn("local_day", T.local_day(F.col("stop"), tz)).groupBy("location", "local_day").agg(F.max("stop").alias("last_off"))
    return hours.join(offs, ["location", "local_day"], "full_outer")


def dli_split(air: DataFrame, tz: str = SITE.tz) -> DataFrame:
    """(device, local_day, dli, dli_lamp, dli_natural): the shielded sensor's light is the natural share."""
    both = air.filter("lux IS NOT NULL AND lux_ref IS NOT NULL")
    total = S.integral(both, ("device",), "lux", tz).select("device", "local_day", F.col("lux").alias("__all"))
    natural = S.integral(both, ("device",), "lux_ref", tz).select("device", "local_day", F.col("lux_ref").alias("__ref"))
    moles = {"dli": F.col("__all") / 54e6, "dli_lamp": (F.col("__all") - F.col("__ref")) / 54e6, "dli_natural": F.col("__ref") / 54e6}
    return total.join(natural, ["device", "local_day"]).withColumns(moles).drop("__all", "__ref")


def dli_by_state(air: DataFrame, states: DataFrame, tz: str = SITE.tz) -> DataFrame:
    """(location, local_day, dli_on, dli_off): light integrated while the lamp was on, and while it wasn't.

    `air` carries a location. A trapezoid belongs to the state at its later end.
    """
    from pyspark.sql import Window as W

    tagged = asof_join(air.filter("lux IS NOT NULL").select("location", "time", "lux"), states, ("location",), ("on",)).withColumn("local_day", T.local_day(F.col("time"), tz))
    w = W.partitionBy("location", "local_day").orderBy("time")
    area = (F.col("lux") + F.lag("lux").over(w)) / 2 * (F.unix_micros("time") - F.unix_micros(F.lag("time").over(w))) / 1e6 / 54e6
    on = F.coalesce(F.col("on") == 1, F.lit(False))
    parts = tagged.withColumn("__a", area)
    return parts.groupBy("location", "local_day").agg(F.coalesce(F.sum(F.when(on, F.col("__a"))), F.lit(0.0)).alias("dli_on"), F.coalesce(F.sum(F.when(~on, F.col("__a"))), F.lit(0.0)).alias("dli_off"))
