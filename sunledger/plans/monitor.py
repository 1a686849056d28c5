"""Monitoring: silence, delivery failures, plausibility of two sensors, alert life cycle, digests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site
from ..functions import text as X
from ..functions import time as T
from ..operators import series as S
from ..operators.days import with_neighbours, with_runs
from ..operators.joins import join_on_window


def _deadman(df: DataFrame, keys: Sequence[str], as_of: datetime, limit_min: float, look_back: timedelta, known: DataFrame | None) -> DataFrame:
    seen = df.filter((F.col("time") >= T.instant(as_of - look_back)) & (F.col("time") <= T.instant(as_of)))
    last = seen.groupBy(*keys).agg(F.max("time").alias("last_seen"))
    if known is not None:
        last = known.select(*keys).distinct().join(last, list(keys), "left")
    age = T.age_minutes(F.col("last_seen"), as_of)
    return last.withColumn("age_min", age).withColumn("state", F.when(F.col("last_seen").isNull(), "NoData").when(F.col("age_min") > limit_min, "Alerting").otherwise("Normal"))


def deadman_air(air: DataFrame, as_of: datetime, known: DataFrame | None = None, skip_devices: Sequence[str] = (), skip_fields: Sequence[str] = ("weight_raw",), limit_min: float = 15, look_back: timedelta = timedelta(days=30), site: Site = SITE) -> DataFrame:
    """Silence of each (device, field) of long air points; light fields count only while the lamp may run.

    `known` names series that must be there: those not seen in the look-back come out as NoData.
    """
    own = S.production_only(air, skip_devices, skip_fields)
    return _deadman(S.gate_fields_at(own, as_of, site=site), ("device", "field"), as_of, limit_min, look_back, known if known is None else S.gate_fields_at(known, as_of, site=site))


def deadman_feed(df: DataFrame, as_of: datetime, limit_min: float = 60, look_back: timedelta = timedelta(days=30)) -> DataFrame:
    """Silence of a whole feed: always one row, NoData if nothing was seen."""
    seen = df.filter((F.col("time") >= T.instant(as_of - look_back)) & (F.col("time") <= T.instant(as_of))).agg(F.max("time").alias("last_seen"))
    return seen.withColumn("age_min", T.age_minutes(F.col("last_seen"), as_of)).withColumn("state", F.when(F.col("last_seen").isNull(), "NoData").when(F.col("age_min") > limit_min, "Alerting").otherwise("Normal"))


def deadman_spectrum(spectrum: DataFrame, as_of: datetime, known: DataFrame | None = None, skip_devices: Sequence[str] = (), limit_min: float = 15, look_back: timedelta = timedelta(days=30)) -> DataFrame:
    """Silence of `clear` in ambient mode, a device."""
    own = S.production_only(spectrum.filter("mode = 'ambient' AND clear IS NOT NULL"), skip_devices)
    return _deadman(own, ("device",), as_of, limit_min, look_back, known)


def delivery_failures(counters: DataFrame, as_of: datetime, series: Sequence[str] = ("integration",), window: timedelta = timedelta(hours=1)) -> DataFrame:
    """Growth of failure counters in the last hour, by integration; no data is fine."""
    grown = S.counter_increase(counters, series, ("integration",), as_of - window, as_of)
    return grown.withColumn("state", F.when(F.col("increase") > 0, "Alerting").otherwise("Normal"))


def failing_hours(counters: DataFrame, series: Sequence[str] = ("integration",)) -> DataFrame:
    """(integration, hour, increase) of every hour with failures: what was missed, and when."""
    found = with_neighbours(counters, series, ("counter",), before="__before")
    hours = found.withColumns({"__d": F.col("counter") - F.col("__before.counter"), "hour": F.date_trunc("hour", "time")})
    return hours.groupBy("integration", "hour").agg(F.sum(F.when(F.col("__d") >= 0, F.col("__d"))).alias("increase")).filter("increase > 0")


def throughput_ratio(air: DataFrame, spectrum: DataFrame, as_of: datetime, low: float = 2.5, high: float = 12.0, look_back: timedelta = timedelta(hours=24), last: int = 6, site: Site = SITE, known: DataFrame | None = None, known_days: int = 30) -> DataFrame:
    """Median of the last ten-minute ratios clear / lux inside the lamp window, a device; outside the band alerts.

    Devices are those of `known`, or else those with readings in the last known_days: a device without a ratio is NoData.
    """
    window = T.in_local_window(F.col("time"), site.tz, site.lamp_start + 60, site.lamp_end - 30)
    inside = window & (F.col("time") >= T.instant(as_of - look_back)) & (F.col("time") < T.instant(as_of))
    lux = S.aggregate_window(air.filter(inside & F.col("lux").isNotNull()), "10m", "median", ("device",), "lux").drop("window_stop")
    clear = S.aggregate_window(S.unsaturated(spectrum.filter((F.col("mode") == "ambient") & inside)), "10m", "median", ("device",), "clear").drop("window_stop")
    ratios = join_on_window(lux, clear, ("device",)).filter("lux > 0").withColumn("ratio", F.col("clear") / F.col("lux"))
    found = S.tail_n(ratios, ("device",), last, ("window_start",)).groupBy("device").agg(F.median("ratio").alias("ratio"), F.count(F.lit(1)).alias("windows"))
    recent = (F.col("time") >= T.instant(as_of - timedelta(days=known_days))) & (F.col("time") < T.instant(as_of))
    devices = (air.filter(recent) if known is None else known).select("device").distinct()
    return devices.join(found, "device", "left").withColumn("windows", F.coalesce("windows", F.lit(0))).withColumn("state", F.when(F.col("ratio").isNull(), "NoData").when(X.outside(F.col("ratio"), low, high), "Alerting").otherwise("Normal"))


def freshness_matrix(points: DataFrame, fields: Sequence[str], as_of: datetime, green_s: float = 180, red_s: float = 300) -> DataFrame:
    """A row a device: seconds since each field's last point (age_<field>), and what the pattern says."""
    ages = points.filter(F.col("time") <= T.instant(as_of)).groupBy("device").agg(*(((F.unix_micros(T.instant(as_of)) - F.max(F.when(F.col("field") == f, F.unix_micros("time")))) / 1e6).alias(f"age_{f}") for f in fields))
    red = sum((F.coalesce(F.col(f"age_{f}") > red_s, F.lit(True)).cast("int") for f in fields), F.lit(0))
    amber = sum((F.coalesce(F.col(f"age_{f}") >= green_s, F.lit(True)).cast("int") for f in fields), F.lit(0))
    label = F.when(F.col("n_red") == len(fields), "device_offline").when(F.col("n_red") > 0, "sensor_dropped").when(F.col("n_late") > 0, "late").otherwise("fresh")
    return ages.withColumns({"n_red": red, "n_late": amber}).withColumn("class", label)


def alert_states(evals: DataFrame, by: Sequence[str], hold_s: float, condition: str = "firing", time: str = "time") -> DataFrame:
    """The life cycle of a condition that is sampled regularly: Normal, Pending, Firing, Resolved.

    It fires once the condition has held for hold_s since the first true sample of its run; the
    first false sample after a run that fired is Resolved. A null condition counts as false.
    """
    own = evals.withColumn("__on", F.coalesce(F.col(condition), F.lit(False)))
    runs = with_runs(own, by, (time, "__on"), lambda a, b: a["__on"] != b["__on"], (time,), time)
    held = lambda at, since: (F.unix_micros(at) - F.unix_micros(since)) / 1e6
    length = F.when(F.col("__on"), held(F.col(time), F.col("__since"))).otherwise(0.0)
    fired = F.col("__before.__on") & (held(F.col(f"__before.{time}"), F.col("__since_before")) >= hold_s)
    state = F.when(F.col("__on") & (F.col("held_s") >= hold_s), "Firing").when(F.col("__on"), "Pending").when(fired, "Resolved").otherwise("Normal")
    return runs.withColumn("held_s", length).withColumn("state", state).drop("__on", "__before", "__new", "__since", "__since_before")


#: Severities, most urgent first.
SEVERITIES = ("critical", "warning", "info")


def alert_digest(alerts: DataFrame) -> DataFrame:
    """One message a rule and device from rows of (rule, device, field, severity, value, state) that fire."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    firing = alerts.filter("state = 'Firing' OR state = 'Alerting'").withColumn("__rank", rank)
    out = firing.groupBy("rule", "device").agg(F.min("__rank").alias("__rank"), F.array_sort(F.collect_set("field")).alias("fields"), F.max("value").alias("worst"))
    text = F.concat(F.col("rule"), F.lit(": "), F.col("device"), F.lit(" "), F.concat_ws(", ", "fields"), F.lit(" "), F.format_string("%.0f", F.col("worst")))
    return out.withColumns({"severity": F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("__rank").cast("int")), "text": text}).select("rule", "device", "severity", "fields", "text")


def health_summary(health: DataFrame, sensors: Sequence[str], tz: str = SITE.tz) -> tuple[DataFrame, DataFrame]:
    """((device, local_day): presence of each sensor, all-absent messages, median read time; (device, reset): counts)."""
    absent = F.count_if(F.greatest(*sensors) == 0) if len(sensors) > 1 else F.count_if(F.col(sensors[0]) == 0)
    daily = health.groupBy("device", T.local_day(F.col("time"), tz).alias("local_day")).agg(
        F.count(F.lit(1)).alias("messages"), *(F.avg(s).alias(f"{s}_ratio") for s in sensors), absent.alias("bus_dead"), F.median("spectrum_read_ms").alias("read_ms")
    )
    return daily, health.groupBy("device", "reset").agg(F.count(F.lit(1)).alias("n"))
