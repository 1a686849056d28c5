"""The weigh station: stable readings, events to weights, references for watering, relabelling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import SITE
from ..functions import time as T
from ..operators import joins as J
from ..operators import series as S
from ..operators.ordered import dedup_ttl
from ..operators.ranked import percentiles
from ..operators.sets import stale_refs
from ..sources.messages import acks
from ..sources.tables import delete_where, upsert_points


def grams(raw: str, tare: str, scale: str) -> Column:
    return F.try_divide(F.col(raw) - F.col(tare), F.when(F.coalesce(F.col(scale), F.lit(0.0)) == 0, 1.0).otherwise(F.col(scale)))


def scale_calibration(raw: DataFrame, known_mass: float, least: int = 8) -> DataFrame:
    """(device, tare, scale) from raw samples with `phase` empty or loaded; null without enough samples or any difference."""
    sums = raw.groupBy("device").agg(
        *(F.avg(F.when(F.col("phase") == p, F.col("raw"))).alias(f"__{p}") for p in ("empty", "loaded")), *(F.count_if(F.col("phase") == p).alias(f"n_{p}") for p in ("empty", "loaded"))
    )
    tare = F.when(F.col("n_empty") >= least, F.round("__empty"))
    delta = F.col("__loaded") - F.col("tare")
    scale = F.when((F.col("n_loaded") >= least) & (delta != 0) & (F.lit(known_mass) > 0), delta / known_mass)
    return sums.withColumn("tare", tare).withColumn("scale", scale).drop("__empty", "__loaded")


def stable_weighs(samples: DataFrame, taps: DataFrame, range_g: float = 2.0, span_s: float = 2.0, hold_s: float = 1.5, settle_s: float = 2.0, timeout_s: float = 20.0, n: int = 24) -> DataFrame:
    """(device, tap_time, uid, result, weight_g, time): the first moment after a tap at which the scale has held still.

    Still means: the last n samples range over less than range_g and span span_s. That must hold for hold_s without
    a break, and settle_s after the tap; after timeout_s the result is UNSTABLE.
    """
    rolled = S.rolling_stats(samples, ("device",), n).withColumn("still", (F.col("range_g") < range_g) & (F.col("span_s") >= span_s))
    tapped = J.asof_join(rolled.select("device", "time", "mean_g", "still"), taps.select("device", "time", "uid"), ("device",), ("uid",), timedelta(seconds=timeout_s)).filter("asof_time IS NOT NULL").withColumnRenamed("asof_time", "tap_time")
    w = W.partitionBy("device", "tap_time").orderBy("time")
    runs = tapped.withColumn("__run", F.sum((~F.col("still").eqNullSafe(F.lag("still").over(w))).cast("int")).over(w))
    held = F.unix_micros("time") - F.min(F.unix_micros("time")).over(W.partitionBy("device", "tap_time", "__run"))
    ok = F.col("still") & (held >= hold_s * 1e6) & (F.unix_micros("time") - F.unix_micros("tap_time") >= settle_s * 1e6)
    first = runs.withColumn("__ok", ok).filter("__ok").groupBy("device", "tap_time").agg(F.min("time").alias("time"), F.min_by("mean_g", "time").alias("weight_g"))
    every = taps.select("device", F.col("time").alias("tap_time"), "uid")
    return every.join(first, ["device", "tap_time"], "left").withColumn("result", F.when(F.col("time").isNotNull(), "MEASURED").otherwise("UNSTABLE"))


def ingest_weights(events: DataFrame, tag_map: DataFrame, ttl_ms: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """(weights, acknowledgements) of valid events: every copy is acknowledged, one is stored, nothing is dropped for its value."""
    # An event id of a scale comes now and then: months of it are put in order together.
    once = dedup_ttl(events, ("device", "event_id"), ttl_ms, ties=("uid", "weight_g"), days=64)
    named = S.label_quality(J.resolve_plant(once, tag_map))
    return named.select("device", "plant_id", "quality", F.col("recv_ts").alias("time"), "weight_g", "uid"), acks(events)


def watering_events(weights: DataFrame, gain_g: float = 10.0) -> DataFrame:
    """Readings more than gain_g above the plant's one before; weight_g is the gain."""
    return S.difference(S.valid_weights(weights), ("plant_id",), "weight_g", ("time", "device")).filter(F.col("weight_g") > gain_g)


def watering_days(weights: DataFrame, plants: int = 8, gain_g: float = 10.0, tz: str = SITE.tz) -> DataFrame:
    """Local days on which so many different plants were watered."""
    gains = watering_events(weights, gain_g).withColumn("local_day", T.local_day(F.col("time"), tz))
    return gains.groupBy("local_day").agg(F.count_distinct("plant_id").alias("plants")).filter(F.col("plants") >= plants)


def weight_refs(weights: DataFrame, as_of: datetime, tz: str = SITE.tz, plants: int = 8, gain_g: float = 10.0, span_g: float = 5.0) -> DataFrame:
    """(plant_id, sat_g, dry_g, anchor_day): saturated since the last watering session, dry as a low quantile of 60 days.

    Without a session in 90 days there is no anchor, and so no row.
    """
    recent = S.valid_weights(weights).filter((F.col("time") >= T.instant(as_of - timedelta(days=90))) & (F.col("time") < T.instant(as_of)))
    anchor = watering_days(recent, plants, gain_g, tz).agg(F.max("local_day")).scalar()
    placed = recent.withColumn("anchor_day", anchor)
    since = F.col("time") >= T.day_start(F.col("anchor_day"), tz)
    dry = F.col("time") >= T.instant(as_of - timedelta(days=60))
    sat = placed.groupBy("plant_id").agg(F.max(F.when(since, F.col("weight_g"))).alias("sat_g"), F.first("anchor_day").alias("anchor_day"))
    refs = sat.join(percentiles(recent.filter(dry), ("plant_id",), "weight_g", {"dry_g": 0.1}), "plant_id").select("plant_id", "sat_g", "dry_g", "anchor_day")
    return refs.filter(F.col("sat_g") - F.col("dry_g") > span_g)


def moisture(weight: Column, dry: Column, sat: Column) -> Column:
    return F.try_divide(weight - dry, sat - dry)


def publish_refs(refs: DataFrame, tag_map: DataFrame, retained: DataFrame, prefix: str = "site/plant_ref") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages to publish, topics to clear, plants without a tag). Raises if there is nothing to publish."""
    finite = refs.filter((F.abs("sat_g") < float("inf")) & (F.abs("dry_g") < float("inf")))
    planned, untagged = J.plan_refs(finite, tag_map)
    payload = F.to_json(F.struct("plant_id", F.round("sat_g", 1).alias("sat_g"), F.round("dry_g", 1).alias("dry_g"), F.col("anchor_day").cast("string").alias("anchor_day")))
    messages = planned.select(F.concat(F.lit(f"{prefix}/"), "uid").alias("topic"), payload.alias("payload"))
    return messages, stale_refs(retained, messages), untagged.select("plant_id").distinct()


def relabel(weights: DataFrame, start: datetime, stop: datetime, quality: str, plant: str | None = None, keys: Sequence[str] = ("device", "plant_id", "time")) -> tuple[DataFrame, DataFrame]:
    """(the table afterwards, the rows as they were): rows of [start, stop) get a new label at their own time."""
    hit = (F.col("time") >= T.instant(start)) & (F.col("time") < T.instant(stop))
    if plant is not None:
        hit = hit & (F.col("plant_id") == plant)
    hit = F.coalesce(hit, F.lit(False))
    before = weights.filter(hit)
    kept = delete_where(weights, F.lit(True) if plant is None else F.col("plant_id") == plant, start, stop)
    return kept.unionByName(upsert_points(before, before.select(*keys, F.lit(quality).alias("quality")), keys).select(*weights.columns)), before


def labels_left(weights: DataFrame, start: datetime, stop: datetime) -> DataFrame:
    """How many rows and different labels an interval has: one label after a relabelling."""
    inside = weights.filter((F.col("time") >= T.instant(start)) & (F.col("time") < T.instant(stop)))
    return inside.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("quality", F.lit(""))).alias("labels"))


def water_uptake(weights: DataFrame, tz: str = SITE.tz) -> DataFrame:
    """(plant_id, local_day, wet_g, dry_g, uptake_g): the day's range between the heaviest and the lightest reading."""
    day = S.valid_weights(weights).groupBy("plant_id", T.local_day(F.col("time"), tz).alias("local_day"))
    return day.agg(F.max("weight_g").alias("wet_g"), F.min("weight_g").alias("dry_g")).withColumn("uptake_g", F.col("wet_g") - F.col("dry_g"))
