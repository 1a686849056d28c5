"""Joins of series: on windows, as of a time, within an interval, against registries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from .days import DAY, KEY, carried, dated

Names = Sequence[str]


def join_on_window(a: DataFrame, b: DataFrame, keys: Names, window: str = "window_start") -> DataFrame:
    return a.join(b, [*keys, window])


def resolve_plant(events: DataFrame, tag_map: DataFrame) -> DataFrame:
    """Adds plant_id by uid; a miss is `unknown`, and the uid stays. Adaptive execution broadcasts the map if it is small."""
    return events.join(tag_map.select("uid", "plant_id"), "uid", "left").withColumn("plant_id", F.coalesce("plant_id", F.lit("unknown")))


def backfill_unknown(weights: DataFrame, tag_map: DataFrame) -> DataFrame:
    """Rows of unknown plants get the plant that their uid has meanwhile."""
    known = tag_map.select("uid", F.col("plant_id").alias("__plant"))
    plant = F.when(F.col("plant_id") == "unknown", F.coalesce("__plant", "plant_id")).otherwise(F.col("plant_id"))
    return weights.join(known, "uid", "left").withColumn("plant_id", plant).drop("__plant")


def plan_refs(refs: DataFrame, tag_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs a uid, refs without a tag): a plant may have several tags; the tare tag is none."""
    tags = tag_map.filter(F.col("plant_id") != "tare-ref").select("uid", "plant_id")
    return refs.join(tags, "plant_id"), refs.join(tags, "plant_id", "left_anti")


def orphan_tags(tag_map: DataFrame, registry: DataFrame) -> DataFrame:
    return tag_map.join(registry, "plant_id", "left_anti")


def asof_join(left: DataFrame, right: DataFrame, keys: Names, values: Names, tolerance: timedelta | None = None, strict: bool = False, time: str = "time") -> DataFrame:
    """Adds to each left row the values (and `asof_time`) of the last right row at or before it (before, if strict).

    Of right rows at one time the one with the largest values counts, whatever the partitioning.
    Works a key and UTC day: inside a day by an ordered window, across days by one carried row a
    key and day, so a key with years of history is never sorted in one piece. A null key is a key like others.
    """
    row = F.struct(F.col(time).alias("asof_time"), *values)
    extra = [c for c in left.columns if c not in (*keys, time)]
    l = left.select(*keys, time, F.struct(*extra, F.lit(1).alias("__l")).alias("__left"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("__right"))
    r = right.select(*keys, time, F.lit(None).cast(l.schema["__left"].dataType).alias("__left"), row.alias("__right"))
    both = dated(l.unionByName(r), keys, time).withColumn("__side", F.col("__left").isNull() if not strict else F.col("__left").isNotNull())
    w = W.partitionBy(KEY, DAY).orderBy(time, F.desc("__side"), "__right").rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("__in", F.last("__right", ignorenulls=True).over(w)).filter("__left IS NOT NULL")
    days = both.groupBy(KEY, DAY).agg(F.max("__right").alias("__last"))
    earlier = days.select(KEY, DAY, F.last("__last", ignorenulls=True).over(W.partitionBy(KEY).orderBy(DAY).rowsBetween(W.unboundedPreceding, -1)).alias("__carried"))
    found = inside.join(earlier, [KEY, DAY]).withColumn("__hit", F.coalesce("__in", "__carried"))
    if tolerance is not None:
        near = F.unix_micros(time) - F.unix_micros("__hit.asof_time") <= int(tolerance.total_seconds() * 1e6)
        found = found.withColumn("__hit", F.when(near, F.col("__hit")))
    return found.select(*keys, time, *(F.col(f"__left.{c}").alias(c) for c in extra), F.col("__hit.asof_time").alias("asof_time"), *(F.col(f"__hit.{v}").alias(v) for v in values))


def pair_within(left: DataFrame, right: DataFrame, keys: Names, half: timedelta, time: str = "time", right_time: str = "right_time") -> DataFrame:
    """Each left row with every right row in [t - half, t + half); left rows without any stay, with nulls.

    Time buckets as wide as the interval turn the range into an equality on at most two buckets.
    """
    width = int(2 * half.total_seconds() * 1e6)
    at = F.unix_micros(time)
    low = at - width // 2
    tagged = left.withColumn("__row", F.struct(*left.columns))
    probes = tagged.select("__row", *keys, low.alias("__low"), F.explode(F.array_distinct(F.array(F.floor(low / width), F.floor((low + width - 1) / width)))).alias("__bucket"))
    base = right.withColumnRenamed(time, right_time).withColumns({"__at": F.unix_micros(right_time), "__bucket": F.floor(F.unix_micros(right_time) / width)})
    renamed = base.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in base.columns if c not in keys and c != "__bucket"), F.col("__bucket").alias("__b"))
    on = (F.col("__bucket") == F.col("__b")) & (F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__low") + width)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    hits = probes.join(renamed, on).select("__row.*", *(c for c in base.columns if c not in keys and not c.startswith("__")))
    alone = left.join(hits.select(*keys, time).distinct(), [*keys, time], "left_anti").select(*left.columns)  # whether a row pairs depends on these alone
    return hits.unionByName(alone, allowMissingColumns=True)


def pair_stats(left: DataFrame, right: DataFrame, keys: Names, half: timedelta, values: Names, spread: Names = (), time: str = "time") -> DataFrame:
    """What pair_within and an aggregate over its pairs would give, without the pairs: a row a distinct left row, with n_<v>, avg_<v> and,
    for those of `spread`, dev_<v> (population deviation) of the right values in [t - half, t + half). Counts are those of all copies of the left row.

    Buckets are as wide as the interval, so it is the end of one bucket and the beginning of the next: a running sum from
    either side, no differences. Time and memory are those of a sort by key and bucket, however many rows pair.
    """
    width = 2 * (half // timedelta(microseconds=1))
    probe = F.col("__left").isNotNull()
    own = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__copies"))
    ends = F.explode(F.array(*(F.struct((F.unix_micros(time) + d).alias("at"), F.lit(high).alias("high")) for d, high in ((-width // 2, False), (width // 2, True)))))
    probes = own.select(*keys, F.struct(*own.columns).alias("__left"), ends.alias("__end")).select(*keys, "__left", F.coalesce("__end.at", F.lit(0)).alias("__at"), F.col("__end.high").alias("__high"))
    known = right.dropna(subset=[*keys, time]).select(*keys, F.unix_micros(time).alias("__at"), *(F.col(v).cast("double").alias(f"__v_{v}") for v in values))
    both = probes.unionByName(known, allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("__at") / width))
    part = W.partitionBy(*keys, "__bucket")
    up = part.orderBy("__at", F.col("__left").isNull()).rowsBetween(W.unboundedPreceding, 0)  # a probe comes before rows of its own instant
    down = part.orderBy(F.desc("__at"), F.col("__left").isNull().desc()).rowsBetween(W.unboundedPreceding, 0)  # and after them
    found = {f"__{n}_{v}": F.when(probe, F.when(F.col("__high"), f(f"__v_{v}").over(up)).otherwise(f(f"__v_{v}").over(down))) for v in values for n, f in (("n", F.count), ("s", F.sum), *((("q", F.var_pop),) if v in spread else ()))}
    halves = both.withColumns(found).filter(probe).select("__left", "__high", *found)
    side = lambda c, high: F.coalesce(F.max(F.when(F.col("__high") == high, F.col(c))), F.lit(0))
    both_sides = halves.groupBy("__left").agg(*(side(c, high).alias(f"{c}_{int(high)}") for c in found for high in (False, True)))
    out = {}
    for v in values:
        (n0, n1), (s0, s1) = ([F.col(f"__{x}_{v}_{i}") for i in (0, 1)] for x in "ns")
        out |= {f"n_{v}": (n0 + n1) * F.col("__left.__copies"), f"avg_{v}": F.try_divide(s0 + s1, n0 + n1)}
        if v in spread:
            q0, q1 = F.col(f"__q_{v}_0"), F.col(f"__q_{v}_1")
            apart = F.coalesce(F.try_divide(s0, n0) - F.try_divide(s1, n1), F.lit(0.0))
            out[f"dev_{v}"] = F.sqrt(F.try_divide(q0 * n0 + q1 * n1 + apart * apart * F.try_divide(n0 * n1, n0 + n1), n0 + n1))
    return both_sides.select(*(F.col("__left")[c].alias(c) for c in left.columns), *(c.alias(k) for k, c in out.items()))


def state_held(windows: DataFrame, states: DataFrame, keys: Names, state: str, value: float, look_back: timedelta = timedelta(days=7)) -> DataFrame:
    """Adds `held`: whether the state was `value` throughout [start, stop).

    True only if the last change before the window set it and none inside the window left it;
    without any change to go by it can't be verified, and is false.
    """
    left_it = F.when(~F.col(state).eqNullSafe(F.lit(value)), F.col("time"))
    known = carried(states.select(*keys, "time", F.col(state).alias("__state"), left_it.alias("__left_it")), keys, F.col("__left_it"), "__until", forward=False)
    entry = asof_join(windows.withColumn("time", F.col("start")), known, keys, ["__state", "__until"], look_back, strict=True)
    held = (F.col("__state") == value) & (F.col("__until").isNull() | (F.col("__until") >= F.col("stop")))
    return entry.select(*windows.columns, F.coalesce(held, F.lit(False)).alias("held"))


def weight_with_spectrum(weights: DataFrame, spectrum: DataFrame, plant: str = "plant_id", day: str = "local_day") -> DataFrame:
    return weights.join(spectrum, [plant, day])


def daily_context(dli: DataFrame, weather: DataFrame, day: str = "local_day") -> DataFrame:
    """Days of either side; correlate with corr() over the result."""
    return dli.join(weather, day, "full_outer")


def compare_windows(cal: DataFrame) -> DataFrame:
    """Same-day fits of the two windows: relative difference and verdict."""
    pre = cal.filter("window_mode = 'pre-lamp'").select("device", "local_day", F.col("cal_ols").alias("pre"))
    noon = cal.filter("window_mode = 'noon'").select("device", "local_day", F.col("cal_ols").alias("noon"))
    apart = F.abs(F.try_divide(F.col("pre") - F.col("noon"), F.col("noon"))) * 100
    verdict = F.when(F.col("apart_pct") <= 5, "agree").when(F.col("apart_pct") <= 10, "watch").when(F.col("apart_pct") > 10, "differ")
    return pre.join(noon, ["device", "local_day"]).withColumn("apart_pct", apart).withColumn("verdict", verdict)


#: Statuses that end a request.
TERMINAL = ("ok", "saturated", "ambient_leak", "timeout", "error")


def reflect_requests(commands: DataFrame, results: DataFrame) -> DataFrame:
    """Each command with its result: a terminal one wins, then the latest; `missing` without any."""
    rank = F.struct(F.col("status").isin(*TERMINAL).alias("done"), F.col("time"))
    best = results.groupBy("request_id").agg(F.max_by("status", rank).alias("status"), F.count(F.lit(1)).alias("messages"))
    return commands.join(best, "request_id", "left").withColumns({"status": F.coalesce("status", F.lit("missing")), "messages": F.coalesce("messages", F.lit(0))})


def cal_check(photone: DataFrame) -> DataFrame:
    """Meter against spectrum and lux, from the values stored with paired readings."""
    return photone.filter("paired = 1").withColumns({"k_spec": F.try_divide("ppfd", "spec_ppfd_at"), "k_lux": F.try_divide("ppfd", F.col("lux_at") / C.LUX_PER_PPFD)})


def k_by_source(photone: DataFrame, least: int = 3) -> DataFrame:
    """Mean correction a light source, null with too few readings; `mixed` is diagnostic only."""
    checked = cal_check(photone).groupBy("source").agg(F.avg("k_spec").alias("k"), F.count(F.lit(1)).alias("n"))
    return checked.withColumn("k", F.when(F.col("n") >= least, F.col("k"))).withColumn("usable", (F.col("n") >= least) & (F.col("source") != "mixed"))


def gap_signal(gaps: DataFrame, air: DataFrame, keys: Names = ("device",)) -> DataFrame:
    """Adds the signal strength at the start of each gap."""
    starts = gaps.withColumn("time", F.col("gap_start"))
    return asof_join(starts, air.filter(F.col("rssi").isNotNull()).select(*keys, "time", "rssi"), keys, ["rssi"]).drop("time", "asof_time")
