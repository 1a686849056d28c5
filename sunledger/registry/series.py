"""Projections, filters, windows, aggregates and joins."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from .. import config as C
from ..functions import light as L
from ..functions import time as T
from ..operators import joins as J
from ..operators import ranked as R
from ..operators import series as S
from ..operators import sets as U
from ..operators import summaries as Y
from ..sources.adapters import EVENTS_AS_OF, FIELDS
from .base import query, sql

US = "epoch_us(time) AS time"
DAY = "local_day::VARCHAR AS local_day"
SUM_S = " + ".join(f"{c} / {C.RESPONSE[c]}.0::DOUBLE * {C.WAVELENGTH[c]}.0::DOUBLE" for c in C.CHANNELS)
GREATEST = f"greatest({', '.join(C.CHANNELS)})"
MINUTE = "(extract(hour FROM time + INTERVAL 8 HOUR) * 60 + extract(minute FROM time + INTERVAL 8 HOUR))::INT"


@query("p01_time_range", sql("air_long", f"SELECT device, field, value, {US} FROM air_long WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-30 12:00:00'"))
def _(t):
    return S.time_range(t.air_long, "2024-01-10T00:00:00Z", "-12h", EVENTS_AS_OF).select("device", "field", "value", "time")


@query("p02_select_series", sql("air_long", f"SELECT device, field, value, {US} FROM air_long WHERE field IN ('lux', 'lux_ref') AND device = 'dev-3'"))
def _(t):
    return S.select_series(t.air_long, ("lux", "lux_ref"), device="dev-3").select("device", "field", "value", "time")


@query("p03_production_only", sql("air_long", "SELECT device, field, count(*) AS n FROM air_long WHERE device NOT IN ('dev-0', 'dev-1') AND field <> 'gas' GROUP BY ALL"))
def _(t):
    return S.production_only(t.air_long, ("dev-0", "dev-1"), ("gas",)).groupBy("device", "field").agg(F.count(F.lit(1)).alias("n"))


@query("p04_local_window", sql("air_long", f"SELECT device, count(*) AS n, sum(value) AS total FROM air_long WHERE {MINUTE} >= 540 AND {MINUTE} < 1080 GROUP BY device"))
def _(t):
    return t.air_long.filter(T.in_local_window(F.col("time"), "Asia/Taipei", 540, 1080)).groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("p05_gate_fields", sql("air_long", f"SELECT device, field, value, {US} FROM air_long WHERE field NOT IN ('lux', 'lux_ref')"))
def _(t):  # 20:00 UTC is 04:00 local: outside the lamp window
    return S.gate_fields_at(t.air_long, datetime(2024, 1, 30, 20, tzinfo=UTC)).select("device", "field", "value", "time")


@query("p06_unsaturated", sql("spectrum", f"SELECT device, {US}, round(clear, 6) AS clear FROM spectrum WHERE saturated = 0 AND clear < 65535"))
def _(t):
    return S.unsaturated(t.spectrum).select("device", "time", "clear")


_JOINED = "both_ AS (SELECT s.*, a.lux FROM spectrum s JOIN air a USING (event_id))"
_REASON = f"CASE WHEN lux IS NULL THEN 'partial' WHEN {GREATEST} >= 65535 THEN 'saturated' WHEN lux >= 45000 THEN 'clamp' WHEN lux < 300 THEN 'below_min' WHEN {SUM_S} <= 0 THEN 'nonpositive' ELSE 'kept' END"


@query("p07_classify_minutes", sql("air spectrum", f"SELECT device, reason, count(*) AS n, round(avg(lux / 54.0::DOUBLE / nullif(s, 0)), 9) AS ratio FROM (SELECT *, {_REASON} AS reason, {SUM_S} AS s FROM both_) GROUP BY ALL", _JOINED))
def _(t):
    both = t.spectrum.join(t.air.select("event_id", "lux"), "event_id")
    return S.classify_minutes(both, 300.0, 45000.0).groupBy("device", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 9).alias("ratio"))


@query(
    "p08_clean_readings",
    sql("ev", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value, 6) END AS temp, round(value * 2 / 100.0::DOUBLE, 6) AS pressure, round(value * 3 / 1000.0::DOUBLE, 6) AS gas, CASE WHEN value - 40 >= 0 AND event_id % 7 <> 0 THEN round(value - 40, 6) END AS lux FROM ev"),
)
def _(t):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    raw = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.col("value")).alias("temp"), (F.col("value") * 2).alias("pressure"), (F.col("value") * 3).alias("gas"), F.when(F.col("event_id") % 7 == 0, inf).otherwise(F.col("value") - 40).alias("lux"))
    return S.clean_readings(raw)


@query("p09_validate_ids", sql("event_raw", "SELECT regexp_matches(upper(CASE WHEN event_id % 7 = 0 THEN 'xyz' ELSE uid END), '^[0-9A-F]{8,20}$') AND regexp_matches(device, '^[A-Za-z0-9_-]{1,40}$') AS ok, count(*) AS n FROM event_raw GROUP BY ok"))
def _(t):
    good, bad = S.validate_ids(t.event_raw.withColumn("uid", F.when(F.col("event_id") % 7 == 0, "xyz").otherwise(F.col("uid"))))
    return U.union_labelled(good=good, bad=bad).groupBy((F.col("k") == "good").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_projections", sql("air", f"SELECT device AS sensor, round(lux / 54.0::DOUBLE, 6) AS ppfd, {US} FROM air WHERE lux_ref > 300"))
def _(t):
    return t.air.filter("lux_ref > 300").select(F.col("device").alias("sensor"), L.lux_to_ppfd(F.col("lux")).alias("ppfd"), "time")


@query("p12_label_quality", sql("event_raw", "SELECT device, CASE WHEN weight_g < 30 THEN 'empty' ELSE 'ok' END AS quality, count(*) AS n FROM event_raw GROUP BY ALL"))
def _(t):
    return S.label_quality(t.event_raw).groupBy("device", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("p13_valid_weights", sql("plant_weight", "SELECT plant_id, count(*) AS n, max(weight_g) AS heaviest FROM plant_weight WHERE quality = 'ok' AND plant_id <> 'cactus-7' GROUP BY plant_id"))
def _(t):
    return S.valid_weights(t.plant_weight, ("cactus-7",)).groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"), F.max("weight_g").alias("heaviest"))


# -- joins -----------------------------------------------------------------------------------

_W10 = "(epoch_us(time) // 600000000) * 600000000"


@query("j01_join_on_window", sql("air spectrum", f"SELECT device, window_start, round(lux, 6) AS lux, round(clear, 6) AS clear FROM (SELECT device, {_W10} AS window_start, median(lux) AS lux FROM air GROUP BY ALL) JOIN (SELECT device, {_W10} AS window_start, median(clear) AS clear FROM spectrum WHERE mode = 'ambient' GROUP BY ALL) USING (device, window_start)"))
def _(t):
    lux = S.aggregate_window(t.air, "10m", "median", ("device",), "lux").drop("window_stop")
    clear = S.aggregate_window(t.spectrum.filter("mode = 'ambient'"), "10m", "median", ("device",), "clear").drop("window_stop")
    return J.join_on_window(lux, clear, ("device",))


@query("j02_resolve_plant", sql("event_raw tag_map", "SELECT e.device, coalesce(m.plant_id, 'unknown') AS plant_id, count(*) AS n, min(e.uid) AS uid FROM event_raw e LEFT JOIN tag_map m USING (uid) GROUP BY ALL"))
def _(t):
    """Events are counted a tag first: the least text takes a sort, which then is one of tags, not of events."""
    counted = t.event_raw.groupBy("device", "uid").agg(F.count(F.lit(1)).alias("n"))
    return J.resolve_plant(counted, t.tag_map).groupBy("device", "plant_id").agg(F.sum("n").alias("n"), F.min("uid").alias("uid"))


@query("j03_backfill_unknown", sql("plant_weight tag_map", "SELECT plant_id, count(*) AS n FROM (SELECT CASE WHEN w.p = 'unknown' THEN coalesce(m.plant_id, 'unknown') ELSE w.p END AS plant_id FROM (SELECT *, CASE WHEN plant_id IN ('cactus-1', 'cactus-2') THEN 'unknown' ELSE plant_id END AS p FROM plant_weight) w LEFT JOIN tag_map m ON w.uid = m.uid) GROUP BY plant_id"))
def _(t):
    unknown = t.plant_weight.withColumn("plant_id", F.when(F.col("plant_id").isin("cactus-1", "cactus-2"), "unknown").otherwise(F.col("plant_id")))
    return J.backfill_unknown(unknown, t.tag_map).groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"))


@query("j04_plan_refs", sql("plant_weight tag_map", "SELECT plant_id, uid, true AS tagged FROM (SELECT DISTINCT plant_id FROM plant_weight) JOIN (SELECT * FROM tag_map WHERE plant_id NOT IN ('tare-ref', 'cactus-3')) USING (plant_id) UNION ALL SELECT 'cactus-3', NULL, false"))
def _(t):
    refs = t.plant_weight.select("plant_id").distinct()
    tagged, untagged = J.plan_refs(refs, t.tag_map.filter("plant_id <> 'cactus-3'"))
    return tagged.withColumn("tagged", F.lit(True)).unionByName(untagged.withColumn("tagged", F.lit(False)), allowMissingColumns=True)


@query("j05_orphan_tags", sql("tag_map registry", "SELECT * FROM tag_map WHERE plant_id NOT IN (SELECT plant_id FROM registry)"))
def _(t):
    return J.orphan_tags(t.tag_map, t.registry)


@query("j06_pair_within", sql("meter air", "SELECT m.device, epoch_us(m.time) AS time, m.ppfd, count(a.lux) AS n, round(avg(a.lux), 6) AS lux FROM meter m LEFT JOIN air a ON a.device = m.device AND a.time >= m.time - INTERVAL 1 HOUR AND a.time < m.time + INTERVAL 1 HOUR GROUP BY ALL"))
def _(t):
    paired = J.pair_stats(t.meter.select("device", "time", "ppfd"), t.air.select("device", "time", "lux"), ("device",), timedelta(hours=1), ("lux",))
    return paired.select("device", "time", "ppfd", F.col("n_lux").alias("n"), F.col("avg_lux").alias("lux"))


@query("j07_asof_join", sql("air lamp", """SELECT a.location, epoch_us(a.time) AS time, a.event_id, CASE WHEN a.time - l.time <= INTERVAL 7 DAY THEN l."on" END AS "on" FROM air a ASOF LEFT JOIN lamp l ON a.location = l.location AND a.time >= l.time"""))
def _(t):
    return J.asof_join(t.air.select("location", "time", "event_id"), t.lamp, ("location",), ("on",), timedelta(days=7)).drop("asof_time")


def _windows(t, keys=("location",)):
    """Two-hour windows from 22:00 UTC of each day of the events table."""
    days = t.air.select(*keys, F.to_date("time").alias("__d")).distinct()
    start = F.timestamp_seconds(F.unix_date("__d").cast("long") * 86400 + 22 * 3600)
    return days.select(*keys, start.alias("start"), F.timestamp_seconds(F.unix_seconds(start) + 7200).alias("stop"))


_WIN = "win AS (SELECT DISTINCT location, date_trunc('day', time)::TIMESTAMP + INTERVAL 22 HOUR AS start, date_trunc('day', time)::TIMESTAMP + INTERVAL 24 HOUR AS stop FROM air)"


@query(
    "j08_state_held",
    sql("air lamp", """SELECT w.location, epoch_us(w.start) AS start, epoch_us(w.stop) AS stop,
        coalesce((SELECT arg_max(l."on", l.time) FROM lamp l WHERE l.location = w.location AND l.time < w.start AND l.time >= w.start - INTERVAL 7 DAY) = 0
                 AND NOT EXISTS (SELECT 1 FROM lamp l WHERE l.location = w.location AND l.time >= w.start AND l.time < w.stop AND l."on" <> 0), false) AS held FROM win w""", _WIN),
)
def _(t):
    return J.state_held(_windows(t), t.lamp, ("location",), "on", 0.0)


@query("j09_weight_with_spectrum", sql("plant_weight", f"SELECT plant_id, {DAY}, w.n, w.g, r.m FROM (SELECT plant_id, local_day, count(*) AS n, min(weight_g) AS g FROM plant_weight GROUP BY ALL) w JOIN (SELECT plant_id, local_day, max(weight_g) AS m FROM plant_weight WHERE device = 'st-1' GROUP BY ALL) r USING (plant_id, local_day)"))
def _(t):
    day = T.local_day(F.col("time")).alias("local_day")
    w = t.plant_weight.groupBy("plant_id", day).agg(F.count(F.lit(1)).alias("n"), F.min("weight_g").alias("g"))
    r = t.plant_weight.filter("device = 'st-1'").groupBy("plant_id", day).agg(F.max("weight_g").alias("m"))
    return J.weight_with_spectrum(w, r)


@query("j12_reflect_requests", sql("reflect", "SELECT request_id, plant, coalesce(status, 'missing') AS status, coalesce(n, 0) AS messages FROM (SELECT DISTINCT request_id, plant FROM reflect) LEFT JOIN (SELECT request_id, count(*) AS n, arg_max(status, (done, time)) AS status FROM (SELECT *, CASE WHEN vec_id % 5 = 4 THEN 'ok' ELSE 'started' END AS status, vec_id % 5 = 4 AS done FROM reflect WHERE vec_id % 7 <> 0 AND (vec_id // 5) % 3 <> 0) GROUP BY request_id) USING (request_id)"))
def _(t):
    results = t.reflect.filter("vec_id % 7 <> 0 AND floor(vec_id / 5) % 3 <> 0").withColumn("status", F.when(F.col("vec_id") % 5 == 4, "ok").otherwise("started"))
    return J.reflect_requests(t.reflect.select("request_id", "plant").distinct(), results)


@query("j14_gap_signal", sql("air", "SELECT device, gap_start, round(minutes, 6) AS minutes, rssi FROM (SELECT device, epoch_us(time) AS gap_start, (epoch_us(coalesce(lead(time) OVER (PARTITION BY device ORDER BY time), TIMESTAMP '2024-01-31')) - epoch_us(time)) / 6e7 AS minutes, rssi FROM air) WHERE minutes > 240"))
def _(t):
    gaps = S.silent_gaps(t.air, ("device",), 240, EVENTS_AS_OF)
    return J.gap_signal(gaps, t.air).select("device", "gap_start", "minutes", "rssi")


# -- aggregates -----------------------------------------------------------------------------

for _every, _step in (("1m", 60), ("10m", 600), ("1h", 3600)):
    _label = f"(epoch_us(time) // {_step * 1000000}) * {_step * 1000000}"

    @query(f"a01_window_{_every}", sql("air_long", f"SELECT device, field, {_label} AS window_start, {_label} + {_step * 1000000} AS window_stop, round(avg(value), 6) AS value FROM air_long GROUP BY ALL"))
    def _(t, every=_every):
        return S.aggregate_window(t.air_long, every, "mean", ("device", "field"))


@query("a02_window_create_empty", sql("air_long", f"SELECT k.device, d.local_day::VARCHAR AS local_day, count(a.value) AS value FROM (SELECT DISTINCT device FROM air_long) k CROSS JOIN (SELECT unnest(range(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS local_day) d LEFT JOIN air_long a ON a.device = k.device AND a.local_day = d.local_day GROUP BY ALL"))
def _(t):
    return S.aggregate_window(t.air_long, "1d", "count", ("device",), create_empty=True, start=datetime(2023, 12, 27, 16, tzinfo=UTC), stop=datetime(2024, 2, 2, 16, tzinfo=UTC))


@query("a03_ingest_completeness", sql("air", "SELECT k.device, d.local_day::VARCHAR AS local_day, count(a.lux) AS n, round(count(a.lux) * 3600.0::DOUBLE / 86400, 6) AS completeness FROM (SELECT DISTINCT device FROM air) k CROSS JOIN (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS local_day) d LEFT JOIN air a ON a.device = k.device AND a.local_day = d.local_day GROUP BY ALL"))
def _(t):
    return S.ingest_completeness(t.air, ("device",), 3600, datetime(2023, 12, 31, 16, tzinfo=UTC), datetime(2024, 1, 30, 16, tzinfo=UTC))


@query("a04_group_stats", sql("air_long", "SELECT device, field, count(*) AS n, max(value) AS hi, min(value) AS lo, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM air_long GROUP BY ALL"))
def _(t):
    return t.air_long.groupBy("device", "field").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


@query("a05_distinct_plants", sql("plant_weight", f"SELECT {DAY}, count(DISTINCT plant_id) AS plants FROM plant_weight GROUP BY local_day"))
def _(t):
    return t.plant_weight.groupBy(T.local_day(F.col("time")).alias("local_day")).agg(F.count_distinct("plant_id").alias("plants"))


@query("a06_median", sql("air_long", "SELECT device, field, round(median(value), 6) AS middle FROM air_long GROUP BY ALL"))
def _(t):
    return R.medians(t.air_long, ("device", "field"), "value", "middle")


@query("a07_quantile", sql("plant_weight", "SELECT plant_id, round(quantile_cont(weight_g, 0.1), 6) AS dry FROM plant_weight GROUP BY plant_id"))
def _(t):
    return R.percentiles(t.plant_weight, ("plant_id",), "weight_g", {"dry": 0.1})


@query("a06_median_sketch", sql("air_long", "SELECT device, field, count(*) AS n, true AS near FROM air_long WHERE time >= TIMESTAMP '2024-01-03 16:00:00' AND time < TIMESTAMP '2024-01-24 16:00:00' GROUP BY ALL"))
def _(t):
    """The median of three weeks from sketches of its days: is its exact rank as near the middle as the bound says?"""
    days = Y.sketch_days(t.air_long, ("device", "field"), ("value",)).filter("local_day BETWEEN DATE'2024-01-04' AND DATE'2024-01-24'")
    found = Y.merge_sketches(days.drop("local_day"), ("device", "field")).select("device", "field", "value_n", Y.sketched_quantile("value", 0.5).alias("middle"))
    local = T.local_day(F.col("time"))
    rows = t.air_long.filter((local >= "2024-01-04") & (local <= "2024-01-24")).join(found, ["device", "field"])
    ranks = rows.groupBy("device", "field", "value_n").agg(F.count_if(F.col("value") < F.col("middle")).alias("below"), F.count_if(F.col("value") <= F.col("middle")).alias("upto"))
    slack = F.lit(Y.rank_error()) * F.col("value_n") + 1
    return ranks.select("device", "field", F.col("value_n").alias("n"), ((F.col("below") <= F.col("value_n") / 2 + slack) & (F.col("upto") >= F.col("value_n") / 2 - slack)).alias("near"))


@query("a05_distinct_sketch", sql("plant_weight", f"SELECT quality, date_trunc('month', local_day)::DATE::VARCHAR AS month, count(DISTINCT plant_id) AS plants FROM plant_weight GROUP BY ALL"))
def _(t):
    """Different plants a month, from sketches of days: exact for so few."""
    days = Y.sketch_days(t.plant_weight, ("quality",), (), ("plant_id",))
    months = Y.merge_sketches(days.withColumn("month", F.trunc("local_day", "month")).drop("local_day"), ("quality", "month"))
    return months.select("quality", "month", Y.sketched_distinct("plant_id").alias("plants"))


_AREA = "SELECT device, local_day::VARCHAR AS local_day, round(coalesce(sum(area), 0) / 1e6, 6) AS lux, count(*) AS n FROM (SELECT *, (lux + lag(lux) OVER w) / 2 * ((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6) AS area FROM air{} WINDOW w AS (PARTITION BY device, local_day ORDER BY time)) GROUP BY ALL"


@query("a10_integral_hours", sql("air", _AREA.format("")))
def _(t):
    """Daily integrals from summaries of hours."""
    return Y.integral_days(Y.integral_hours(t.air, ("device",), "lux"), ("device",)).select("device", "local_day", (F.col("area") / 1e6).alias("lux"), "n")


@query("a10_integral_range", sql("air", _AREA.format(" WHERE time >= TIMESTAMP '2024-01-05 03:17:09' AND time < TIMESTAMP '2024-01-20 19:44:51'")))
def _(t):
    """A range that cuts hours: whole hours from summaries, the two cut ones from points."""
    found = Y.integral_between(Y.integral_hours(t.air, ("device",), "lux"), t.air, ("device",), datetime(2024, 1, 5, 3, 17, 9, tzinfo=UTC), datetime(2024, 1, 20, 19, 44, 51, tzinfo=UTC), "lux")
    return found.select("device", "local_day", (F.col("area") / 1e6).alias("lux"), "n")


@query("a08_rank_quantile", sql("air", "SELECT device, (list_sort(list(lux)))[floor(0.1 * (count(*) - 1))::INT + 1] AS p10, (list_sort(list(lux)))[floor(0.9 * (count(*) - 1))::INT + 1] AS p90 FROM air GROUP BY device"))
def _(t):
    return S.rank_quantiles(t.air, ("device",), "lux", {"p10": 0.1, "p90": 0.9})


@query("a09_variation", sql("air", f"SELECT device, {_W10} AS window_start, round(CASE WHEN count(lux) < 2 OR avg(lux) = 0 THEN 0 ELSE stddev_pop(lux) / avg(lux) END, 6) AS cv FROM air GROUP BY ALL"))
def _(t):
    return S.aggregate_window(t.air, "10m", S.variation, ("device",), "lux").select("device", "window_start", F.col("lux").alias("cv"))


@query("a10_integral", sql("air", f"SELECT device, {DAY}, round(coalesce(sum(area), 0), 4) AS lux, count(*) AS n FROM (SELECT *, (lux + lag(lux) OVER w) / 2 * ((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6) AS area FROM air WINDOW w AS (PARTITION BY device, local_day ORDER BY time)) GROUP BY ALL"))
def _(t):
    return S.integral(t.air, ("device",), "lux").withColumn("lux", F.round("lux", 4))


@query("a11_counter_increase", sql("counters", "SELECT integration, coalesce(sum(CASE WHEN d >= 0 THEN d END), 0.0) AS increase FROM (SELECT *, counter - lag(counter) OVER (PARTITION BY integration ORDER BY time) AS d FROM counters WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20') GROUP BY integration"))
def _(t):
    return S.counter_increase(t.counters, ("integration",), ("integration",), datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC))


_FIT = f"xy AS (SELECT s.device, {SUM_S.replace('f', 's.f')} AS x, a.lux / 54.0::DOUBLE AS y FROM spectrum s JOIN air a USING (event_id)), slope AS (SELECT device, sum(x * y) / nullif(sum(x * x), 0) AS b FROM xy GROUP BY device)"


@query("a12_fit_origin", sql("air spectrum", "SELECT device, count(*) AS n, round(any_value(b), 9) AS slope, round(1 - sum((y - b * x) * (y - b * x)) / nullif(sum(y * y), 0), 6) AS r2 FROM xy JOIN slope USING (device) GROUP BY device", _FIT))
def _(t):
    xy = t.spectrum.join(t.air.select("event_id", "lux"), "event_id").select("device", L.spectrum_sum().alias("x"), L.lux_to_ppfd(F.col("lux")).alias("y"))
    return S.fit_origin(xy, "x", "y", ("device",)).withColumn("slope", F.round("slope", 9).cast("double")).select("device", "n", F.col("slope").alias("slope"), "r2")


@query("a13_bin_drift", sql("air", "SELECT device, round((max(m) - min(m)) / any_value(med) * 100, 6) AS drift_pct FROM (SELECT device, bin, avg(ratio) AS m, any_value(med) AS med FROM (SELECT device, ratio, floor((row_number() OVER (PARTITION BY device ORDER BY lux, event_id) * 5 - 1) / count(*) OVER (PARTITION BY device)) AS bin, median(ratio) OVER (PARTITION BY device) AS med FROM (SELECT *, 1.0::DOUBLE + (event_id % 13) / 100.0::DOUBLE + lux / 100000 AS ratio FROM air)) GROUP BY ALL) GROUP BY device"))
def _(t):
    rows = t.air.withColumn("ratio", F.lit(1.0) + F.col("event_id") % 13 / F.lit(100.0) + F.col("lux") / 100000)
    return R.bin_drift(rows, ("device",), ("lux", "event_id"))


@query("a15_window_report", sql("air spectrum", f"SELECT device, count(*) AS n, round(min(lux), 6) AS lo, round(max(lux), 6) AS hi, round(avg(lux), 6) AS mean, {', '.join(f'''count(*) FILTER (WHERE reason = '{r}') AS n_{r}''' for r in S.REASONS)} FROM (SELECT *, {_REASON} AS reason FROM both_) GROUP BY device", _JOINED))
def _(t):
    both = S.classify_minutes(t.spectrum.join(t.air.select("event_id", "lux"), "event_id"), 300.0, 45000.0)
    return both.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.min("lux").alias("lo"), F.max("lux").alias("hi"), F.avg("lux").alias("mean"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in S.REASONS))


@query("a16_pivot_fields", sql("air_long", f"SELECT device, {_W10} AS window_start, {', '.join(f'''max(value) FILTER (WHERE field = '{f}') AS {f}''' for f in FIELDS.values())} FROM air_long GROUP BY ALL"))
def _(t):
    return S.pivot_fields(t.air_long.withColumn("window_start", F.timestamp_seconds(F.floor(F.unix_seconds("time") / 600) * 600)), ("device", "window_start"), tuple(FIELDS.values()))


@query("a20_daily_min", sql("plant_weight", f"SELECT plant_id, {DAY}, min(weight_g) AS weight_g FROM plant_weight GROUP BY ALL"))
def _(t):
    return S.daily_min(t.plant_weight, ("plant_id",), "weight_g")


# -- ordered windows --------------------------------------------------------------------------


@query("w01_latest_per", sql("air_long", "SELECT device, field, epoch_us(max(time)) AS time, arg_max(value, time) AS value FROM air_long GROUP BY device, field"))
def _(t):
    return S.latest_per(t.air_long, ("device", "field"), ("time", "event_id")).select("device", "field", "time", "value")


@query("w02_difference", sql("plant_weight", f"SELECT plant_id, device, {US}, d AS weight_g FROM (SELECT *, weight_g - lag(weight_g) OVER (PARTITION BY plant_id ORDER BY time, device) AS d FROM plant_weight) WHERE d IS NOT NULL"))
def _(t):
    return S.difference(t.plant_weight, ("plant_id",), "weight_g", ("time", "device")).select("plant_id", "device", "time", "weight_g")


@query("w03_day_over_day", sql("plant_weight", f"SELECT plant_id, {DAY}, g AS weight_g, g - lag(g) OVER (PARTITION BY plant_id ORDER BY local_day) AS change FROM (SELECT plant_id, local_day, min(weight_g) AS g FROM plant_weight GROUP BY ALL)"))
def _(t):
    return S.day_over_day(t.plant_weight, ("plant_id",), "weight_g")


@query("w04_tail_n", sql("air_long", f"SELECT device, field, {US}, value FROM air_long QUALIFY row_number() OVER (PARTITION BY device, field ORDER BY time DESC) <= 6"))
def _(t):
    return S.tail_n(t.air_long, ("device", "field"), 6).select("device", "field", "time", "value")


@query("w05_staleness", sql("air_long", "SELECT device, field, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(time))) / 6e7, 6) AS age_min FROM air_long GROUP BY ALL"))
def _(t):
    return t.air_long.groupBy("device", "field").agg(F.max("time").alias("t")).select("device", "field", T.age_minutes(F.col("t"), EVENTS_AS_OF).alias("age_min"))


@query("w06_silent_gaps", sql("air", "SELECT * FROM (SELECT device, epoch_us(time) AS gap_start, epoch_us(coalesce(lead(time) OVER (PARTITION BY device ORDER BY time), TIMESTAMP '2024-01-31')) AS gap_stop, round((gap_stop - gap_start) / 6e7, 6) AS minutes FROM air) WHERE minutes > 180"))
def _(t):
    return S.silent_gaps(t.air, ("device",), 180, EVENTS_AS_OF)


@query("w07_rolling_stats", sql("air", f"SELECT device, {US}, round(avg(lux) OVER w, 6) AS mean_g, min(lux) OVER w AS min_g, max(lux) OVER w AS max_g, count(lux) OVER w AS samples, round((epoch_us(time) - min(epoch_us(time)) OVER w) / 1e6, 6) AS span_s, round(max(lux) OVER w - min(lux) OVER w, 6) AS range_g FROM air WINDOW w AS (PARTITION BY device ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"))
def _(t):
    return S.rolling_stats(t.air, ("device",), 24, "lux").select("device", "time", "mean_g", "min_g", "max_g", "samples", "span_s", "range_g")


@query("w09_state_changes", sql("lamp", """SELECT location, epoch_us(time) AS time, "on" FROM lamp QUALIFY "on" IS DISTINCT FROM lag("on") OVER (PARTITION BY location ORDER BY time)"""))
def _(t):
    return S.state_changes(t.lamp, ("location",), "on").select("location", "time", "on")


@query("w10_state_intervals", sql("light", """SELECT location, "on", epoch_us(time) AS start, epoch_us(lead(time) OVER (PARTITION BY location ORDER BY time)) AS stop FROM light"""))
def _(t):
    return S.state_intervals(t.light, ("location",), "on")


@query("w13_baseline_drift", sql("air", f"SELECT device, {DAY}, lux, round(base, 6) AS baseline, round((lux - base) / nullif(base, 0), 6) AS drift FROM (SELECT *, median(lux) OVER (PARTITION BY device ORDER BY local_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM (SELECT device, local_day, min(lux) AS lux FROM air GROUP BY ALL))"))
def _(t):
    return S.baseline_drift(S.daily_min(t.air, ("device",), "lux"), ("device",), "lux", 7, ("local_day",))


# -- sorts, sets --------------------------------------------------------------------------------


@query("o01_sorted", sql("plant_weight", f"SELECT plant_id, {US}, device, weight_g FROM plant_weight ORDER BY plant_id, time, device"))
def _(t):
    """Sorted at the sink: by ranges of the keys, so that no task sorts all rows."""
    return t.plant_weight.select("plant_id", "time", "device", "weight_g").orderBy("plant_id", "time", "device")


@query("o03_first_and_last", sql("plant_weight", f"(SELECT 'first' AS what, plant_id, device, {US}, weight_g FROM plant_weight ORDER BY plant_weight.time, plant_id, device LIMIT 1) UNION ALL (SELECT 'heaviest', plant_id, device, {US}, weight_g FROM plant_weight ORDER BY weight_g DESC, plant_weight.time, plant_id, device LIMIT 10)"))
def _(t):
    """The first record, and a top-k report."""
    rows = t.plant_weight.select("plant_id", "device", "time", "weight_g")
    parts = {"first": rows.orderBy("time", "plant_id", "device").limit(1), "heaviest": rows.orderBy(F.desc("weight_g"), "time", "plant_id", "device").limit(10)}
    return U.union_labelled(**parts).withColumnRenamed("k", "what")


@query("o02_latest_day", sql("plant_weight", "SELECT plant_id, count(*) AS n FROM plant_weight WHERE local_day = (SELECT max(local_day) FROM plant_weight WHERE weight_g > 45) GROUP BY plant_id"))
def _(t):
    dated = t.plant_weight.withColumn("local_day", T.local_day(F.col("time")))
    last = dated.filter("weight_g > 45").agg(F.max("local_day")).scalar()
    return dated.filter(F.col("local_day") == last).groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"))


@query("u01_union_labelled", sql("plant_weight", "SELECT plant_id, max(weight_g) AS sat, min(weight_g) AS dry FROM plant_weight GROUP BY plant_id"))
def _(t):
    sat = t.plant_weight.groupBy("plant_id").agg(F.max("weight_g").alias("v"))
    dry = t.plant_weight.groupBy("plant_id").agg(F.min("weight_g").alias("v"))
    both = U.union_labelled(sat=sat, dry=dry).withColumnRenamed("k", "field")
    return S.pivot_fields(both, ("plant_id",), ("sat", "dry"), "v")


@query("u02_stale_refs", sql("retained tag_map", "SELECT DISTINCT topic FROM retained WHERE topic NOT IN (SELECT 'ref/' || uid::BIGINT FROM tag_map)"))
def _(t):
    return U.stale_refs(t.retained, t.tag_map.select(F.concat(F.lit("ref/"), F.col("uid").cast("bigint").cast("string")).alias("topic")))


@query("u03_union_columns", sql("meter plant_weight", "SELECT 'm' AS k, count(ppfd) AS n_ppfd, count(weight_g) AS n_weight FROM (SELECT device, ppfd FROM meter) FULL JOIN (SELECT device, weight_g FROM plant_weight) USING (device)"))
def _(t):
    return U.union_columns(t.meter.select("device", "ppfd"), t.plant_weight.select("device", "weight_g")).agg(F.count("ppfd").alias("n_ppfd"), F.count("weight_g").alias("n_weight")).select(F.lit("m").alias("k"), "n_ppfd", "n_weight")


@query("u04_distinct", sql("air_long", "SELECT DISTINCT device, field FROM air_long"))
def _(t):
    return t.air_long.select("device", "field").distinct()


# -- arguments and functions of functions -----------------------------------------------------------

#: Ranges in every form of a time argument: now, relative, local wall clock, RFC 3339 with and without an offset.
_FORMS = (("-8m", "now"), ("-36h", "-30m"), ("-2w", "-1d"), ("2024-01-10T06:30", "now()"), ("2024-01-10T00:00:00Z", "2024-01-20T12:00:00+02:00"), ("2024-01-15", "2024-01-16T08:00:00.500Z"))
_BOUNDS = "('2024-01-30 23:52:00', '2024-01-31'), ('2024-01-29 12:00:00', '2024-01-30 23:30:00'), ('2024-01-17', '2024-01-30'), ('2024-01-09 22:30:00', '2024-01-31'), ('2024-01-10', '2024-01-20 10:00:00'), ('2024-01-14 16:00:00', '2024-01-16 08:00:00.5')"


@query("f04_time_arguments", sql("air_long", f"SELECT form, device, count(*) AS n, min(epoch_us(time)) AS first FROM (SELECT row_number() OVER () - 1 AS form, a::TIMESTAMP AS a, b::TIMESTAMP AS b FROM (VALUES {_BOUNDS}) AS v(a, b)) JOIN air_long ON time >= a AND time < b GROUP BY ALL"))
def _(t):
    """Points a device in ranges whose ends are given in each form."""
    found = [S.time_range(t.air_long, a, b, EVENTS_AS_OF).select(F.lit(k).cast("long").alias("form"), "device", "time") for k, (a, b) in enumerate(_FORMS)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("form", "device").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("time")).alias("first"))


@query("x01_row_functions", sql("air_long", f"SELECT device, event_id, ({MINUTE} >= 540 AND {MINUTE} < 1080) AS inside, CASE WHEN field = 'gas' THEN value / 1000.0::DOUBLE ELSE value END AS value FROM air_long"))
def _(t):
    """Row functions are functions that give columns, as built-in ones do."""

    def in_window(time):
        return T.in_local_window(time, "Asia/Taipei", 540, 1080)

    def scaled(field, value):
        return F.when(field == "gas", value / 1000.0).otherwise(value)

    return t.air_long.select("device", "event_id", in_window(F.col("time")).alias("inside"), scaled(F.col("field"), F.col("value")).alias("value"))


@query("x02_window_function", sql("air", f"SELECT device, {DAY}, round(max(lux) - min(lux) + count(lux), 6) AS lux FROM air GROUP BY ALL"))
def _(t):
    """A window's aggregate given as a function of the column's name."""
    return S.aggregate_window(t.air, "1d", lambda c: F.max(c) - F.min(c) + F.count(c), ("device",), "lux")


@query("x04_fit_report", sql("air spectrum", """SELECT f.device, f.n, f.slope, f.r2, p10, p90 FROM (SELECT device, count(*) AS n, round(any_value(b), 9) AS slope, round(1 - sum((y - b * x) * (y - b * x)) / nullif(sum(y * y), 0), 6) AS r2 FROM xy JOIN slope USING (device) GROUP BY device) f
    JOIN (SELECT device, (list_sort(list(y / x)))[floor(0.1 * (count(*) - 1))::INT + 1] * 1e3 AS p10, (list_sort(list(y / x)))[floor(0.9 * (count(*) - 1))::INT + 1] * 1e3 AS p90 FROM xy WHERE x > 0 GROUP BY device) q USING (device)""".replace(" AS p10", " AS p10_").replace(" AS p90", " AS p90_").replace("p10, p90 FROM", "round(p10_, 6) AS p10, round(p90_, 6) AS p90 FROM"), _FIT))
def _(t):
    """What a script does with a query's rows, as one job: a fit through the origin and rank quantiles of the ratio, a device."""
    xy = t.spectrum.join(t.air.select("event_id", "lux"), "event_id").select("device", L.spectrum_sum().alias("x"), L.lux_to_ppfd(F.col("lux")).alias("y"))
    fits = S.fit_origin(xy, "x", "y", ("device",)).withColumn("slope", F.round("slope", 9))
    spread = S.rank_quantiles(xy.filter("x > 0").withColumn("ratio", F.col("y") / F.col("x") * 1e3), ("device",), "ratio", {"p10": 0.1, "p90": 0.9})
    return fits.join(spread, "device").select("device", "n", "slope", "r2", "p10", "p90")
