"""Monitoring, light, calibration."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from .. import config as C
from ..functions import light as L
from ..functions import solar
from ..functions import time as T
from ..operators import joins as J
from ..operators import series as S
from ..plans import calibrate as K
from ..plans import light as P
from ..plans import monitor as M
from ..sources.adapters import EVENTS_AS_OF, FIELDS
from .base import query, sql
from .series import DAY, GREATEST, MINUTE, SUM_S

#: Lamp hours at 12:00 local of the last day: the light fields are gated in.
NOON = datetime(2024, 1, 30, 4, tzinfo=UTC)
AGE = "round((epoch_us(TIMESTAMP '2024-01-30 04:00:00') - epoch_us(max(time))) / 6e7, 6)"
UNTIL = "time <= TIMESTAMP '2024-01-30 04:00:00' AND time >= TIMESTAMP '2023-12-31 04:00:00'"


@query("d01_deadman_air", sql("air_long", f"SELECT k.device, k.field, last_seen, age_min, CASE WHEN last_seen IS NULL THEN 'NoData' WHEN age_min > 60 THEN 'Alerting' ELSE 'Normal' END AS state FROM (SELECT DISTINCT device, field FROM air_long UNION ALL SELECT 'dev-99', 'temp') k LEFT JOIN (SELECT device, field, epoch_us(max(time)) AS last_seen, {AGE} AS age_min FROM air_long WHERE {UNTIL} AND device <> 'dev-0' AND field <> 'gas' GROUP BY ALL) USING (device, field)"))
def _(t):
    known = t.air_long.select("device", "field").distinct().union(t.spark.range(1).select(F.lit("dev-99"), F.lit("temp")))
    return M.deadman_air(t.air_long, NOON, known, ("dev-0",), ("gas",), 60)


@query("d02_deadman_weather", sql("air", f"SELECT epoch_us(max(time)) AS last_seen, {AGE} AS age_min, CASE WHEN {AGE} > 60 THEN 'Alerting' ELSE 'Normal' END AS state FROM air WHERE {UNTIL}"))
def _(t):
    return M.deadman_feed(t.air, NOON)


@query("d03_deadman_spectrum", sql("spectrum", f"SELECT device, epoch_us(max(time)) AS last_seen, {AGE} AS age_min, CASE WHEN {AGE} > 15 THEN 'Alerting' ELSE 'Normal' END AS state FROM spectrum WHERE {UNTIL} AND mode = 'ambient' GROUP BY device"))
def _(t):
    return M.deadman_spectrum(t.spectrum, NOON)


@query("d04_delivery_failures", sql("counters", "SELECT integration, coalesce(sum(CASE WHEN d >= 0 THEN d END), 0.0) AS increase, CASE WHEN coalesce(sum(CASE WHEN d >= 0 THEN d END), 0.0) > 0 THEN 'Alerting' ELSE 'Normal' END AS state FROM (SELECT *, counter - lag(counter) OVER (PARTITION BY integration ORDER BY time) AS d FROM counters WHERE time >= TIMESTAMP '2024-01-30 00:00:00' AND time < TIMESTAMP '2024-01-30 04:00:00') GROUP BY integration"))
def _(t):
    return M.delivery_failures(t.counters, NOON, window=timedelta(hours=4))


@query("d04_failing_hours", sql("counters", "SELECT * FROM (SELECT integration, epoch_us(date_trunc('hour', time)) AS hour, sum(CASE WHEN d >= 0 THEN d END) AS increase FROM (SELECT *, counter - lag(counter) OVER (PARTITION BY integration ORDER BY time) AS d FROM counters) GROUP BY ALL) WHERE increase > 0"))
def _(t):
    return M.failing_hours(t.counters)


_TEN = "(epoch_us(time) // 600000000)"
_RATIO = f"""lux10 AS (SELECT device, {_TEN} AS w, median(lux) AS lux FROM air WHERE {MINUTE} >= 540 AND {MINUTE} < 1080 AND time >= TIMESTAMP '2024-01-25 04:00:00' AND time < TIMESTAMP '2024-01-30 04:00:00' GROUP BY ALL),
    clear10 AS (SELECT device, {_TEN} AS w, median(clear) AS clear FROM spectrum WHERE mode = 'ambient' AND saturated = 0 AND clear < 65535 AND {MINUTE} >= 540 AND {MINUTE} < 1080 AND time >= TIMESTAMP '2024-01-25 04:00:00' AND time < TIMESTAMP '2024-01-30 04:00:00' GROUP BY ALL),
    last6 AS (SELECT device, clear / lux AS ratio FROM lux10 JOIN clear10 USING (device, w) WHERE lux > 0 QUALIFY row_number() OVER (PARTITION BY device ORDER BY w DESC) <= 6),
    found AS (SELECT device, median(ratio) AS ratio, count(*) AS windows FROM last6 GROUP BY device)"""


@query("d05_throughput_ratio", sql("air spectrum", "SELECT device, round(ratio, 6) AS ratio, coalesce(windows, 0) AS windows, CASE WHEN ratio IS NULL THEN 'NoData' WHEN ratio < 2.5 OR ratio > 6.45 THEN 'Alerting' ELSE 'Normal' END AS state FROM (SELECT DISTINCT device FROM air) LEFT JOIN found USING (device)", _RATIO))
def _(t):
    return M.throughput_ratio(t.air, t.spectrum, NOON, 2.5, 6.45, timedelta(days=5))


_STATES = """h AS (SELECT device, time, lux > 6000 AS firing FROM air),
    r AS (SELECT *, sum(CASE WHEN firing IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY time) AS run FROM (SELECT *, lag(firing) OVER (PARTITION BY device ORDER BY time) AS prev FROM h)),
    s AS (SELECT *, CASE WHEN firing THEN (epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY device, run)) / 1e6 ELSE 0.0::DOUBLE END AS held_s FROM r),
    states AS (SELECT device, time, firing, held_s, CASE WHEN firing AND held_s >= 3600 THEN 'Firing' WHEN firing THEN 'Pending' WHEN lag(firing AND held_s >= 3600) OVER (PARTITION BY device ORDER BY time) THEN 'Resolved' ELSE 'Normal' END AS state FROM s)"""


@query("w12_alert_states", sql("air", "SELECT device, epoch_us(time) AS time, firing, round(held_s, 6) AS held_s, state FROM states", _STATES))
def _(t):
    return M.alert_states(t.air.select("device", "time", (F.col("lux") > 6000).alias("firing")), ("device",), 3600)


@query("d06_alert_digest", sql("air_long", "SELECT 'high' AS rule, device, CASE min(CASE field WHEN 'temp' THEN 1 WHEN 'hum' THEN 2 ELSE 3 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, list_sort(list(DISTINCT field)) AS fields, 'high: ' || device || ' ' || array_to_string(list_sort(list(DISTINCT field)), ', ') || ' ' || printf('%.0f', max(value)) AS text FROM air_long WHERE value > 300 GROUP BY device"))
def _(t):
    severity = F.when(F.col("field") == "temp", "critical").when(F.col("field") == "hum", "warning").otherwise("info")
    alerts = t.air_long.withColumns({"rule": F.lit("high"), "severity": severity, "state": F.when(F.col("value") > 300, "Firing").otherwise("Normal")})
    return M.alert_digest(alerts)


@query(
    "a17_freshness_matrix",
    sql("air_long", f"SELECT *, CASE WHEN n_red = 5 THEN 'device_offline' WHEN n_red > 0 THEN 'sensor_dropped' WHEN n_late > 0 THEN 'late' ELSE 'fresh' END AS class FROM (SELECT *, {' + '.join(f'coalesce((age_{f} > 7200)::INT, 1)' for f in FIELDS.values())} AS n_red, {' + '.join(f'coalesce((age_{f} >= 3600)::INT, 1)' for f in FIELDS.values())} AS n_late FROM (SELECT device, {', '.join(f'''round((epoch_us(TIMESTAMP '2024-01-30 04:00:00') - epoch_us(max(time) FILTER (WHERE field = '{f}'))) / 1e6, 6) AS age_{f}''' for f in FIELDS.values())} FROM air_long WHERE time <= TIMESTAMP '2024-01-30 04:00:00' GROUP BY device))"),
)
def _(t):
    return M.freshness_matrix(t.air_long, tuple(FIELDS.values()), NOON, 3600, 7200)


_HEALTH = "health AS (SELECT device, time, local_day, (event_id % 3 <> 0)::INT::DOUBLE AS bme, (event_id % 5 <> 0)::INT::DOUBLE AS as7341, (400 + event_id % 90)::DOUBLE AS spectrum_read_ms, CASE WHEN event_id % 11 = 0 THEN 'brownout' ELSE 'power' END AS reset FROM ev)"


def _health(t):
    e = F.col("event_id")
    return t.events.select("device", "time", (e % 3 != 0).cast("double").alias("bme"), (e % 5 != 0).cast("double").alias("as7341"), (400 + e % 90).cast("double").alias("spectrum_read_ms"), F.when(e % 11 == 0, "brownout").otherwise("power").alias("reset"))


@query("a23_health_summary", sql("ev", f"SELECT device, {DAY}, count(*) AS messages, round(avg(bme), 6) AS bme_ratio, round(avg(as7341), 6) AS as7341_ratio, count(*) FILTER (WHERE greatest(bme, as7341) = 0) AS bus_dead, median(spectrum_read_ms) AS read_ms FROM health GROUP BY ALL", _HEALTH))
def _(t):
    return M.health_summary(_health(t), ("bme", "as7341"))[0]


@query("a23_reset_reasons", sql("ev", "SELECT device, reset, count(*) AS n FROM health GROUP BY ALL", _HEALTH))
def _(t):
    return M.health_summary(_health(t), ("bme", "as7341"))[1]


# -- light --------------------------------------------------------------------------------------

_AREA = "/ 2 * ((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6)"
_BYDAY = "WINDOW w AS (PARTITION BY device, local_day ORDER BY time)"


@query("d07_dli_lux", sql("air", f"SELECT device, {DAY}, round(coalesce(sum(area), 0) / 1e6, 6) AS dli, count(*) AS n FROM (SELECT *, (lux / 54 + lag(lux / 54) OVER w) {_AREA} AS area FROM air {_BYDAY}) GROUP BY ALL"))
def _(t):
    return P.dli_lux(t.air)


_PPFD = f"ppfd AS (SELECT device, local_day, time, ({SUM_S}) * 0.0017469::DOUBLE AS ppfd FROM spectrum WHERE mode = 'ambient' AND saturated = 0 AND clear < 65535)"


@query("d07_dli_spectrum", sql("spectrum", f"SELECT device, {DAY}, round(coalesce(sum(area), 0) / 1e6, 6) AS dli, count(*) AS n FROM (SELECT *, (ppfd + lag(ppfd) OVER w) {_AREA} AS area FROM ppfd {_BYDAY}) GROUP BY ALL", _PPFD))
def _(t):
    return P.dli_spectrum(t.spectrum, 0.0017469)


@query("d08_ppfd_series", sql("spectrum", "SELECT device, epoch_us(time) AS time, round(ppfd, 6) AS ppfd FROM ppfd", _PPFD))
def _(t):
    return P.ppfd_series(t.spectrum, 0.0017469)


@query("w11_running_dli", sql("air", f"SELECT device, epoch_us(time) AS time, round(sum(coalesce(area, 0)) OVER (PARTITION BY device, local_day ORDER BY time) / 1e6, 6) AS dli FROM (SELECT *, (lux / 54 + lag(lux / 54) OVER w) {_AREA} AS area FROM air {_BYDAY})"))
def _(t):
    return P.running_dli(t.air).select("device", "time", "dli")


@query("a18_lamp_window_medians", sql("air spectrum", f"SELECT device, {DAY}, round(lux, 6) AS lux, round(clear, 6) AS clear FROM (SELECT device, local_day, median(lux) AS lux FROM air WHERE {MINUTE} >= 480 AND {MINUTE} < 1110 GROUP BY ALL) FULL JOIN (SELECT device, local_day, median(clear) AS clear FROM spectrum WHERE mode = 'ambient' AND saturated = 0 AND clear < 65535 AND {MINUTE} >= 480 AND {MINUTE} < 1110 GROUP BY ALL) USING (device, local_day)"))
def _(t):
    return P.lamp_window_medians(t.air, t.spectrum)


_SPANS = """spans AS (SELECT location, "on", time AS start, coalesce(lead(time) OVER (PARTITION BY location ORDER BY time), TIMESTAMP '2024-01-31') AS stop FROM lamp),
    cuts AS (SELECT location, d::DATE AS local_day, greatest(start, d - INTERVAL 8 HOUR) AS a, least(stop, d + INTERVAL 16 HOUR) AS b FROM spans, unnest(range(date_trunc('day', start + INTERVAL 8 HOUR)::TIMESTAMP, stop + INTERVAL 8 HOUR, INTERVAL 1 DAY)) AS u(d) WHERE "on" = 1),
    offs AS (SELECT location, (stop + INTERVAL 8 HOUR)::DATE AS local_day, epoch_us(max(stop)) AS last_off FROM spans WHERE "on" = 1 AND stop < TIMESTAMP '2024-01-31' GROUP BY ALL)"""


@query("a19_lamp_daily", sql("lamp", f"SELECT location, {DAY}, round(on_hours, 6) AS on_hours, last_off FROM (SELECT location, local_day, sum((epoch_us(b) - epoch_us(a)) / 3.6e9) AS on_hours FROM cuts GROUP BY ALL) FULL JOIN offs USING (location, local_day)", _SPANS))
def _(t):
    return P.lamp_daily(t.lamp, EVENTS_AS_OF)


@query("d23_dli_split", sql("air", f"SELECT device, {DAY}, round(l / 54e6, 6) AS dli, round((l - r) / 54e6, 6) AS dli_lamp, round(r / 54e6, 6) AS dli_natural FROM (SELECT device, local_day, coalesce(sum((lux + pl) / 2 * dt), 0) AS l, coalesce(sum((lux_ref + pr) / 2 * dt), 0) AS r FROM (SELECT *, lag(lux) OVER w AS pl, lag(lux_ref) OVER w AS pr, (epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6 AS dt FROM air {_BYDAY}) GROUP BY ALL)"))
def _(t):
    return P.dli_split(t.air)


_BY_STATE = """tagged AS (SELECT a.location, a.time, a.local_day, a.lux, l."on" FROM air a ASOF LEFT JOIN lamp l ON a.location = l.location AND a.time >= l.time),
    steps AS (SELECT location, local_day, "on", (lux + lag(lux) OVER w) / 2 * (epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6 / 54e6 AS area FROM tagged WINDOW w AS (PARTITION BY location, local_day ORDER BY time))"""


@query("d23_dli_by_state", sql("air lamp", f"""SELECT location, {DAY}, round(coalesce(sum(area) FILTER (WHERE "on" = 1), 0), 6) AS dli_on, round(coalesce(sum(area) FILTER (WHERE "on" IS DISTINCT FROM 1), 0), 6) AS dli_off FROM steps GROUP BY ALL""", _BY_STATE))
def _(t):
    return P.dli_by_state(t.air, t.lamp)


@query("j10_daily_context", sql("air", f"SELECT {DAY}, round(dli, 6) AS dli, round(rad, 6) AS rad FROM (SELECT local_day, sum(area) / 1e6 AS dli FROM (SELECT local_day, coalesce((lux / 54 + lag(lux / 54) OVER w) {_AREA}, 0) AS area FROM air {_BYDAY}) GROUP BY ALL) FULL JOIN (SELECT local_day, avg(lux_ref) AS rad FROM air GROUP BY ALL) USING (local_day)"))
def _(t):
    """The light of all devices together, beside the day's mean of the shielded sensors."""
    dli = P.dli_lux(t.air).groupBy("local_day").agg(F.sum("dli").alias("dli"))
    weather = S.aggregate_window(t.air, "1d", "mean", (), "lux_ref").withColumnRenamed("lux_ref", "rad")
    return J.daily_context(dli, weather)


#: Solar noon of each local day, step by step as in the library.
_SUN = """s1 AS (SELECT local_day, (local_day - DATE '1970-01-01')::BIGINT * 86400 - 28800 AS mid, ((local_day - DATE '1970-01-01')::BIGINT - 10957 - 0.5::DOUBLE + 4.0::DOUBLE / 24.0::DOUBLE) / 36525.0::DOUBLE AS t FROM (SELECT DISTINCT {day} AS local_day FROM ev)),
    s2 AS (SELECT *, radians(357.52911::DOUBLE + t * (35999.05029::DOUBLE + t * -0.0001537::DOUBLE)) AS m, radians(125.04::DOUBLE + t * -1934.136::DOUBLE) AS node, 0.016708634::DOUBLE + t * (-0.000042037::DOUBLE + t * -0.0000001267::DOUBLE) AS ecc,
                  radians((280.46646::DOUBLE + t * (36000.76983::DOUBLE + t * 0.0003032::DOUBLE)) % 360) AS lng, 21.448::DOUBLE + t * (-46.8150::DOUBLE + t * (-0.00059::DOUBLE + t * 0.001813::DOUBLE)) AS secs FROM s1),
    s3 AS (SELECT *, radians(23.0::DOUBLE + (26.0::DOUBLE + secs / 60) / 60 + cos(node) * 0.00256::DOUBLE) AS tilt,
                  lng + radians(sin(m) * (1.914602::DOUBLE + t * (-0.004817::DOUBLE + t * -0.000014::DOUBLE)) + sin(2 * m) * (0.019993::DOUBLE + t * -0.000101::DOUBLE) + sin(3 * m) * 0.000289::DOUBLE - 0.00569::DOUBLE - sin(node) * 0.00478::DOUBLE) AS seen FROM s2),
    s4 AS (SELECT *, pow(tan(tilt / 2), 2) AS h, degrees(asin(sin(tilt) * sin(seen))) AS sun FROM s3),
    s5 AS (SELECT *, 4 * degrees(h * sin(2 * lng) - 2 * ecc * sin(m) + 4 * ecc * h * sin(m) * cos(2 * lng) - h * h * sin(4 * lng) / 2 - ecc * ecc * sin(2 * m) * 1.25::DOUBLE) AS eq FROM s4),
    solar AS (SELECT local_day, floor(mid + (720.0::DOUBLE - 4.0::DOUBLE * 121.46::DOUBLE - eq + 480.0::DOUBLE) * 60)::BIGINT AS noon, 90.0::DOUBLE - abs(25.01::DOUBLE - sun) AS noon_height FROM s5)"""


@query("f05_solar_noon", sql("ev", f"SELECT {DAY}, noon * 1000000 AS noon, round(noon_height, 6) AS noon_height FROM solar", _SUN.replace("{day}", "time::DATE")))
def _(t):
    days = t.events.select(F.to_date("time").alias("local_day")).distinct()
    return solar.with_solar_noon(days)


@query("f06_cal_windows", sql("ev", f"SELECT DISTINCT {DAY}, epoch_us(local_day::TIMESTAMP - INTERVAL 2 HOUR) AS start, epoch_us(local_day::TIMESTAMP) AS stop, 'pre-lamp' AS window_mode FROM ev"))
def _(t):
    return K.cal_windows(t.events.select(T.local_day(F.col("time")).alias("local_day")).distinct()).select("local_day", "start", "stop", "window_mode")


@query("f11_lamp_share", sql("air", "SELECT event_id, round(lux - lux_ref, 6) AS share, round((lux - lux_ref) / nullif(lux, 0), 6) AS fraction FROM air"))
def _(t):
    return t.air.select("event_id", L.lamp_share(F.col("lux"), F.col("lux_ref")).alias("share"), L.lamp_fraction(F.col("lux"), F.col("lux_ref")).alias("fraction"))


@query("f15_decide", sql("air", f"SELECT event_id, CASE WHEN NOT ({MINUTE} >= 480 AND {MINUTE} < 1110) THEN 'OFF' WHEN event_id % 400 > 300 THEN 'ON' WHEN lux < 5000 THEN 'ON' WHEN lux > 15000 THEN 'OFF' ELSE CASE WHEN event_id % 2 = 0 THEN 'ON' ELSE 'OFF' END END AS state FROM air"))
def _(t):
    current = F.when(F.col("event_id") % 2 == 0, "ON").otherwise("OFF")
    return t.air.select("event_id", L.decide(F.col("lux"), F.col("event_id") % 400, T.minute_of_day(F.col("time")), current, 1110).alias("state"))


# -- calibration ----------------------------------------------------------------------------------

_REASON = f"CASE WHEN lux IS NULL OR f415 IS NULL THEN 'partial' WHEN {GREATEST} >= 65535 THEN 'saturated' WHEN lux >= 45000 THEN 'clamp' WHEN lux < 300 THEN 'below_min' WHEN {SUM_S} <= 0 THEN 'nonpositive' ELSE 'kept' END"
_AVGS = ", ".join(f"avg({c}) AS {c}" for c in C.CHANNELS)
#: One window a device and UTC day, as long as the day: enough readings for every path.
_DAYS = "win AS (SELECT DISTINCT device, date_trunc('day', time)::TIMESTAMP AS start, date_trunc('day', time)::TIMESTAMP + INTERVAL 1 DAY AS stop FROM air UNION ALL SELECT 'dev-99', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06')"
_PRELAMP = "win AS (SELECT DISTINCT device, local_day, local_day::TIMESTAMP - INTERVAL 2 HOUR AS start, local_day::TIMESTAMP AS stop FROM air)"
_FITTED = f"""parts AS (SELECT device, time, lux, {', '.join(f'NULL::DOUBLE AS {c}' for c in C.CHANNELS)} FROM air UNION ALL SELECT device, time, NULL, {', '.join(C.CHANNELS)} FROM spectrum WHERE mode = 'ambient'),
    minutes AS (SELECT p.device, w.start, date_trunc('minute', p.time) AS minute, avg(lux) AS lux, {_AVGS} FROM parts p JOIN win w ON p.device = w.device AND p.time >= w.start AND p.time < w.stop GROUP BY ALL),
    judged AS (SELECT *, {_REASON} AS reason, {SUM_S} AS s, lux / 54.0::DOUBLE AS ppfd, lux / 54.0::DOUBLE / nullif({SUM_S}, 0) AS ratio FROM minutes),
    kept AS (SELECT *, floor((row_number() OVER (PARTITION BY device, start ORDER BY lux, minute) * 5 - 1) / count(*) OVER (PARTITION BY device, start)) AS bin FROM judged WHERE reason = 'kept'),
    slopes AS (SELECT device, start, sum(s * ppfd) / nullif(sum(s * s), 0) AS b FROM kept GROUP BY ALL),
    fits AS (SELECT device, start, any_value(b) AS cal_ols, 1 - sum((ppfd - b * s) * (ppfd - b * s)) / nullif(sum(ppfd * ppfd), 0) AS r2, median(ratio) AS cal_med, min(lux) AS lux_lo, max(lux) AS lux_hi, count(*) AS n,
             (list_sort(list(ratio)))[floor(0.9 * (count(*) - 1))::INT + 1] - (list_sort(list(ratio)))[floor(0.1 * (count(*) - 1))::INT + 1] AS spread FROM kept JOIN slopes USING (device, start) GROUP BY ALL),
    drifts AS (SELECT device, start, max(m) - min(m) AS d FROM (SELECT device, start, bin, avg(ratio) AS m FROM kept GROUP BY ALL) GROUP BY ALL),
    counts AS (SELECT device, start, count(*) AS n_total, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS n_{r}" for r in S.REASONS)} FROM judged GROUP BY ALL),
    every AS (SELECT w.device, w.start, w.stop, coalesce(n_total, 0) AS n_total, {', '.join(f'coalesce(n_{r}, 0) AS n_{r}' for r in S.REASONS)}, lux_lo, lux_hi, cal_med, cal_ols, r2, d * 100 / nullif(cal_med, 0) AS drift_pct, spread * 100 / nullif(cal_med, 0) AS spread_pct,
              coalesce(n_kept >= 20 AND lux_hi / greatest(lux_lo, 1e-9) >= 2, false) AS enough FROM win w LEFT JOIN counts USING (device, start) LEFT JOIN fits USING (device, start) LEFT JOIN drifts USING (device, start))"""
_GATED = ", ".join(f"round(CASE WHEN enough THEN {m} END, {9 if m.startswith('cal') else 6}) AS {m}" for m in K.METRICS)
_OUTCOME = "CASE WHEN n_kept < 20 THEN 'insufficient' WHEN NOT enough THEN 'narrow' WHEN drift_pct > 30 THEN 'drifting' ELSE 'ok' END"


@query("d09_calibrate_window", sql("air spectrum", f"SELECT device, epoch_us(start) AS start, epoch_us(stop) AS stop, n_total, {', '.join(f'n_{r}' for r in S.REASONS)}, round(lux_lo, 6) AS lux_lo, round(lux_hi, 6) AS lux_hi, {_GATED.replace(', 9)', ', 6)')}, {_OUTCOME} AS outcome, CASE WHEN {_OUTCOME} = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS valid FROM every", f"{_DAYS}, {_FITTED}"))
def _(t):
    day = F.date_trunc("day", "time")
    windows = t.air.select("device", day.alias("start"), F.timestamp_seconds(F.unix_seconds(day) + 86400).alias("stop")).distinct()
    absent = t.spark.range(1).select(F.lit("dev-99"), F.timestamp_seconds(F.lit(1704412800)), F.timestamp_seconds(F.lit(1704499200)))
    return K.calibrate_window(t.air, t.spectrum, windows.union(absent), 300.0)


_NOON = _SUN.replace("{day}", "local_day") + """,
    win AS (SELECT DISTINCT a.device, a.location, a.local_day, make_timestamp((noon - 900) * 1000000) AS start, make_timestamp((noon + 900) * 1000000) AS stop FROM air a JOIN solar USING (local_day)),
    dark AS (SELECT w.device, w.start, median(a.lux_ref) AS ref FROM win w JOIN air a ON a.device = w.device AND a.time >= w.start - INTERVAL 125 MINUTE AND a.time < w.start - INTERVAL 120 MINUTE GROUP BY ALL),
    checked AS (SELECT w.device, w.local_day, w.start, NOT coalesce(ref >= 1000, false) AS skip,
        coalesce((SELECT arg_max(l."on", l.time) FROM lamp l WHERE l.location = w.location AND l.time < w.start AND l.time >= w.start - INTERVAL 7 DAY) = 0
                 AND NOT EXISTS (SELECT 1 FROM lamp l WHERE l.location = w.location AND l.time >= w.start AND l.time < w.stop AND l."on" <> 0), false) AS held FROM win w LEFT JOIN dark USING (device, start))"""
_UNLESS = ", ".join(f"round(CASE WHEN NOT skip AND enough THEN {m} END, 6) AS {m}" for m in K.METRICS)


@query(
    "d10_ppfd_cal_daily",
    sql("air spectrum lamp", f"SELECT device, 'noon' AS window_mode, {DAY}, epoch_us(start) AS time, CASE WHEN skip THEN 0 ELSE n_kept END AS n_kept, {_UNLESS}, round(CASE WHEN NOT skip THEN lux_lo END, 6) AS lux_lo, round(CASE WHEN NOT skip THEN lux_hi END, 6) AS lux_hi, CASE WHEN NOT skip AND {_OUTCOME} = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS valid, skip::INT::DOUBLE AS skipped, (NOT skip AND held)::INT::DOUBLE AS lamp_off_ok FROM every JOIN checked USING (device, start)", f"{_NOON}, {_FITTED}"),
)
def _(t):
    days = t.air.select("device", "location", T.local_day(F.col("time")).alias("local_day")).distinct()
    return K.ppfd_cal_daily(t.air, t.spectrum, t.lamp, days, "noon", 300.0, ref_min=1000.0)


@query(
    "d10_ppfd_cal_prelamp",
    sql("air spectrum", f"SELECT device, 'pre-lamp' AS window_mode, (start + INTERVAL 8 HOUR)::DATE::VARCHAR AS local_day, epoch_us(start) AS time, n_kept, {_GATED.replace(', 9)', ', 6)')}, round(lux_lo, 6) AS lux_lo, round(lux_hi, 6) AS lux_hi, CASE WHEN {_OUTCOME} = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS valid, 0.0::DOUBLE AS skipped, 1.0::DOUBLE AS lamp_off_ok FROM every", f"{_PRELAMP}, {_FITTED}"),
)
def _(t):
    days = t.air.select("device", "location", T.local_day(F.col("time")).alias("local_day")).distinct()
    return K.ppfd_cal_daily(t.air, t.spectrum, t.lamp, days)


_FITS = "fits AS (SELECT device, time, 0.0017::DOUBLE + lux / 1e9 AS cal_ols, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS valid FROM air)"


@query("d11_cal_adoption", sql("air", "SELECT *, n >= 5 AND spread_pct <= 0.6 AND off_pct > 10 AS propose FROM (SELECT device, count(*) AS n, round(median(cal_ols), 6) AS proposed, round((max(cal_ols) - min(cal_ols)) * 100 / median(cal_ols), 6) AS spread_pct, round(abs(median(cal_ols) / 0.0015 - 1) * 100, 6) AS off_pct FROM (SELECT * FROM fits WHERE valid = 1 QUALIFY row_number() OVER (PARTITION BY device ORDER BY time DESC) <= 5) GROUP BY device)", _FITS))
def _(t):
    fits = t.air.select("device", "time", (F.lit(0.0017) + F.col("lux") / 1e9).alias("cal_ols"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).alias("valid"))
    return K.cal_adoption(fits, 0.0015, 5, 0.6)


_METER = f"""lx AS (SELECT m.device, m.time, m.source, m.ppfd, count(a.lux) AS n_lux, avg(a.lux) AS lux_at, avg(a.lux_ref) AS lux_ref_at, CASE WHEN count(a.lux) < 2 OR avg(a.lux) = 0 THEN 0 ELSE stddev_pop(a.lux) / avg(a.lux) END AS lux_cv FROM meter m LEFT JOIN air a ON a.device = m.device AND a.time >= m.time - INTERVAL 3 HOUR AND a.time < m.time + INTERVAL 3 HOUR GROUP BY ALL),
    sp AS (SELECT m.device, m.time, count(s.clear) AS n, avg(({SUM_S}) * 0.0017469::DOUBLE) AS spec_ppfd_at, {_AVGS} FROM meter m LEFT JOIN (SELECT * FROM spectrum WHERE mode = 'ambient' AND {GREATEST} < 65535) s ON s.device = m.device AND s.time >= m.time - INTERVAL 3 HOUR AND s.time < m.time + INTERVAL 3 HOUR GROUP BY ALL),
    marked AS (SELECT *, n >= 3 AND n_lux >= 1 AND lux_cv <= 0.9 AS ok FROM lx JOIN sp USING (device, time)),
    photone AS (SELECT device, time, source, ppfd, n_lux, round(lux_cv, 6) AS lux_cv, n, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS paired, {', '.join(f'round(CASE WHEN ok THEN coalesce({c}, -1) ELSE -1 END, 6) AS {c}' for c in ('spec_ppfd_at', 'lux_at', 'lux_ref_at', *C.CHANNELS))}, 0.0017469::DOUBLE AS cal_at FROM marked)"""


def _photone(t):
    return K.pair_meter(t.meter, t.air, t.spectrum, 0.0017469, timedelta(hours=3), max_cv=0.9)


@query("d12_pair_meter", sql("meter air spectrum", "SELECT * REPLACE (epoch_us(time) AS time, round(cal_at, 6) AS cal_at) FROM photone", _METER))
def _(t):
    return _photone(t)


@query("j13_cal_check", sql("meter air spectrum", "SELECT device, epoch_us(time) AS time, round(ppfd / nullif(spec_ppfd_at, 0), 5) AS k_spec, round(ppfd / nullif(lux_at / 54, 0), 5) AS k_lux FROM photone WHERE paired = 1", _METER))
def _(t):
    return J.cal_check(_photone(t)).select("device", "time", F.round("k_spec", 5).alias("k_spec"), F.round("k_lux", 5).alias("k_lux"))


@query("a14_k_by_source", sql("meter air spectrum", "SELECT source, n, CASE WHEN n >= 3 THEN k END AS k, n >= 3 AND source <> 'mixed' AS usable FROM (SELECT source, count(*) AS n, round(avg(ppfd / nullif(spec_ppfd_at, 0)), 5) AS k FROM photone WHERE paired = 1 GROUP BY source)", _METER))
def _(t):
    return J.k_by_source(_photone(t)).withColumn("k", F.round("k", 5))


@query("j11_compare_windows", sql("air", f"SELECT device, {DAY}, round(pre, 6) AS pre, round(noon, 6) AS noon, round(abs(pre - noon) / noon * 100, 6) AS apart_pct, CASE WHEN abs(pre - noon) / noon * 100 <= 5 THEN 'agree' WHEN abs(pre - noon) / noon * 100 <= 10 THEN 'watch' ELSE 'differ' END AS verdict FROM (SELECT device, local_day, 1 + avg(lux) * 1.3707e-5 AS pre, 1 + max(lux) * 1.3909e-5 AS noon FROM air GROUP BY ALL)"))
def _(t):
    daily = t.air.groupBy("device", T.local_day(F.col("time")).alias("local_day")).agg((1 + F.avg("lux") * 1.3707e-5).alias("a"), (1 + F.max("lux") * 1.3909e-5).alias("b"))
    both = daily.select("device", "local_day", F.lit("pre-lamp").alias("window_mode"), F.col("a").alias("cal_ols")).union(daily.select("device", "local_day", F.lit("noon"), "b"))
    return J.compare_windows(both)


_DRIFT = f"""off_ AS (SELECT a.device, a.local_day, a.lux / nullif(a.lux_ref, 0) AS q FROM air a ASOF LEFT JOIN lamp l ON a.location = l.location AND a.time >= l.time WHERE l."on" = 0 AND a.time - l.time <= INTERVAL 7 DAY),
    lamp_off AS (SELECT device, local_day, median(q) AS lux_over_ref FROM off_ GROUP BY ALL),
    optics AS (SELECT s.device, s.local_day, min(clear) AS dark_floor, median(({SUM_S.replace('f', 's.f')}) / nullif(a.lux, 0)) AS spectrum_over_lux, median(clear / nullif(a.lux, 0)) AS clear_over_lux FROM spectrum s JOIN air a ON a.device = s.device AND a.time = s.time WHERE s.mode = 'ambient' GROUP BY ALL)"""


@query("d20_drift_diagnostics", sql("air spectrum lamp", f"SELECT device, {DAY}, round(dark_floor, 6) AS dark_floor, round(spectrum_over_lux, 6) AS spectrum_over_lux, round(clear_over_lux, 6) AS clear_over_lux, round(lux_over_ref, 6) AS lux_over_ref FROM optics FULL JOIN lamp_off USING (device, local_day)", _DRIFT))
def _(t):
    return K.drift_diagnostics(t.air, t.spectrum, t.lamp)


_FIELDS = " || ".join(f"coalesce(',{m}=' || printf('%.10g', {m}), '')" for m in (*K.METRICS, "lux_lo", "lux_hi"))
_PUT = ", ".join(f"CASE WHEN enough THEN {m} END AS {m}" for m in K.METRICS)


@query("s07_cal_lines", sql("air spectrum", f"SELECT 'ppfd_cal,device=' || device || ',window_mode=pre-lamp n_kept=' || n_kept || {_FIELDS} || ',valid=' || CASE WHEN {_OUTCOME} = 'ok' THEN 1 ELSE 0 END || ',skipped=0,lamp_off_ok=1 ' || epoch_us(start) * 1000 AS line FROM (SELECT device, start, n_kept, enough, lux_lo, lux_hi, {_PUT} FROM every)", f"{_PRELAMP}, {_FITTED}"))
def _(t):
    days = t.air.select("device", "location", T.local_day(F.col("time")).alias("local_day")).distinct()
    return K.as_points(K.ppfd_cal_daily(t.air, t.spectrum, t.lamp, days))
