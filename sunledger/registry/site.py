"""Weigh station, leaf reflectance, lamp controller, scalar functions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..config import CHANNELS, SITE
from ..functions import light as L
from ..functions import reflect as R
from ..functions import text as X
from ..functions import time as T
from ..operators.joins import resolve_plant
from ..operators.ordered import dedup_ttl
from ..operators.ranked import ranked
from ..operators.series import label_quality
from ..plans import control as C
from ..plans import reflect as V
from ..plans import weights as P
from ..sources import messages as I
from ..sources.adapters import EVENTS_AS_OF, REFLECT_BANDS
from .base import query, sql
from .series import DAY, MINUTE, SUM_S, _windows

# -- weigh station --------------------------------------------------------------------------------


def _bursts():
    """The milliseconds after a weigh event at which it comes. Some bursts last longer than the ttl."""
    return F.sequence(F.lit(0), (F.col("event_id") % 4 * 75_000).cast("int"), F.lit(25_000))


#: Of one key and time the first row counts; from each kept time on to the first beyond the ttl, in steps of all keys at once.
_WALK = """stamps AS (SELECT device, event_id, recv_ts, min(struct_pack(uid := uid, g := weight_g)) AS e FROM bursts GROUP BY ALL),
    nxt AS (SELECT a.*, b.recv_ts AS after FROM stamps a ASOF LEFT JOIN stamps b ON a.device = b.device AND a.event_id = b.event_id AND a.recv_ts + INTERVAL 60 SECOND < b.recv_ts),
    kept AS (WITH RECURSIVE walk AS (SELECT * FROM (SELECT * FROM nxt QUALIFY row_number() OVER (PARTITION BY device, event_id ORDER BY recv_ts) = 1)
             UNION ALL SELECT n.* FROM walk w JOIN nxt n ON n.device = w.device AND n.event_id = w.event_id AND n.recv_ts = w.after) SELECT * FROM walk)"""
_BURSTS = "bursts AS (SELECT DISTINCT device, event_id, uid, weight_g, recv_ts + to_seconds(25 * k) AS recv_ts FROM event_raw, unnest(range((event_id % 4 * 3)::INT + 1)) AS u(k))"


@query("t02_dedup_ttl", sql("event_raw", "SELECT device, event_id, e.uid, e.g AS weight_g, epoch_us(recv_ts) AS recv_ts FROM kept", f"{_BURSTS}, {_WALK}"))
def _dedup_all(t):
    return dedup_ttl(t.event_raw, ("device", "event_id"), ties=("uid", "weight_g"), days=64, again=_bursts()).select("device", "event_id", "uid", "weight_g", "recv_ts")


@query(
    "d13_ingest_weights",
    sql("event_raw tag_map", "SELECT device, coalesce(plant_id, 'unknown') AS plant_id, CASE WHEN weight_g < 30 THEN 'empty' ELSE 'ok' END AS quality, count(*) AS n, round(sum(weight_g), 6) AS total FROM kept LEFT JOIN tag_map USING (uid) GROUP BY ALL",
        """stamps AS (SELECT device, event_id, recv_ts, arg_min(uid, (uid, weight_g)) AS uid, arg_min(weight_g, (uid, weight_g)) AS weight_g FROM event_raw GROUP BY ALL),
        nxt AS (SELECT a.*, b.recv_ts AS after FROM stamps a ASOF LEFT JOIN stamps b ON a.device = b.device AND a.event_id = b.event_id AND a.recv_ts + INTERVAL 60 SECOND < b.recv_ts),
        kept AS (WITH RECURSIVE walk AS (SELECT * FROM (SELECT * FROM nxt QUALIFY row_number() OVER (PARTITION BY device, event_id ORDER BY recv_ts) = 1)
                 UNION ALL SELECT n.* FROM walk w JOIN nxt n ON n.device = w.device AND n.event_id = w.event_id AND n.recv_ts = w.after) SELECT * FROM walk)"""),
)
def _(t):
    weights, _ = P.ingest_weights(t.event_raw, t.tag_map)
    return weights.groupBy("device", "plant_id", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("weight_g").alias("total"))


_GAINS = "gains AS (SELECT *, weight_g - lag(weight_g) OVER (PARTITION BY plant_id ORDER BY time, device) AS gain FROM plant_weight WHERE quality = 'ok')"


@query("d17_watering_events", sql("plant_weight", "SELECT plant_id, device, epoch_us(time) AS time, gain AS weight_g FROM gains WHERE gain > 10", _GAINS))
def _(t):
    return P.watering_events(t.plant_weight).select("plant_id", "device", "time", "weight_g")


@query("d17_watering_days", sql("plant_weight", f"SELECT {DAY}, count(DISTINCT plant_id) AS plants FROM gains WHERE gain > 10 GROUP BY local_day HAVING count(DISTINCT plant_id) >= 8", _GAINS))
def _(t):
    return P.watering_days(t.plant_weight)


@query("d17_water_uptake", sql("plant_weight", f"SELECT plant_id, {DAY}, max(weight_g) AS wet_g, min(weight_g) AS dry_g, max(weight_g) - min(weight_g) AS uptake_g FROM plant_weight WHERE quality = 'ok' GROUP BY ALL"))
def _(t):
    return P.water_uptake(t.plant_weight)


_REFS = """recent AS (SELECT * FROM plant_weight WHERE quality = 'ok' AND time >= TIMESTAMP '2000-10-01' - INTERVAL 90 DAY AND time < TIMESTAMP '2000-10-01'),
    rg AS (SELECT *, weight_g - lag(weight_g) OVER (PARTITION BY plant_id ORDER BY time, device) AS gain FROM recent),
    anchor AS (SELECT max(local_day) AS d FROM (SELECT local_day FROM rg WHERE gain > 10 GROUP BY local_day HAVING count(DISTINCT plant_id) >= 4)),
    refs AS (SELECT plant_id, max(weight_g) FILTER (WHERE time >= d::TIMESTAMP - INTERVAL 8 HOUR) AS sat_g, quantile_cont(weight_g, 0.1) FILTER (WHERE time >= TIMESTAMP '2000-10-01' - INTERVAL 60 DAY) AS dry_g, any_value(d) AS anchor_day FROM recent, anchor GROUP BY plant_id)"""
_REF_TIME = datetime(2000, 10, 1, tzinfo=UTC)


@query("d14_weight_refs", sql("plant_weight", "SELECT plant_id, sat_g, round(dry_g, 6) AS dry_g, anchor_day::VARCHAR AS anchor_day FROM refs WHERE sat_g - dry_g > 5", _REFS))
def _(t):
    return P.weight_refs(t.plant_weight, _REF_TIME, plants=4)


@query("d15_publish_refs", sql("plant_weight tag_map", "SELECT 'site/plant_ref/' || uid AS topic, plant_id, round(sat_g, 1) AS sat_g, anchor_day::VARCHAR AS anchor_day FROM refs JOIN tag_map USING (plant_id) WHERE sat_g - dry_g > 5", _REFS.replace(">= 4", ">= 1")))
def _(t):
    messages, _, _ = P.publish_refs(P.weight_refs(t.plant_weight, _REF_TIME, plants=1), t.tag_map, t.retained)
    back = F.from_json("payload", "plant_id string, sat_g double, dry_g double, anchor_day string")
    return messages.select("topic", back.alias("p")).select("topic", "p.plant_id", "p.sat_g", "p.anchor_day")


@query("d15_untagged", sql("plant_weight tag_map", "SELECT DISTINCT plant_id FROM refs WHERE sat_g - dry_g > 5 AND plant_id NOT IN (SELECT plant_id FROM tag_map WHERE plant_id NOT IN ('tare-ref', 'cactus-3', 'cactus-4'))", _REFS.replace(">= 4", ">= 1")))
def _(t):
    tags = t.tag_map.filter("plant_id NOT IN ('cactus-3', 'cactus-4')")
    return P.publish_refs(P.weight_refs(t.plant_weight, _REF_TIME, plants=1), tags, t.retained)[2]


@query("d15_stale_topics", sql("plant_weight tag_map retained", "SELECT DISTINCT topic FROM retained WHERE topic NOT IN (SELECT 'ref/' || uid FROM refs JOIN tag_map USING (plant_id) WHERE sat_g - dry_g > 5)", _REFS.replace(">= 4", ">= 1")))
def _(t):
    return P.publish_refs(P.weight_refs(t.plant_weight, _REF_TIME, plants=1), t.tag_map, t.retained, "ref")[1]


@query("d16_relabel", sql("plant_weight", "SELECT plant_id, quality, count(*) AS n FROM (SELECT plant_id, CASE WHEN plant_id = 'cactus-3' AND time >= TIMESTAMP '1998-01-01' AND time < TIMESTAMP '1999-01-01' THEN 'suspect' ELSE quality END AS quality FROM plant_weight) GROUP BY ALL"))
def _(t):
    after, _ = P.relabel(t.plant_weight, datetime(1998, 1, 1, tzinfo=UTC), datetime(1999, 1, 1, tzinfo=UTC), "suspect", "cactus-3")
    return after.groupBy("plant_id", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("d16_labels_left", sql("plant_weight", "SELECT count(*) AS n, 1 AS labels FROM plant_weight WHERE time >= TIMESTAMP '1998-01-01' AND time < TIMESTAMP '1999-01-01'"))
def _(t):
    low, high = datetime(1998, 1, 1, tzinfo=UTC), datetime(1999, 1, 1, tzinfo=UTC)
    return P.labels_left(P.relabel(t.plant_weight, low, high, "suspect")[0], low, high).select("n", F.col("labels").cast("int").alias("labels"))


@query("f22_moisture", sql("plant_weight", "SELECT plant_id, round((avg(weight_g) - min(weight_g)) / nullif(max(weight_g) - min(weight_g), 0), 6) AS moisture FROM plant_weight GROUP BY plant_id"))
def _(t):
    return t.plant_weight.groupBy("plant_id").agg(P.moisture(F.avg("weight_g"), F.min("weight_g"), F.max("weight_g")).alias("moisture"))


@query("a21_scale_calibration", sql("ev", "SELECT device, n_empty, n_loaded, tare, round(CASE WHEN n_loaded >= 8 AND loaded <> tare THEN (loaded - tare) / 250 END, 6) AS scale FROM (SELECT device, count(*) FILTER (WHERE event_id % 2 = 0) AS n_empty, count(*) FILTER (WHERE event_id % 2 = 1) AS n_loaded, CASE WHEN count(*) FILTER (WHERE event_id % 2 = 0) >= 8 THEN round(avg(value) FILTER (WHERE event_id % 2 = 0)) END AS tare, avg(value * 50) FILTER (WHERE event_id % 2 = 1) AS loaded FROM ev GROUP BY device)"))
def _(t):
    empty = F.col("event_id") % 2 == 0
    raw = t.events.select("device", F.when(empty, "empty").otherwise("loaded").alias("phase"), F.when(empty, F.col("value")).otherwise(F.col("value") * 50).alias("raw"))
    return P.scale_calibration(raw, 250.0)


_WEIGH = """smp AS (SELECT device, time, (300 + value / 100.0::DOUBLE + CASE WHEN event_id % 40 = 0 THEN 5 ELSE 0 END) AS grams, row_number() OVER (PARTITION BY device ORDER BY time) AS rn, event_id FROM ev),
    rol AS (SELECT *, avg(grams) OVER w AS mean_g, max(grams) OVER w - min(grams) OVER w AS range_g, (epoch_us(time) - min(epoch_us(time)) OVER w) / 1e6 AS span_s FROM smp WINDOW w AS (PARTITION BY device ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    tap AS (SELECT device, time, event_id::VARCHAR AS uid FROM ev WHERE event_type = 'signup'),
    own AS (SELECT r.device, r.time, mean_g, range_g < 2 AND span_s >= 2 AS still, t.time AS tap_time FROM rol r ASOF JOIN tap t ON r.device = t.device AND r.time >= t.time WHERE r.time - t.time <= INTERVAL 24 HOUR),
    run AS (SELECT *, sum(CASE WHEN still IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY device, tap_time ORDER BY time) AS run FROM (SELECT *, lag(still) OVER (PARTITION BY device, tap_time ORDER BY time) AS prev FROM own)),
    ok AS (SELECT device, tap_time, min(time) AS time, arg_min(mean_g, time) AS weight_g FROM (SELECT *, epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY device, tap_time, run) AS held FROM run) WHERE still AND held >= 3600e6 AND epoch_us(time) - epoch_us(tap_time) >= 7200e6 GROUP BY ALL)"""


@query("w08_stable_weighs", sql("ev", "SELECT t.device, epoch_us(t.time) AS tap_time, uid, epoch_us(ok.time) AS time, round(weight_g, 6) AS weight_g, CASE WHEN ok.time IS NULL THEN 'UNSTABLE' ELSE 'MEASURED' END AS result FROM tap t LEFT JOIN ok ON ok.device = t.device AND ok.tap_time = t.time", _WEIGH))
def _(t):
    samples = t.events.select("device", "time", (300 + F.col("value") / 100.0 + F.when(F.col("event_id") % 40 == 0, 5).otherwise(0)).alias("grams"))
    taps = t.events.filter("event_type = 'signup'").select("device", "time", F.col("event_id").cast("string").alias("uid"))
    return P.stable_weighs(samples, taps, 2.0, 2.0, 3600.0, 7200.0, 86400.0, 4)


# -- reflectance ----------------------------------------------------------------------------------

_NETS = ", ".join(f"lit_{b} - dark_{b} AS net_{b}" for b in REFLECT_BANDS)
_STATUS = f"CASE WHEN greatest({', '.join(f'lit_{b}' for b in REFLECT_BANDS)}) >= 65000 THEN 'saturated' WHEN dark_clear > 2000 THEN 'ambient_leak' ELSE 'ok' END"
_NET = f"net AS (SELECT *, {_NETS}, {_STATUS} AS status FROM reflect)"
_OK = "nir_valid = 1 AND net_n680 > 0 AND net_n810 > 0 AND net_n730 > 0"
_INDEX = f"""{_NET}, idx AS (SELECT *, CASE WHEN {_OK} AND abs((net_n810 - net_n680) / (net_n810 + net_n680)) <= 1 THEN (net_n810 - net_n680) / (net_n810 + net_n680) END AS ndvi,
    CASE WHEN {_OK} AND abs((net_n810 - net_n730) / (net_n810 + net_n730)) <= 1 THEN (net_n810 - net_n730) / (net_n810 + net_n730) END AS ndre, CASE WHEN {_OK} THEN net_n810 / net_n730 - 1 END AS cire FROM net),
    hist AS (SELECT plant, request_id, max(time) AS time, median(ndvi) AS ndvi, median(ndre) AS ndre, median(cire) AS cire FROM idx WHERE status = 'ok' GROUP BY ALL)"""


def _net(t):
    return V.reflect_net(t.reflect, REFLECT_BANDS)


@query("f12_reflect_net", sql("reflect", f"SELECT vec_id, status, {', '.join(f'round(net_{b}, 4) AS net_{b}' for b in REFLECT_BANDS)}, (status = 'saturated')::INT::DOUBLE AS saturated, (status = 'ambient_leak')::INT::DOUBLE AS ambient_leak FROM net", _NET))
def _(t):
    return _net(t).select("vec_id", "status", *(F.round(f"net_{b}", 4).alias(f"net_{b}") for b in REFLECT_BANDS), "saturated", "ambient_leak")


@query("f13_nir_invalid", sql("reflect", "SELECT vec_id, least(lit_n610, lit_n680, lit_n730, lit_n760, lit_n810, lit_n860) * 25 >= 65535 AS bad FROM reflect"))
def _(t):
    bands = [f"lit_{b}" for b in REFLECT_BANDS if b.startswith("n")]
    return t.reflect.withColumns({b: F.col(b) * 25 for b in bands}).select("vec_id", R.nir_invalid(bands).alias("bad"))


@query("f14_vegetation_indices", sql("reflect", "SELECT vec_id, round(ndvi, 6) AS ndvi, round(ndre, 6) AS ndre, round(cire, 6) AS cire FROM idx", _INDEX))
def _(t):
    return V.with_indices(_net(t)).select("vec_id", "ndvi", "ndre", "cire")


@query("d18_latest_spectrum", sql("spectrum", f"SELECT device, epoch_us(time) AS time, wavelength, round(value, 6) AS value FROM (SELECT device, max(time) AS time, {', '.join(f'arg_max({c}, time) AS {c}' for c in CHANNELS)} FROM spectrum WHERE mode = 'ambient' GROUP BY device), LATERAL (VALUES {', '.join(f'({c[1:]}, {c})' for c in CHANNELS)}) AS v(wavelength, value)"))
def _(t):
    return V.latest_spectrum(t.spectrum)


@query("d18_latest_reflectance", sql("reflect", f"SELECT plant, epoch_us(time) AS time, channel, round(value, 4) AS value FROM (SELECT plant, max(time) AS time, {', '.join(f'arg_max(net_{b}, time) AS net_{b}' for b in REFLECT_BANDS)} FROM net GROUP BY plant), LATERAL (VALUES {', '.join(f"('net_{b}', net_{b})" for b in REFLECT_BANDS)}) AS v(channel, value)", _NET))
def _(t):
    return V.latest_reflectance(_net(t), REFLECT_BANDS).withColumn("value", F.round("value", 4))


@query("a22_burst_summary", sql("reflect", f"SELECT plant, request_id, count(*) AS samples, count(*) FILTER (WHERE status <> 'ok') AS failures, (max(epoch_us(time)) - min(epoch_us(time))) / 1e6 AS span_s, {', '.join(f'''round(median(net_{b}) FILTER (WHERE status = 'ok'), 4) AS net_{b}''' for b in REFLECT_BANDS)} FROM net GROUP BY ALL", _NET))
def _(t):
    found = V.burst_summary(_net(t), REFLECT_BANDS)
    return found.withColumns({f"net_{b}": F.round(f"net_{b}", 4) for b in REFLECT_BANDS})


@query("t11_sessions", sql("reflect", "SELECT plant, epoch_us(min(time)) AS session_start, count(*) AS samples FROM (SELECT plant, time, sum(new) OVER (PARTITION BY plant ORDER BY time) AS s FROM (SELECT plant, time, CASE WHEN time - lag(time) OVER (PARTITION BY plant ORDER BY time) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM reflect)) GROUP BY plant, s"))
def _(t):
    return V.sessions(t.reflect, ("plant",))


@query("d19_veg_index_history", sql("reflect", "SELECT plant, request_id, epoch_us(time) AS time, round(ndvi, 6) AS ndvi, round(ndre, 6) AS ndre, round(cire, 6) AS cire FROM hist", _INDEX))
def _(t):
    return V.veg_index_history(_net(t))


@query("d19_veg_index_latest", sql("reflect", "SELECT plant, epoch_us(time) AS time, request_id, round(ndvi, 6) AS ndvi, round(ndre, 6) AS ndre, round(cire, 6) AS cire FROM hist QUALIFY row_number() OVER (PARTITION BY plant ORDER BY time DESC, request_id DESC) = 1", _INDEX))
def _(t):
    return V.veg_index_latest(_net(t))


@query("w13_index_drift", sql("reflect", "SELECT plant, request_id, round(base, 6) AS baseline, round((ndvi - base) / nullif(base, 0), 6) AS drift FROM (SELECT *, median(ndvi) OVER (PARTITION BY plant ORDER BY time ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base FROM hist WHERE ndvi IS NOT NULL)", _INDEX))
def _(t):
    return V.index_drift(V.veg_index_history(_net(t))).select("plant", "request_id", "baseline", "drift")


# -- lamp controller --------------------------------------------------------------------------------


def _ticks(t, step=600):
    """A tick every `step` seconds at each location, over the days from its first reading to its last."""
    days = t.air.groupBy("location").agg(F.min(F.to_date("time")).alias("a"), F.max(F.to_date("time")).alias("b")).select("location", F.explode(F.sequence("a", "b")).alias("d"))
    grid = days.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(86399), F.lit(step))))
    return grid.select("location", F.timestamp_seconds(F.unix_date("d").cast("long") * 86400 + F.col("s")).alias("time"))


def _seen(step):
    return f"""tick AS (SELECT location, a + to_seconds(s) AS time FROM (SELECT location, date_trunc('day', min(time))::TIMESTAMP AS a, date_diff('day', min(time), max(time)) AS n FROM air GROUP BY location), unnest(range(0, 86400 * (n + 1), {step})) AS u(s)),
    flux AS (SELECT location, time, local_day, sum(coalesce(area, 0)) OVER (PARTITION BY location, local_day ORDER BY time) / 1e6 AS dli FROM (SELECT *, (lux / 54 + lag(lux / 54) OVER w) / 2 * ((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6) AS area FROM air WINDOW w AS (PARTITION BY location, local_day ORDER BY time))),
    seen AS (SELECT t.location, t.time, CASE WHEN t.time - a.time <= INTERVAL 1 DAY THEN a.lux END AS lux, CASE WHEN t.time - a.time <= INTERVAL 1 DAY THEN (epoch_us(t.time) - epoch_us(a.time)) / 1e6 END AS lux_age_s FROM tick t ASOF LEFT JOIN air a ON t.location = a.location AND t.time >= a.time),
    prep AS (SELECT s.*, (extract(hour FROM s.time + INTERVAL 8 HOUR) * 60 + extract(minute FROM s.time + INTERVAL 8 HOUR))::INT AS minute, CASE WHEN f.local_day = (s.time + INTERVAL 8 HOUR)::DATE THEN f.dli END AS dli FROM seen s ASOF LEFT JOIN flux f ON s.location = f.location AND s.time >= f.time)"""


_PREP = "SELECT location, epoch_us(time) AS time, lux, round(lux_age_s, 6) AS lux_age_s, minute, round(dli, 6) AS dli FROM prep"


@query("d21_prepare_ticks", sql("air", _PREP, _seen(600)))
def _(t):
    return C.prepare_ticks(_ticks(t), t.air).drop("local_day")


@query("d21_prepare_ticks_all", sql("air", _PREP, _seen(SITE.tick_s)))
def _(t):
    return C.prepare_ticks(_ticks(t, SITE.tick_s), t.air).drop("local_day")


_FORCED = "CASE WHEN NOT (minute >= 480 AND minute < 1110) THEN 'OFF' WHEN lux IS NULL OR lux_age_s > 300 THEN 'ON' WHEN lux < 5000 THEN 'ON' WHEN lux > 15000 THEN 'OFF' END"
_BAND = f"SELECT location, epoch_us(time) AS time, coalesce(last_value({_FORCED} IGNORE NULLS) OVER (PARTITION BY location ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'OFF') AS state FROM prep"


@query("t08_hysteresis", sql("air", _BAND, _seen(600)))
def _(t):
    return C.hysteresis(C.prepare_ticks(_ticks(t), t.air)).select("location", "time", "state")


@query("t08_hysteresis_all", sql("air", _BAND, _seen(SITE.tick_s)))
def _hysteresis_all(t):
    return C.hysteresis(C.prepare_ticks(_ticks(t, SITE.tick_s), t.air)).select("location", "time", "state")


def raw_commands(t):
    """Every event as a command, some of them retained or in small letters."""
    return t.events.select(F.concat(F.lit("loc-"), (F.col("user_id") % 8).cast("string")).alias("location"), "time", F.when(F.col("event_id") % 3 == 0, "ON").otherwise("off").alias("state"), (F.col("event_id") % 7 == 0).alias("retained"))


def prepared_rows(t, step=600):
    return C.controller_rows(_ticks(t, step), t.air, raw_commands(t))


#: The controller as a recursion: one row a tick or command, the state carried along.
REPLAY = "cmds AS (SELECT 'loc-' || (user_id % 8) AS location, time, CASE WHEN event_id % 3 = 0 THEN 'ON' ELSE 'OFF' END AS cmd FROM ev WHERE event_id % 7 <> 0), " + _seen(600) + """,
    rowz AS (SELECT location, time, 'tick' AS kind, lux, lux_age_s, minute, (time + INTERVAL 8 HOUR)::DATE AS day, dli, NULL AS cmd FROM prep UNION ALL SELECT location, time, 'cmd', NULL, NULL, NULL, NULL, NULL, cmd FROM cmds),
    seq AS (SELECT *, epoch_us(time) / 1e6 AS t, row_number() OVER (PARTITION BY location ORDER BY time, kind) AS rn FROM rowz),
    walk AS (WITH RECURSIVE w AS (
        SELECT location, 0::BIGINT AS rn, false AS is_on, -1e18::DOUBLE AS manual_until, -1e18::DOUBLE AS last_switch, false AS ext, NULL::DATE AS day, NULL::VARCHAR AS said, NULL::TIMESTAMP AS time FROM (SELECT DISTINCT location FROM seq)
        UNION ALL
        SELECT location, rn, CASE WHEN cmd IS NOT NULL THEN cmd = 'ON' WHEN held THEN is_on ELSE want END,
               CASE WHEN cmd IS NOT NULL THEN t + 300 ELSE manual_until END,
               CASE WHEN cmd IS NULL AND NOT held AND want <> is_on THEN t ELSE last_switch END,
               ext2, CASE WHEN cmd IS NULL THEN day2 ELSE day END,
               CASE WHEN cmd IS NOT NULL AND (cmd = 'ON') <> is_on THEN 'manual' WHEN cmd IS NULL AND NOT held AND want <> is_on THEN 'auto' END, time
        FROM (SELECT *, t < manual_until OR t - last_switch < 300 AS held,
                     minute >= 480 AND minute < CASE WHEN ext2 THEN 1230 ELSE 1110 END AND (lux IS NULL OR lux_age_s > 300 OR lux < 5000 OR (is_on AND lux <= 15000)) AS want
              FROM (SELECT w.*, s.rn AS rn_, s.time AS time_, s.lux, s.lux_age_s, s.minute, s.day AS day2, s.cmd, s.t,
                           CASE WHEN s.cmd IS NOT NULL THEN w.ext WHEN s.minute >= 1110 AND s.minute < 1230 AND s.dli IS NOT NULL THEN s.dli < 4 WHEN s.day IS DISTINCT FROM w.day THEN false ELSE w.ext END AS ext2
                    FROM w JOIN seq s ON s.location = w.location AND s.rn = w.rn + 1) AS z(location, rn0, is_on, manual_until, last_switch, ext, day, said, time0, rn, time, lux, lux_age_s, minute, day2, cmd, t, ext2)))
        SELECT * FROM w)"""


@query("d21_replay_light", sql("air", "SELECT location, epoch_us(time) AS time, CASE WHEN is_on THEN 'ON' ELSE 'OFF' END AS state, said AS source FROM walk WHERE said IS NOT NULL", REPLAY))
def _(t):
    """Every location and command, a tick in ten minutes."""
    return C.replay(_ticks(t), t.air, raw_commands(t))


#: The same as a fold over a list a location, for which a tick a minute isn't too much. The evening's answer needs no state of the lamp.
_HELD = "x.us < a.manual_until OR x.us - a.last_switch < 300000000"
_WANT = "CASE WHEN a.lamp THEN x.stay_on ELSE x.start_on END"
FOLD = "cmds AS (SELECT 'loc-' || (user_id % 8) AS location, time, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS cmd FROM ev WHERE event_id % 7 <> 0), " + _seen(SITE.tick_s) + f""",
    rowz AS (SELECT location, time, 'tick' AS kind, NULL::INT AS cmd, minute >= 480 AND minute < CASE WHEN ext THEN 1230 ELSE 1110 END AS inside, lux IS NULL OR lux_age_s > 300 OR lux < 5000 AS dark, coalesce(lux <= 15000, false) AS band
             FROM (SELECT *, coalesce(last_value(CASE WHEN minute >= 1110 AND minute < 1230 THEN dli < 4 END IGNORE NULLS) OVER (PARTITION BY location, (time + INTERVAL 8 HOUR)::DATE ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS ext FROM prep)
             UNION ALL SELECT location, time, 'cmd', cmd, false, false, false FROM cmds),
    lists AS (SELECT location, list(struct_pack(us := epoch_us(time), cmd := cmd, start_on := inside AND dark, stay_on := inside AND (dark OR band), lamp := false, manual_until := 0::BIGINT, last_switch := 0::BIGINT, said := []::STRUCT(us BIGINT, lamp BOOLEAN, source VARCHAR)[]) ORDER BY time, kind) AS l FROM rowz GROUP BY location),
    folded AS (SELECT location, unnest(list_reduce(l, lambda a, x: struct_pack(us := x.us, cmd := x.cmd, start_on := x.start_on, stay_on := x.stay_on,
            lamp := CASE WHEN x.cmd IS NOT NULL THEN x.cmd = 1 WHEN {_HELD} THEN a.lamp ELSE {_WANT} END,
            manual_until := CASE WHEN x.cmd IS NOT NULL THEN x.us + 300000000 ELSE a.manual_until END,
            last_switch := CASE WHEN x.cmd IS NOT NULL OR {_HELD} OR a.lamp = {_WANT} THEN a.last_switch ELSE x.us END,
            said := CASE WHEN x.cmd IS NOT NULL AND (x.cmd = 1) <> a.lamp THEN list_append(a.said, struct_pack(us := x.us, lamp := x.cmd = 1, source := 'manual'))
                         WHEN x.cmd IS NULL AND NOT ({_HELD}) AND a.lamp <> {_WANT} THEN list_append(a.said, struct_pack(us := x.us, lamp := NOT a.lamp, source := 'auto')) ELSE a.said END),
            struct_pack(us := 0::BIGINT, cmd := NULL::INT, start_on := false, stay_on := false, lamp := false, manual_until := 0::BIGINT, last_switch := 0::BIGINT, said := []::STRUCT(us BIGINT, lamp BOOLEAN, source VARCHAR)[])).said) AS s FROM lists)"""
REPLAYED = "SELECT location, s.us AS time, CASE WHEN s.lamp THEN 'ON' ELSE 'OFF' END AS state, s.source FROM folded"


@query("d21_replay_light_all", sql("air", REPLAYED, FOLD))
def _replay_all(t):
    """The same at every tick of the controller."""
    return C.replay(_ticks(t, SITE.tick_s), t.air, raw_commands(t))


_WIN = "win AS (SELECT DISTINCT location, date_trunc('day', time)::TIMESTAMP + INTERVAL 22 HOUR AS start, date_trunc('day', time)::TIMESTAMP + INTERVAL 24 HOUR AS stop FROM air)"


@query("d22_verify_lamp_off", sql("air lamp", """SELECT w.location, epoch_us(w.start) AS start, coalesce((SELECT arg_max(l."on", l.time) FROM lamp l WHERE l.location = w.location AND l.time < w.start AND l.time >= w.start - INTERVAL 7 DAY) = 0 AND NOT EXISTS (SELECT 1 FROM lamp l WHERE l.location = w.location AND l.time >= w.start AND l.time < w.stop AND l."on" = 1), false) AS held FROM win w""", _WIN))
def _(t):
    return C.verify_lamp_off(_windows(t), t.lamp).select("location", "start", "held")


# -- scalar functions -------------------------------------------------------------------------------


@query("f01_minute_of_day", sql("ev", f"SELECT event_id, {MINUTE} AS minute, {DAY} FROM ev"))
def _(t):
    return t.events.select("event_id", T.minute_of_day(F.col("time")).alias("minute"), T.local_day(F.col("time")).alias("local_day"))


@query("f03_wall_clock", sql("ev", "SELECT event_id, (epoch_us(time) // 60000000) * 60000000 AS back, epoch_us(time) * 1000 AS ns, epoch_us(local_day::TIMESTAMP - INTERVAL 8 HOUR) AS midnight FROM ev"))
def _(t):
    wall = F.date_format(T.local(F.col("time")), "yyyy-MM-dd'T'HH:mm")
    return t.events.select("event_id", T.from_local(wall).alias("back"), T.epoch_ns(F.col("time")).alias("ns"), T.day_start(T.local_day(F.col("time"))).alias("midnight"))


@query("f08_spectrum_sum", sql("spectrum", f"SELECT event_id, round({SUM_S}, 5) AS s, round(({SUM_S}) * 0.0017469::DOUBLE, 6) AS ppfd FROM spectrum"))
def _(t):
    return t.spectrum.select("event_id", F.round(L.spectrum_sum(), 5).alias("s"), L.spectrum_ppfd(0.0017469).alias("ppfd"))


@query("f09_datasheet_cal", sql("ev", "SELECT gain, round(cal, 9) * 1e6 AS cal_e6, 0.0017469 / cal BETWEEN 0.5 AND 2 AS agrees, count(*) AS n FROM (SELECT 1 + event_id % 8 AS gain, 0.00836 * 55 / ((3200.0 / 0.57 / (512.0 * 100.0)) * (1 + event_id % 8) * 280.78)::DOUBLE AS cal FROM ev) GROUP BY ALL"))
def _(t):
    cal = F.lit(L.datasheet_cal(1.0, 280.78)) / F.col("gain")
    rows = t.events.select((1 + F.col("event_id") % 8).alias("gain")).withColumn("cal", cal)
    return rows.groupBy("gain", (F.round("cal", 9) * 1e6).alias("cal_e6"), (F.lit(0.0017469) / F.col("cal")).between(0.5, 2.0).alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


@query("f10_recalibrate", sql("ev", "SELECT event_id, round(2.0 * value / nullif(value + 1, 0), 6) AS cal FROM ev"))
def _(t):
    return t.events.select("event_id", L.recalibrate(F.lit(2.0), F.col("value"), F.col("value") + 1).alias("cal"))


@query("f16_top_up", sql("ev", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 10 < 4 END, event_id % 2 = 0) AS go FROM ev"))
def _(t):
    return t.events.select("event_id", L.top_up(F.when(F.col("event_id") % 3 != 0, F.col("value") / 10), F.col("event_id") % 2 == 0).alias("go"))


@query("f18_escapes", sql("", r"""SELECT p_partkey, replace(replace(replace(replace(n, '\', '\\'), ' ', '\ '), ',', '\,'), '=', '\=') AS tag, replace(n || chr(10) || 'x', chr(10), ' ') AS line FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ',a=b' WHEN 1 THEN '\ c' ELSE '' END AS n FROM part)"""))
def _(t):
    """Names with commas, equals signs and backslashes, too."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ",a=b").when(F.col("p_partkey") % 3 == 1, "\\ c").otherwise(""))
    return t.read("part").withColumn("n", name).select("p_partkey", X.escape_tag(F.col("n")).alias("tag"), X.one_line(F.concat("n", F.lit("\n"), F.lit("x"))).alias("line"))


@query("f19_outside", sql("air", "SELECT device, count(*) FILTER (WHERE lux < 2500 OR lux > 12000) AS n FROM air GROUP BY device"))
def _(t):
    return t.air.groupBy("device").agg(F.count_if(X.outside(F.col("lux"), 2500, 12000)).alias("n"))


@query("f21_tags_of_plant", sql("tag_map", "SELECT plant_id, uid, row_number() OVER (PARTITION BY plant_id ORDER BY uid) AS place, count(*) OVER (PARTITION BY plant_id) AS tags FROM tag_map"))
def _(t):
    """A row a tag, in order: a plant may have any number."""
    return ranked(t.tag_map.select("plant_id", "uid"), ("plant_id",), ("uid",), "place", "tags")


@query("f02_local_day", sql("light", """SELECT location, epoch_us(time) AS time, (timezone('Europe/Berlin', timezone('UTC', time)))::DATE::VARCHAR AS local_day, epoch_us(timezone('UTC', timezone('Europe/Berlin', (timezone('Europe/Berlin', timezone('UTC', time)))::DATE::TIMESTAMP))) AS midnight,
    (extract(hour FROM timezone('Europe/Berlin', timezone('UTC', time))) * 60 + extract(minute FROM timezone('Europe/Berlin', timezone('UTC', time))))::INT AS minute FROM light"""))
def _(t):
    """Local days of a zone with summer time, over years: each day's midnight and the minute of the day."""
    zone, day = "Europe/Berlin", T.local_day(F.col("time"), "Europe/Berlin")
    return t.light.select("location", "time", day.alias("local_day"), T.day_start(day, zone).alias("midnight"), T.minute_of_day(F.col("time"), zone).alias("minute"))


@query("f07_light_units", sql("air", "SELECT event_id, round(lux / 54.0::DOUBLE, 6) AS ppfd, round(lux / 54.0::DOUBLE / 1e6::DOUBLE * 3600.0::DOUBLE, 6) AS moles_an_hour FROM air"))
def _(t):
    ppfd = L.lux_to_ppfd(F.col("lux"))
    return t.air.select("event_id", ppfd.alias("ppfd"), L.micromoles_to_moles(ppfd * 3600.0).alias("moles_an_hour"))


@query("f17_ref_payloads", sql("plant_weight tag_map", """SELECT 'site/plant_ref/' || uid AS topic, '{"plant_id":"' || plant_id || '","sat_g":' || round(sat_g, 1)::DOUBLE || ',"dry_g":' || round(dry_g, 1)::DOUBLE || ',"anchor_day":"' || anchor_day || '"}' AS payload FROM refs JOIN tag_map USING (plant_id) WHERE sat_g - dry_g > 5""", _REFS.replace(">= 4", ">= 1")))
def _(t):
    """Topics and JSON texts as they are published."""
    return P.publish_refs(P.weight_refs(t.plant_weight, _REF_TIME, plants=1), t.tag_map, t.retained)[0]


@query("f20_alert_text", sql("air_long", "SELECT device, field, CASE WHEN age_min > 60 THEN 'silent: ' || device || '/' || field || ' for ' || printf('%.0f', age_min) || ' min, limit 60 min' END AS text FROM (SELECT device, field, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(time))) / 6e7 AS age_min FROM air_long GROUP BY ALL)"))
def _(t):
    ages = t.air_long.groupBy("device", "field").agg(F.max("time").alias("t")).withColumn("age_min", T.age_minutes(F.col("t"), EVENTS_AS_OF))
    return ages.select("device", "field", F.when(F.col("age_min") > 60, X.silence_text(F.col("device"), F.col("field"), F.col("age_min"), 60)).alias("text"))


@query("x03_station_nodes", sql("event_raw tag_map", "SELECT device, event_id, coalesce(plant_id, 'unknown') AS plant_id, CASE WHEN e.g < 30 THEN 'empty' ELSE 'ok' END AS quality, e.g AS weight_g, epoch_us(recv_ts) AS time FROM kept LEFT JOIN tag_map ON uid = e.uid", f"bursts AS (SELECT * FROM event_raw), {_WALK}"))
def _(t):
    """The station's steps from the raw JSON on: validate, drop repeats, resolve the tag, label."""
    body = F.to_json(F.struct("event_id", "uid", "weight_g"))
    raw = t.event_raw.select("device", body.alias("payload"), "recv_ts")
    broken = raw.withColumn("payload", F.regexp_replace("payload", '"weight_g":', '"weight":'))
    good, _ = I.validate_events(raw.unionByName(broken))
    once = dedup_ttl(good.drop("payload"), ("device", "event_id"), ties=("uid", "weight_g"), days=64)
    named = label_quality(resolve_plant(once, t.tag_map))
    return named.select("device", "event_id", "plant_id", "quality", "weight_g", F.col("recv_ts").alias("time"))
