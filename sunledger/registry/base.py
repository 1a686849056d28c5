"""Registration, and the adapted tables in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHANNELS, RESPONSE
from ..sources.adapters import REFLECT_BANDS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_channels = ", ".join(f"value * {RESPONSE[c]} * (1.0::DOUBLE + (((event_id * {i + 1}) % 11) - 5) / 100.0::DOUBLE) AS {c}" for i, c in enumerate(CHANNELS))
_bands = ", ".join(f"(embedding[{i + 1}]::DOUBLE + 1) * 1000 AS dark_{b}, (embedding[{i + 17}]::DOUBLE + 3) * 1000 * {1 + i % 4} AS lit_{b}" for i, b in enumerate(REFLECT_BANDS))
_field = "CASE event_type WHEN 'view' THEN 'temp' WHEN 'click' THEN 'hum' WHEN 'signup' THEN 'lux' WHEN 'purchase' THEN 'lux_ref' WHEN 'error' THEN 'gas' END"

#: The adapted tables, each in terms of the supplied ones and of those before it.
VIEWS = {
    "ev": "SELECT *, ts::TIMESTAMP AS time, 'dev-' || (user_id % 16) AS device, (ts::TIMESTAMP + INTERVAL 8 HOUR)::DATE AS local_day FROM events",
    "air_long": f"SELECT device, time, {_field} AS field, value, event_id, local_day FROM ev",
    "air": "SELECT device, 'loc-' || (user_id % 8) AS location, time, value * 100 AS lux, value * 30 AS lux_ref, (-40.0 - (event_id % 50))::DOUBLE AS rssi, event_id, local_day FROM ev",
    "spectrum": f"SELECT device, time, CASE WHEN event_id % 13 = 0 THEN 'reflect' ELSE 'ambient' END AS mode, {_channels}, value * 640.0::DOUBLE * (1.0::DOUBLE + ((event_id % 7) - 3) / 50.0::DOUBLE) AS clear, CASE WHEN event_id % 97 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS saturated, event_id, local_day FROM ev",
    "messages": f"""SELECT 'site/' || device || '/telemetry' AS topic, '{{"' || {_field} || '": ' || round(value * 100)::BIGINT || ', "n": "x", "ok": true, "site": "s' || (event_id % 3) || '"}}' AS payload, time AS recv_ts, event_id % 101 = 0 AS retained, device, {_field} AS field, round(value * 100)::DOUBLE AS v, 's' || (event_id % 3) AS site FROM ev""",
    "shipped": "SELECT *, l_shipdate::TIMESTAMP + to_seconds(l_orderkey % 86400) AS time FROM lineitem",
    "event_raw": "SELECT device, event_id, lpad(part::VARCHAR, 8, '0') AS uid, q * 10 AS weight_g, time + to_seconds(3 * k) AS recv_ts FROM (SELECT 'st-' || l_linenumber AS device, l_orderkey % 50 AS event_id, time, max(l_quantity) AS q, min(l_partkey) AS part, min(l_orderkey % 5) AS copies FROM shipped GROUP BY ALL), unnest(range(copies::INT + 1)) AS t(k)",
    "plant_weight": "SELECT *, CASE WHEN weight_g < 5 THEN 'empty' ELSE 'ok' END AS quality, (time + INTERVAL 8 HOUR)::DATE AS local_day FROM (SELECT 'st-' || l_linenumber AS device, 'cactus-' || (l_suppkey % 20) AS plant_id, time, max(l_quantity) AS weight_g, lpad(min(l_partkey)::VARCHAR, 8, '0') AS uid FROM shipped GROUP BY ALL)",
    "tag_map": "SELECT lpad(p_partkey::VARCHAR, 8, '0') AS uid, CASE WHEN p_partkey % 41 = 0 THEN 'tare-ref' ELSE 'cactus-' || (p_partkey % 22) END AS plant_id FROM part WHERE p_partkey % 5 <> 0",
    "registry": "SELECT DISTINCT 'cactus-' || (s_suppkey % 20) AS plant_id FROM supplier",
    "light": """SELECT 'loc-' || (o_custkey % 8) AS location, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS time, max(CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS "on" FROM orders GROUP BY ALL""",
    "lamp": """SELECT 'loc-' || (user_id % 8) AS location, time, max(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS "on" FROM ev GROUP BY ALL""",
    "counters": "SELECT 'notifications_failed_total' AS name, (user_id % 4)::VARCHAR AS integration, time, (floor(event_id / 3) % 1000)::DOUBLE AS counter FROM ev WHERE event_type = 'error'",
    "meter": "SELECT device, time, (['daylight', 'lamp', 'mixed'])[user_id % 3 + 1] AS source, value AS ppfd FROM ev WHERE event_type = 'purchase'",
    "reflect": f"SELECT 'cactus-' || label AS plant, (vec_id // 5)::VARCHAR AS request_id, make_timestamp((1704067200 + vec_id * 60) * 1000000) AS time, CASE WHEN vec_id % 9 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nir_valid, {_bands}, vec_id FROM embeddings",
    "retained": "SELECT 'ref/' || conv_id AS topic, turn AS recv_ts, CASE WHEN turn % 5 = 0 THEN '' ELSE max(text) END AS payload FROM conversations GROUP BY conv_id, turn",
}
_NEEDS = {
    "air_long": ["ev"], "air": ["ev"], "spectrum": ["ev"], "messages": ["ev"], "lamp": ["ev"], "counters": ["ev"], "meter": ["ev"], "event_raw": ["shipped"], "plant_weight": ["shipped"],
}


def sql(views: str, body: str, more: str = "") -> str:
    """SQL over the named views; `more` has further common tables."""
    wanted: list[str] = []
    for v in views.split():
        wanted += [x for x in (*_NEEDS.get(v, ()), v) if x not in wanted]
    tables = [f"{v} AS ({VIEWS[v]})" for v in wanted] + ([more] if more else [])
    return ("WITH " + ", ".join(tables) if tables else "") + "\n" + body


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Instants as microseconds, days as text, doubles rounded: what both engines print alike."""

    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            return F.unix_micros(c).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(c, digits) + 0.0).alias(f.name)
        return c

    return df.select(*map(one, df.schema.fields))


def query(name: str, text: str | None = None) -> Callable:
    """Registers a function of adapted Tables under a name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if text is not None:
            SQL[name] = text
        return f

    return register
