"""Device messages to points: topics, JSON payloads, nested polls, counters, schema reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SITE
from ..functions.time import from_local, local

MESSAGES = T.StructType([T.StructField("topic", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("recv_ts", T.TimestampType()), T.StructField("retained", T.BooleanType())])

#: Topic suffix to (measurement, name of the tag in the second segment).
ROUTES = {
    "telemetry": ("air", "device"), "light/state": ("light", "location"), "spectrum": ("spectrum", "device"), "reflect/result": ("spectrum", "device"), "plant_weight": ("plant_weight", "device"),
    "health": ("health", "device"), "measure/event_raw": ("measure_event_raw", "device"),
}


def read_messages(spark: SparkSession, path: str, streaming: bool = False, format: str = "json") -> DataFrame:
    """Landed messages from files of a folder, as a table or as a stream. (Kafka works the same way after a select.)"""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGES).format(format).load(path)


def parse_topic(df: DataFrame, routes: Mapping[str, tuple[str, str]] = ROUTES) -> DataFrame:
    """Adds measurement, device and location; topics of no route get a null measurement."""
    part = F.regexp_extract("topic", r"^[^/]+/([^/]+)/", 1)
    measurement, device, location = (F.lit(None).cast("string") for _ in range(3))
    for suffix, (name, tag) in routes.items():
        hit = F.col("topic").rlike(rf"^[^/]+/[^/]+/{suffix}$")
        measurement = F.when(hit, name).otherwise(measurement)
        if tag == "device":
            device = F.when(hit, part).otherwise(device)
        else:
            location = F.when(hit, part).otherwise(location)
    return df.withColumns({"measurement": measurement, "device": device, "location": location})


def json_to_points(df: DataFrame, tag_keys: Sequence[str] = (), string_fields: Sequence[str] = (), payload: str = "payload") -> DataFrame:
    """One row a field: (other columns, tags as columns, field, value, value_str).

    Every JSON number is a double, true and false are 1 and 0, named string fields are kept as they are; other
    strings, quoted numbers included, and nulls, arrays and objects are dropped. Numbers in named string fields and tags count as
    their text. A payload that is no JSON object gives no rows.
    """
    parsed = df.withColumn("__map", F.from_json(payload, "map<string,variant>"))
    tags = {k: F.expr(f"try_variant_get(element_at(__map, '{k}'), '$', 'string')") for k in tag_keys}
    rows = parsed.withColumns(tags).select(*[c for c in df.columns if c != payload], *tags, F.explode("__map").alias("field", "__raw"))
    kind = F.expr("schema_of_variant(__raw)")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$")
    text = F.col("field").isin(*string_fields) if string_fields else F.lit(False)
    out = rows.filter(~F.col("field").isin(*tag_keys)) if tag_keys else rows
    out = out.withColumns({"value": F.when(~text & number, F.expr("try_variant_get(__raw, '$', 'double')")), "value_str": F.when(text, F.expr("try_variant_get(__raw, '$', 'string')"))}).drop("__raw")
    return out.filter(F.col("value").isNotNull() | F.col("value_str").isNotNull())


WEATHER = "struct<current: struct<time: string, interval: double, precipitation: double, rain: double, temperature_2m: double, relative_humidity_2m: double, cloud_cover: double, shortwave_radiation: double>>"


def parse_weather(df: DataFrame, tz: str = SITE.tz, payload: str = "payload") -> DataFrame:
    """The object at `current`, stamped with its own local time; `interval` is left out."""
    current = df.withColumn("__w", F.from_json(payload, WEATHER)["current"]).filter("__w IS NOT NULL")
    fields = ("precipitation", "rain", "temperature_2m", "relative_humidity_2m", "cloud_cover", "shortwave_radiation")
    return current.select(*[c for c in df.columns if c != payload], from_local(F.col("__w.time"), tz).alias("time"), *(F.col(f"__w.{f}").alias(f) for f in fields))


def collapse_polls(df: DataFrame, keys: Sequence[str], values: Sequence[str], received: str = "recv_ts") -> DataFrame:
    """Polls of one slot are one point: each field from the latest poll that had it."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(received))).alias(v) for v in values))


def select_metrics(df: DataFrame, names: Sequence[str], drop_tags: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col("name").isin(*names)).drop(*drop_tags)


def validate_events(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of weigh events: event_id and weight_g must be JSON numbers, uid a JSON string, the device known."""
    number = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"

    def raw(key: str, kind: str) -> Column:  # the JSON text itself tells a number from a quoted one
        body = r'("(?:[^"\\]++|\\.)*+")' if kind == "string" else r"([^,}\s\"]+)"
        return F.regexp_extract(payload, rf'"{key}"\s*:\s*{body}', 1)

    ok = F.from_json(payload, "map<string,string>").isNotNull() & F.col("device").isNotNull() & raw("event_id", "number").rlike(number) & raw("weight_g", "number").rlike(number) & (raw("uid", "string") != "")
    parsed = df.withColumns({"event_id": F.expr(f"try_cast(get_json_object({payload}, '$.event_id') AS bigint)"), "uid": F.get_json_object(payload, "$.uid"), "weight_g": F.expr(f"try_cast(get_json_object({payload}, '$.weight_g') AS double)")})
    flagged = parsed.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("__ok").drop("__ok"), flagged.filter("NOT __ok").select(*df.columns)


def acks(events: DataFrame, prefix: str = "site") -> DataFrame:
    """An acknowledgement for every valid copy, repeats included."""
    return events.select(F.concat(F.lit(f"{prefix}/"), "device", F.lit("/measure/ack")).alias("topic"), F.to_json(F.struct("event_id")).alias("payload"))


def compact_retained(df: DataFrame, received: str = "recv_ts") -> DataFrame:
    """The latest payload of each topic; an empty one clears the topic."""
    return df.groupBy("topic").agg(F.max_by("payload", received).alias("payload")).filter("payload IS NOT NULL AND payload <> ''")


def measurements(points: DataFrame) -> DataFrame:
    return points.select("measurement").distinct()


def field_keys(points: DataFrame, measurement: str) -> DataFrame:
    return points.filter(F.col("measurement") == measurement).select("field").distinct()


def tag_keys(points: DataFrame, measurement: str) -> DataFrame:
    """Keys of the map column `tags`."""
    return points.filter(F.col("measurement") == measurement).select(F.explode(F.map_keys("tags")).alias("tag")).distinct()


def type_conflicts(raw: DataFrame, by: Sequence[str] = ("measurement", "field"), value: str = "raw") -> DataFrame:
    """Fields that came as more than one of int, float and string."""
    kind = F.when(F.col(value).rlike(r"^-?\d+$"), "int").when(F.expr(f"try_cast({value} AS double)").isNotNull(), "float").otherwise("string")
    return raw.withColumn("__kind", kind).groupBy(*by).agg(F.array_sort(F.collect_set("__kind")).alias("kinds")).filter(F.size("kinds") > 1)


def format_local(df: DataFrame, tz: str = SITE.tz, time: str = "time", numbers: Sequence[str] = ()) -> DataFrame:
    """A report: local times as MM-dd HH:mm:ss, numbers in short form."""
    short = {c: F.regexp_replace(F.regexp_replace(F.format_string("%.6g", F.col(c)), r"(\.\d*?)0+$", "$1"), r"\.$", "") for c in numbers}
    return df.withColumns({time: F.date_format(local(F.col(time), tz), "MM-dd HH:mm:ss")} | short)
