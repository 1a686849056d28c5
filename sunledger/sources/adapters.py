"""The supplied star-schema and event tables as telemetry: the same expressions exist as SQL beside the queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

#: "Now" for the events table, and for weights.
EVENTS_AS_OF = datetime(2024, 1, 31, tzinfo=UTC)
WEIGHTS_AS_OF = datetime(2001, 11, 5, tzinfo=UTC)
FIELDS = {"view": "temp", "click": "hum", "signup": "lux", "purchase": "lux_ref", "error": "gas"}
#: Rows of lineitem that a task groups to weights, at most about.
GROUPED = 250_000


class Tables:
    """Adapted tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("time", F.col("ts").cast("timestamp")).withColumn("device", F.concat(F.lit("dev-"), (F.col("user_id") % 16).cast("string")))

    @property
    def air_long(self) -> DataFrame:
        field = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))[F.col("event_type")]
        return self.events.select("device", "time", field.alias("field"), "value", "event_id")

    @property
    def air(self) -> DataFrame:
        """One row a message: lux, a shielded lux and a signal strength."""
        e = F.col("event_id")
        return self.events.select(
            "device", F.concat(F.lit("loc-"), (F.col("user_id") % 8).cast("string")).alias("location"), "time", (F.col("value") * 100).alias("lux"), (F.col("value") * 30).alias("lux_ref"), (-40.0 - (e % 50)).cast("double").alias("rssi"), "event_id"
        )

    @property
    def spectrum(self) -> DataFrame:
        e, v = F.col("event_id"), F.col("value")
        channels = [(v * C.RESPONSE[c] * (F.lit(1.0) + (((e * (i + 1)) % 11) - 5) / F.lit(100.0))).alias(c) for i, c in enumerate(C.CHANNELS)]
        clear = (v * 640.0 * (F.lit(1.0) + ((e % 7) - 3) / F.lit(50.0))).alias("clear")
        mode = F.when(e % 13 == 0, "reflect").otherwise("ambient").alias("mode")
        return self.events.select("device", "time", mode, *channels, clear, (e % 97 == 0).cast("double").alias("saturated"), "event_id")

    @property
    def messages(self) -> DataFrame:
        field = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))[F.col("event_type")]
        payload = F.concat(F.lit('{"'), field, F.lit('": '), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit(', "n": "x", "ok": true, "site": "s'), (F.col("event_id") % 3).cast("string"), F.lit('"}'))
        return self.events.select(F.concat(F.lit("site/"), "device", F.lit("/telemetry")).alias("topic"), payload.alias("payload"), F.col("time").alias("recv_ts"), (F.col("event_id") % 101 == 0).alias("retained"))

    def _ship_time(self) -> Column:
        return F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 86400)

    @property
    def event_raw(self) -> DataFrame:
        """Weigh events: one row an event, and its repeats three seconds apart."""
        base = self.read("lineitem").groupBy(
            F.concat(F.lit("st-"), F.col("l_linenumber").cast("string")).alias("device"), (F.col("l_orderkey") % 50).alias("event_id"), self._ship_time().alias("time")
        ).agg(F.max("l_quantity").alias("q"), F.min("l_partkey").alias("part"), F.min(F.col("l_orderkey") % 5).alias("copies"))
        copies = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int"))))
        return copies.select("device", "event_id", F.lpad(F.col("part").cast("string"), 8, "0").alias("uid"), (F.col("q") * 10).alias("weight_g"), F.timestamp_seconds(F.unix_seconds("time") + 3 * F.col("k")).alias("recv_ts"))

    @property
    def plant_weight(self) -> DataFrame:
        rows, keys = self.read("lineitem"), ("device", "plant_id", "time")
        named = rows.select(
            F.concat(F.lit("st-"), F.col("l_linenumber").cast("string")).alias("device"), F.concat(F.lit("cactus-"), (F.col("l_suppkey") % 20).cast("string")).alias("plant_id"), self._ship_time().alias("time"), "l_quantity", "l_partkey"
        )
        # Nearly every row is a group of its own, so nothing is gained before the shuffle; a task's memory follows the rows that it groups.
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // GROUPED))
        weights = named.repartition(tasks, *keys).groupBy(*keys).agg(F.max("l_quantity").alias("weight_g"), F.lpad(F.min("l_partkey").cast("string"), 8, "0").alias("uid"))
        return weights.withColumn("quality", F.when(F.col("weight_g") < 5, "empty").otherwise("ok"))

    @property
    def tag_map(self) -> DataFrame:
        parts = self.read("part").filter("p_partkey % 5 <> 0")
        return parts.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("uid"), F.when(F.col("p_partkey") % 41 == 0, "tare-ref").otherwise(F.concat(F.lit("cactus-"), (F.col("p_partkey") % 22).cast("string"))).alias("plant_id"))

    @property
    def registry(self) -> DataFrame:
        return self.read("supplier").select(F.concat(F.lit("cactus-"), (F.col("s_suppkey") % 20).cast("string")).alias("plant_id")).distinct()

    @property
    def light(self) -> DataFrame:
        """Changes of the lamp: one row a location and time."""
        time = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
        raw = self.read("orders").groupBy(F.concat(F.lit("loc-"), (F.col("o_custkey") % 8).cast("string")).alias("location"), time.alias("time"))
        return raw.agg(F.max((F.col("o_orderstatus") == "O").cast("double")).alias("on"))

    @property
    def lamp(self) -> DataFrame:
        """Lamp changes over the time of the events table."""
        return self.events.groupBy(F.concat(F.lit("loc-"), (F.col("user_id") % 8).cast("string")).alias("location"), "time").agg(F.max((F.col("event_id") % 3 == 0).cast("double")).alias("on"))

    @property
    def counters(self) -> DataFrame:
        rows = self.events.filter("event_type = 'error'")
        return rows.select(F.lit("notifications_failed_total").alias("name"), (F.col("user_id") % 4).cast("string").alias("integration"), "time", (F.floor(F.col("event_id") / 3) % 1000).cast("double").alias("counter"))

    @property
    def meter(self) -> DataFrame:
        """Readings of a handheld meter: the purchases."""
        source = F.element_at(F.array(F.lit("daylight"), F.lit("lamp"), F.lit("mixed")), (F.col("user_id") % 3).cast("int") + 1)
        return self.events.filter("event_type = 'purchase'").select("device", "time", source.alias("source"), F.col("value").alias("ppfd"))

    @property
    def reflect(self) -> DataFrame:
        """Reflect measurements from vectors: ten bands dark and lit."""
        bands = ("f415", "f555", "f680", "clear", "n610", "n680", "n730", "n760", "n810", "n860")
        e = F.col("embedding")
        dark = [((F.element_at(e, i + 1).cast("double") + 1) * 1000).alias(f"dark_{b}") for i, b in enumerate(bands)]
        lit = [((F.element_at(e, i + 17).cast("double") + 3) * 1000 * (1 + i % 4)).alias(f"lit_{b}") for i, b in enumerate(bands)]
        base = self.read("embeddings")
        return base.select(
            F.concat(F.lit("cactus-"), F.col("label").cast("string")).alias("plant"), F.floor(F.col("vec_id") / 5).cast("string").alias("request_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60).alias("time"), F.lit("reflect").alias("mode"),
            (F.col("vec_id") % 9 != 0).cast("double").alias("nir_valid"), *dark, *lit, "vec_id",
        )

    @property
    def retained(self) -> DataFrame:
        rows = self.read("conversations").groupBy(F.concat(F.lit("ref/"), F.col("conv_id").cast("string")).alias("topic"), F.col("turn").alias("recv_ts")).agg(F.max("text").alias("text"))
        return rows.select("topic", "recv_ts", F.when(F.col("recv_ts") % 5 == 0, "").otherwise(F.col("text")).alias("payload"))


REFLECT_BANDS = ("f415", "f555", "f680", "clear", "n610", "n680", "n730", "n760", "n810", "n860")
