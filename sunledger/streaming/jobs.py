"""Structured Streaming forms of the jobs. Each takes a streaming frame and returns one, or starts a query."""

from __future__ import annotations

import json
from bisect import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import resolve_plant
from ..operators.series import label_quality
from ..sources.messages import acks, json_to_points, parse_topic
from ..sources.tables import upsert_points


#: Keeps typed state and timers in a store of its own beside the checkpoint, not on the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_typed(df: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet", once: bool = True) -> StreamingQuery:
    """As start, for queries with typed state and timers, which need another state store. The session's own setting is left as it was."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        return start(df, path, checkpoint, mode, format, once)
    finally:
        conf.set(name, before) if before else conf.unset(name)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet", once: bool = True) -> StreamingQuery:
    """Writes a stream to files; `once` works off what is there and ends."""
    writer = df.writeStream.outputMode(mode).format(format).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_ingest(messages: DataFrame, tag_keys: Sequence[str] = (), string_fields: Sequence[str] = ()) -> DataFrame:
    """Messages to points, as they come: topics routed, payloads typed. Retained messages are history, not readings."""
    routed = parse_topic(messages.filter(~F.coalesce("retained", F.lit(False)))).filter("measurement IS NOT NULL")
    return json_to_points(routed, tag_keys, string_fields)


#: How many buckets of keys dedup_stream deals rows over, for streams that begin anew.
BUCKETS = 2048


def in_buckets(events: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    return events.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def dedup_stream(events: DataFrame, ttl_ms: int = 60_000, keys: Sequence[str] = ("device", "event_id"), time: str = "recv_ts", late: str = "60 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Keeps the first of each key and drops its repeats up to ttl_ms after the kept one, in whatever batch they come; later ones are new.

    As dedup_ttl, over a stream. Keys are dealt over hash buckets, and a bucket's state has the kept times that a row above the
    watermark can still repeat. A row that comes after later ones of its key repeats a kept row that is up to ttl_ms away on either side.
    A task's Python holds one bucket's rows of a batch at a time. A stream that goes on from a checkpoint needs the number of buckets it began with.
    """
    names, schema, columns = list(keys), events.schema, events.columns
    marked = in_buckets(events.withWatermark(time, late), names, buckets)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[int]] = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat([b for b in batches if len(b)]).sort_values([time, *(c for c in columns if c != time and schema[c].dataType.typeName() in ("string", "long", "integer", "double"))], kind="stable")
        micros = rows[time].astype("int64") // {"ns": 1000, "us": 1}[rows[time].dt.unit]
        stay = np.zeros(len(rows), bool)
        for i, (key, t) in enumerate(zip(map(str, zip(*(rows[k] for k in names), strict=True)), micros.tolist(), strict=True)):
            seen = kept.setdefault(key, [])
            at = bisect(seen, t)
            if all(abs(t - s) > ttl_ms * 1000 for s in seen[max(0, at - 1) : at + 1]):
                seen.insert(at, t)
                stay[i] = True
        low = (state.getCurrentWatermarkMs() - ttl_ms) * 1000
        state.update((json.dumps({k: left for k, v in kept.items() if (left := [t for t in v if t >= low])}),))
        yield rows.loc[stay, columns]

    return marked.groupBy("__bucket").applyInPandasWithState(step, schema, "kept string", "append", GroupStateTimeout.NoTimeout)


def request_dedup(commands: DataFrame, time: str = "time", delay: str = "1 day") -> DataFrame:
    """A request is measured once, however often it is sent within the delay."""
    return commands.withWatermark(time, delay).dropDuplicatesWithinWatermark(["request_id"])


def store_weights(read_map: Callable[[SparkSession], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over events without repeats (dedup_stream): names plants, labels and stores the weights.

    The tag map is read anew for every batch; a map that can't be read leaves plants unknown, it stops nothing. A batch has a folder
    of its own, batch=N, so a batch that is run again replaces what it wrote before.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            tags = read_map(spark)
            tags.schema["uid"], tags.schema["plant_id"]
        except Exception:
            tags = spark.createDataFrame([], "uid string, plant_id string")
        label_quality(resolve_plant(batch, tags)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return work


def weigh_station(events: DataFrame, read_map: Callable[[SparkSession], DataFrame], weights: str, acknowledged: str, checkpoint: str, once: bool = True) -> tuple[StreamingQuery, StreamingQuery]:
    """Valid events, live: every copy is acknowledged, one weight an event is stored. Each sink has its own query and checkpoint."""
    return start(acks(events), acknowledged, f"{checkpoint}/acks", once=once), each_batch(dedup_stream(events), store_weights(read_map, weights), f"{checkpoint}/weights", once=once)


def windowed(points: DataFrame, every: str, by: Sequence[str], value: str = "value", late: str = "10 minutes", median: bool = False, time: str = "time") -> DataFrame:
    """Tumbling means and counts (or approximate medians) that wait for late points."""
    fn = F.percentile_approx(value, 0.5, 10_000) if median else F.avg(value)
    out = points.withWatermark(time, late).groupBy(*by, F.window(time, every).alias("__w")).agg(fn.alias(value), F.count(value).alias("n"))
    return out.select(*by, F.col("__w.start").alias("window_start"), value, "n")


def burst_sessions(points: DataFrame, by: Sequence[str], gap: str = "10 minutes", late: str = "10 minutes", time: str = "time") -> DataFrame:
    out = points.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("__w")).agg(F.count(F.lit(1)).alias("samples"))
    return out.select(*by, F.col("__w.start").alias("session_start"), F.col("__w.end").alias("session_end"), "samples")


def deadman_stream(points: DataFrame, keys: Sequence[str], minutes: float, late: str = "0 seconds", time: str = "time") -> DataFrame:
    """(keys, event 'silent'/'recovered', at): when a series falls silent, and when it comes back.

    Event time: a series is silent once the watermark is `minutes` past its last point; state is one timestamp a
    series. Points inside a batch are compared in time order, so gaps that open and close in one batch are told too.
    """
    limit_ms = int(minutes * 60_000)
    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys) + ", event string, at timestamp"
    columns = [*keys, "event", "at"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent = state.get if state.exists else (None, False)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((*key, "silent", pd.Timestamp(last + limit_ms, unit="ms")))
            state.update((last, True))
        else:
            stamps = sorted({int(t.value // 1_000_000) for batch in batches for t in batch[time]})
            for t in stamps:
                if last is not None and not silent and t - last > limit_ms:
                    out.append((*key, "silent", pd.Timestamp(last + limit_ms, unit="ms")))
                    silent = True
                if silent and t > last:
                    out.append((*key, "recovered", pd.Timestamp(t, unit="ms")))
                    silent = False
                last = t if last is None else max(last, t)
            state.update((last, silent))
            if not silent and last + limit_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(last + limit_ms)
            elif not silent:
                out.append((*key, "silent", pd.Timestamp(last + limit_ms, unit="ms")))
                state.update((last, True))
        yield pd.DataFrame(out, columns=columns)

    return points.withWatermark(time, late).groupBy(*keys).applyInPandasWithState(step, schema, "last bigint, silent boolean", "append", GroupStateTimeout.EventTimeTimeout)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def upsert_batches(path: str, keys: Sequence[str], day: str = "local_day", order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into a table partitioned by day, rewriting the days that it touches only.

    The merge is written beside the table first and read from there when it replaces the days: nothing is computed from files
    that are being overwritten, whatever is lost meanwhile. A table that is there but can't be read stops the batch. A batch that
    is run again merges the same rows again, which changes nothing.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{path}.staged/{number}"
        old = spark.read.parquet(path).join(batch.select(day).distinct(), day, "left_semi") if exists(spark, path) else batch.limit(0)
        upsert_points(old, batch, [*keys, day], order).write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
        remove(spark, staged)

    return work


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
