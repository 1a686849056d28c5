"""Joins of two live streams within a bounded time: rows of both sides wait in state no longer than the bound says, and what stays
without a partner is told once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import TERMINAL

Names = Sequence[str]


def _interval(d: timedelta):
    return F.expr(f"INTERVAL {d // timedelta(microseconds=1)} MICROSECONDS")  # a constant: the bound of the state is read off it


def pair_live(left: DataFrame, right: DataFrame, keys: Names, half: timedelta, late: str = "10 minutes", time: str = "time", right_time: str = "right_time") -> DataFrame:
    """As pair_within, over streams: each left row with every right row in [t - half, t + half); left rows without any come with nulls.

    A left row waits until the watermark is `half` past it, a right row as long; then both leave the state. A null key pairs with nothing.
    """
    l = left.withWatermark(time, late)
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(time).alias(right_time), *(c for c in right.columns if c not in (*keys, time))).withWatermark(right_time, late)
    on = (F.col(right_time) >= F.col(time) - _interval(half)) & (F.col(right_time) < F.col(time) + _interval(half))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return l.join(r, on, "left_outer").drop(*(f"__{k}" for k in keys))


def pair_stats_live(left: DataFrame, right: DataFrame, keys: Names, half: timedelta, value: str, late: timedelta = timedelta(minutes=10), time: str = "time") -> DataFrame:
    """As pair_live and an aggregate over its pairs, without the pairs: each left row with n and the mean (avg_<value>) of the right values in [t - half, t + half).

    Rows wait a key and window of twice the interval, which slides by the interval: a left row is told by the window in whose first half
    its interval begins, once the watermark has passed that window. There it takes a sort and two searches in running sums, however many rows pair.
    """
    unit, names = timedelta(microseconds=1), [*left.columns, "n", f"avg_{value}"]
    width = 2 * (half // unit)
    micros = lambda d: f"{d // unit} microseconds"
    own = left.select(*keys, (F.col(time) - _interval(half)).alias("__at"), F.struct(*left.columns).alias("__left")).withWatermark("__at", micros(late))
    # Rows that pair with nothing move the watermark all the same, so they go only behind it.
    other = right.select(*keys, F.col(time).alias("__at"), F.col(value).cast("double").alias("__v")).withWatermark("__at", micros(late + half))
    both = own.unionByName(other, allowMissingColumns=True).withColumn("__us", F.unix_micros("__at"))
    known = F.concat_ws("", *(F.when(F.col(k).isNull(), "-") for k in keys)) == ""
    waits = both.groupBy(*keys, F.window("__at", f"{2 * width} microseconds", f"{width} microseconds").alias("__w")).agg(
        F.collect_list(F.when(F.col("__left").isNull() & F.col("__v").isNotNull() & known, F.struct(F.col("__us").alias("at"), F.col("__v").alias("v")))).alias("rights"), F.collect_list(F.when(F.col("__left").isNotNull(), F.struct(F.col("__us").alias("at"), F.col("__left").alias("row")))).alias("lefts")
    )
    ready = waits.select(F.unix_micros("__w.start").alias("start"), "rights", "lefts").filter(F.size("lefts") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rights, lefts = batch.column("rights"), batch.column("lefts")
            flat, probes = rights.flatten(), lefts.flatten()
            at, v, ask = flat.field("at").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False), probes.field("at").to_numpy(zero_copy_only=False)
            ends, stops = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(int) for x in (rights, lefts))
            told, n, mean = [], [], []
            for i, start in enumerate(batch.column("start").to_pylist()):
                low = ask[stops[i] : stops[i + 1]]
                mine = np.flatnonzero(low < start + width)  # the others are told by the next window
                order = np.argsort(at[ends[i] : ends[i + 1]], kind="stable")
                times, found = at[ends[i] : ends[i + 1]][order], v[ends[i] : ends[i + 1]][order]
                finite = np.isfinite(found)
                middle = found[finite].mean() if finite.any() else 0.0
                sums, odd = (np.concatenate([[0], np.cumsum(x)]) for x in (np.where(finite, found - middle, 0.0), ~finite))
                a, b = np.searchsorted(times, low[mine]), np.searchsorted(times, low[mine] + width)
                with np.errstate(invalid="ignore", divide="ignore"):
                    means = (sums[b] - sums[a]) / (b - a) + middle
                for j in np.flatnonzero(odd[b] > odd[a]):
                    means[j] = found[a[j] : b[j]].mean()
                told.append(stops[i] + mine), n.append(b - a), mean.append(means)
            n = np.concatenate(n)
            rows = probes.field("row").take(pa.array(np.concatenate(told)))
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(n.astype("int64")), pa.array(np.concatenate(mean), mask=n == 0)], names=names)

    return ready.mapInArrow(run, T.StructType([*left.schema.fields, T.StructField("n", T.LongType()), T.StructField(f"avg_{value}", T.DoubleType())]))


def requests_live(commands: DataFrame, results: DataFrame, wait: timedelta, late: str = "10 minutes", time: str = "time") -> DataFrame:
    """(request_id, time, the other columns of commands, status, messages): each command with its result, once it can't change any more.

    As reflect_requests, over streams: of a command's messages within `wait` a terminal one wins, then the latest; `missing`
    without any. A command that is sent again within the bound of lateness is one command. A request is told
    when the watermark is `wait` past it, so a restart between batches neither loses nor repeats one.
    """
    others = [c for c in commands.columns if c not in ("request_id", time)]
    asked = commands.withWatermark(time, late).dropDuplicatesWithinWatermark(["request_id"])
    told = results.select(F.col("request_id").alias("__id"), F.col(time).alias("__at"), "status").withWatermark("__at", late)
    on = (F.col("request_id") == F.col("__id")) & (F.col("__at") >= F.col(time)) & (F.col("__at") <= F.col(time) + _interval(wait))
    both = asked.join(told, on, "left_outer")
    rank = F.when(F.col("__at").isNotNull(), F.struct(F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)), F.col("__at")))
    # Grouped by a window of the command's own instant, which carries the watermark on.
    best = both.groupBy("request_id", *others, F.window(time, "1 second").alias("__w")).agg(F.min(time).alias("__time"), F.max_by("status", rank).alias("status"), F.count("__at").alias("messages"))
    return best.select("request_id", F.col("__time").alias(time), *others, F.coalesce("status", F.lit("missing")).alias("status"), "messages")
