"""The lamp controller: replay by stretches against one sequence, and live against the replay."""

import random
import tracemalloc
from dataclasses import replace
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunledger.config import SITE
from sunledger.operators.ordered import Lamp, in_stretches, night_cut, replay_light
from sunledger.plans import control as C
from sunledger.streaming import jobs as Q
from sunledger.streaming.control import CMDS, DAY_US, PART_US, ROW, TOGETHER, ControlLamp, LiveLamp, control_live

T0 = datetime(2024, 3, 28, tzinfo=UTC)
ROWS = "location string, time timestamp, kind string, lux double, lux_age_s double, minute int, local_day date, dli double, cmd string"


def prepared(seed, site, days=7, step=60, gaps=True):
    """Ticks and commands of two places: dense commands on some nights, none on others, hours without ticks."""
    rng, zone, out = random.Random(seed), ZoneInfo(site.tz), []
    for place in ("x", None):
        for day in range(days):
            dark = rng.random() < 0.3
            missing = (rng.randint(0, 1000), rng.randint(1000, 1440)) if gaps and rng.random() < 0.4 else (0, 0)
            busy = rng.choice([0, 4, 60, 700])
            for m in range(0, 1440, step // 60):
                t = T0 + timedelta(days=day, minutes=m)
                here = t.astimezone(zone)
                if not missing[0] <= m < missing[1]:
                    out.append((place, t, "tick", rng.choice([None, 1000.0, 9000.0, 20000.0]), rng.choice([10.0, 400.0]), here.hour * 60 + here.minute, here.date(), 3.0 if dark else 5.0, None))
            for s in rng.sample(range(86400), busy):
                out.append((place, T0 + timedelta(days=day, seconds=s, milliseconds=500), "cmd", None, None, None, None, None, rng.choice(["ON", "OFF"])))
    return out


def one_sequence(rows, site):
    out = []
    for place in {r[0] for r in rows}:
        frame = pd.DataFrame(sorted((r for r in rows if r[0] == place), key=lambda r: (r[1], r[2])), columns=[c.split()[0] for c in ROWS.split(", ")])
        frame["time"] = frame["time"].dt.tz_localize(None) if frame["time"].dt.tz is None else frame["time"].dt.tz_convert("UTC").dt.tz_localize(None)
        out += [(str(place), t.to_pydatetime(), state, source) for t, state, source in Lamp(site).feed(frame)]
    return sorted(out)


@pytest.mark.parametrize("site", [SITE, replace(SITE, tz="Europe/Berlin"), replace(SITE, extend_end=1435), replace(SITE, lamp_start=0, lamp_end=1300, extend_end=1300), replace(SITE, manual_hold_s=60, min_hold_s=600), replace(SITE, tz="America/New_York", manual_hold_s=3600)])
def test_stretches_equal_one_sequence(spark, site):
    for seed, step in ((1, 60), (2, 60), (3, 600)):
        rows = prepared(seed, site, step=step)
        got = sorted((str(r["location"]), r["time"], r["state"], r["source"]) for r in replay_light(spark.createDataFrame(rows, ROWS), site).collect())
        assert got == one_sequence(rows, site)


def test_a_location_of_many_days_is_many_tasks(spark):
    rows = spark.createDataFrame([r for r in prepared(4, SITE, days=9, gaps=False) if r[0]], ROWS)
    parts = in_stretches(rows).groupBy("location", "__from").agg(F.count(F.lit(1)).alias("n"), F.count_if("__warm").alias("warm")).collect()
    assert len(parts) == 10 and max(r["n"] for r in parts) < 3000  # cut at 02:21 local, so ten pieces
    assert all(r["warm"] > 0 for r in parts if r["__from"] is not None)
    assert night_cut(SITE, 1800) == 141 + 9


def raw(seed, days=3):
    rng, out = random.Random(seed), []
    for place in ("x", "y"):
        for s in sorted(rng.sample(range(0, 86400 * days), 900)):
            t = T0 + timedelta(seconds=s, microseconds=rng.randint(0, 999_999))
            lux = rng.choice([None, 500.0, 3000.0, 9000.0, 30000.0, 200000.0])
            out.append((place, t, lux, rng.choice([None, None, "on", "OFF", "dim"]), rng.random() < 0.1))
    return sorted(out, key=lambda r: r[1])


SCHEMA = "location string, time timestamp, lux double, state string, retained boolean"


def test_live_equals_the_replay_over_batches_and_restarts(spark, tmp_path):
    """Six files, two runs of the query: rows late within the bound, holds and light sums across batches and the restart."""
    rows, late = raw(5), "20 minutes"
    rng = random.Random(6)
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 1100)))  # out of order, by less than the bound
    end = T0 + timedelta(days=3) + timedelta(minutes=20) - timedelta(seconds=1)
    size = -(-len(arrival) // 6)
    batches = [arrival[i : i + size] for i in range(0, len(arrival), size)] + [[("end", end, None, None, True)]]
    runs = []
    for k, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (2, 6):
            live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = Q.start_typed(control_live(live, late=late), str(tmp_path / "out"), str(tmp_path / "state"))
            q.awaitTermination()
            runs.append(q.lastProgress["batchId"])
    assert runs[0] >= 2 and runs[1] >= runs[0] + 4
    found = spark.read.parquet(str(tmp_path / "out")).filter("location <> 'end'")
    got = sorted((r["location"], r["time"], r["state"], r["source"]) for r in found.collect())
    df = spark.createDataFrame(rows, SCHEMA)
    ticks = df.select("location").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(3 * 1440 - 1)))).select("location", (F.lit(T0) + F.make_dt_interval(mins=F.col("m"))).alias("time"))
    want = sorted((r["location"], r["time"], r["state"], r["source"]) for r in C.replay(ticks, df, df).collect())
    assert len(want) > 100 and got == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != Q.ROCKSDB


def test_live_tells_a_switch_before_the_next_tick_is_due(spark, tmp_path):
    """The stream ends between a command and the tick after it: the watermark has passed the command, so it is told."""
    at = T0 + timedelta(hours=1, seconds=10)
    batches = [[("x", T0 + timedelta(minutes=m), 500.0, None, False)] for m in (0, 10, 20)] + [[("x", at, None, "on", False)], [("x", at + timedelta(seconds=20), None, "off", False)], [("end", at + timedelta(seconds=30), 0.0, None, True)]]
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    Q.start_typed(control_live(live, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    manual = spark.read.parquet(str(tmp_path / "out")).filter("source = 'manual'").orderBy("time").collect()
    assert [(r["time"] - at.replace(tzinfo=None), r["state"]) for r in manual][-1] == (timedelta(seconds=20), "OFF")


def test_state_goes_through_its_columns():
    """Kept and restored at any point, the controller goes on alike."""
    rows = sorted((int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)), 0 if lux is not None else 1, lux or 0.0, "" if lux is not None else "ON") for p, t, lux, s, r in raw(7) if p == "x")
    upto = rows[-1][0]
    whole = list(LiveLamp(SITE).advance(rows, upto))
    for cut in (10, 333, 700):
        lamp, at = LiveLamp(SITE), rows[cut][0]
        first = list(lamp.advance(rows[: cut + 1], at))
        assert first + list(LiveLamp(SITE, lamp.kept()).advance(rows[cut + 1 :], upto)) == whole
    assert list(LiveLamp(SITE).advance([], upto)) == []


class Store(dict):
    """A location's state in memory, for values, lists and maps; knows the largest piece that was ever put at once."""

    most = 0
    getValue, removeKey = dict.get, dict.pop

    def exists(self):
        return bool(self)

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value

    def updateValue(self, key, value):
        Store.most = max(Store.most, len(value[0]))
        self[key] = value

    def appendList(self, values):
        Store.most = max(Store.most, 25 * len(values))
        self.setdefault(None, []).extend(values)


class Handle:
    """What the controller asks of Spark."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Store())

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)


def test_rows_of_a_large_batch_wait_by_parts():
    """A batch of 300,000 rows in any order: state takes and gives ten minutes' rows at a time, memory follows those, and the switches are those of one walk."""
    days, n = 30, 300_000
    rng = random.Random(11)
    begin = int(T0.timestamp()) * 1_000_000
    rows = [(begin + rng.randrange(days * 86_400) * 1_000_000, *((0, rng.choice([500.0, 9000.0, 30000.0]), 0) if rng.random() < 0.5 else (1, 0.0, rng.choice([1, 2])))) for _ in range(n)]
    batches = [pd.DataFrame(rows[i : i + 10_000], columns=["at", "kind", "lux", "cmd"]) for i in range(0, n, 10_000)]
    upto = begin + days * DAY_US - 90_000_000
    want = list(LiveLamp(SITE).advance(sorted((a, k, x, CMDS[c]) for a, k, x, c in rows if a <= upto), upto))
    lamp, clock = ControlLamp(SITE, ["location", "time", "state", "source"]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    lamp.init(handle := Handle())
    del rows
    Store.most = 0
    tracemalloc.start()
    assert sum(map(len, lamp.handleInputRows(("x",), iter(batches), clock))) == 0
    assert tracemalloc.get_traced_memory()[1] < 20_000_000 + n * ROW.itemsize
    assert handle.timers and Store.most < 10_000
    tracemalloc.reset_peak()
    held, found = tracemalloc.get_traced_memory()[0], 0
    clock.getCurrentWatermarkInMs = lambda: upto // 1000
    for frame in lamp.handleExpiredTimer(("x",), clock, None):
        part = list(zip(frame["time"].astype("datetime64[us]").astype("int64"), frame["state"], frame["source"]))
        assert part == want[found : found + len(part)] and len(part) <= TOGETHER
        found += len(part)
    assert found == len(want) > TOGETHER
    assert tracemalloc.get_traced_memory()[1] < held + 40_000_000
    tracemalloc.stop()
    left = handle.states["packed"]
    assert sum(len(v[0]) for v in left.values()) < 200 * ROW.itemsize and all(k[0] * PART_US > upto - PART_US for k in left)


def test_rows_that_waited_in_a_list_are_taken_over():
    """A checkpoint made before rows were packed."""
    lamp, clock = ControlLamp(SITE, ["location", "time", "state", "source"]), SimpleNamespace(getCurrentWatermarkInMs=lambda: int(T0.timestamp()) * 1000 + 90_000)
    lamp.init(handle := Handle())
    begin = int(T0.timestamp()) * 1_000_000
    handle.states["waiting"].appendList([(begin + 70_000_000, 1, 0.0, "OFF"), (begin + 60_000_000, 1, 0.0, "ON"), (begin + 5_000_000_000, 1, 0.0, "ON")])
    frame = pd.concat(list(lamp.handleExpiredTimer(("x",), clock, None)))
    assert frame[["state", "source"]].values.tolist() == [["ON", "auto"], ["OFF", "manual"]]
    assert not handle.states["waiting"] and len(handle.states["packed"]) == 1
