"""Streams joined with streams, and tables that readers see whole."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunledger.operators import joins as J
from sunledger.sources.snapshots import Conflict, SnapshotTable, upsert_snapshots
from sunledger.streaming import jobs as Q
from sunledger.streaming.matching import pair_live, pair_stats_live, requests_live

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(s):
    return T0 + timedelta(seconds=s)


def run(build, tables, folder, rounds):
    """Files of both streams come round by round; the query is stopped and started in between. The numbers of state rows after each."""
    spark, rows = tables[0][0].sparkSession, []
    for k in range(rounds):
        for n, (df, part) in enumerate(tables):
            df.filter(part(k)).coalesce(1).write.mode("append").parquet(f"{folder}/in{n}")
        live = [spark.readStream.schema(df.schema).parquet(f"{folder}/in{n}") for n, (df, _) in enumerate(tables)]
        q = Q.start(build(*live), f"{folder}/out", f"{folder}/state")
        q.awaitTermination()
        rows.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
    return spark.read.parquet(f"{folder}/out"), rows


def test_pairs_of_two_streams_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice(["a", "b"]), at(t), float(t)) for t in sorted(rng.sample(range(9000), 60))], "k string, time timestamp, x double")
    right = spark.createDataFrame([(rng.choice(["a", "b"]), at(t), float(t)) for t in sorted(rng.sample(range(9000), 300))], "k string, time timestamp, y double")
    end = spark.createDataFrame([("end", at(10**6), 0.0)], left.schema)
    half = timedelta(seconds=100)
    part = lambda k: (F.unix_seconds("time") >= F.lit(int(T0.timestamp()) + 3000 * k)) & (F.unix_seconds("time") < F.lit(int(T0.timestamp()) + (3000 * (k + 1) if k < 3 else 10**7)))
    found, state = run(lambda l, r: pair_live(l, r, ("k",), half, "0 seconds"), [(left.union(end), part), (right.union(end.withColumnRenamed("x", "y")), part)], str(tmp_path), 4)
    want = J.pair_within(left, right, ("k",), half)
    key = lambda r: (r["k"], str(r["time"]), r["x"], str(r["right_time"]), r["y"] or -1.0)
    assert sorted(map(key, found.filter("k <> 'end'").collect())) == sorted(map(key, want.collect()))
    assert want.filter("y IS NULL").count() > 0
    assert max(state) < 100 and state[-1] <= 2  # what the bound has passed leaves the state


def test_means_of_two_streams_equal_the_batch_job(spark, tmp_path):
    """As many rows out as readings come in, in four rounds; the state holds lists a key and window, not rows."""
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice(["a", "b"]), at(t), float(t)) for t in sorted(rng.sample(range(9000), 60))], "k string, time timestamp, x double")
    right = spark.createDataFrame([(rng.choice(["a", "b"]), at(t), float(t)) for t in sorted(rng.sample(range(9000), 300))], "k string, time timestamp, y double")
    end = spark.createDataFrame([("end", at(10**6), 0.0)], left.schema)
    half = timedelta(seconds=100)
    part = lambda k: (F.unix_seconds("time") >= F.lit(int(T0.timestamp()) + 3000 * k)) & (F.unix_seconds("time") < F.lit(int(T0.timestamp()) + (3000 * (k + 1) if k < 3 else 10**7)))
    found, state = run(lambda l, r: pair_stats_live(l, r, ("k",), half, "y", timedelta(0)), [(left.union(end), part), (right.union(end.select("k", "time", F.lit(None).cast("double"))), part)], str(tmp_path), 4)
    want = J.pair_within(left, right, ("k",), half).groupBy("k", "time", "x").agg(F.count("y").alias("n"), F.avg("y").alias("avg_y"))
    key = lambda r: (r["k"], str(r["time"]), r["x"], r["n"], round(r["avg_y"] or -1.0, 6))
    assert sorted(map(key, found.filter("k <> 'end'").collect())) == sorted(map(key, want.collect()))
    assert max(state) < 60


def test_requests_live_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(2)
    asked = [(f"r{i}", at(600 * i), f"plant-{i % 3}") for i in range(20)]
    told = [(f"r{i}", at(600 * i + d), s) for i in range(20) for d, s in rng.sample([(1, "started"), (5, "busy"), (20, "ok"), (30, "error"), (250, "timeout"), (299, "started")], rng.randint(0, 4))]
    commands, results = spark.createDataFrame(asked, "request_id string, time timestamp, plant string"), spark.createDataFrame(told, "request_id string, time timestamp, status string")
    again = commands.filter("request_id in ('r1', 'r9')").withColumn("time", F.col("time") + F.expr("INTERVAL 2 SECONDS"))  # sent twice
    end = spark.createDataFrame([("end", at(10**6), None)], commands.schema)
    low = lambda k: F.lit(int(T0.timestamp()) + 4000 * k)
    part = lambda k: (F.unix_seconds("time") >= low(k)) & ((F.unix_seconds("time") < low(k + 1)) if k < 3 else F.lit(True))
    found, state = run(lambda c, r: requests_live(c, r, timedelta(seconds=300), "30 seconds"), [(commands.union(again).union(end), part), (results.union(end.withColumnRenamed("plant", "status")), part)], str(tmp_path), 4)
    want = J.reflect_requests(commands, results)
    key = lambda r: (r["request_id"], r["plant"], r["status"], r["messages"])
    assert sorted(map(key, found.filter("request_id <> 'end'").collect())) == sorted(map(key, want.collect()))
    assert want.filter("status = 'missing'").count() > 0 and state[-1] <= 6


ROWS = "k string, local_day string, x double, y double, seq int"


def contents(table, **which):
    return sorted((r["k"], r["local_day"], r["x"], r["y"]) for r in table.read(**which).collect())


def test_readers_see_whole_commits(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    first = spark.createDataFrame([("a", "2024-01-01", 1.0, None, 1), ("b", "2024-01-02", 2.0, 5.0, 1), ("z", None, 9.0, 9.0, 1)], ROWS)
    second = spark.createDataFrame([("b", "2024-01-02", 7.0, None, 2), ("b", "2024-01-02", 3.0, 4.0, 3), ("c", "2024-01-03", 9.0, None, 1)], ROWS)
    work = upsert_snapshots(table.path, ("k",), order=("seq",))
    work(first, 0)
    before = sorted([("a", "2024-01-01", 1.0, None), ("b", "2024-01-02", 2.0, 5.0), ("z", None, 9.0, 9.0)], key=str)
    assert sorted(contents(table), key=str) == before
    for step in ("_switch", "_names"):  # the batch fails after its files are written
        with monkeypatch.context() as m:
            real = getattr(SnapshotTable, step)
            m.setattr(SnapshotTable, step, lambda self, x, real=real, step=step: (_ for _ in ()).throw(OSError("lost")) if step == "_switch" or x.startswith("data") else real(self, x))
            with pytest.raises(OSError, match="lost"):
                work(second, 1)
        assert sorted(contents(table), key=str) == before
    work(second, 1)
    after = sorted([("a", "2024-01-01", 1.0, None), ("b", "2024-01-02", 3.0, 4.0), ("c", "2024-01-03", 9.0, None), ("z", None, 9.0, 9.0)], key=str)
    assert sorted(contents(table), key=str) == after
    work(second.withColumn("x", F.lit(100.0)), 1)  # the same batch again is skipped
    work(first.withColumn("x", F.lit(100.0)), 0)
    assert sorted(contents(table), key=str) == after and table.versions() == [0, 1]
    assert sorted(contents(table, version=0), key=str) == before
    assert contents(table, days=("2024-01-02", "2024-01-03")) == [("b", "2024-01-02", 3.0, 4.0), ("c", "2024-01-03", 9.0, None)]
    assert contents(table, days=("2025-01-01", "2025-01-02")) == []
    assert len(table.read(days=("2024-01-02", "2024-01-02")).inputFiles()) == 1
    table.delete_days(["2024-01-02"])
    assert sorted(contents(table), key=str) == [r for r in after if r[1] != "2024-01-02"]
    assert table.clean(keep=1) >= 2 and table.versions() == [2]  # folders of failed batches go too
    assert sorted(contents(table), key=str) == [r for r in after if r[1] != "2024-01-02"]


def test_of_two_writers_one_goes_first(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([("a", "2024-01-01", 1.0, None, 1)], ROWS)
    base = table.snapshot()
    table.upsert(one, ("k",), writer="p", batch=4)
    with pytest.raises(Conflict):
        table.commit(one, base)
    switch, calls = SnapshotTable._switch, []

    class Late(SnapshotTable):
        def _switch(self, new):
            if not calls:  # another writer commits between this one's read and its switch
                calls.append(SnapshotTable(spark, self.path).upsert(spark.createDataFrame([("b", "2024-01-01", 2.0, None, 1)], ROWS), ("k",), writer="q", batch=0).version)
            return switch(self, new)

    Late(spark, table.path).upsert(spark.createDataFrame([("c", "2024-01-01", 3.0, None, 1)], ROWS), ("k",), writer="p", batch=5)
    assert [r[0] for r in contents(table)] == ["a", "b", "c"] and table.snapshot().batches == {"p": 5, "q": 0}
