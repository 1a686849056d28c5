"""Order-dependent operators against plain loops."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunledger.operators import days as D
from sunledger.operators import joins as J
from sunledger.operators import ranked as R
from sunledger.operators import series as S
from sunledger.operators import sets as U
from sunledger.operators.ordered import dedup_ttl, in_pauses
from sunledger.plans import monitor as M
from sunledger.plans import weights as P
from sunledger.sources import annotated_csv, line_protocol, messages

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def seconds(t):
    return int((t.replace(tzinfo=UTC) - T0).total_seconds()) if t is not None else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=40, unique=True))
def test_dedup_ttl_equals_the_loop(spark, rows):
    df = spark.createDataFrame([(f"d{k}", at(s)) for k, s in rows], "device string, recv_ts timestamp")
    got = sorted((r["device"], seconds(r["recv_ts"])) for r in dedup_ttl(df, ("device",)).collect())
    want, last = [], {}
    for k, s in sorted(rows, key=lambda x: (x[0], x[1])):
        if k not in last or s - last[k] > 60:
            last[k] = s
            want.append((f"d{k}", s))
    assert got == sorted(want)


def test_long_islands_go_on_over_batches(spark):
    rows = [(f"d{k}", at(25 * i + k)) for k in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "device string, recv_ts timestamp")
    want, before = sorted((f"d{k}", 75 * i + k) for k in range(3) for i in range(134)), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted((r["device"], seconds(r["recv_ts"])) for r in dedup_ttl(df, ("device",)).collect()) == want


def test_asof_equals_the_loop(spark):
    rng = random.Random(3)
    left = [(f"k{rng.randrange(3)}", rng.randrange(0, 400_000), i) for i in range(200)]
    right = [(k, s, i) for i, (k, s) in enumerate({(f"k{rng.randrange(4)}", rng.randrange(0, 400_000)) for _ in range(60)})]
    l = spark.createDataFrame([(k, at(s), i) for k, s, i in left], "key string, time timestamp, id int")
    r = spark.createDataFrame([(k, at(s), i) for k, s, i in right], "key string, time timestamp, v int")
    for strict, limit in ((False, None), (True, timedelta(days=1))):
        got = {x["id"]: x["v"] for x in J.asof_join(l, r, ("key",), ("v",), limit, strict).collect()}
        for k, s, i in left:
            fit = [(t, v) for kk, t, v in right if kk == k and (t < s if strict else t <= s) and (limit is None or s - t <= limit.total_seconds())]
            assert got[i] == (max(fit)[1] if fit else None)


def test_pairs_equal_the_loop(spark):
    rng = random.Random(4)
    left, right = [(f"k{rng.randrange(2)}", rng.randrange(5000)) for _ in range(50)], [(f"k{rng.randrange(3)}", rng.randrange(5000), float(i)) for i in range(200)]
    left = list(dict.fromkeys(left)) + [("alone", 7)]
    l = spark.createDataFrame([(k, at(s)) for k, s in left], "device string, time timestamp")
    r = spark.createDataFrame([(k, at(s), v) for k, s, v in right], "device string, time timestamp, v double")
    got = sorted((x["device"], seconds(x["time"]), x["v"] if x["v"] is not None else -1) for x in J.pair_within(l, r, ("device",), timedelta(minutes=2)).collect())
    want = []
    for k, s in left:
        hits = [v for kk, t, v in right if kk == k and s - 120 <= t < s + 120]
        want += [(k, s, v) for v in hits] or [(k, s, -1)]
    assert got == sorted(want)


def test_state_held_fails_closed(spark):
    states = spark.createDataFrame([("a", at(0), 0.0), ("b", at(0), 1.0), ("d", at(0), 0.0), ("d", at(150), 1.0), ("e", at(0), 1.0), ("e", at(50), 0.0), ("f", at(0), 0.0), ("f", at(200), 1.0)], "loc string, time timestamp, on double")
    windows = spark.createDataFrame([(k, at(100), at(200)) for k in "abcdef"], "loc string, start timestamp, stop timestamp")
    got = {r["loc"]: r["held"] for r in J.state_held(windows, states, ("loc",), "on", 0.0).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": True}


@pytest.mark.parametrize("n", [20, 23, 57, 100])
def test_bins_equal_slices(spark, n):
    df = spark.createDataFrame([("k", i) for i in range(n)], "k string, i int")
    bins = {r["i"]: r["bin"] for r in R.equal_bins(df, ("k",), ("i",)).collect()}
    assert all(bins[i] == b for b in range(5) for i in range(b * n // 5, (b + 1) * n // 5))


def test_integral_stays_inside_the_day(spark):
    df = spark.createDataFrame([("d", datetime(2024, 1, 1, 15, 59, 0), 10.0), ("d", datetime(2024, 1, 1, 16, 1, 0), 10.0), ("d", datetime(2024, 1, 1, 16, 2, 0), 20.0), ("d", datetime(2024, 1, 1, 16, 5, 0), None)], "device string, time timestamp, value double")
    got = {str(r["local_day"]): r["value"] for r in S.integral(df, ("device",)).collect()}
    assert got == {"2024-01-01": 0.0, "2024-01-02": 900.0}
    assert S.integral(df, ("device",), max_gap_s=30).filter("value > 0").count() == 0


def test_counter_restart_is_no_decrease(spark):
    df = spark.createDataFrame([("a", at(i), float(v)) for i, v in enumerate((5, 7, 1, 4))], "integration string, time timestamp, counter double")
    assert S.counter_increase(df, ("integration",), ("integration",), T0, at(100)).first()["increase"] == 5.0


def test_create_empty(spark):
    df = spark.createDataFrame([("d", at(30), 1.0)], "device string, time timestamp, value double")
    got = S.aggregate_window(df, "1m", "count", ("device",), create_empty=True, start=T0, stop=at(180)).orderBy("window_start").collect()
    assert [r["value"] for r in got] == [1, 0, 0]


def test_reject_order(spark):
    from sunledger.config import CHANNELS

    def row(lux, level):
        return (lux, *(level,) * 8)

    df = spark.createDataFrame([row(None, 1.0), row(50000.0, 65535.0), row(50000.0, 1.0), row(1.0, 1.0), row(3000.0, 0.0), row(3000.0, 5.0)], "lux double, " + ", ".join(f"{c} double" for c in CHANNELS))
    assert [r["reason"] for r in S.classify_minutes(df, 300, 45000).collect()] == list(S.REASONS)


def test_spectrum_silence_fires_when_stated(spark):
    seen = spark.createDataFrame([("d", "ambient", datetime(2026, 8, 9, 15, 44, 48), 5.0)], "device string, mode string, time timestamp, clear double")
    for now, age, state in ((datetime(2026, 8, 9, 15, 50, tzinfo=UTC), 5.2, "Normal"), (datetime(2026, 8, 9, 16, 30, tzinfo=UTC), 45.2, "Alerting")):
        row = M.deadman_spectrum(seen, now).first()
        assert round(row["age_min"], 1) == age and row["state"] == state
    assert M.deadman_feed(seen.limit(0), AS).first()["state"] == "NoData"


AS = datetime(2026, 8, 9, tzinfo=UTC)


def test_alert_life_cycle(spark):
    df = spark.createDataFrame([("r", at(60 * i), c) for i, c in enumerate((False, True, True, True, False, False, True, None))], "rule string, time timestamp, firing boolean")
    assert [r["state"] for r in M.alert_states(df, ("rule",), 120).orderBy("time").collect()] == ["Normal", "Pending", "Pending", "Firing", "Resolved", "Normal", "Pending", "Normal"]


def test_two_copies_two_acks_one_weight(spark):
    raw = spark.createDataFrame([("st", '{"event_id":1,"uid":"00A8635C","weight_g":334.8}', at(0)), ("st", '{"event_id":1,"uid":"00A8635C","weight_g":334.8}', at(3)), ("st", '{"event_id":"1","uid":"00A8635C","weight_g":334.8}', at(4)), ("st", "no json", at(5))], "device string, payload string, recv_ts timestamp")
    good, bad = messages.validate_events(raw)
    weights, acks = P.ingest_weights(good, spark.createDataFrame([("00A8635C", "cactus-1")], "uid string, plant_id string"))
    assert acks.count() == 2 and bad.count() == 2
    assert [(r["plant_id"], r["quality"], r["weight_g"]) for r in weights.collect()] == [("cactus-1", "ok", 334.8)]


def test_nothing_expected_is_refused(spark):
    topics = spark.createDataFrame([("a",), ("b",)], "topic string")
    assert [r["topic"] for r in U.stale_refs(topics, topics.filter("topic = 'a'")).collect()] == ["b"]
    with pytest.raises(ValueError):
        U.stale_refs(topics, topics.limit(0))


def test_lines_round_trip(spark):
    df = spark.createDataFrame([('a b,c="d"', 'say "hi", x=1', 1.5, at(7))], "device string, note string, v double, time timestamp")
    for precision in ("s", "ns"):
        back = line_protocol.from_line_protocol(line_protocol.to_line_protocol(df, "m", ("device",), ("v",), ("note",), precision), precision).collect()
        assert {(r["field"], r["value"], r["value_str"]) for r in back} == {("v", 1.5, None), ("note", None, 'say "hi", x=1')}
        assert all(r["tags"] == {"device": 'a b,c="d"'} and seconds(r["time"]) == 7 for r in back)


def test_long_lines_do_not_overflow(spark):
    df = spark.createDataFrame([("d,\\ " * 3000, 'q"\\ ' * 20000, at(1))], "device string, note string, time timestamp")
    back = line_protocol.from_line_protocol(line_protocol.to_line_protocol(df, "m", ("device",), (), ("note",))).collect()
    assert [(r["tags"]["device"], r["value_str"]) for r in back] == [("d,\\ " * 3000, 'q"\\ ' * 20000)]


def test_csv_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#group\n#datatype\n,result,table,_value,x\n,_r,0,1,a\n,_r,0,2,b\n\n#group\n,result,table,_value,y,empty\n,_r,0,3,c,\n")
    got = annotated_csv.read_annotated_csv(spark, str(tmp_path)).drop("path").orderBy("row")
    assert set(got.columns) == {"row", "_value", "x", "y"}
    assert [(r["_value"], r["x"], r["y"]) for r in got.collect()] == [("1", "a", None), ("2", "b", None), ("3", None, "c")]


def test_stable_weigh(spark):
    samples = [("st", T0 + timedelta(milliseconds=100 * i), 500.0 + (5.0 * (i % 2) if i < 30 else 0.1 * (i % 2))) for i in range(120)]
    df = spark.createDataFrame(samples, "device string, time timestamp, grams double")
    taps = spark.createDataFrame([("st", T0, "uid"), ("st", T0 + timedelta(seconds=300), "late")], "device string, time timestamp, uid string")
    got = {r["uid"]: (r["result"], r["time"]) for r in P.stable_weighs(df, taps).collect()}
    assert got["late"] == ("UNSTABLE", None) and got["uid"][0] == "MEASURED"
    # 24 samples after the wobble ends, and held for 1.5 s more.
    assert (got["uid"][1].replace(tzinfo=UTC) - T0).total_seconds() == pytest.approx(5.3 + 1.5, abs=0.11)


def test_rank_quantiles_equal_the_sorted_list(spark):
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1000) for _ in range(3000)], "b": [1.5], "c": [7.0] * 900 + [8.0] * 100, None: [-0.5, 0.0, 2e-300, math.inf, -math.inf], "d": [20 + rng.randint(0, 9) / 1e5 for _ in range(500)], "e": []}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "device string, lux double")
    qs = {"low": 0.0, "p10": 0.1, "half": 0.5, "p90": 0.9, "high": 1.0}
    out = S.rank_quantiles(df, ("device",), "lux", qs)
    got = {r["device"]: [r[n] for n in qs] for r in out.collect()}
    assert got == {k: [sorted(vs)[math.floor(q * (len(vs) - 1))] if vs else None for q in qs.values()] for k, vs in groups.items()}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_csv_cells_are_bounded(spark):
    from sunledger.registry import ingest

    air = spark.range(5000).selectExpr("id AS event_id", "IF(id % 3 = 0, 'dev-1', concat('dev-', id % 5)) AS device", "CAST(id % 100 AS double) AS lux", "CAST(-40 AS double) AS rssi")
    files = ingest._csv_files(air, 100).cache()
    assert files.count() == files.select("path").distinct().count() >= 40
    assert files.agg(F.max(F.length("value"))).first()[0] < 200 * 25
    assert annotated_csv.cells(files).filter("column = 'lux'").count() == 5000


def test_dedup_of_every_device_equals_the_loop(spark):
    from types import SimpleNamespace

    from sunledger.registry import site

    rng = random.Random(6)
    raw = sorted({(f"st-{d}", i, "u", 1.0, rng.randrange(2000)) for d in range(1, 5) for i in range(9) for _ in range(4)})
    t = SimpleNamespace(event_raw=spark.createDataFrame([(*r[:4], at(r[4])) for r in raw], "device string, event_id long, uid string, weight_g double, recv_ts timestamp"))
    want, last = [], {}
    for d, i, s in sorted({(d, i, s + 25 * k) for d, i, _, _, s in raw for k in range(i % 4 * 3 + 1)}):
        if (d, i) not in last or s - last[d, i] > 60:
            last[d, i] = s
            want.append((d, i, s))
    assert sorted((r["device"], r["event_id"], seconds(r["recv_ts"])) for r in site._dedup_all(t).collect()) == want


def test_controller_at_every_location_equals_the_loop(spark):
    from bisect import bisect_right
    from types import SimpleNamespace

    from sunledger.registry import site

    rng = random.Random(8)
    events = [(i, i % 4, rng.randrange(1000, 46_000)) for i in range(40)]
    air = {f"loc-{p}": [(s, rng.uniform(0, top)) for s in range(p, 46_000, 50) if not 20_000 < s < 21_000] for p, top in ((0, 20_000), (1, 8_000), (5, 16_000))}
    t = SimpleNamespace(
        events=spark.createDataFrame([(i, u, at(s)) for i, u, s in events], "event_id long, user_id long, time timestamp"),
        air=spark.createDataFrame([(p, at(s), v) for p, rows in air.items() for s, v in rows], "location string, time timestamp, lux double"),
    )
    want, states, withheld = [], [], 0
    for place in ("loc-0", "loc-1", "loc-2", "loc-3", "loc-5"):
        readings = air.get(place, [])
        times, dli = [s for s, _ in readings], []
        for k, (s, v) in enumerate(readings):  # all readings lie in one local day
            dli.append(dli[-1] + (v + readings[k - 1][1]) / 108 * (s - readings[k - 1][0]) / 1e6 if k else 0.0)
        rows = [(s, 0, i % 3 == 0) for i, u, s in events if f"loc-{u}" == place and i % 7]
        rows += [(s, 1, None) for s in range(0, 86_400, 60)] if readings else []
        on, simple, manual, switched, extend, day = False, "OFF", -1e18, -1e18, False, None
        for s, kind, command in sorted(rows):
            if kind == 0:
                manual = s + 300
                if command != on:
                    on = command
                    want.append((place, s, "ON" if on else "OFF", "manual"))
                continue
            k = bisect_right(times, s) - 1
            minute, today = (s // 60 + 480) % 1440, s >= 57_600
            blind = k < 0 or s - times[k] > 300
            lux = None if blind else readings[k][1]
            forced = "OFF" if not 480 <= minute < 1110 else "ON" if blind or lux < 5000 else "OFF" if lux > 15_000 else None
            simple = forced or simple
            states.append((place, s, simple))
            if today != day:
                extend, day = False, today
            if 1110 <= minute < 1230 and k >= 0 and not today:
                extend = dli[k] < 4
            wish = 480 <= minute < (1230 if extend else 1110) and (blind or lux < 5000 or on and lux <= 15_000)
            if s < manual or s - switched < 300:
                withheld += wish != on and s >= manual
            elif wish != on:
                on, switched = wish, s
                want.append((place, s, "ON" if on else "OFF", "auto"))
    got = sorted((r["location"], seconds(r["time"]), r["state"], r["source"]) for r in site._replay_all(t).collect())
    assert withheld > 10 and got == sorted(want)
    assert sorted((r["location"], seconds(r["time"]), r["state"]) for r in site._hysteresis_all(t).collect()) == states


def test_windows_over_days_equal_the_loop(spark):
    """Neighbours, carried values and parts: over empty days, days of one row, null keys, rows without time."""
    rng = random.Random(9)
    rows = sorted({(rng.choice(["a", "b", None]), rng.choice([0, 1, 2, 9, 30]) * 86_400 + rng.randrange(86_400)) for _ in range(90)} | {("c", 5)}, key=str)
    rows = [(k, s, rng.choice([None, 1.0, 2.0]), float(i)) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame([(k, at(s), v, x) for k, s, v, x in rows], "device string, time timestamp, v double, grams double").repartition(3)
    found = D.with_neighbours(df, ("device",), ("grams",), before="b", after="a")
    found = D.carried(D.carried(found, ("device",), F.col("v"), "last"), ("device",), F.col("v"), "next", forward=False)
    got = {r["grams"]: (r["b"] and r["b"][0], r["a"] and r["a"][0], r["last"], r["next"]) for r in found.collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", "c", None):
        own = sorted((s, v, x) for kk, s, v, x in rows if kk == k)
        for i, (_, v, x) in enumerate(own):
            past, coming = [q[1] for q in own[: i + 1] if q[1] is not None], [q[1] for q in own[i + 1 :] if q[1] is not None]
            assert got[x] == (own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None, past[-1] if past else None, coming[0] if coming else None)
    for n in (2, 5):
        parts, names = D.in_parts(df, ("device",), n - 1, rows=7)
        assert parts.groupBy(*names).count().agg(F.max("count")).first()[0] <= 7 + n - 1
        sums = {r["grams"]: r["s"] for r in D.without_parts(parts.withColumn("s", F.sum("grams").over(D.W.partitionBy(*names).orderBy("time").rowsBetween(1 - n, 0)))).collect()}
        assert len(sums) == len(rows)
        for k in ("a", "b", "c", None):
            own = [x for _, x in sorted((s, x) for kk, s, _, x in rows if kk == k)]
            assert all(sums[x] == sum(own[max(0, i + 1 - n) : i + 1]) for i, x in enumerate(own))


def test_neighbours_put_the_rows_in_order_once(spark):
    """In tasks that aren't merged, and under a merge join in the order that the join has too."""
    df = spark.range(400).select((F.col("id") % 3).alias("device"), F.timestamp_seconds(F.col("id") * 7_000).alias("time"), F.col("id").alias("grams"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = D.with_neighbours(df, ("device",), ("grams",), before="b", after="a")
        assert {r["grams"]: (r["b"] and r["b"][0], r["a"] and r["a"][0]) for r in found.collect()} == {i: (i - 3 if i > 2 else None, i + 3 if i < 397 else None) for i in range(400)}
        assert found.rdd.getNumPartitions() == D.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[-1].split("Exchange")[0]
        assert rows.count("Sort [") == 1 and "Window" in rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_window_holds_a_whole_history(spark):
    """Windows over rows have the day or the part among their keys; those without are over one row a day."""
    import re

    df = spark.createDataFrame([("a", at(1), 1.0, True, 1.0)], "device string, time timestamp, value double, firing boolean, counter double").withColumn("integration", F.col("device"))
    frames = [
        S.difference(df, ("device",)), S.silent_gaps(df, ("device",), 1, at(9)), S.rolling_stats(df, ("device",), 24, "value"), S.state_changes(df, ("device",), "value"), S.state_intervals(df, ("device",), "value"),
        S.baseline_drift(df, ("device",), "value"), M.alert_states(df, ("device",), 5), M.failing_hours(df), dedup_ttl(df, ("device",), time="time"),
        J.state_held(df.withColumns({"start": F.col("time"), "stop": F.col("time")}), df, ("device",), "value", 1.0),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
        assert windows and all("__day" in keys or "__part" in keys or "__day" in order for keys, order in windows), plan


def test_no_frame_shrinks_from_row_to_row(spark):
    """A frame that ends with the key is read anew for every row: time in the square of a key's rows."""
    df = spark.createDataFrame([("a", at(1), 1.0)], "device string, time timestamp, value double")
    frames = [D.carried(df, ("device",), F.col("value"), "next", forward=False), J.state_held(df.withColumns({"start": F.col("time"), "stop": F.col("time")}), df, ("device",), "value", 1.0)]
    assert not any("unboundedfollowing" in f._jdf.queryExecution().optimizedPlan().toString().lower() for f in frames)


def test_pair_stats_equal_the_loop(spark):
    """Copies of left rows count, borders are half-open, null keys pair with nothing; no step has a row a pair."""
    rng = random.Random(14)
    left = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(3000), 240 * rng.randrange(9)]), float(i % 4)) for i in range(60)]
    left += left[:7] + [("alone", 7, 0.0)]
    right = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(3000), 120 * rng.randrange(20)]), rng.choice([None, 1e6 + rng.random()])) for _ in range(300)]
    l = spark.createDataFrame([(k, at(s), x) for k, s, x in left], "device string, time timestamp, x double")
    r = spark.createDataFrame([(k, at(s), v) for k, s, v in right], "device string, time timestamp, v double")
    found = J.pair_stats(l, r, ("device",), timedelta(minutes=2), ("v",), ("v",))
    got = {(x["device"], seconds(x["time"]), x["x"]): (x["n_v"], x["avg_v"], x["dev_v"]) for x in found.collect()}
    assert set(got) == set(left)
    for k, s, x in set(left):
        hits = [v for kk, t, v in right if v is not None and k is not None and kk == k and s - 120 <= t < s + 120]
        n, mean, dev = got[k, s, x]
        assert n == len(hits) * left.count((k, s, x))
        assert (mean, dev) == (None, None) if not hits else (mean == pytest.approx(sum(hits) / len(hits), abs=1e-8) and dev == pytest.approx((sum((h - sum(hits) / len(hits)) ** 2 for h in hits) / len(hits)) ** 0.5, abs=1e-8))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_dedup_ttl_deals_rows_once(spark):
    """Over midnights, days without a pause, repeats of one instant, null keys and rows without time; only what hangs on the day before is dealt again."""
    rng = random.Random(15)
    rows = [(k, s) for k in ("a", None) for s in [*(86_400 * d + rng.randrange(-400, 400) for d in range(1, 4) for _ in range(25)), *range(5 * 86_400 - 90, 6 * 86_400 + 90, 45), *(rng.randrange(700_000) for _ in range(40))]]
    df = spark.createDataFrame([(k, at(s)) for k, s in [*rows, *rows[::3]]] + [("a", None), ("a", None)], "device string, recv_ts timestamp").repartition(3)
    want, last = [("a", None)], {}
    for k, s in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        if k not in last or s - last[k] > 60:
            last[k] = s
            want.append((k, s))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = dedup_ttl(df, ("device",))
        assert sorted(((r["device"], seconds(r["recv_ts"])) for r in found.collect()), key=str) == sorted(want, key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") >= 2


def kept_of(rows, ttl):
    """(key, second, tie) of what a loop keeps; of one instant the least tie."""
    want, last = [], {}
    for k, s, tie in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2])):
        if k not in last or s - last[k] > ttl:
            last[k] = s
            want.append((k, s, tie))
    return sorted(want, key=str)


def test_repeats_are_made_in_the_scan(spark):
    """Rows that stand for their repeats, over batches and midnights, equal the repeats as rows; ties between repeats of different rows go to the least."""
    rng = random.Random(4)
    sent = [(k, rng.randrange(-900, 900) + 86_400 * rng.randrange(4), rng.choice([None, "p", "q", "r"]), [25 * i + 3 * j for i in range(rng.choice([1, 4, 10])) for j in range(rng.choice([1, 3]))]) for k in ("a", "b", None) for _ in range(300)]
    df = spark.createDataFrame([(k, at(s), u, [1000 * x for x in more]) for k, s, u, more in sent] + [("a", None, "z", [0, 9000]), ("b", at(0), "none", [])], "device string, recv_ts timestamp, uid string, more array<int>").repartition(3)
    want = kept_of([(k, s + x, u) for k, s, u, more in sent for x in more], 60)
    for size in ("7", "10000"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for days in (1, 64):
            found = dedup_ttl(df, ("device",), ties=("uid",), days=days, again=F.col("more")).collect()
            assert [(r["device"], r["uid"]) for r in found if r["recv_ts"] is None] == [("a", "z")]
            assert sorted(((r["device"], seconds(r["recv_ts"]), r["uid"]) for r in found if r["recv_ts"] is not None), key=str) == want
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_lifetime_of_days_over_years(spark):
    """An island longer than a year, and a lifetime longer than the stretch by which rows are dealt."""
    rows = [(k, 60_000 * i + 7 * k, None) for k in range(3) for i in range(900)]
    df = spark.createDataFrame([(k, at(s)) for k, s, _ in rows], "device int, recv_ts timestamp")
    for ttl in (86_400, 3 * 86_400):
        found = dedup_ttl(df, ("device",), ttl_ms=1000 * ttl).collect()
        assert sorted(((r["device"], seconds(r["recv_ts"]), None) for r in found), key=str) == kept_of(rows, ttl)


def test_dedup_ttl_reads_its_rows_once(spark):
    """The pauses are found on times alone, and one scan of the rows follows; no row of a burst is dealt."""
    from sunledger import registry

    plan = registry.QUERIES["t02_dedup_ttl"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    scans = [x for x in plan.splitlines() if "MapInArrow" in x or "MapInPandas" in x]
    assert len(scans) == 2 and sum("weight_g" in x for x in scans) == 1
    assert plan.index("__again") < plan.index("RepartitionByExpression")


def test_pieces_begin_at_pauses(spark):
    """A key of many days is many pieces; days without a pause go on with the one before."""
    rng = random.Random(9)
    rows = [("a", 86_400 * d + rng.randrange(86_400)) for d in range(20) for _ in range(30)] + [("b", s) for s in range(0, 5 * 86_400, 50)] + [("c", 86_400 * d + s) for d in (1, 2, 9) for s in (-30, 20, 70, 5000)]
    df = spark.createDataFrame([(k, at(s)) for k, s in rows], "device string, recv_ts timestamp")
    found = {}
    for r in in_pauses(df, ("device",), 60_000_000, "recv_ts", 1).collect():
        found.setdefault(r["device"], {}).setdefault(r["__from"], []).append(seconds(r["recv_ts"]))
    assert len(found["a"]) == 20 and len(found["b"]) == 1 and len(found["c"]) == 5
    for pieces in found.values():
        spans = sorted((min(p), max(p)) for p in pieces.values())
        assert all(b[0] - a[1] > 60 for a, b in zip(spans, spans[1:]))


def test_events_are_counted_before_tags_are_resolved(spark):
    """The join and the sort for the least tag get a row a device and tag."""
    from sunledger import registry

    plan = registry.QUERIES["j02_resolve_plant"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert below.index("Aggregate [device") < below.index("Generate")
