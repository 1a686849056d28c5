"""Reading and writing: files, streams of files, partitioned tables, pruning."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunledger.operators import series as S
from sunledger.sources import adapters
from sunledger.sources import messages as I
from sunledger.sources import tables as B
from sunledger.streaming import jobs as Q

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    lines = [
        '{"topic":"site/sensor-01/telemetry","payload":"{\\"temp\\":24.8,\\"lux\\":350,\\"ok\\":true,\\"note\\":\\"x\\",\\"gone\\":null}","recv_ts":"2024-01-01T00:00:00Z","retained":false}',
        '{"topic":"site/room/light/state","payload":"{\\"state\\":\\"ON\\",\\"on\\":1,\\"source\\":\\"auto\\"}","recv_ts":"2024-01-01T00:00:01Z","retained":false}',
        '{"topic":"site/sensor-01/telemetry","payload":"{\\"temp\\":1}","recv_ts":"2024-01-01T00:00:02Z","retained":true}',
        '{"topic":"site/sensor-01/telemetry","payload":"not json","recv_ts":"2024-01-01T00:00:03Z","retained":false}',
        '{"topic":"site/sensor-01/other","payload":"{\\"temp\\":2}","recv_ts":"2024-01-01T00:00:04Z","retained":false}',
    ]
    (folder / "a.json").write_text("\n".join(lines))
    return str(folder)


WANT = [("air", "sensor-01", None, "lux", 350.0), ("air", "sensor-01", None, "ok", 1.0), ("air", "sensor-01", None, "temp", 24.8), ("light", None, "room", "on", 1.0)]


def points(df):
    return sorted((r["measurement"], r["device"], r["location"], r["field"], r["value"]) for r in df.collect())


def test_batch_and_stream_ingest_agree(spark, landed, tmp_path):
    batch = I.read_messages(spark, landed).filter("NOT retained")
    assert points(I.json_to_points(I.parse_topic(batch)).filter("measurement IS NOT NULL")) == WANT
    Q.start(Q.stream_ingest(I.read_messages(spark, landed, streaming=True)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert points(spark.read.parquet(str(tmp_path / "out"))) == WANT


def test_string_fields_and_tags(spark, landed):
    rows = I.json_to_points(I.parse_topic(I.read_messages(spark, landed)), ("state",), ("source",)).filter("location = 'room'").collect()
    assert {(r["state"], r["field"], r["value"], r["value_str"]) for r in rows} == {("ON", "on", 1.0, None), ("ON", "source", None, "auto")}


def test_weather_of_a_zone(spark):
    df = spark.createDataFrame([('{"current":{"time":"2024-07-01T02:15","interval":900,"rain":0.5}}',), ("{}",)], "payload string")
    row = I.parse_weather(df, "Europe/Berlin").select(F.unix_seconds("time").alias("t"), "rain", "cloud_cover").collect()
    assert [(r["t"], r["rain"], r["cloud_cover"]) for r in row] == [(int(datetime(2024, 7, 1, 0, 15, tzinfo=UTC).timestamp()), 0.5, None)]


def test_writing_days_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("air", "2024-01-01", 1.0), ("air", "2024-01-02", 2.0)], "measurement string, local_day string, value double")
    B.write_days(first, path)
    B.write_days(first.filter("local_day = '2024-01-02'").withColumn("value", F.lit(9.0)), path)
    assert sorted(r["value"] for r in spark.read.parquet(path).collect()) == [1.0, 9.0]


def test_upsert_merges_fields(spark):
    base = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "k string, x double, y double")
    new = spark.createDataFrame([("a", None, 5.0), ("c", 7.0, None)], "k string, x double, y double")
    assert sorted(map(tuple, B.upsert_points(base, new, ("k",)).collect())) == [("a", 1.0, 5.0), ("b", 3.0, None), ("c", 7.0, None)]


def test_delete_keeps_rows_without_the_tag(spark):
    df = spark.createDataFrame([("sim", at(1)), (None, at(1)), ("a", at(1)), ("sim", at(100))], "device string, time timestamp")
    left = B.delete_where(df, F.col("device") == "sim", T0, at(50))
    assert sorted((r["device"] or "", r["time"].second) for r in left.collect()) == [("", 1), ("a", 1), ("sim", 40)]


def test_audit_log_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    for _ in range(2):
        B.append_audit(df, str(tmp_path / "log"), ("b", "a"))
    read = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert read.columns == ["b", "a"] and read.count() == 2


def test_ranges_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", at(i), float(i)) for i in range(10)], "device string, time timestamp, value double").write.parquet(str(tmp_path / "p"))
    found = S.time_range(spark.read.parquet(str(tmp_path / "p")), "2024-01-01T00:00:02Z", "now", at(5)).select("value")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in plan and "LessThan(time" in plan and "device" not in plan.split("ReadSchema")[1]
    assert sorted(r["value"] for r in found.collect()) == [2.0, 3.0, 4.0]


def test_deadman_stream_tells_gaps_and_recovery(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", at(0)), ("a", at(60)), ("a", at(2000)), ("b", at(2050))]
    spark.createDataFrame(rows, "device string, time timestamp").coalesce(1).write.parquet(str(source))
    live = spark.readStream.schema("device string, time timestamp").parquet(str(source))
    Q.start(Q.deadman_stream(live, ("device",), 10), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r["device"], r["event"], int((r["at"].replace(tzinfo=UTC) - T0).total_seconds())) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [("a", "recovered", 2000), ("a", "silent", 660)]


def test_controller_stream_carries_state(spark, tmp_path):
    from sunledger.operators.ordered import control_stream, replay_light

    schema = "location string, time timestamp, kind string, lux double, lux_age_s double, minute int, local_day date, dli double, cmd string"
    day = T0.date()
    ticks = [("x", at(60 * i), "tick", 100.0 if i < 60 else 20000.0, 5.0, 500 + i, day, None, None) for i in range(120)] + [("x", at(60 * 30 + 1), "cmd", None, None, None, None, None, "OFF")]
    df = spark.createDataFrame(ticks, schema)
    want = sorted((r["time"], r["state"], r["source"]) for r in replay_light(df).collect())
    assert [(s, c) for _, s, c in want] == [("ON", "auto"), ("OFF", "manual"), ("ON", "auto"), ("OFF", "auto")]
    for k, part in enumerate((df.filter(F.col("time") < F.lit(at(1200))), df.filter(F.col("time") >= F.lit(at(1200))))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        live = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        Q.start(control_stream(live), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["time"], r["state"], r["source"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_quoted_values_are_strings(spark):
    df = spark.createDataFrame([('{"lux":"350","ok":"true","w":"NaN","a":1,"b":2.5,"c":true,"d":null,"e":{"x":1},"f":1e3,"g":[1],"s":7}',), ("[1]",), ("{",), (None,)], "payload string")
    got = {r["field"]: (r["value"], r["value_str"]) for r in I.json_to_points(df, (), ("s",)).collect()}
    assert got == {"a": (1.0, None), "b": (2.5, None), "c": (1.0, None), "f": (1000.0, None), "s": (None, "7")}


EVENTS = "device string, event_id long, uid string, weight_g double, recv_ts timestamp"


def test_repeats_over_batches_are_stored_once(spark, tmp_path):
    """Copies in one batch, in the next, after the minute, and a batch that is run again."""
    files = [[(1, 0), (1, 3), (2, 0)], [(1, 6), (2, 59), (1, 61), (3, 5)], [(1, 100), (2, 60), (2, 200), (3, 4)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([("st", i, "u1", 50.0, at(s)) for i, s in rows], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        live = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        tags = spark.createDataFrame([("u1", "cactus-1")], "uid string, plant_id string")
        for q in Q.weigh_station(live, lambda _: tags if k else tags.select("uid"), str(tmp_path / "w"), str(tmp_path / "acks"), str(tmp_path / "state")):
            q.awaitTermination()
    weights = spark.read.parquet(str(tmp_path / "w"))
    got = sorted((r["event_id"], int((r["recv_ts"].replace(tzinfo=UTC) - T0).total_seconds()), r["plant_id"]) for r in weights.collect())
    assert got == [(1, 0, "unknown"), (1, 61, "cactus-1"), (2, 0, "unknown"), (2, 200, "cactus-1"), (3, 5, "cactus-1")]
    assert spark.read.parquet(str(tmp_path / "acks")).count() == sum(map(len, files))
    again = Q.store_weights(lambda _: tags, str(tmp_path / "w"))
    batch = spark.createDataFrame([("st", 1, "u1", 50.0, at(0)), ("st", 2, "u1", 50.0, at(0))], EVENTS)
    again(batch, 0)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 5


def test_upserts_by_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    work = Q.upsert_batches(path, ("k",), "day", ("seq",))
    first = spark.createDataFrame([("a", "1", 1.0, None, 1), ("b", "2", 2.0, 5.0, 1)], "k string, day string, x double, y double, seq int")
    second = spark.createDataFrame([("b", "2", 7.0, None, 2), ("b", "2", 3.0, 4.0, 3), ("c", "2", 9.0, None, 1)], first.schema)
    for number, batch in enumerate((first, second, second)):
        work(batch, number)
    got = sorted((r["k"], r["x"], r["y"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1.0, None), ("b", 3.0, 4.0), ("c", 9.0, None)]
    assert not Q.exists(spark, f"{path}.staged/1")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/part-0.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet|footer"):  # a table that can't be read is never written over
        Q.upsert_batches(str(tmp_path / "broken"), ("k",), "day")(first, 0)
    assert (tmp_path / "broken/part-0.parquet").read_text() == "no table"


def test_lines_are_made_and_matched_once(spark):
    """However many parts are read from a line, the plan formats its number in one place."""
    from sunledger.sources.line_protocol import add_tag, from_line_protocol, to_line_protocol

    points = spark.createDataFrame([("a", 1.5, None), ("b", None, 'say "x, y=z"'), ("c", float("nan"), None)], "device string, lux double, note string").withColumn("time", F.timestamp_seconds(F.lit(5)))
    lines = to_line_protocol(points, "air", ("device",), ("lux",), ("note",))
    back = from_line_protocol(lines.select(add_tag(F.col("line"), "k", "v w").alias("line")))
    assert sorted((r["tags"]["device"], r["tags"]["k"], r["field"], r["value"], r["value_str"]) for r in back.collect()) == [("a", "v w", "lux", 1.5, None), ("b", "v w", "note", None, 'say "x, y=z"')]
    assert back._jdf.queryExecution().optimizedPlan().toString().count("format_string(") == 1


def test_a_bucket_of_a_stream_is_a_small_part_of_a_batch(spark):
    """What a task's Python holds at once: of 200,000 keys in one batch no more than some 150."""
    rows = spark.range(200_000).select(F.concat(F.lit("st-"), F.col("id") % 7).alias("device"), F.col("id").alias("event_id"))
    assert Q.in_buckets(rows, ("device", "event_id")).groupBy("__bucket").count().agg(F.max("count")).first()[0] < 200


def test_a_task_groups_few_rows_to_weights(spark, monkeypatch):
    """As many tasks as the rows ask for, not as adaptive execution merges them; upserts by the same keys deal them no further."""
    sf_dir = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, adapters.Tables(spark, sf_dir).plant_weight.collect()))
    monkeypatch.setattr(adapters, "GROUPED", 300)
    weights = adapters.Tables(spark, sf_dir).plant_weight
    assert max(r["n"] for r in weights.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) < 600
    merged = B.upsert_points(weights, weights.withColumn("quality", F.lit("heavy")), ("plant_id", "device", "time"))
    assert merged.rdd.getNumPartitions() == weights.rdd.getNumPartitions() >= len(whole) / 300 and {r[0] for r in merged.select("quality").distinct().collect()} == {"heavy"}
    assert sorted(map(tuple, weights.collect())) == whole and merged.count() == len(whole)
