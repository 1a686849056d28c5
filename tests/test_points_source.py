"""The data sources for line protocol and annotated CSV."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from sunledger.sources import line_protocol
from sunledger.sources import points_source as P
from sunledger.streaming import jobs as Q

T0 = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    P.register(spark)


def points(spark, n=300, seed=1, start=T0):
    rng = random.Random(seed)
    odd = ["plain", "a b", "c,d=e", 'say "hi"', "back\\slash", "ünï", ""]
    rows = []
    for i in range(n):
        text = rng.choice([None, None, rng.choice(odd)])
        rows.append((rng.choice(["air", "my air"]), {"device": rng.choice(odd[:-1]), "k=1": "v"} if i % 5 else None, rng.choice(["lux", "te mp"]), None if text is not None else rng.uniform(-1e9, 1e9), text, start + timedelta(seconds=i, microseconds=i) if i % 50 else None))
    return spark.createDataFrame(rows, P.POINTS), rows


def plain(rows):
    return sorted((r["measurement"], json.dumps(r["tags"] or {}, sort_keys=True), r["field"], r["value"] is None, r["value"] or 0.0, r["value_str"] or "", str(r["time"])) for r in rows)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_what_is_written_is_read_in_any_pieces(spark, tmp_path, split):
    df, _ = points(spark, 120)
    df.repartition(3).write.format("lineprotocol").mode("append").save(str(tmp_path / "p"))
    back = spark.read.format("lineprotocol").option("splitBytes", max(split, 5)).load(str(tmp_path / "p"))
    assert plain(back.collect()) == plain(df.collect())


@pytest.mark.parametrize("text", ["a f=1 1\nb f=2 2\n", "a f=1 1\nb f=2 2", "\n\na f=1 1\r\n\nb f=2 2\n\n", "", "a f=1 1"])
def test_pieces_share_no_line_and_miss_none(tmp_path, text):
    (tmp_path / "x.lp").write_text(text, newline="")
    whole = [x for x in text.replace("\r", "").split("\n") if x]
    for each in range(1, len(text) + 2):
        cut = P.pieces([P.File(str(tmp_path / "x.lp"), len(text), 0)], each)
        assert [x for p in cut for x in P.lines(p.path, fs.LocalFileSystem(), p.start, p.end)] == whole, each


def test_lines_parse_as_by_the_column_functions(spark, tmp_path):
    lines = ["air,device=a lux=1.5,note=\"x, y=z\" 10", "air lux=1", "air,t=a\\ b,u=c\\,d f\\=g=2e3 5", "bad", "air f=5i,g=t,h=nan,i=\"\" 7", "air f=\"un closed 3", "a\\ b,x=y f=-0.5 -9", "air f=1 1.5", ",x=y f=1 1", "m f=.5,g=5.,h=+3 2"]
    (tmp_path / "x.lp").write_text("\n".join(lines))
    got = spark.read.format("lineprotocol").option("precision", "s").load(str(tmp_path))
    want = line_protocol.from_line_protocol(spark.createDataFrame([(x,) for x in lines], "line string"))
    key = lambda r: repr((r["measurement"], sorted((r["tags"] or {}).items()), r["field"], r["value"], r["value_str"], r["time"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(got.columns).collect()))


def test_commits_are_seen_whole(spark, tmp_path):
    path = str(tmp_path / "p")
    first, _ = points(spark, 40)
    first.write.format("lineprotocol").mode("append").save(path)
    seen = spark.read.format("lineprotocol").load(path).count()
    broken = points(spark, 40, 2)[0].repartition(4).withColumn("value", F.when(F.spark_partition_id() == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("lineprotocol").mode("append").save(path)
    (tmp_path / "p/points-left.lp").write_text("air f=1 1\n")  # what a lost task may leave
    assert spark.read.format("lineprotocol").load(path).count() == seen == first.count()
    first.limit(7).write.format("lineprotocol").mode("overwrite").save(path)
    assert spark.read.format("lineprotocol").load(path).count() == 7
    assert [entry["replaces"] for _, entry in P.commits(path)] == [False, True]


def test_filters_on_time_skip_files_and_lines(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("air", {"device": "a"}, "lux", float(i), None, T0 + timedelta(hours=i)) for i in range(240)]
    spark.createDataFrame(rows, P.POINTS).repartitionByRange(10, "time").write.format("lineprotocol").mode("append").save(path)
    low, high = T0 + timedelta(hours=50), T0 + timedelta(hours=60)
    found = spark.read.format("lineprotocol").load(path).filter((F.col("time") >= F.lit(low)) & (F.col("time") < F.lit(high)))
    assert sorted(r["value"] for r in found.collect()) == [float(i) for i in range(50, 60)]
    assert found.rdd.getNumPartitions() <= 2 < len(P.files(path))
    reader = P.PointsReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    given = [GreaterThanOrEqual(("time",), low), LessThan(("time",), high), EqualTo(("field",), "lux")]
    assert list(reader.pushFilters(given)) == given and reader.range.low == P.micros(low)
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 11  # the bounds are Spark's to cut
    spark.createDataFrame([("air", {}, "lux", 1.0, None, None)], P.POINTS).write.format("lineprotocol").mode("append").save(path)
    assert spark.read.format("lineprotocol").load(path).filter("time is null").count() == 1


@pytest.mark.parametrize("logged", [True, False])
def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, logged):
    path = tmp_path / "p"
    path.mkdir()
    for k in range(3):
        if logged:
            spark.createDataFrame([("air", {}, "n", float(k), None, T0)], P.POINTS).write.format("lineprotocol").mode("append").save(str(path))
        else:
            (path / f"{9 - k}.lp").write_text(f"air n={k} 0\n")  # names don't say which is newer
        for _ in range(2):  # the second run finds nothing new
            live = spark.readStream.format("lineprotocol").load(str(path))
            Q.start(live.select("field", "value"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [float(i) for i in range(k + 1)]


def test_csv_blocks_by_schema_and_by_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text('#group,false\n,result,table,_time,lux,note\n,_r,0,2024-01-01T00:00:00Z,1.5,"a, ""b"""\n,_r,0,2024-01-02T00:00:00+08:00,x,\n\n#group,false\n,result,table,_time,on\n,_r,1,2024-01-03T00:00:00Z,true\n')
    (tmp_path / "b.csv").write_text("")
    df = spark.read.format("annotatedcsv").schema("lux double, _time timestamp, note string, on boolean, missing int").load(str(tmp_path))
    got = sorted((r["_time"].isoformat(), r["lux"], r["note"], r["on"], r["missing"]) for r in df.collect())
    assert got == [("2024-01-01T00:00:00", 1.5, 'a, "b"', None, None), ("2024-01-01T16:00:00", None, None, None, None), ("2024-01-03T00:00:00", None, None, True, None)]
    assert df.filter("_time > timestamp'2024-01-02'").count() == 1
    cells = spark.read.format("annotatedcsv").load(str(tmp_path))
    assert sorted((r["column"], r["value"]) for r in cells.collect()) == sorted([("_time", "2024-01-01T00:00:00Z"), ("lux", "1.5"), ("note", 'a, "b"'), ("_time", "2024-01-02T00:00:00+08:00"), ("lux", "x"), ("_time", "2024-01-03T00:00:00Z"), ("on", "true")])


def test_a_series_is_escaped_and_read_once(monkeypatch):
    """Lines come from Arrow batches; what a series and a line's head are is worked out once a task, not once a row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    calls = []
    for name in ("_start", "_head"):
        monkeypatch.setattr(P, name, lambda x, inner=getattr(P, name): calls.append(x) or inner(x))
    rows = [("my air", [("k", "a b"), ("gone", None)], "te mp", float(i), 'say "hi"' if i % 2 else None, i if i % 3 else None) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), to_arrow_schema(P.POINTS).types)], schema=to_arrow_schema(P.POINTS))
    told = list(P.to_lines(batch, 1000, {}, {}, {}))
    assert told[:2] == [("my\\ air,k=a\\ b te\\ mp=0.0", None), ('my\\ air,k=a\\ b te\\ mp="say \\"hi\\"" 1', 1)]
    heads, names = {}, {}
    assert [P.parse(line, 1000, heads, names) for line, _ in told] == [("my air", [("k", "a b")], [("te mp", None if i % 2 else float(i), 'say "hi"' if i % 2 else None)], i if i % 3 else None) for i in range(100)]
    assert len(calls) == 2
