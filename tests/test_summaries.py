"""Ranks, percentiles and stored summaries against plain lists."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunledger.operators import ranked as R
from sunledger.operators import series as S
from sunledger.operators import summaries as Y
from sunledger.session import shared_folder

T0 = datetime(2024, 3, 30, tzinfo=UTC)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.fixture(scope="module")
def skewed(spark):
    """A key with nearly all rows, nearly all of one value; a null key, null values, NaN-free."""
    rng = random.Random(1)
    rows = [("hot", 0.0, i) for i in range(4000)] + [("hot", rng.uniform(-5, 5), 4000 + i) for i in range(1500)]
    rows += [(k, rng.choice([None, 1.0, -2.5, rng.random()]), 10_000 + i) for i, k in enumerate(rng.choices(["a", "b", None], k=60))]
    rows += [("none", None, 20_000), ("one", 7.0, 20_001)]
    return spark.createDataFrame(rows, "k string, v double, i long").repartition(4).cache(), rows


def test_ranks_equal_the_sorted_list(spark, skewed):
    df, rows = skewed
    got = {r["i"]: (r["rank"], r["n"]) for r in R.ranked(df, ("k",), ("v", "i")).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        assert all(got[r[2]] == (n + 1, len(own)) for n, r in enumerate(own))
    assert shared_folder(spark)


def test_no_piece_holds_the_hot_key(skewed):
    """Equal values of one key are dealt over pieces too."""
    df, rows = skewed
    from sunledger.operators.days import KEY

    dealt = df.withColumn(KEY, F.struct("k")).repartitionByRange(8, KEY, "v", "i")
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < len(rows) / 3


def test_percentiles_equal_the_exact_ones(skewed):
    df, rows = skewed
    got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in R.percentiles(df, ("k",), "v", {"lo": 0.1, "mid": 0.5, "hi": 0.93}).collect()}
    want = {r["k"]: tuple(r["p"]) if r["p"] else (None,) * 3 for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.93))).alias("p")).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert all(a == b if b is None else math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[k], v)), k


def test_ranked_plans_have_no_window_by_key_alone(skewed):
    import re

    for frame in (R.ranked(skewed[0], ("k",), ("v", "i")), R.bin_drift(skewed[0], ("k",), ("v", "i"), "v"), R.percentiles(skewed[0], ("k",), "v", {"m": 0.5})):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[(.*?)\], \[([^\]]*)\](?:, \[([^\]]*)\])?$", plan, re.M)
        # By key alone only small tables are put in order: counts of pieces, ranges or values.
        assert windows and all(any(x in keys + order for x in ("__piece", "__r#", "__q#")) or "sum(__n" in what for what, keys, order in windows), windows


# -- sketches ---------------------------------------------------------------------------------


def test_merged_sketches_keep_the_bound(spark):
    rng = random.Random(2)
    rows = [(k, at(rng.randint(0, 30 * 86400)), rng.lognormvariate(0, 2) if k == "a" else float(rng.randint(0, 9)), f"p{rng.randint(0, 299)}") for k in ("a", "b") for _ in range(20_000)]
    rows += [("c", at(5), float("nan"), None), ("c", at(6), None, None), ("d", at(7), 3.5, "x")]
    df = spark.createDataFrame(rows, "k string, time timestamp, v double, p string").repartition(5)
    days = Y.sketch_days(df, ("k",), ("v",), ("p",)).cache()
    assert days.filter("k = 'a'").count() in (30, 31)
    once = Y.merge_sketches(days.drop("local_day"), ("k",))
    halves = Y.merge_sketches(days.withColumn("h", F.dayofmonth("local_day") % 2).drop("local_day"), ("k", "h"))
    for merged in (once, Y.merge_sketches(halves.drop("h"), ("k",))):
        for q in (0.05, 0.5, 0.9):
            got = {r["k"]: (r["x"], r["v_n"]) for r in merged.select("k", "v_n", Y.sketched_quantile("v", q).alias("x")).collect()}
            for k in ("a", "b"):
                values = [r[2] for r in rows if r[0] == k]
                low, high = sum(v < got[k][0] for v in values) / len(values), sum(v <= got[k][0] for v in values) / len(values)
                assert got[k][1] == 20_000 and low - Y.rank_error() <= q <= high + Y.rank_error()
            assert got["c"] == (None, 0) and got["d"] == (3.5, 1)
        plants = {r["k"]: r["n"] for r in merged.select("k", Y.sketched_distinct("p").alias("n")).collect()}
        assert abs(plants["a"] - 300) <= 5 and plants["c"] == 0 and plants["d"] == 1


def test_late_points_merge_into_their_day(spark):
    rows = [("a", at(60 * i), float(i), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, time timestamp, v double, p string")
    early, late = df.filter("v % 7 <> 0"), df.filter("v % 7 = 0")
    both = Y.merge_sketches(Y.sketch_days(early, ("k",), ("v",)).unionByName(Y.sketch_days(late, ("k",), ("v",))), ("k", "local_day"))
    whole = Y.sketch_days(df, ("k",), ("v",))
    ask = lambda s: sorted((r["local_day"], r["v_n"], r["m"]) for r in s.select("local_day", "v_n", Y.sketched_quantile("v", 0.5).alias("m")).collect())
    assert ask(both) == ask(whole)  # so few values are kept exactly


# -- integrals --------------------------------------------------------------------------------


def points(seed, n=900, days=4):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), at(rng.randint(0, days * 86400 - 1)) + timedelta(microseconds=i), rng.choice([None, rng.uniform(0, 100)])) for i in range(n)]


def near(got, want, by=("k", "local_day")):
    key = lambda r: tuple(str(r[c]) for c in by)
    g, w = {key(r): (r["area"], r["n"]) for r in got.collect()}, {key(r): (r["v"], r["n"]) for r in want.collect()}
    assert set(g) == set(w) and all(g[k][1] == w[k][1] and math.isclose(g[k][0], w[k][0], rel_tol=1e-9, abs_tol=1e-9) for k in w)


@pytest.mark.parametrize("tz", ["Asia/Taipei", "Europe/Berlin", "Asia/Kolkata"])  # Berlin: a day of 23 hours is among these
def test_hours_add_up_to_the_scan(spark, tz):
    df = spark.createDataFrame(points(3), "k string, time timestamp, v double")
    hours = Y.integral_hours(df, ("k",), "v", tz).cache()
    near(Y.integral_days(hours, ("k",)), S.integral(df, ("k",), "v", tz))
    for start, stop in ((at(3600 * 5 + 17), at(3600 * 70 + 1234)), (at(7200), at(86400)), (at(100), at(200)), (at(3600 * 9 + 1), at(3600 * 9 + 1800)), (at(-10_000), at(9_000_000))):
        inside = df.filter((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(stop)))
        near(Y.integral_between(hours, df, ("k",), start, stop, "v", tz), S.integral(inside, ("k",), "v", tz))


def test_late_points_refresh_their_hours_only(spark):
    df = spark.createDataFrame(points(4), "k string, time timestamp, v double")
    late = df.filter("pmod(xxhash64(time), 50) = 0")
    early = df.join(late, ["time"], "left_anti").select(df.columns)
    stored = Y.integral_hours(early, ("k",), "v")
    fresh = Y.refresh_hours(stored, df, late, ("k",), "v")
    near(Y.integral_days(fresh, ("k",)), S.integral(df, ("k",), "v"))
    assert fresh.count() == Y.integral_hours(df, ("k",), "v").count()
    assert fresh.join(stored, ["local_day", "hour", "area", "n"], "left_semi").count() > 0.3 * stored.count()
