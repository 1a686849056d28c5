"""Scalar functions against stated values."""

from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from sunledger import config as C
from sunledger.functions import light as L
from sunledger.functions import reflect as R
from sunledger.functions import text as X
from sunledger.functions import time as T
from sunledger.functions.solar import with_solar_noon

AS_OF = datetime(2024, 1, 31, tzinfo=UTC)


@pytest.mark.parametrize(
    ("text", "want"),
    [("now", AS_OF), ("-8m", datetime(2024, 1, 30, 23, 52, tzinfo=UTC)), ("2024-01-01T08:00", datetime(2024, 1, 1, tzinfo=UTC)), ("2024-01-01T08:00:00Z", datetime(2024, 1, 1, 8, tzinfo=UTC))],
)
def test_resolve_time(text, want):
    assert T.resolve_time(text, AS_OF) == want


def test_unit_counts_give_the_sum_of_wavelengths(spark):
    row = spark.createDataFrame([tuple(float(C.RESPONSE[c]) for c in C.CHANNELS)], C.CHANNELS).select(L.spectrum_sum().alias("s"), L.spectrum_ppfd(2.0).alias("p")).first()
    assert row["s"] == pytest.approx(4310) and row["p"] == pytest.approx(8620)


def test_missing_channel_gives_no_sum(spark):
    row = spark.createDataFrame([(None, *(1.0,) * 7)], ", ".join(f"{c} double" for c in C.CHANNELS)).select(L.spectrum_sum().alias("s")).first()
    assert row["s"] is None


def test_datasheet_factor():
    assert L.datasheet_cal(4, 280.78) == pytest.approx(0.0037337, rel=1e-3)


def test_indices(spark):
    idx = R.vegetation_indices(F.lit(382.0), F.lit(516.0), F.lit(4520.0), F.lit(True))
    row = spark.range(1).select(*(c.alias(k) for k, c in idx.items())).first()
    assert (round(row["ndvi"], 3), round(row["ndre"], 3), round(row["cire"], 2)) == (0.844, 0.795, 7.76)
    assert spark.range(1).select(R.vegetation_indices(F.lit(-1.0), F.lit(516.0), F.lit(4520.0), F.lit(True))["ndvi"].alias("x")).first()["x"] is None


#: hour, minute, lux, current state, age of the reading (s), end of the window (min) -> wanted state
DECISIONS = [
    (12, 0, 50, "OFF", 10, 1110, "ON"), (12, 0, 4300, "OFF", 10, 1110, "ON"), (12, 0, 20000, "OFF", 10, 1110, "OFF"), (7, 0, 50, "OFF", 10, 1110, "OFF"), (18, 10, 50, "OFF", 10, 1110, "ON"),
    (18, 45, 50, "OFF", 10, 1110, "OFF"), (18, 45, 50, "ON", 10, 1110, "OFF"), (12, 0, 8000, "ON", 10, 1110, "ON"), (12, 0, 8000, "OFF", 10, 1110, "OFF"), (12, 0, 5000, "ON", 10, 1110, "ON"), (12, 0, 5000, "OFF", 10, 1110, "OFF"),
    (12, 0, 50, "ON", 301, 1110, "ON"), (12, 0, None, "ON", 0, 1110, "ON"), (12, 0, None, "OFF", 0, 1110, "ON"), (12, 0, None, "OFF", 0, 1230, "ON"), (20, 0, None, "ON", 0, 1110, "OFF"), (8, 0, None, "ON", 0, 1110, "ON"),
    (18, 30, None, "ON", 0, 1110, "OFF"), (19, 0, 50, "OFF", 10, 1110, "OFF"), (19, 0, 50, "OFF", 10, 1230, "ON"), (20, 30, 50, "OFF", 10, 1230, "OFF"), (19, 0, 20000, "OFF", 10, 1230, "OFF"),
]


def test_decisions(spark):
    rows = [(h * 60 + m, None if lux is None else float(lux), cur, float(age), end, want) for h, m, lux, cur, age, end, want in DECISIONS]
    df = spark.createDataFrame(rows, "minute int, lux double, cur string, age double, end int, want string")
    got = df.select(L.decide(F.col("lux"), F.col("age"), F.col("minute"), F.col("cur"), F.col("end")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_top_up(spark):
    df = spark.createDataFrame([(3.4, False, True), (4.0, True, False), (4.2, True, False), (None, True, True), (None, False, False)], "dli double, last boolean, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(L.top_up(F.col("dli"), F.col("last")).alias("got"), "want").collect())


def test_windows_before_the_lamp(spark):
    start, stop = T.pre_lamp_window(F.lit(date(2026, 8, 17)))
    row = spark.range(1).select(F.unix_seconds(start).alias("a"), F.unix_seconds(stop).alias("b")).first()
    assert datetime.fromtimestamp(row["a"], UTC) == datetime(2026, 8, 16, 22, tzinfo=UTC) and row["b"] - row["a"] == 7200
    with pytest.raises(ValueError):
        T.pre_lamp_window(F.lit(date(2026, 8, 17)), C.Site(lamp_start=60))


def test_solar_noon(spark):
    rows = with_solar_noon(spark.createDataFrame([(date(2026, 6, 21),), (date(2026, 12, 21),)], "local_day date")).select(F.unix_seconds("noon").alias("t"), "noon_height").collect()
    # Taipei at 121.46 E: noon at 11:54 plus the equation of time (about +2 min in June, -2 in December).
    for r, minutes, height in zip(rows, (716, 712), (88.4, 41.6), strict=True):
        assert (r["t"] + 8 * 3600) % 86400 / 60 == pytest.approx(minutes, abs=2) and r["noon_height"] == pytest.approx(height, abs=0.2)


def test_day_length_follows_the_zone(spark):
    day = F.lit(date(2024, 3, 31))
    row = spark.range(1).select((F.unix_seconds(T.day_start(F.date_add(day, 1), "Europe/Berlin")) - F.unix_seconds(T.day_start(day, "Europe/Berlin"))).alias("s")).first()
    assert row["s"] == 23 * 3600


def test_number_format(spark):
    df = spark.createDataFrame([(1.0,), (0.0017469,), (1e300,), (float("nan"),), (float("inf"),), (None,), (120.0,)], "x double")
    assert [r["n"] for r in df.select(X.number(F.col("x")).alias("n")).collect()] == ["1", "0.0017469", "1e+300", None, None, None, "120"]
