"""Typing a feed whose fields change."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunledger.sources import feed

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def messages(spark, payloads):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=i), p) for i, p in enumerate(payloads)], "id int, recv_ts timestamp, payload string")


def kind(v):
    return {bool: "boolean", int: "bigint", float: "double", str: "string", dict: "object", list: "array"}.get(type(v))


def test_kinds_and_columns_equal_a_loop(spark):
    rng = random.Random(1)
    values = [1, -7, 2.5, 1e300, True, False, "x", "", None, {"a": 1}, [1, "b"], 2**60]
    names = ["lux", "a.b", "it's", "id", "LUX2", "conflicting", "ok"]
    found = [{n: rng.choice(values[:4] if n == "ok" else values) for n in rng.sample(names, rng.randint(0, 7))} for _ in range(200)]
    df = messages(spark, [json.dumps(x) for x in found] + ["[1]", "{", "3", None, "null"])
    kinds = {(r["name"], r["kind"]): (r["n"], r["first"].replace(tzinfo=UTC), r["last"].replace(tzinfo=UTC)) for r in feed.field_kinds(df).collect()}
    want: dict = {}
    for i, x in enumerate(found):
        for n, v in x.items():
            if v is not None:
                want.setdefault((n, kind(v)), []).append(T0 + timedelta(minutes=i))
    assert kinds == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    rows, report = feed.read_feed(df)
    assert {r["name"] for r in report.collect()} == set(names) - {"ok"}
    assert dict(rows.dtypes)["ok"] == "double" and dict(rows.dtypes)["id"] == "int" and {"field_id", "field_conflicting"} <= set(rows.columns)
    planned = {f.name: f for f in feed.plan_fields(feed.field_kinds(df))}
    for r in rows.collect():
        given = found[r["id"]] if r["id"] < len(found) else {}
        for n in names:
            v, f = given.get(n), planned[n]
            column = f"field_{n}" if n in ("id", "conflicting") else n
            fits = v is not None and (kind(v) == f.kind or (f.kind == "double" and kind(v) == "bigint"))
            got = r[column]
            assert (got == v if f.kind not in ("object", "array") else json.loads(got) == v) if fits else got is None
            apart = (r["conflicting"] or {}).get(n)
            assert (apart is None) == (v is None or fits) and (apart is None or json.loads(apart) == v)


def test_feeds_without_fields(spark):
    for payloads in ([], [None, "[]", "{}"]):
        rows, report = feed.read_feed(messages(spark, payloads))
        assert rows.count() == len(payloads) and report.count() == 0 and rows.columns == ["id", "recv_ts", "payload", "conflicting"]


def test_names_that_are_data_are_refused(spark):
    df = messages(spark, [json.dumps({f"k{i}": 1}) for i in range(30)])
    with pytest.raises(ValueError, match="more than 20"):
        feed.plan_fields(feed.field_kinds(df), most=20)
    assert df.select(F.count(F.lit(1))).first()[0] == 30
