"""Typing a heterogeneous JSON feed without a list of its fields: what kinds each field has had, then columns by it.

One pass counts the kinds of every field, and when each was seen. A field with one kind becomes a column of that type (whole numbers
and fractions together are doubles). Where kinds conflict, the most frequent one is the column, and values of other kinds stay
apart as JSON, so nothing is lost and nothing is silently turned into something else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column types by kind. Objects and arrays stay JSON texts.
TYPES = {"bigint": "bigint", "double": "double", "boolean": "boolean", "string": "string", "object": "string", "array": "string", "other": "string"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    conflicts: bool


#: What schema_of_variant calls them. JSON's null has no kind.
KINDS = {"BIGINT": "bigint", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "STRING": "string", "OBJECT": "object", "ARRAY": "array", "VOID": None}


def kind_of(value: Column) -> Column:
    """The kind of a variant value; null for JSON's null."""
    known = F.create_map(*(x for said, kind in KINDS.items() for x in (F.lit(said), F.lit(kind).cast("string"))))
    return F.element_at(known, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _fields(payload: str) -> Column:
    """The fields of a payload by name; null if it is no object."""
    return F.from_json(payload, "map<string,variant>")


def field_kinds(messages: DataFrame, payload: str = "payload", time: str = "recv_ts") -> DataFrame:
    """(name, kind, n, first, last): how often a field was of a kind, and when. Partial counts meet, so a hot field is a row a task."""
    values = messages.select(time, F.explode(_fields(payload)).alias("name", "value")).withColumn("kind", kind_of(F.col("value")))
    return values.filter("kind IS NOT NULL").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def conflicts(kinds: DataFrame) -> DataFrame:
    """The rows of field_kinds for fields whose kinds don't fit one column."""
    many = kinds.groupBy("name").agg(F.count_distinct(F.when(F.col("kind") == "bigint", "double").otherwise(F.col("kind"))).alias("__k")).filter("__k > 1")
    return kinds.join(many.select("name"), "name", "left_semi")


def plan_fields(kinds: DataFrame, most: int = 5000) -> list[Field]:
    """The columns of a feed, by name. Raises if there are more than `most` names: then names are data, and rows (field, value) are the right form."""
    rows = kinds.select("name", "kind", "n").limit(most * len(TYPES) + 1).collect()
    seen: dict[str, dict[str, int]] = {}
    for r in rows:
        seen.setdefault(r["name"], {})[r["kind"]] = r["n"]
    if len(seen) > most:
        raise ValueError(f"more than {most} field names")
    out = []
    for name, counts in sorted(seen.items()):
        if "bigint" in counts and "double" in counts:
            counts["double"] += counts.pop("bigint")
        out.append(Field(name, max(counts, key=lambda k: (counts[k], k)), len(counts) > 1))
    return out


def typed(messages: DataFrame, fields: list[Field], payload: str = "payload") -> DataFrame:
    """The messages with a column a field, and `conflicting`: values of other kinds as JSON by name. Payloads that are no objects have neither.

    A field whose name is a column of the messages already is called field_<name>.
    """
    parsed = messages.withColumn("__m", _fields(payload))
    taken, columns, apart = {c.lower() for c in messages.columns} | {"conflicting"}, {}, []
    for f in fields:
        value = F.element_at("__m", F.lit(f.name))
        kind = kind_of(value)
        fits = kind.isin("bigint", "double") if f.kind == "double" else kind == f.kind
        got = F.to_json(value) if TYPES[f.kind] == "string" and f.kind != "string" else F.try_variant_get(value, "$", TYPES[f.kind])
        name = f.name
        while name.lower() in taken:
            name = f"field_{name}"
        taken.add(name.lower())
        columns[name] = F.when(fits, got)
        if f.conflicts:
            apart.append(F.when(~fits, F.struct(F.lit(f.name).alias("key"), F.to_json(value).alias("value"))))
    columns["conflicting"] = F.map_from_entries(F.array_compact(F.array(*apart))) if apart else F.create_map().cast("map<string,string>")
    return parsed.withColumns(columns).drop("__m")


def read_feed(messages: DataFrame, payload: str = "payload", time: str = "recv_ts") -> tuple[DataFrame, DataFrame]:
    """(typed messages, conflict report): the feed is read once for its kinds and once for its values."""
    kinds = field_kinds(messages, payload, time)
    return typed(messages, plan_fields(kinds), payload), conflicts(kinds)
