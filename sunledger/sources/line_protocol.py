"""Line protocol as text: writing and reading back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _pair(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value))


def to_line_protocol(df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], strings: Sequence[str] = (), precision: str = "s", time: str | None = "time") -> DataFrame:
    """(line): null and non-finite fields are left out, rows without any field too. Precision s or ns."""
    head = F.concat_ws(",", F.lit(measurement), *(_pair(t, X.escape_tag(F.col(t))) for t in tags))
    numbers = [_pair(f, X.number(F.col(f).cast("double"))) for f in fields]
    texts = [_pair(f, F.concat(F.lit('"'), X.escape_string(X.one_line(F.col(f))), F.lit('"'))) for f in strings]
    body = F.concat_ws(",", *numbers, *texts)
    stamp = [] if time is None else [(F.unix_seconds(time) if precision == "s" else F.unix_micros(time) * 1000).cast("string")]
    # Of the columns as they came: a filter on the body would format every number twice.
    some = reduce(or_, [*(X.finite(F.col(f).cast("double")) for f in fields), *(F.col(f).isNotNull() for f in strings)], F.lit(False))
    return df.filter(some).select(F.concat_ws(" ", head, body, *stamp).alias("line"))


def add_tag(line: Column, key: str, value: Column | str) -> Column:
    """Puts a tag at the end of the tag set: before the first space that no backslash escapes."""
    tag = F.concat(F.lit(","), X.escape_tag(F.lit(key)), F.lit("="), X.escape_tag(F.lit(value) if isinstance(value, str) else value))
    head = F.regexp_extract(line, r"^((?:[^ \\]++|\\.)*+)", 1)
    return F.concat(head, tag, F.substr(line, F.length(head) + 1))


#: Head and body of a line; quoted strings may hold spaces. Runs are taken whole, so long lines don't deepen the matcher's stack.
_HEAD, _BODY, _STAMP = r"^((?:[^ \\]++|\\.)*+) ", r'^((?:[^ "\\]++|\\.|"(?:[^"\\]++|\\.)*+")*+)', r"^(?: (-?\d+))?$"
_NAME = r"^((?:[^=\\]++|\\.)*+)="


def _rest(s: Column, head: Column) -> Column:
    """What follows a head and the sign after it."""
    return F.substr(s, F.length(head) + 2)


def from_line_protocol(df: DataFrame, precision: str = "s", line: str = "line") -> DataFrame:
    """(measurement, tags, field, value, value_str, time) from lines; lines that don't parse are dropped.

    Each part is cut off once, in a step of its own, and lines that don't parse have no fields. (A filter would be moved down
    to where lines are made, and make and match each of them again.)
    """
    first = df.select(F.col(line).alias("__line"), F.regexp_extract(line, _HEAD, 1).alias("__head"))
    second = first.select("__head", _rest(F.col("__line"), F.col("__head")).alias("__rest"), F.startswith("__line", F.concat("__head", F.lit(" "))).alias("__whole"))
    third = second.select("__head", "__rest", "__whole", F.regexp_extract("__rest", _BODY, 1).alias("__body"))
    fourth = third.select("__head", "__body", "__whole", F.substr("__rest", F.length("__body") + 1).alias("__tail"))
    parts = F.regexp_extract_all("__head", F.lit(r"((?:[^,\\]++|\\.)++)"), F.lit(1))
    fields = F.regexp_extract_all("__body", F.lit(r'((?:[^,="\\]++|\\.)++=(?:"(?:[^"\\]++|\\.)*+"|[^,"]*+))'), F.lit(1))
    fifth = fourth.select(parts.alias("__parts"), F.when(F.col("__whole") & F.col("__tail").rlike(_STAMP), fields).alias("__fields"), F.regexp_extract("__tail", _STAMP, 1).alias("__stamp"))

    def pair(p: Column) -> Column:
        name = F.regexp_extract(p, _NAME, 1)
        return F.struct(X.unescape(name), F.when(F.startswith(p, F.concat(name, F.lit("="))), X.unescape(_rest(p, name))).otherwise(""))

    tags = F.map_from_entries(F.transform(F.slice("__parts", 2, 1000), pair))
    number = F.when(F.col("__stamp") != "", F.col("__stamp").cast("bigint"))
    micros = number * 1_000_000 if precision == "s" else F.floor(number / 1000)
    named = fifth.select(X.unescape(F.get("__parts", 0)).alias("measurement"), tags.alias("tags"), F.timestamp_micros(micros.cast("bigint")).alias("time"), F.when(F.size("__parts") > 0, F.col("__fields")).alias("__fields"))
    rows = named.select("measurement", "tags", "time", F.explode_outer("__fields").alias("__f"))
    sixth = rows.select("measurement", "tags", "time", "__f", F.regexp_extract("__f", _NAME, 1).alias("__name"))
    seventh = sixth.select("measurement", "tags", "time", "__f", "__name", _rest(F.col("__f"), F.col("__name")).alias("__raw"))
    raw, quoted = F.col("__raw"), F.col("__raw").startswith('"')
    text = X.unescape(F.substr(raw, F.lit(2), F.length(raw) - 2))
    found = seventh.filter("__f IS NOT NULL")
    return found.select("measurement", "tags", X.unescape("__name").alias("field"), F.when(~quoted, raw.try_cast("double")).alias("value"), F.when(quoted, text).alias("value_str"), "time")
