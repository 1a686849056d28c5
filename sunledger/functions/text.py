"""Line-protocol escapes, number formats, identifiers, alert texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of identifiers (fixed values of the message contract).
DEVICE_ID = r"^[A-Za-z0-9_-]{1,40}$"
TAG_UID = r"^[0-9A-F]{8,20}$"
QUALITY = r"^[a-z_]{1,20}$"


def one_line(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n]+", " ")


def escape_tag(s: Column) -> Column:
    """Backslash before backslash, space, comma and equals sign."""
    return F.regexp_replace(s, r"([\\ ,=])", r"\\$1")


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"\\(.)", "$1")


def escape_string(s: Column) -> Column:
    return F.regexp_replace(s, r'([\\"])', r"\\$1")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def number(x: Column) -> Column:
    """Ten significant digits, null for values that line protocol can't hold."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.10g", x), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(finite(x), short)


def outside(x: Column, low: float, high: float) -> Column:
    return (x < low) | (x > high)


def silence_text(device: Column, field: Column, age_min: Column, limit_min: int) -> Column:
    """What an alert on a silent series says."""
    return F.format_string(f"silent: %s/%s for %.0f min, limit {limit_min} min", device, field, age_min)
