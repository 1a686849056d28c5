"""Instants, local wall clocks and calendar windows. Timestamps are instants under a UTC session."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SITE, Site

_RELATIVE = re.compile(r"([+-])(\d+)(s|m|h|d|w)")
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds_of(duration: str) -> int:
    """Seconds of a literal like 10m, 1d, -24h."""
    m = _RELATIVE.fullmatch(duration if duration[0] in "+-" else f"+{duration}")
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m[1] + m[2]) * _SECONDS[m[3]]


def resolve_time(value: str, as_of: datetime, tz: str = SITE.tz) -> datetime:
    """An instant from `now`, `now()`, a relative duration, an ISO time with offset, or a local wall clock."""
    text = value.strip()
    if text in ("now", "now()", ""):
        return as_of
    if _RELATIVE.fullmatch(text):
        return as_of + timedelta(seconds=seconds_of(text))
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (at if at.tzinfo else at.replace(tzinfo=ZoneInfo(tz))).astimezone(UTC)


def instant(at: datetime) -> Column:
    """A literal timestamp, whatever the session's zone."""
    return F.timestamp_micros(F.lit(round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)))


def local(t: Column, tz: str = SITE.tz) -> Column:
    return F.from_utc_timestamp(t, tz)


def local_day(t: Column, tz: str = SITE.tz) -> Column:
    return F.to_date(local(t, tz))


def minute_of_day(t: Column, tz: str = SITE.tz) -> Column:
    wall = local(t, tz)
    return F.hour(wall) * 60 + F.minute(wall)


def in_local_window(t: Column, tz: str, start_min: int, end_min: int) -> Column:
    """Whether the local time of day of each row lies in [start, end)."""
    minute = minute_of_day(t, tz)
    return (minute >= start_min) & (minute < end_min)


def from_local(text: Column, tz: str = SITE.tz, pattern: str = "yyyy-MM-dd'T'HH:mm") -> Column:
    """The instant of a local wall-clock string; null if it doesn't parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), tz)


def day_start(day: Column, tz: str = SITE.tz, minute: int | Column = 0) -> Column:
    """The instant of a minute of a local day."""
    minutes = F.lit(minute) if isinstance(minute, int) else minute
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minutes * 60), tz)


def epoch_ns(t: Column) -> Column:
    return F.unix_micros(t) * 1000


def age_minutes(t: Column, as_of: datetime) -> Column:
    return (F.unix_micros(instant(as_of)) - F.unix_micros(t)) / 6e7


def pre_lamp_window(day: Column, site: Site = SITE, span_min: int = 120) -> tuple[Column, Column]:
    """[lamp start - span, lamp start) of a local day."""
    if site.lamp_start <= span_min:
        raise ValueError(f"the lamp starts at minute {site.lamp_start}: no room for {span_min} minutes before it")
    return day_start(day, site.tz, site.lamp_start - span_min), day_start(day, site.tz, site.lamp_start)
