"""The lamp controller live: from readings and commands alone, with ticks of its own.

State is kept a location, in typed columns: the lamp and its holds, the latest lux and its age, and the light sum of
the local day; beside them the rows that wait until the watermark has passed them, since what comes late must
still be taken in order of time. They wait packed, by ten minutes of their time, and ten minutes are all that is in memory at once, however
many rows a batch brings. Event-time timers wake a location when ticks are due, whether or not rows come.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timezone
from itertools import chain
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import LUX_PER_PPFD, SITE, Site
from ..operators.ordered import Lamp

#: A day, in microseconds: the look-back for readings, and where ticks begin.
DAY_US = 86_400_000_000
AIR, CMD = 0, 1

LAMP = "lit boolean, manual_until double, last_switch double, extend boolean, day string, lux double, lux_at bigint, flux double, flux_at bigint, flux_day string, next_tick bigint"
#: As rows waited before they were packed: a checkpoint may still hold some.
LISTED = "at bigint, kind int, lux double, cmd string"
#: A row that waits, its command a place in CMDS.
ROW = np.dtype([("at", "<i8"), ("kind", "i1"), ("lux", "<f8"), ("cmd", "i1")])
CMDS = ("", "OFF", "ON")
#: Rows wait by so much of their time.
PART_US = 600_000_000
#: Rows that are unpacked or told together, at most; and packed ones beyond which those of a batch go into state.
TOGETHER, PACKED = 50_000, 250_000


class LiveLamp(Lamp):
    """The controller's rules, fed with raw rows: what a tick is given is kept up here."""

    def __init__(self, site: Site, kept: tuple | None = None):
        super().__init__(site)
        self.zone, self.lux, self.lux_at, self.flux, self.flux_at, self.flux_day, self.next_tick = ZoneInfo(site.tz), None, None, 0.0, None, None, None
        if kept:
            self.on, self.manual_until, self.last_switch, self.extend, day, self.lux, self.lux_at, self.flux, self.flux_at, flux_day, self.next_tick = kept
            self.day, self.flux_day = day and date.fromisoformat(day), flux_day and date.fromisoformat(flux_day)

    def kept(self) -> tuple:
        return self.on, self.manual_until, self.last_switch, self.extend, self.day and str(self.day), self.lux, self.lux_at, self.flux, self.flux_at, self.flux_day and str(self.flux_day), self.next_tick

    def local(self, us: int) -> datetime:
        return datetime.fromtimestamp(us // 1_000_000, timezone.utc).astimezone(self.zone)

    def reading(self, us: int, lux: float) -> None:
        """The latest lux, and the day's light sum: trapezoids between readings of one local day."""
        day = self.local(us).date()
        if day != self.flux_day:
            self.flux, self.flux_day = 0.0, day
        elif self.lux is not None:
            self.flux += (lux / LUX_PER_PPFD + self.lux / LUX_PER_PPFD) / 2 * ((us - self.lux_at) / 1e6)
        self.lux, self.lux_at, self.flux_at = lux, us, us

    def due(self, us: int) -> str | None:
        """The tick at an instant."""
        here = self.local(us)
        fresh = self.lux_at is not None and us - self.lux_at <= DAY_US
        dli = self.flux / 1e6 if fresh and self.flux_day == here.date() else None
        return self.tick(us / 1e6, self.lux if fresh else None, (us - self.lux_at) / 1e6 if fresh else None, here.hour * 60 + here.minute, here.date(), dli)

    def advance(self, rows: Iterable[tuple], upto: int) -> Iterator[tuple[int, str, str]]:
        """(instant, state, source) of the switches that ordered rows and the ticks among them cause, up to an instant.

        At one instant a reading comes before a command, and both before the tick. Ticks begin with the day (UTC) of the first row.
        """
        step = self.site.tick_s * 1_000_000
        for at, kind, lux, cmd in chain(rows, [(upto + 1, AIR, None, None)]):
            if self.next_tick is None:
                if at > upto:
                    return
                self.next_tick = at // DAY_US * DAY_US
            while self.next_tick < at:
                state = self.due(self.next_tick)
                if state:
                    yield self.next_tick, state, "auto"
                self.next_tick += step
            if at > upto:
                return
            if kind == AIR:
                self.reading(at, lux)
            elif state := self.command(at / 1e6, cmd):
                yield at, state, "manual"


class ControlLamp(StatefulProcessor):
    """A location's controller in Structured Streaming: typed state, event-time timers."""

    def __init__(self, site: Site, columns: list[str]):
        self.site, self.columns = site, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lamp, self.waiting = handle.getValueState("lamp", LAMP), handle.getMapState("packed", "part bigint", "rows binary")
        self.listed = handle.getListState("waiting", LISTED)

    def wait(self, rows: np.ndarray) -> None:
        """Adds rows to those that wait."""
        part = rows["at"] // PART_US
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        for some in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
            key = (int(some["at"][0]) // PART_US,)
            before = self.waiting.getValue(key)
            self.waiting.updateValue(key, ((bytes(before[0]) if before else b"") + some.tobytes(),))

    def part(self, key: int) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue((key,))[0], ROW)

    def due(self, upto: int) -> Iterator[tuple]:
        """The rows up to an instant in order, which then wait no more."""
        for (key,) in sorted(self.waiting.keys()):
            if key * PART_US > upto:
                return
            rows = self.part(key)
            rows = rows[np.lexsort([rows[c] for c in reversed(ROW.names)])]
            n = int(np.searchsorted(rows["at"], upto, "right"))
            if n == len(rows):
                self.waiting.removeKey((key,))
            else:
                self.waiting.updateValue((key,), (rows[n:].tobytes(),))
            for low in range(0, n, TOGETHER):
                for at, kind, lux, cmd in rows[low : min(n, low + TOGETHER)].tolist():
                    yield at, kind, lux, CMDS[cmd]

    def told(self, key, found: list[tuple]) -> pd.DataFrame:
        at, state, source = map(list, zip(*found)) if found else ([], [], [])
        place, time = pd.Series([*key] * len(found), dtype=object), pd.to_datetime(at, unit="us")
        return pd.DataFrame(dict(zip(self.columns, (place, time, pd.Series(state, dtype=object), pd.Series(source, dtype=object)), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = math.inf, [], 0
        for batch in rows:
            some = np.empty(len(batch), ROW)
            for c in ROW.names:
                some[c] = batch[c]
            if len(some):
                first, n = min(first, int(some["at"].min())), n + len(some)
                held.append(some)
            if n > PACKED:
                self.wait(np.concatenate(held))
                held, n = [], 0
        if held:
            self.wait(np.concatenate(held))
        if first < math.inf:
            # As soon as the first of these rows is final: the timer of the next tick may be due only after the stream's last watermark.
            self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        lamp = LiveLamp(self.site, self.lamp.get() if self.lamp.exists() else None)
        if self.listed.exists():
            self.wait(np.array([(at, kind, lux, CMDS.index(cmd)) for at, kind, lux, cmd in self.listed.get()], ROW))
            self.listed.clear()
        out = []
        for switch in lamp.advance(self.due(upto), upto):
            out.append(switch)
            if len(out) == TOGETHER:
                yield self.told(key, out)
                out = []
        if lamp.next_tick is not None:
            self.lamp.update(lamp.kept())
        # Several timers of a location may expire at once: the first has done the work of all, and each tick has one timer.
        left = min((k for (k,) in self.waiting.keys()), default=None)
        following = min(t for t in (lamp.next_tick, None if left is None else int(self.part(left)["at"].min())) if t is not None)
        self.handle.registerTimer(max(-(-following // 1000), upto // 1000 + 1))
        yield self.told(key, out)

    def close(self) -> None:
        pass


def control_live(rows: DataFrame, site: Site = SITE, location: str = "location", late: str = "10 minutes") -> DataFrame:
    """(location, time, state, source): the controller's switches from a stream of raw rows (location, time, lux, state, retained).

    A row with lux is a reading; one with state ON or OFF (any case) that isn't retained is a command; it may be both. Ticks
    come from timers, `site.tick_s` apart, so the stream needs none. Switches are told once the watermark has passed
    them, in the order of time; rows that come later than `late` are dropped by the watermark. Equals a replay of the same rows.
    """
    kind = rows.schema[location].dataType.simpleString()
    state = F.upper("state")
    command = F.coalesce(state.isin("ON", "OFF") & ~F.coalesce("retained", F.lit(False)), F.lit(False))
    parts = F.array_compact(F.array(
        F.when(F.col("lux").isNotNull(), F.struct(F.lit(AIR).alias("kind"), F.col("lux").cast("double").alias("lux"), F.lit(0).alias("cmd"))),
        F.when(command, F.struct(F.lit(CMD).alias("kind"), F.lit(0.0).alias("lux"), F.when(state == "ON", 2).otherwise(1).alias("cmd"))),
    ))
    told = rows.withWatermark("time", late).withColumn("part", F.explode(parts)).select(location, "time", F.unix_micros("time").alias("at"), "part.kind", "part.lux", "part.cmd")
    columns = [location, "time", "state", "source"]
    return told.groupBy(location).transformWithStateInPandas(ControlLamp(site, columns), f"{location} {kind}, time timestamp, state string, source string", "Append", "EventTime")
