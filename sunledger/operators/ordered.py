"""The steps whose result depends on order in a way that windows can't express. Everything around them stays in Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SITE, Site
from .days import DAY, KEY


#: The instant of rows without a time: before all others.
NEVER = -(1 << 62)
DAY_US = 86_400_000_000
#: How far into a stretch a pause is looked for at which rows can be cut.
LOOK_US = 6 * 3_600_000_000


def dedup_ttl(events: DataFrame, keys: Sequence[str], ttl_ms: int = 60_000, time: str = "recv_ts", ties: Sequence[str] = (), days: int = 1, again: Column | None = None) -> DataFrame:
    """Keeps the first of each key and drops its repeats up to ttl_ms after the kept one; later ones are new.

    The time runs from the kept row, repeats don't extend it. After a pause longer than the ttl all begins anew, so each key's rows are cut at
    the first pause of each day (or stretch of `days` days, see in_pauses), dealt by key and piece and read in order once, batch by batch, with the last kept
    time as state: neither a key's history nor a day has to fit in memory. Rows without a time count as one instant before all others.
    With `again` a row stands for its repeats: an array of the milliseconds, not negative, after its time at which it comes (0: then). They are
    made where they are read, so they are neither dealt nor put in order by Spark; a row without any doesn't come at all.
    """
    columns, names = events.columns, [*keys, FROM]
    ordered = in_pauses(events, keys, ttl_ms * 1000, time, days, again).repartition(*names).sortWithinPartitions(*names, time)
    told = ordered if again is None else ordered.withColumn(AGAIN, again.cast("array<bigint>"))
    return told.mapInArrow(lambda batches: _scan(batches, names, columns, time, ties, ttl_ms * 1000), events.schema)


FROM, AGAIN = "__from", "__again"


def in_pauses(rows: DataFrame, keys: Sequence[str], ttl: int, time: str, days: int, again: Column | None = None) -> DataFrame:
    """Cuts each key's rows where more than `ttl` microseconds lie before a row and after all repeats (`again`) of those before it. Adds the pieces' FROM.

    The first such pause in the first hours of a stretch of days counts, for which only the rows around there are put in order. A
    stretch that has none there goes on with the one before, and one without rows there is cut where it begins.
    """
    span = days * DAY_US
    look, floor = min(span, max(span // 32, LOOK_US)), lambda at: at - F.pmod(at, F.lit(span))
    at, end = F.unix_micros(time), F.col("__end")
    ends = rows.withColumn("__end", at if again is None else at + F.array_max(again) * 1000)
    # A row counts where it lies at most `look` after a stretch's beginning, or where it or a repeat comes at most the ttl before that.
    low, high = floor(at - look) + span, floor(end + ttl)
    near = ends.select(*keys, at.alias("__at"), end, F.explode(F.when(low <= high, F.sequence(low, high, F.lit(span)))).alias(DAY))
    names = [*keys, DAY]
    schema = T.StructType([*(near.schema[c] for c in names), T.StructField("__cut", T.LongType())])
    cuts = near.repartition(*names).sortWithinPartitions(*names, "__at").mapInArrow(lambda batches: _cuts(batches, names, ttl, look), schema)
    over = W.partitionBy(KEY).orderBy(DAY)
    alone = F.coalesce(F.lag(DAY).over(over) != F.col(DAY) - span, F.lit(True))
    edges = cuts.withColumn(KEY, F.struct(*keys)).withColumn("__alone", F.when(alone, F.col(DAY) - span)).withColumn("__start", F.coalesce("__cut", "__alone"))
    before = F.coalesce("__alone", F.last("__start", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)))
    own = rows.withColumns({KEY: F.struct(*keys), DAY: F.coalesce(floor(at), F.lit(NEVER))})
    placed = own.join(edges.select(KEY, DAY, "__cut", before.alias("__before")), [KEY, DAY], "left")
    start = F.when(F.col("__before").isNull(), F.col(DAY)).when(at >= F.col("__cut"), F.col("__cut")).otherwise(F.col("__before"))
    return placed.withColumn(FROM, start).drop(KEY, DAY, "__cut", "__before")


def _starts(rows: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Whether a row's names differ from those of the row before; nulls are equal."""
    n = rows.num_rows
    starts = np.zeros(n, bool)
    for c in names:
        column = rows.column(c)
        a, b = column.slice(0, n - 1), column.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        starts[1:] |= differs.to_numpy(zero_copy_only=False)
    return starts


def _cuts(batches: Iterator[pa.RecordBatch], names: Sequence[str], ttl: int, look: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order by names and time: for each of the names the first pause, where the look ahead ends if all is over by then, or null."""
    held, reached, cut = None, NEVER, None  # of the stretch so far: its names, how far its rows and their repeats reach, its cut

    def told(head: pa.RecordBatch, found: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*head.columns, pa.array(found, pa.int64())], names=[*names, "__cut"])

    def over(day: int) -> int | None:
        return cut if cut is not None else day + look if reached < day + look - ttl else None

    for batch in batches:
        if not batch.num_rows:
            continue
        heads = batch.select(list(names))
        same = held is not None and not _starts(pa.Table.from_batches([held, heads.slice(0, 1)]).combine_chunks().to_batches()[0], names)[1]
        if held is not None and not same:
            yield told(held, [over(held.column(DAY)[0].as_py())])
        at, end, day = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__at", "__end", DAY))
        edges = [0, *np.flatnonzero(_starts(batch, names)).tolist(), batch.num_rows]
        found = []
        for low, high in zip(edges, edges[1:], strict=False):
            if low or not same:
                reached, cut = NEVER, None
            far = np.maximum.accumulate(np.append(reached, end[low:high]))
            if cut is None:
                pauses = (at[low:high] >= day[low]) & (at[low:high] - far[:-1] > ttl)
                first = int(pauses.argmax())
                cut = int(at[low + first]) if pauses[first] else None
            reached = int(far[-1])
            found.append(over(int(day[low])))
        if len(found) > 1:
            yield told(heads.take(pa.array(edges[:-2])), found[:-1])
        held = heads.slice(edges[-2], 1)
    if held is not None:
        yield told(held, [over(held.column(DAY)[0].as_py())])


def _least(rows: pa.RecordBatch, ties: Sequence[str]) -> np.ndarray:
    """Each row's place in the order of ties: nulls first, NaN last."""
    table, order = {}, []
    for c in ties:
        column = rows.column(c)
        if pa.types.is_floating(column.type):
            table[f"{c} NaN"] = pc.fill_null(pc.is_nan(column), False)
            order.append((f"{c} NaN", "ascending"))
        table[c] = column
        order.append((c, "ascending"))
    places = np.empty(rows.num_rows, int)
    places[pc.sort_indices(pa.table(table), sort_keys=order, null_placement="at_start").to_numpy()] = np.arange(rows.num_rows)
    return places


def _scan(batches: Iterator[pa.RecordBatch], names: Sequence[str], columns: Sequence[str], time: str, ties: Sequence[str], ttl: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order by names and time, what is kept.

    What comes before the last row's time is decided with each batch; rows that come then or later again wait for the next.
    """
    rest, done, last = None, NEVER, None  # of the piece that the batch before ended in: rows that wait, up to when it is decided, its last kept time
    for batch in chain((b for b in batches if b.num_rows), [None]):
        both = [b for b in (rest, batch) if b is not None]
        if not both:
            return
        rows = pa.Table.from_batches(both).combine_chunks().to_batches()[0]
        at = pc.fill_null(rows.column(time).cast(pa.int64()), NEVER).to_numpy(zero_copy_only=False)
        piece = np.cumsum(_starts(rows, names))
        row, when = np.arange(len(at)), at
        if AGAIN in rows.schema.names:
            lists = rows.column(AGAIN)
            row = np.repeat(row, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            when = np.where(at[row] == NEVER, NEVER, at[row] + lists.flatten().to_numpy(zero_copy_only=False) * 1000)
        if rest is not None:
            left = (when >= done) | (piece[row] > 0)
            row, when = row[left], when[left]
        if AGAIN in rows.schema.names:
            order = np.lexsort((when, piece[row]))
            row, when = row[order], when[order]
        of = piece[row]
        # Time in which no pause and no step to another piece is longer than just beyond the ttl: the first row beyond it is the same, over all pieces at once.
        flat = np.append(0, np.cumsum(np.where(of[1:] != of[:-1], ttl + 1, np.minimum(np.diff(when), ttl + 1))))
        follow = np.searchsorted(flat, flat + ttl, "right").tolist()
        i = 0 if last is None else int(np.searchsorted(when[: np.searchsorted(of, 0, "right")], last + ttl, "right"))
        final = len(when)
        if batch is not None:
            begun = int(np.searchsorted(of, piece[-1]))
            final = begun + int(np.searchsorted(when[begun:], at[-1]))
        kept = []
        while i < final:  # from a kept row to the first beyond the ttl
            kept.append(i)
            i = follow[i]
        if kept and of[kept[-1]] == piece[-1]:
            last = int(when[kept[-1]])
        elif piece[-1] > 0:
            last = None
        if kept:
            picks = np.array(kept)
            chosen, alike = row[picks], np.searchsorted(flat, flat[picks], "right") - picks
            disputed = np.flatnonzero(alike > 1)
            if ties and len(disputed):
                # Of one instant the row that is the first by ties.
                begin = np.cumsum(alike[disputed]) - alike[disputed]
                claims = row[np.repeat(picks[disputed] - begin, alike[disputed]) + np.arange(alike[disputed].sum())]
                some, place = np.unique(claims, return_inverse=True)
                rank = _least(rows.take(pa.array(some)), ties)
                least = np.minimum.reduceat(rank[place], begin)
                chosen[disputed] = some[np.argsort(rank)[least]]
            out = rows.take(pa.array(chosen)).select(list(columns))
            if AGAIN in rows.schema.names:
                kind = out.schema.field(time).type
                moved = pa.array(when[picks], pa.int64(), mask=when[picks] == NEVER).cast(kind)
                out = out.set_column(list(columns).index(time), time, moved)
            yield out
        if batch is not None:
            rest, done = rows.take(pa.array(np.union1d(row[final:], len(at) - 1))), int(at[-1])


@dataclass
class Lamp:
    """The controller's state at one location, and its rules."""

    site: Site = SITE
    on: bool = False
    manual_until: float = -math.inf
    last_switch: float = -math.inf
    extend: bool = False
    day: object = None

    def command(self, t: float, state: str) -> str | None:
        """A command acts at once and holds off automatic switching; every repeat extends that."""
        self.manual_until = t + self.site.manual_hold_s
        if (state == "ON") == self.on:
            return None
        self.on = not self.on
        return state

    def tick(self, t: float, lux: float | None, age: float | None, minute: int, day: object, dli: float | None) -> str | None:
        """One automatic decision. The evening top-up is asked again at every tick, and starts anew each local day."""
        site = self.site
        lux, age, dli = (None if x is None or x != x else x for x in (lux, age, dli))
        if day != self.day:
            self.extend, self.day = False, day
        if site.lamp_end <= minute < site.extend_end and dli is not None:
            self.extend = dli < site.dli_target
        if t < self.manual_until or t - self.last_switch < site.min_hold_s:
            return None
        inside = site.lamp_start <= minute < (site.extend_end if self.extend else site.lamp_end)
        blind = lux is None or age is None or age > site.stale_s
        want = inside and (blind or lux < site.lux_on_below or (self.on and lux <= site.lux_off_above))
        if want == self.on:
            return None
        self.on, self.last_switch = want, t
        return "ON" if want else "OFF"

    def feed(self, rows: pd.DataFrame) -> Iterator[tuple[object, str, str]]:
        """(time, state, source) of the switches that rows in time order cause."""
        zone = rows["time"].dt.tz
        seconds = (rows["time"] - pd.Timestamp(0, tz=zone)).dt.total_seconds()
        for when, t, kind, lux, age, minute, day, dli, cmd in zip(rows["time"], seconds, *(rows[c] for c in ("kind", "lux", "lux_age_s", "minute", "local_day", "dli", "cmd")), strict=True):
            state = self.command(t, cmd) if kind == "cmd" else self.tick(t, lux, age, minute, day, dli)
            if state:
                yield when, state, "manual" if kind == "cmd" else "auto"


def night_cut(site: Site = SITE, settle_s: int = 0) -> int | None:
    """The minute after local midnight at which days of the controller are cut: deep in the night, with `settle_s` and an hour (for
    clock changes) of night on either side. None if the night is too short for that, or if a command doesn't outlast a hold.
    """
    begun = max(site.lamp_end, site.extend_end)
    night = 1440 + site.lamp_start - begun
    if begun > 1440 or site.min_hold_s > site.manual_hold_s or night < 120 + settle_s / 60:
        return None
    return begun + int(night + settle_s / 60) // 2 - 1440


def in_stretches(rows: DataFrame, site: Site = SITE, location: str = "location", settle_s: int | None = None) -> DataFrame:
    """Cuts each location's rows where the lamp's state is known whatever came before.

    At night the lamp is off once holds are over, and a command sets it whatever it was. So of a day's start at the
    cut, the `settle_s` before it tell all: either a command lies in there, or a tick after the last possible hold that is itself a
    hold away from the cut. A day without both goes on with the one before. Adds `__from` (a stretch's start, null for a
    location's first) and `__warm` (a copy of a row before the start, fed but not told).
    """
    hold = max(site.manual_hold_s, site.min_hold_s)
    settle_s = 2 * hold + 20 * site.tick_s if settle_s is None else settle_s
    cut = night_cut(site, settle_s)
    if cut is None:
        return rows.withColumns({"__from": F.lit(None).cast("timestamp"), "__warm": F.lit(False)})
    of = lambda at: F.to_date(F.from_utc_timestamp(at - F.expr(f"INTERVAL {cut} MINUTES"), site.tz))
    start_of = lambda day: F.to_utc_timestamp(day.cast("timestamp"), site.tz) + F.expr(f"INTERVAL {cut} MINUTES")
    own = rows.withColumns({KEY: F.struct(location), "__day": of(F.col("time"))})
    # A row shortly before the next day's start also counts for that one.
    ahead = start_of(F.date_add("__day", 1))
    left = (F.unix_micros(ahead) - F.unix_micros("time")) / 1e6
    tells = F.when(left <= settle_s, (F.col("kind") == "cmd") | left.between(site.min_hold_s, settle_s - hold))
    days = own.groupBy(KEY, "__day").agg(F.coalesce(F.bool_or(tells), F.lit(False)).alias("__tells"))
    over = W.partitionBy(KEY).orderBy("__day")
    fresh = F.coalesce(F.lag("__tells").over(over) & (F.lag("__day").over(over) == F.date_sub("__day", 1)), F.lit(False))
    days = days.withColumn("__fresh", fresh)
    begins = F.last(F.when(F.col("__fresh"), start_of(F.col("__day"))), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, 0))
    days = days.select(KEY, "__day", begins.alias("__from"), F.lead("__fresh").over(over).alias("__next"))
    placed = own.join(days, [KEY, "__day"]).withColumn("__warm", F.explode(F.when((left <= settle_s) & F.col("__next"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return placed.withColumn("__from", F.when(F.col("__warm"), ahead).otherwise(F.col("__from"))).drop(KEY, "__day", "__next")


def replay_light(ticks: DataFrame, site: Site = SITE, location: str = "location", settle_s: int | None = None) -> DataFrame:
    """Replays the lamp controller over prepared ticks, one sequence a stretch: a location's rows are cut every night (in_stretches).

    Rows are ticks or commands: (location, time, kind 'tick'/'cmd', lux, lux_age_s, minute, local_day, dli,
    cmd). Switching always succeeds. Output: (location, time, state, source), one row a switch. A stretch's rows
    are read in time order batch by batch, with the state carried, so nothing has to fit in memory.
    """
    parts = [location, "__from"]
    ordered = in_stretches(ticks, site, location, settle_s).repartition(*parts).sortWithinPartitions(*parts, "time", "kind")
    schema = T.StructType([ticks.schema[location], T.StructField("time", T.TimestampType()), T.StructField("state", T.StringType()), T.StructField("source", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, lamp = None, Lamp(site)
        for batch in batches:
            out = []
            for (place, start), rows in batch.groupby(parts, sort=False, dropna=False):
                if (str(place), str(start)) != here:
                    here, lamp = (str(place), str(start)), Lamp(site)
                name = rows[location].iloc[0] if pd.notna(place) else None
                out += [(name, *switch) for switch in lamp.feed(rows) if start is pd.NaT or switch[0] >= start]
            yield pd.DataFrame({c: pd.Series(list(v), dtype="datetime64[us]" if c == "time" else object) for c, v in zip([location, "time", "state", "source"], zip(*out) if out else [()] * 4)})

    return ordered.mapInPandas(run, schema)


def control_stream(ticks: DataFrame, site: Site = SITE, location: str = "location") -> DataFrame:
    """The controller over a stream of prepared ticks and commands: its state is kept a location between batches.

    Rows of a batch are taken in time order; rows that come after later ones of an earlier batch are taken when they come.
    """
    schema = f"{location} {ticks.schema[location].dataType.simpleString()}, time timestamp, state string, source string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lamp = Lamp(site)
        if state.exists:
            on, manual, last, extend, day = state.get
            lamp = Lamp(site, on, manual, last, extend, day and date.fromisoformat(day))
        rows = pd.concat(list(batches)).sort_values(["time", "kind"], kind="stable")
        out = [(*key, *switch) for switch in lamp.feed(rows)]
        state.update((lamp.on, lamp.manual_until, lamp.last_switch, lamp.extend, lamp.day and str(lamp.day)))
        yield pd.DataFrame(out, columns=[location, "time", "state", "source"])

    return ticks.groupBy(location).applyInPandasWithState(step, schema, "on boolean, manual double, last double, extend boolean, day string", "append", GroupStateTimeout.NoTimeout)
