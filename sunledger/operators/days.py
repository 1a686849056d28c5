"""Ordered windows that never hold a key's whole history: partitions are a key and day, and what reaches over days is carried.

A day's edge rows (or last values) are one row a key and day, from an aggregate that is combined before the shuffle; only those few
rows are put in order over all days of a key. Rows without a time come before all others. Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Names = Sequence[str]

KEY, DAY = "__key", "__day"
#: Tasks for each configured shuffle partition where a task holds all of its rows.
FINER = 4


def dated(df: DataFrame, by: Names, time: str, days: int = 1) -> DataFrame:
    """Adds the key as one column, so that nulls in it join, and the UTC day, or the first of each stretch of so many days.

    Keys with a row now and then take long stretches: with one row a day, a table of days would be no smaller than the rows.
    """
    day = F.to_date(time) if days == 1 else F.date_from_unix_date((F.floor(F.unix_date(F.to_date(time)) / days) * days).cast("int"))
    return df.withColumns({KEY: F.struct(*by), DAY: F.coalesce(day, F.lit("0001-01-01").cast("date"))})


def dealt(df: DataFrame, *names: str) -> DataFrame:
    """The rows dealt by these columns over FINER times as many tasks as configured, which adaptive execution never merges."""
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)


def with_neighbours(df: DataFrame, by: Names, columns: Names, order: Names = ("time",), before: str | None = None, after: str | None = None, time: str = "time") -> DataFrame:
    """Adds the struct of `columns` of the row before and of the row after, under the given names; null where there is none.

    The order starts with the time.
    """
    own, row, rank = dated(df, by, time), F.struct(*columns), F.struct(*order)
    edges = own.groupBy(KEY, DAY).agg(F.min_by(row, rank).alias("__first"), F.max_by(row, rank).alias("__last"))
    days, inside = W.partitionBy(KEY).orderBy(DAY), W.partitionBy(KEY, DAY).orderBy(*order)
    found = {name: (step, far) for name, step, far in ((before, F.lag, "__earlier"), (after, F.lead, "__later")) if name}
    # Before the join: the order of the windows serves a merge join too, so that a task puts its rows in order once.
    near = dealt(own, KEY, DAY).withColumns({name: step(row).over(inside) for name, (step, _) in found.items()})
    joined = near.join(edges.select(KEY, DAY, F.lag("__last").over(days).alias("__earlier"), F.lead("__first").over(days).alias("__later")), [KEY, DAY])
    return joined.withColumns({name: F.coalesce(name, far) for name, (_, far) in found.items()}).drop(KEY, DAY, "__earlier", "__later")


def carried(df: DataFrame, by: Names, value: Column, to: str, order: Names = ("time",), time: str = "time", forward: bool = True) -> DataFrame:
    """Adds the last value that isn't null up to this row; with forward=False the first one in later rows."""
    own = dated(df, by, time).withColumn("__value", value)
    rank = F.when(F.col("__value").isNotNull(), F.struct(*order))
    edge = (F.max_by if forward else F.min_by)("__value", rank)
    days = own.groupBy(KEY, DAY).agg(edge.alias("__edge"))
    # Looking ahead is looking back in the opposite order: a frame that shrinks from row to row would be read anew for each of them.
    turn = F.asc if forward else F.desc
    across, inside = W.partitionBy(KEY).orderBy(turn(DAY)), W.partitionBy(KEY, DAY).orderBy(*map(turn, order))
    far = F.last("__edge", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1))
    near = F.last("__value", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0 if forward else -1))
    joined = own.join(days.select(KEY, DAY, far.alias("__far")), [KEY, DAY])
    return joined.withColumn(to, F.coalesce(near, "__far")).drop(KEY, DAY, "__value", "__far")


def with_runs(df: DataFrame, by: Names, columns: Names, new: Callable[[Column, Column], Column], order: Names = ("time",), time: str = "time", days: int = 1) -> DataFrame:
    """Adds `__before` (the struct of `columns` of the row before, null for a key's first), `__new` (whether a run begins here), `__since`
    (when this row's run began) and `__since_before` (when that of the row before did).

    A run begins where `new` says so of the row before and this one, given as such structs, and with a key's first row. `columns` include
    the time. One table of a row a key and day (its first and last row, and its last beginning) carries all of it over days, so the
    rows are dealt once, by key and day.
    """
    row, rank, inside, over = F.struct(*columns), F.struct(*order), W.partitionBy(KEY, DAY).orderBy(*order), W.partitionBy(KEY).orderBy(DAY)
    marked = dated(df, by, time, days).withColumn("__prev", F.lag(row).over(inside)).withColumn("__break", F.when(F.col("__prev").isNotNull(), F.coalesce(new(F.col("__prev"), row), F.lit(False))))
    edges = marked.groupBy(KEY, DAY).agg(F.min_by(row, rank).alias("__first"), F.max_by(row, rank).alias("__last"), F.max(F.when(F.col("__break"), F.col(time))).alias("__broke"))
    edges = edges.withColumn("__earlier", F.lag("__last").over(over)).withColumn("__opens", F.coalesce(F.when(F.col("__earlier").isNotNull(), F.coalesce(new(F.col("__earlier"), F.col("__first")), F.lit(False))), F.lit(True)))
    ends = F.coalesce("__broke", F.when(F.col("__opens"), F.col(f"__first.{time}")))
    edges = edges.select(KEY, DAY, "__earlier", "__opens", F.last(ends, ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("__entry"))
    joined = marked.join(edges, [KEY, DAY]).withColumn("__new", F.coalesce("__break", "__opens"))
    begun = F.coalesce(F.last(F.when(F.col("__new"), F.col(time)), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "__entry")
    found = joined.withColumn("__since", begun).withColumns({"__since_before": F.coalesce(F.lag("__since").over(inside), "__entry"), "__before": F.coalesce("__prev", "__earlier")})
    return found.drop(KEY, DAY, "__prev", "__break", "__earlier", "__opens", "__entry")


#: Rows of a key that make one part.
PART = 50_000


def in_parts(df: DataFrame, by: Names, before: int, order: Names = ("time",), time: str = "time", rows: int = PART) -> tuple[DataFrame, list[str]]:
    """Cuts each key's ordered rows into parts of `rows`, each with copies of the `before` rows that precede it.

    Returns the frame and the columns that name a part: windows over them that look back `before` rows at most see what they
    would see over the whole key. Copies have `__copy` true and are to be dropped afterwards. A row's number is its place in its
    day plus the rows of the days before.
    """
    if before >= rows:
        raise ValueError(f"a part of {rows} rows can't be preceded by {before}")
    own = dated(df, by, time)
    counts = own.groupBy(KEY, DAY).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.partitionBy(KEY).orderBy(DAY).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy(KEY, DAY).orderBy(*order)) - 1 + F.col("__earlier")
    numbered = own.join(counts.select(KEY, DAY, earlier.alias("__earlier")), [KEY, DAY]).withColumn("__at", place)
    part = F.floor(F.col("__at") / rows).cast("long")
    copies = F.when(F.col("__at") % rows >= rows - before, F.array(part, part + 1)).otherwise(F.array(part))
    spread = numbered.withColumn("__home", part).withColumn("__part", F.explode(copies))
    return spread.withColumn("__copy", F.col("__part") != F.col("__home")).drop(DAY, "__earlier", "__home", "__at"), [KEY, "__part"]


def without_parts(df: DataFrame) -> DataFrame:
    """The rows themselves, after windows over in_parts."""
    return df.filter("NOT __copy").drop(KEY, "__part", "__copy")
