"""Mixing sources to target weights: repetition rates per source, whole copies plus one drawn copy.

Words are summed per source; a source's share of the wanted total follows its weight, but never
exceeds a multiple of what it has, and what such a limit frees is shared again by weight. That
fixed point has a closed form over the sources ordered by the level at which each one fills up,
so no iteration is needed. A document of a source with rate r is taken floor(r) times, and once
more if a hash of its id falls below the rest of r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, as_row, cut, row_again, shuffle_partitions, text_of

WEIGHTS = (3, 1, 2)
#: Up to so many sources (a few MB) one task puts them in order and their targets are broadcast; beyond, both go by ranges and shuffles, with the same result.
FEW_SOURCES = 20_000


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column], ranges: int | None) -> DataFrame:
    """Adds, for each name, the sum of a column over all rows before this one in `order`, which has no ties.

    With `ranges` no task gets all rows: they are dealt by ranges of the order, summed inside a range, and the table of what lies
    before a range has a row a range. Without, one task sums them.
    """
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if ranges is None:
        return rows.withColumns({name: F.coalesce(F.sum(x).over(before), F.lit(0)) for name, x in sums.items()})
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    inside, ahead = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    each = dealt.groupBy("__range").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    starts = each.select("__range", *(F.coalesce(F.sum(name).over(ahead), F.lit(0)).alias(f"__{name}") for name in sums))
    found = dealt.join(F.broadcast(starts), "__range").withColumns({name: F.col(f"__{name}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for name, x in sums.items()})
    return found.drop("__range", *(f"__{name}" for name in sums))


def _targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """The table of source_targets, and its number of rows."""
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    n, words = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ranges, by_name, turns = shuffle_partitions(sizes.sparkSession) if n > FEW_SOURCES else None, F.col("source").asc_nulls_last(), len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % turns + 1).cast("int")).cast("double")
    weighed = sums_before(totals, [by_name], {"turn": F.lit(1)}, ranges).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    weighed = weighed.withColumn("fills_at", F.col("cap") / F.col("weight"))
    all_weights = float(sum(weights) * (n // turns) + sum(weights[: n % turns]))
    level = (F.lit(words * share) - F.col("cap_below")) / (F.lit(all_weights) - F.col("weight_below"))
    ranked = sums_before(weighed, [F.col("fills_at").asc(), by_name], {"cap_below": F.col("cap"), "weight_below": F.col("weight")}, ranges).withColumn("level", level)
    still_open = F.col("fills_at") > F.col("level")
    at = F.lit(ranked.filter(still_open).agg(F.max("level")).first()[0]).cast("double")
    target = F.when(still_open, F.least(F.col("weight") * at, F.col("cap"))).otherwise(F.col("cap"))
    done = ranked.withColumn("target", target)
    return done.select("source", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate")), n


def source_targets(sizes: DataFrame, **targets) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size): one row a source."""
    return _targets(sizes, **targets)[0]


def drawn(id_col: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", **targets) -> DataFrame:
    """Adds __size, __source_size, __target and __copies to `docs`.

    A null text has no words; a null source is a source of its own, ordered last. A document is
    taken at most ceil(rate) times, so never beyond the multiple that limits its source. Rows repeated
    with the same id share one draw. An empty table gives an empty result.
    """
    sized = docs.withColumn("__size", words_in(text_of(text_col)))
    found, n = _targets(sized.select(F.col(source_col).alias("source"), F.col("__size").alias("size")), **targets)
    found = found.select(*(F.col(c).alias(f"__{c}") for c in found.columns))
    # The targets are broadcast only if they are few; more sources are joined by a shuffle, which adaptive execution splits where one source is hot.
    if n <= FEW_SOURCES:
        found = F.broadcast(found)
    rate = F.col("__rate")
    copies = (F.floor(rate) + (drawn(id_col, seed) < rate - F.floor(rate)).cast("long")).cast("long")
    return sized.join(found, sized[source_col].eqNullSafe(found["__source"])).withColumn("__copies", copies).drop("__source", "__rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows, copies repeated, with the columns of `docs`, whatever their names."""
    packed = docs.select(as_row(docs).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    planned = with_copies(packed, **options)
    repeated = planned.filter("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))))
    return repeated.select(*row_again(docs))
