"""Writing points: idempotent upserts, deletes by predicate, append-only logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import instant


def upsert_points(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Merges field by field: a new value replaces the old one, a field that the new row lacks stays.

    Of several new rows of one key the last by `order` counts, then the one with the largest fields: one and the same for all
    fields that it has, whatever the partitioning.
    """
    fields = [c for c in dict.fromkeys([*base.columns, *new.columns]) if c not in keys]
    both = base.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    ranked = [c for c in dict.fromkeys([*order, *fields]) if both.schema[c].dataType.typeName() not in ("map", "variant")]
    rank = F.struct("__seq", *ranked)
    return both.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields))


def write_days(df: DataFrame, path: str, day: str = "local_day", partition: Sequence[str] = ("measurement",)) -> None:
    """Overwrites the days that `df` holds and leaves the others."""
    keys = [*partition, day]
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def delete_where(df: DataFrame, predicate: Column, start: datetime, stop: datetime, time: str = "time") -> DataFrame:
    """Drops matching rows of [start, stop). Rows on which the predicate is null stay."""
    hit = predicate & (F.col(time) >= instant(start)) & (F.col(time) < instant(stop))
    return df.filter(~F.coalesce(hit, F.lit(False)))


def append_audit(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Appends rows with a fixed set of columns as CSV."""
    df.select(*columns).write.mode("append").option("header", True).csv(path)
