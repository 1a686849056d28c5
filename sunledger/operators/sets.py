"""Unions, differences and distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_labelled(**parts: DataFrame) -> DataFrame:
    """Frames under one roof, each row labelled with its part's name."""
    return reduce(DataFrame.unionByName, (df.withColumn("k", F.lit(k)) for k, df in parts.items()))


def union_columns(*parts: DataFrame) -> DataFrame:
    """Frames with different columns; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stale_refs(current: DataFrame, expected: DataFrame, key: str = "topic") -> DataFrame:
    """Keys that are retained but no longer expected. Nothing expected is a fault, not an order to clear all."""
    if expected.isEmpty():
        raise ValueError("nothing is expected: refusing to call everything stale")
    return current.select(key).distinct().join(expected.select(key), key, "left_anti")
