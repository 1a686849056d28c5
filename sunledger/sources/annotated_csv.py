"""Annotated CSV with several blocks: a comment line ends a block, the next line is its header."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DROPPED = ("result", "table", "_start", "_stop", "")


def read_cells(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, row, column, value): every non-empty cell, whatever the columns of its block.

    The header is state that runs through a file, so a file is read by one task, row by row; files
    are spread over tasks.
    """
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return cells(files)


def cells(files: DataFrame) -> DataFrame:
    """The same from a frame of (path, value), value being a whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"], strict=True):
                header, out = None, []
                for number, row in enumerate(csv.reader((text or "").splitlines())):
                    if not row or row[0].startswith("#"):
                        header = None if row else header
                    elif header is None:
                        header = row
                    else:
                        out += [(path, number, c, v) for c, v in zip(header, row, strict=False) if c not in DROPPED and v]
                yield pd.DataFrame(out, columns=["path", "row", "column", "value"])

    return files.mapInPandas(run, "path string, row bigint, column string, value string")


def read_annotated_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One table with the union of all blocks' columns; columns that are empty throughout don't appear."""
    return read_cells(spark, paths).groupBy("path", "row").pivot("column").agg(F.first("value"))
