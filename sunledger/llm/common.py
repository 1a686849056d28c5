"""What the training-data operators share: reading, fixed column names, cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_row(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct: beside it an operator's own columns can't clash with any name."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns))


def row_again(docs: DataFrame, row: str = "row") -> list[Column]:
    """The columns of such a struct, as they were."""
    return [F.col(f"{row}.{quoted(c)}").alias(c) for c in docs.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints, from spark.checkpoint.dir.

    Only a session in one process, where any folder is shared, gets one of its own if it has none.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="sunledger-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def list_sizes(spark: SparkSession, folder: str, prefix: str) -> list[tuple[str, int]]:
    """(path, bytes) of what lies in a folder and whose name begins so; nothing if there is no such folder."""
    where, system = _at(spark, folder)
    found = system.listStatus(where) if system.exists(where) else []
    own = [f.getPath() for f in found if f.getPath().getName().startswith(prefix)]
    return [(p.toString(), system.getContentSummary(p).getLength()) for p in own]


def remove(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)
