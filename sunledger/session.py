"""A session set up the way the jobs expect: UTC, adaptive execution."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "sunledger", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for what jobs store on the way, from spark.checkpoint.dir.

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


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder once: whatever is lost later, every reader sees the same rows in the same pieces."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
