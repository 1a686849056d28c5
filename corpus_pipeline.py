"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, extra ones included. Each works on all that its predecessor kept.

Null and empty texts, and texts that the network finds more like scrambled letters and signs than like any language, go in the
first stage; where lang is null, its label takes the place. Rows with a null id are documents like others; of rows repeated with one id one stays. Null sources
are one source. An empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sunledger.llm import exact_dedup, langid, mixing, packing, simhash
from sunledger.llm.common import read, remove, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network recognises no language go."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that fingerprints link, the one with the smallest id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until each source has its share."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID, SimHash components and packing aren't expressible in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if k:  # what the stage has read is needed no more
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
