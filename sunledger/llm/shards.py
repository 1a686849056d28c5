"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row gets a dense number 0..n-1 in a fixed order. A keyed Feistel network permutes the numbers:
numbers that leave 0..n-1 are walked through it again until they come back. Shard and slot are
the remainder and the quotient of the permuted number, so both can be computed for any row
number without looking at other rows, shard sizes differ by one at most, and the order of the rows
inside a shard is a shuffle that the key reproduces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import text_of

#: Rows are numbered inside this many hash buckets, then across them. Part of the fixed order: changing it changes the numbers.
BUCKETS = 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser; any fixed well-mixing function serves as the round function."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A permutation of 0..n-1, and its inverse."""

    def __init__(self, n: int, seed: int = 7, rounds: int = 6) -> None:
        self.n, self.keys = n, [seed * 1000 + i for i in range(rounds)]
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (_mix(right, key) & self.mask)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ (_mix(left, key) & self.mask), left
        return (left << self.half) | right

    def _walk(self, numbers: np.ndarray, step) -> np.ndarray:
        out = step(numbers.astype(np.uint64))
        while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[far] = step(out[far])
        return out.astype(np.int64)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._once)

    def inverse(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._back)


def number_rows(df: DataFrame, order: list[str], to: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Adds dense global numbers from 0: by hash bucket of the `order` columns, then by those columns.

    No sampling and no sort in one task: a number is its rank in its bucket plus the sizes of the
    buckets before, and the table of those sizes has `buckets` rows whatever the input. Rows that
    agree in all `order` columns are interchangeable.
    """
    keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(W.partitionBy("__bucket").orderBy(*order)) - 1
    # The broadcast side has at most `buckets` rows.
    return keyed.withColumn("__rank", rank).join(F.broadcast(starts), "__bucket").withColumn(to, (F.col("__start") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__start")


def assign_shards(df: DataFrame, order: list[str], shards: int = 24, seed: int = 7) -> DataFrame:
    """Adds row_number, shard and slot to the columns of `df`; columns that have these names already are replaced.

    Shard sizes differ by one at most (the law `rows`); slots are gapless from 0 in each shard. Nulls
    in any column are ordinary values. Repeated rows get numbers of their own. An empty table
    gives an empty result.
    """
    if clash := {"row_number", "shard", "slot"} & set(order):
        raise ValueError(f"rows can't be ordered by columns that are replaced: {sorted(clash)}")
    numbered = number_rows(df.drop("row_number", "shard", "slot"), order)
    permute = Feistel(max(1, df.count()), seed)
    schema = T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=[*batch.schema.names, "shard", "slot"])

    return numbered.mapInArrow(place, schema)


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus 8, and the CRC of the bytes; a null text has none."""
    raw = text_of(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def shard_digest(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Where each document goes, without moving any text."""
    placed = assign_shards(with_digest(docs), ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 7, format: str = "parquet") -> None:
    """Writes whole documents under shard=N folders, rows in slot order within each task's file."""
    base = docs.withColumns({"__size": F.octet_length(text_of("text")), "__crc": F.crc32(text_of("text").cast("binary"))})
    placed = assign_shards(base, ["doc_id", "__size", "__crc"], shards, seed).drop("__size", "__crc", "row_number")
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").format(format).save(path)
