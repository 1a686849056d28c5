"""Centroid clustering: the nearest centroid by progressive search over Walsh-Hadamard coefficients.

The transform of integer vectors is exact (sums and differences), and squared distances between
transforms are 64 times those between vectors, summed coefficient by coefficient. So the sum over the
first, coarse coefficients is a lower bound. A vector's nearest centroid by the coarse coefficients is
finished first; a centroid whose partial sum is strictly above that whole distance is out, and those
that remain go on to finer coefficients, the last of them through all 64. Ties survive, so the smaller
number wins as in a plain search.

Tasks keep nothing but the batch at hand and 16 sums. The driver gets 16 centroids a round: never more,
however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import as_long, integers, takes_part

WIDTH, SCALE = 64, 64
#: How many coefficients are summed before centroids are left out.
LEVELS = (4, 8, 16, 32, 64)
#: Integers below this keep every sum of the search inside int64: 64 coefficients, each up to 64 * 2 * SMALL, squared.
SMALL = 2**21


def _coarse_first() -> np.ndarray:
    """The order of Walsh functions by their number of sign changes."""
    signs = np.array([[1]])
    while len(signs) < WIDTH:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = _coarse_first()


def transform(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row, coarse coefficients first. Exact for int64 and for Python's integers."""
    x, half = x.copy(), 1
    while half < WIDTH:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), WIDTH)
        half *= 2
    return x[:, ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row of x, and how many coefficient differences were summed."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    vectors, points, n, k = transform(x), transform(centroids), len(x), len(centroids)
    row, number = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    below, work = np.zeros(n * k, vectors.dtype), 0
    limit = None
    for low, high in zip((0, *LEVELS), LEVELS):
        below = below + ((vectors[row, low:high] - points[number, low:high]) ** 2).sum(axis=1)
        work += len(row) * (high - low)
        if limit is None:  # the nearest by the coarse coefficients is finished: its whole distance is the limit
            first = below.reshape(n, k).argmin(axis=1)
            limit = ((vectors - points[first]) ** 2).sum(axis=1)
            work += n * WIDTH
        if high < WIDTH:
            stays = (below <= limit[row]).astype(bool)
            row, number, below = row[stays], number[stays], below[stays]
    order = np.lexsort((number, below, row)) if below.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], below[i], number[i])), dtype=np.int64)
    firsts = order[np.searchsorted(row[order], np.arange(n))] if n else order
    return number[firsts].astype(np.int32), below[firsts] // WIDTH, work


def _sums(centroids: np.ndarray):
    """For mapInArrow: (cluster, place, total), the sums of a task's vectors; place 64 is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), WIDTH + 1), object)
        for batch in batches:
            x = integers(batch.column("vector"), SCALE, WIDTH)
            cluster, _, _ = nearest(x, centroids)
            wide = x if np.abs(x).max(initial=0) < SMALL else x.astype(object)
            for c in np.unique(cluster):
                own = wide[cluster == c]
                sums[c, :WIDTH] += own.sum(axis=0).astype(object)
                sums[c, WIDTH] += len(own)
        at, place = np.nonzero(sums)
        total = pa.array([str(v) for v in sums[at, place]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), total], ["cluster", "place", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(integers(batch.column("vector"), SCALE, WIDTH), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), as_long(distance)], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests. A null id counts as empty; of rows with one id, those with smaller vectors come first."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = kept.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return integers(pa.array([r["vector"] for r in found], pa.list_(pa.float64())), SCALE, WIDTH) if found else np.zeros((0, WIDTH), np.int64)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; a centroid without vectors stays."""
    sums = kept.mapInArrow(_sums(centroids), "cluster int, place int, total string").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in sums.collect()}  # at most k * 65 rows
    return np.array([[found.get((c, p), 0) // n if (n := found.get((c, WIDTH), 0)) else int(centroids[c, p]) for p in range(WIDTH)] for c in range(len(centroids))], np.int64)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for every vector that takes part.

    Vectors with other than 64 components, null vectors and those with a component that is null, not
    finite or so large that 64 times it leaves a long take no part. Repeated rows count each. With fewer
    than k vectors there are as many centroids as vectors. A distance or sum that a long can't hold is
    null, though the choice of the centroid is exact. Other columns are ignored, so their names can't
    clash. An empty table gives an empty result.
    """
    vector = F.col(vector_col)
    kept = rows.filter((F.size(vector) == WIDTH) & takes_part(vector, SCALE)).select(F.col(id_col).alias("vec_id"), vector.alias("vector"))
    centroids = first_centroids(kept, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(kept, centroids)
    told = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = rows.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    kind = rows.schema[id_col].dataType.simpleString()
    if not told:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).limit(0)
    found = cut(kept.mapInArrow(_assign(centroids), f"vec_id {kind}, cluster int, distance long"))
    # try_sum leaves nulls out, so a null distance makes its sums null by name.
    whole = lambda x: F.when(F.count_if(F.col(x).isNull()) == 0, F.try_sum(x))
    sums = found.groupBy("cluster").agg(whole("distance").alias("cluster_inertia"))
    total = sums.agg(whole("cluster_inertia")).first()[0]
    each = sums.join(named, "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
