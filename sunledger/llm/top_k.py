"""Exact top-k search by inner product: a ball tree per shard, branch and bound, shared k-th scores.

Vectors are dealt over shards of a bounded size by a hash, so every shard looks alike whatever the data.
A shard's task builds a ball tree of its distinct vectors; equal vectors are one leaf entry with their
smallest ids, so a vector that a third of all rows repeat costs a search what any other does. Queries
come past in batches: the tree's nodes are taken in the order of their upper bound, centre times query
plus radius times the query's length, and a node below the query's k-th score so far is left out.

The k-th score is shared between shards: each query first searches one shard (one in eight serve for
that), and what it finds there goes with it into all the others, which return only what isn't below.
Queries are never held whole; they stream through a shard's task in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shuffle_partitions
from .vectors import integers, takes_part

SCALE = 1024
#: Vectors a shard, on average: some 60 MB in a task for 64 components.
SHARD = 65_536
LEAF = 96
#: Queries searched together.
BATCH = 2048
#: Float64 sums of products are exact below this.
EXACT = 2.0**53
FOUND = "query_row long, query_id long, vec_id long, score long"


class BallTree:
    """A ball tree of integer vectors with ids; equal vectors share an entry that keeps their smallest ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int):
        # Ids in ascending order, none last: the order of ties.
        by_id = np.lexsort((ids, none))
        vectors, ids, none = vectors[by_id], ids[by_id], none[by_id]
        _, first, entry = np.unique(np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel() if vectors.shape[1] else np.zeros(len(vectors)), return_index=True, return_inverse=True)
        entry = entry.ravel()
        fresh = np.ones(len(ids), bool)
        inside = np.lexsort((np.arange(len(ids)), entry))
        e, i, m = entry[inside], ids[inside], none[inside]
        fresh[1:] = (e[1:] != e[:-1]) | (i[1:] != i[:-1]) | m[1:]  # another id
        runs = np.cumsum(fresh)
        start = np.searchsorted(e, np.arange(len(first)))
        kept = runs - runs[start][e] <= k  # rows of the k + 1 smallest different ids: one of them may be a query's own
        if kept.any():
            seen = np.arange(len(e)) - np.maximum.accumulate(np.where(fresh, np.arange(len(e)), 0))
            kept &= seen < k  # of rows repeated with one id k are enough
        e, self.ids, self.none = e[kept], i[kept], m[kept]
        self.vectors = vectors[first].astype(np.float64)
        order, leaves, nodes = np.arange(len(first)), [], []
        stack = [(0, len(first))] if len(first) else []
        while stack:
            low, high = stack.pop()
            own = self.vectors[order[low:high]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            nodes.append((low, high, centre, away.max(), -1))
            if high - low <= LEAF:
                leaves.append(len(nodes) - 1)
                continue
            # Two vectors far from each other; the rest go to the nearer one, or by halves where one of them would get next to nothing.
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            along = own @ (other - one)
            nearer = along < (other @ other - one @ one) / 2
            middle = int(nearer.sum())
            if min(middle, high - low - middle) * 16 < high - low:
                middle = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(along, middle)]
            nodes[-1] = (*nodes[-1][:4], low + middle)
            stack += [(low + middle, high), (low, low + middle)]
        self.centres, self.radii = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        self.spans = np.array([n[:2] for n in nodes], np.int64).reshape(-1, 2)
        self.leaf = np.zeros(len(nodes), bool)
        self.leaf[leaves] = True
        # Children: nodes are in preorder, so the first child follows at once and the second where the first one's span ends.
        at = {n[:2]: i for i, n in enumerate(nodes)}
        self.second = np.array([-1 if n[4] < 0 else at[n[4], n[1]] for n in nodes], np.int64)
        self.order, self.entry_at = order, np.searchsorted(e, np.arange(len(first) + 1))
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def _leaves_above(self, queries: np.ndarray, lengths: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, upper bound) of all leaves that no bound on the way rules out."""
        row, node, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(row):
            # The slack is above what rounding can take away, so a bound is never too low.
            bound = np.empty(len(row))
            for n in np.unique(node):
                own = node == n
                dot, far = queries[row[own]] @ self.centres[n], lengths[row[own]] * self.radii[n]
                bound[own] = dot + far + 1e-9 * (np.abs(dot) + far + lengths[row[own]] * np.sqrt((self.centres[n] ** 2).sum())) + 1e-6
            stays = bound >= limit[row]
            row, node, bound = row[stays], node[stays], bound[stays]
            ends = self.leaf[node]
            found.append((row[ends], node[ends], bound[ends]))
            row, node = row[~ends], node[~ends]
            row, node = np.concatenate([row, row]), np.concatenate([node + 1, self.second[node]])
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    def search(self, queries: np.ndarray, own_ids: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, id, id is null, score): for each query its k best of this tree, as far as they aren't below its limit."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))
        if not len(self.spans) or not len(queries):
            return none
        queries = queries.astype(np.float64)
        if float(np.abs(queries).max(initial=0)) * self.largest * max(1, queries.shape[1]) >= EXACT:
            return self._plain(queries, own_ids, limit, k)
        limit = limit.copy()
        row, leaf, bound = self._leaves_above(queries, np.sqrt((queries**2).sum(axis=1)), limit)
        order = np.lexsort((-bound, row))
        row, leaf, bound = row[order], leaf[order], bound[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)  # 0 for the leaf with the highest bound
        best, step, upto = none, 0, 1
        while len(row):
            now = turn < upto  # first one leaf a query, then two, four and so on more
            pairs = [best]
            r, n = row[now], leaf[now]
            by_leaf = np.argsort(n, kind="stable")
            r, n = r[by_leaf], n[by_leaf]
            for s in np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else ():
                rows = r[s : np.searchsorted(n, n[s], "right")]
                pairs.append(self._scan(queries, rows, own_ids, n[s], limit, k))
            best = _best(*(np.concatenate(x) for x in zip(*pairs)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) >= k)
            last = np.searchsorted(best[0], full, "right") - 1
            limit[full] = np.maximum(limit[full], best[3][last])
            stays = ~now & (bound >= limit[row])
            row, leaf, bound, turn = row[stays], leaf[stays], bound[stays], turn[stays]
            step += 1
            upto += 2**step
        return best

    def _scan(self, queries, rows, own_ids, node, limit, k):
        entries = self.order[self.spans[node, 0] : self.spans[node, 1]]
        scores = queries[rows] @ self.vectors[entries].T
        least = limit[rows]
        if scores.shape[1] > k + 1:  # an entry whose only id is the query's own may be above
            least = np.maximum(least, np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)])
        a, b = np.nonzero(scores >= least[:, None])
        return self._spell(rows[a], entries[b], scores[a, b], own_ids)

    def _spell(self, rows, entries, scores, own_ids):
        """A row for every id of the entries but the query's own."""
        many = self.entry_at[entries + 1] - self.entry_at[entries]
        at = np.repeat(self.entry_at[entries] - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows, scores = np.repeat(rows, many), np.repeat(scores, many)
        other = self.none[at] | (self.ids[at] != own_ids[rows])
        return rows[other], self.ids[at][other], self.none[at][other], scores[other]

    def _plain(self, queries, own_ids, limit, k):
        """With components so large that float64 isn't exact: all entries, in Python's integers."""
        exact, found = self.vectors.astype(object), []
        exact = np.array([[int(v) for v in x] for x in exact], object).reshape(exact.shape)
        for q in range(len(queries)):
            scores = exact @ np.array([int(v) for v in queries[q]], object) if exact.shape[1] else np.zeros(len(exact), object)
            found.append(self._spell(np.full(len(scores), q), np.arange(len(scores)), scores, own_ids))
        rows, ids, none, scores = (np.concatenate(x) for x in zip(*found))
        order = sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], none[i], ids[i]))
        seen = np.zeros(len(queries), np.int64)
        kept = []
        for i in order:
            if seen[rows[i]] < k and scores[i] >= limit[rows[i]]:
                seen[rows[i]] += 1
                kept.append(i)
        return rows[kept], ids[kept], none[kept], scores[kept]


def _best(row, ids, none, scores, k):
    """The k best of each query, in order: by score, then by id, none last."""
    order = np.lexsort((ids, none, -scores, row))
    row, ids, none, scores = row[order], ids[order], none[order], scores[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], none[kept], scores[kept]


def _search_shards(k: int):
    """For mapInArrow over partitions that hold shards one after the other, each one's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, waiting = None, None, []
        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("query_row").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(shards)]):
                part = batch.slice(int(low), int(high - low))
                if shards[low] != shard:
                    shard, tree, waiting = shards[low], None, []
                if not asks[low]:
                    waiting.append(part)
                    continue
                if tree is None:
                    tree, waiting = _tree(waiting, k), []
                for start in range(0, len(part), BATCH):
                    yield _answers(tree, part.slice(start, BATCH), k)

    return run


def _few_copies(k: int):
    """For mapInArrow: of rows equal in id and vector k of each batch are enough, so rows that are repeated without end don't meet in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            _, which, counts = np.unique(place, return_inverse=True, return_counts=True)
            if len(batch) and counts.max() > k:
                kept, seen = np.ones(len(batch), bool), {}
                for i in np.flatnonzero(counts[which.ravel()] > k):
                    row = (batch.column("vec_id")[i].as_py(), tuple(batch.column("vector")[i].as_py()))
                    seen[row] = seen.get(row, 0) + 1
                    kept[i] = seen[row] <= k
                batch = batch.filter(pa.array(kept))
            yield batch

    return run


def _tree(parts: list[pa.RecordBatch], k: int) -> BallTree:
    if not parts:
        return BallTree(np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, bool), k)
    table = pa.Table.from_batches(parts).combine_chunks()
    ids = table.column("vec_id").combine_chunks()
    return BallTree(integers(table.column("vector"), SCALE), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), k)


def _answers(tree: BallTree, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    # Components that one of the two hasn't got count as zero, so the shorter width is enough.
    queries, width = integers(part.column("vector"), SCALE), tree.vectors.shape[1]
    queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
    given = part.column("limit")
    # One step down, since a float64 can be above the long that it stands for.
    limit = np.where(given.is_valid().to_numpy(zero_copy_only=False), np.nextafter(given.fill_null(0).to_numpy().astype(np.float64), -np.inf), -np.inf)
    own = part.column("vec_id").to_numpy()
    row, ids, none, scores = tree.search(queries, own, limit, k)
    long = [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores] if scores.dtype == object else scores.astype(np.int64)
    columns = [part.column("query_row").take(pa.array(row)), pa.array(own[row], pa.int64()), pa.array(ids, pa.int64(), mask=none), pa.array(long, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score"])


def top_k(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best by the inner product of floor(1024 * component).

    `is_query` is a condition on `rows`. Candidates are all rows with another id than the query's; ties go
    to the smaller id, null ids last. Vectors that are null or hold null, not finite components (or such
    that 1024 times them leaves a long) take no part, as candidate or query. Components that the shorter of
    two vectors hasn't got count as zero. A query row that is repeated is answered as often. A score beyond
    a long is the long nearest to it. Other columns are ignored, so their names can't clash. An empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    kept = rows.filter(takes_part(F.col(vector_col), SCALE)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    shards = max(shuffle_partitions(spark), -(-rows.count() // shard))
    front = -(-shards // 8)
    place = F.pmod("place", F.lit(shards)).cast("int")
    same = kept.select("vec_id", "vector", F.xxhash64("vec_id", "vector").alias("place"))
    candidates = same.mapInArrow(_few_copies(k), same.schema).select(place.alias("shard"), "vec_id", "vector", F.lit(None).cast("long").alias("query_row"), F.lit(None).cast("long").alias("limit"))
    # Query rows equal in id and vector are one query, given out as often as it occurs.
    queries = kept.filter("asks").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("query_row", F.xxhash64("vec_id", "vector"))
    first = F.pmod("query_row", F.lit(front)).cast("int")

    def searched(asked: DataFrame, among: DataFrame) -> DataFrame:
        dealt = among.unionByName(asked.select(among.columns)).repartition(shards, "shard")
        return dealt.sortWithinPartitions("shard", F.col("query_row").asc_nulls_first()).mapInArrow(_search_shards(k), FOUND)

    near = cut(_ranked(searched(queries.select("*", first.alias("shard"), F.lit(None).cast("long").alias("limit")), candidates.filter(F.col("shard") < front)), k))
    # What a query has found so far: its k-th score is the limit for all other shards.
    limits = near.filter(F.col("rank") == k).select("query_row", F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    asked = queries.join(limits, ["query_row", "vec_id"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != first)
    found = near.drop("rank").unionByName(searched(asked, candidates))
    times = queries.filter("times > 1").select("query_row", F.col("vec_id").alias("query_id"), F.explode(F.array_repeat(F.lit(0), (F.col("times") - 1).cast("int"))).alias("again"))
    best = _ranked(found, k)
    return best.unionByName(best.join(times, ["query_row", "query_id"]).drop("again")).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_row", "query_id").orderBy(F.col("score").desc_nulls_last(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
