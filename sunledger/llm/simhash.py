"""SimHash near-deduplication with pigeonring filtering.

A 64-bit fingerprint is cut into five segments on a ring. If two fingerprints differ in at most four
bits, some segment starts a chain whose first l segments together differ in at most floor(4 l / 5)
bits, for every l up to 5: the first equals, the first two differ by one bit at most, and so
on. Candidates must share the first two links of such a chain, which a key of (segment, next segment
with one bit masked) makes an equality, so finding them is one shuffle of 64 keys a distinct
fingerprint. The longer prefixes of the chain prune the candidates before the full Hamming check.

Equal fingerprints are one node. A run of fingerprints under one key is linked by spanning links
only, never by all its pairs, and components come from those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, as_row, cut, text_of
from .components import connected_components
from .exact_dedup import first_of, name_of

BITS, LIMIT = 64, 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
BUDGETS = tuple(LIMIT * n // len(WIDTHS) for n in range(1, len(WIDTHS) + 1))
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Shingles whose bits are counted at once, so a very long text needs no more memory.
BLOCK = 1 << 16
#: Runs up to this length compare by shifted arrays; longer ones by a search that drops what it has reached.
SHORT_RUN = 48


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text: each bit says whether over half of the shingle hashes have it. No words: 0."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_sha: bool = False) -> DataFrame:
    """(doc_id, [sha,] fp) with fp as a signed 64-bit number and sha of the text as it is; a null text counts as empty."""
    own = docs.select(F.col(id_col).alias("doc_id"), *[F.sha2(text_of(text_col), 256).alias("sha")] * with_sha, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {'sha string, ' * with_sha}fp bigint")


def _segment(fp: Column, i: int) -> Column:
    """Segment i, counted from the low end."""
    return F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def chain_keys(fp: Column) -> Column:
    """64 keys: the chain's start i, segment i, and the next segment with bit j masked out."""
    keys = []
    for i in range(len(WIDTHS)):
        k = (i + 1) % len(WIDTHS)
        first, second = _segment(fp, i), _segment(fp, k)
        for j in range(WIDTHS[k]):
            masked = second.bitwiseAND(F.lit(((1 << WIDTHS[k]) - 1) & ~(1 << j)))
            keys.append(F.lit((i << 4 | j) << 26).bitwiseOR(F.shiftleft(first, 13)).bitwiseOR(masked))
    return F.array(*keys)


def _chain_masks() -> np.ndarray:
    """[i, l]: the bits of the first l + 1 segments of the chain that starts at i."""
    parts = [((1 << w) - 1) << s for s, w in zip(STARTS, WIDTHS, strict=True)]
    return np.array([[sum(parts[(i + k) % len(parts)] for k in range(n + 1)) for n in range(len(parts))] for i in range(len(parts))], np.uint64)


def passes_chain(difference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every prefix of the chain stays within its proportional budget; the last one is the Hamming check."""
    masks, ok = _chain_masks(), np.ones(len(difference), bool)
    for n, budget in enumerate(BUDGETS):
        ok &= np.bitwise_count(difference & masks[start, n]) <= budget
    return ok


def _short_runs(key: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    start = (key >> 30).astype(np.int64)
    a, b, alive, k = [], [], np.arange(len(key)), 1
    while alive.size:
        alive = alive[alive + k < len(key)]
        alive = alive[key[alive] == key[alive + k]]
        x = fp[alive] ^ fp[alive + k]
        hit = alive[passes_chain(x, start[alive])]
        a.append(fp[hit])
        b.append(fp[hit + k])
        k += 1
    return a, b


def _long_run(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning links of one run: each reached fingerprint takes its unreached neighbours, so close runs shrink at once."""
    rest, a, b = fp, [], []
    while rest.size:
        queue, rest = [rest[:1]], rest[1:]
        while queue and rest.size:
            for x in queue.pop():
                near = np.bitwise_count(rest ^ x) <= LIMIT
                if near.any():
                    got, rest = rest[near], rest[~near]
                    a.append(np.full(len(got), x))
                    b.append(got)
                    queue.append(got)
                if not rest.size:
                    break
    return a, b


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
        sizes = np.diff(edges)
        a, b = [], []
        for at in np.flatnonzero(sizes > SHORT_RUN):
            more = _long_run(fp[edges[at] : edges[at + 1]])
            a += more[0]
            b += more[1]
        short = np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes)
        more = _short_runs(key[short], fp[short])
        left, right = np.concatenate([*a, *more[0], held_fp[:0]]), np.concatenate([*b, *more[1], held_fp[:0]])
        pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].view(np.int64) if len(pairs) else [], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
        if last:
            yield links(key[:last], fp[:last])
        held_key, held_fp = key[last:], fp[last:]
    if len(held_key):
        yield links(held_key, held_fp)


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all those within four bits."""
    keyed = nodes.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key")).select("key", "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "a bigint, b bigint").distinct()


def _components(prints: DataFrame, rank: Column) -> tuple[DataFrame, DataFrame]:
    """((fp, least, root) of every distinct fingerprint; (root, least) of every component), least being the smallest rank."""
    nodes = cut(prints.groupBy("fp").agg(F.min(rank).alias("least")))
    roots = connected_components(near_links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return placed, placed.groupBy("root").agg(F.min("least").alias("least"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Documents link when their fingerprints differ in four bits or fewer; component_id is the smallest
    doc_id that links reach. Texts without words, empty and null ones included, have fingerprint 0 and
    link like any other. Rows with a null id take part in links but never name a component unless all its
    ids are null. Repeated rows give repeated results; an empty table an empty one. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    placed, components = _components(prints, F.col("doc_id"))
    # The second join key gives both sides exchanges of their own: only then does adaptive execution split a component with very many fingerprints.
    salt = F.xxhash64("root").alias("salt")
    named = placed.select("fp", "root", salt).join(components.select("root", salt, F.col("least").alias("component_id")), ["root", "salt"]).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id, null ids last.

    Of rows with that id the one whose fingerprint, then whose text's SHA-256, then whose other columns as JSON come first stays.
    """
    prints = cut(fingerprints(docs, id_col, text_col, with_sha=True))
    _, components = _components(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "sha"))
    winners = components.select(name_of("least.doc_id").alias("id"), F.col("least.sha").alias("sha"))
    own = docs.select(as_row(docs).alias("row"), name_of(id_col).alias("id"), F.sha2(text_of(text_col), 256).alias("sha"))
    return first_of(own.join(winners, ["sha", "id"], "left_semi"), docs, text_col)
