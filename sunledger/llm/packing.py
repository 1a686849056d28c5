"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised and cut into pieces of the sequence length; only lengths matter then. The
histogram, with at most as many rows as a sequence has tokens, is packed from the longest length
down: pieces of one length go onto the group of equal packs that is shortest so far, many at a
time, so groups of packs ("patterns" with a count) are all the state there is. Each slot of a
pattern takes a range of ranks of its length; documents find their sequence and offset by their rank.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, text_of

CAPACITY = 2048
#: Ranks are counted inside hash buckets of a length, about so many pieces each, so that one length may hold most pieces.
BUCKET = 20_000
#: The pattern's white space. tiktoken's regex engine has a bounded stack and fails on runs of a million; longer runs than this don't go there.
LONG_RUN = 100_000
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Plain-text ids of a byte-level BPE file of the `tokenizers` library.

    The file's vocabulary and merge order are run by tiktoken, which gives the same ids in a quarter of the
    time: in such a file a merged token's id grows with the rank of its merge. A file where it doesn't is refused.
    As in that library, an added token (<|endoftext|>) in a text is its one id and parts the text, leftmost and longest first.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that take more or less than their own letters")
        self._added: dict[str, int] = {t["content"]: t["id"] for t in added}
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the order of merges")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self._added}
        #: Bytes of each id.
        self.lengths = np.zeros(max([*ranks.values(), *self._added.values()]) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.lengths[list(self._added.values())] = [len(t.encode()) for t in self._added]
        self._encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not any(t in text for t in self._added):
            return self._plain(text)
        ids: list[int] = []
        for k, part in enumerate(self._parts.split(text)):
            ids += [self._added[part]] if k % 2 else self._plain(part)
        return ids

    def _plain(self, text: str) -> list[int]:
        """The pattern makes a run of white space one piece, without its last character if something follows: long runs are cut out so."""
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text) if len(text) >= LONG_RUN else ():
            stop = run.end() - (run.end() < len(text))
            ids += self._encoding.encode_ordinary(text[at : run.start()])
            ids += self._encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + self._encoding.encode_ordinary(text[at:]) if at else self._encoding.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document's tokens and end id, in pieces of at most `capacity`.

    ids holds little-endian unsigned 32-bit numbers. A null or empty text is one piece with the end id alone.
    """
    path = tokenizer or default_tokenizer()
    own = docs.select(F.col("doc_id"), text_of("text").alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, start bigint, length int, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i in range(batch.num_rows):
                all_ids = np.array([*encode(texts[i].as_py()), end_id], "<u4")
                for at in range(0, len(all_ids), capacity):
                    part = all_ids[at : at + capacity].tobytes()
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(all_ids))
                    if with_ids:
                        ids.append(part)
            cols = [keys.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return own.mapInArrow(run, schema)


def shortest_pack_first(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, their lengths in order) for a histogram of (length, count).

    Work and state grow with the number of different lengths, not with the number of pieces.
    """
    groups: list[tuple[int, int, int, tuple[int, ...]]] = []  # a heap by tokens used: the shortest packs first
    tie = 0
    for length, left in sorted(histogram, reverse=True):
        grown = []
        while left and groups and groups[0][0] + length <= capacity:
            used, _, count, pattern = heapq.heappop(groups)
            taken = min(left, count)
            left -= taken
            grown.append((used + length, taken, (*pattern, length)))
            if taken < count:
                heapq.heappush(groups, (used, tie := tie + 1, count - taken, pattern))
            if not left or not groups or groups[0][0] + length > capacity:
                # Only when every pack has had its turn may a pack take a second piece of this length.
                for used, n, pattern in grown:
                    heapq.heappush(groups, (used, tie := tie + 1, n, pattern))
                grown = []
        for used, n, pattern in grown:
            heapq.heappush(groups, (used, tie := tie + 1, n, pattern))
        if left:
            per = max(1, capacity // length)
            full, rest = divmod(left, per)
            if full:
                heapq.heappush(groups, (per * length, tie := tie + 1, full, (length,) * per))
            if rest:
                heapq.heappush(groups, (rest * length, tie := tie + 1, 1, (length,) * rest))
    return [(count, pattern) for _, _, count, pattern in sorted(groups, key=lambda g: (-g[0], g[1]))]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows of (length, first rank, sequence of the first rank, offset), by length and rank."""
    rows, first, sequence = [], {}, 0
    for count, pattern in packs:
        offset = 0
        for length in pattern:
            rows.append((length, first.get(length, 0), sequence, offset))
            first[length] = first.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(parts: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, start and length. Equal rows are interchangeable."""
    histogram = [(r["length"], r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most `capacity` rows
    table = slots(shortest_pack_first(histogram, capacity))
    buckets = max(256, max((n for _, n in histogram), default=0) // bucket)
    keyed = parts.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")).select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "start")) - 1
    ranked = keyed.withColumn("__rank", rank).join(starts, ["length", "__bucket"]).withColumn("__rank", (F.col("__rank") + F.col("__first")).cast("long"))
    kept = parts.columns
    names = [*kept, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.int64(48)
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            found = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*parts.columns, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, **tokens) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset): where each piece of each document lies.

    Sequences have at most `capacity` tokens and are padded to it. Rows with a null id or text are
    documents like others, repeated rows are packed each. An empty table gives an empty result.
    Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pack(cut(pieces(own, capacity=capacity, with_ids=with_ids, **tokens)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from pack_documents(with_ids=True)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(ordered, lambda x: F.hex(x["ids"]))).alias("__hex")).select("sequence_id", F.unhex("__hex").alias("ids"))
