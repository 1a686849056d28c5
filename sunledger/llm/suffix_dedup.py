"""Removing long repeated strings with a logarithmic family of suffix indexes.

Every 400-byte string that starts at least twice anywhere in the corpus is removed wherever it
stands. Strings of one content must meet in one task, without moving every suffix: each
window of 400 bytes is represented by the smallest hash of the 64-byte strings inside it, a
function of its content alone. Neighbouring windows mostly share that minimum, so a text falls into a
few segments, each with one minimum; only segments whose minimum occurs in another segment, or
twice in their own, can hold a repeated string, and only those are sent on, to the task that owns the
minimum.

There, batches of segments arrive one after the other. Segments of equal bytes, as copies have them, are found by a dictionary of
the segments themselves; the rest of a batch gets a suffix array: its window starts in alphabetical order of their 400 bytes, by
doubling ranks of 5, 10, ... 320 and then 400 bytes, so equality is that of bytes, not of hashes. Its suffixes are searched in
the levels that exist, by binary search over their bytes; those that are in none become a level, and levels of about equal size merge in
one pass without a sort. So only the batch is ever sorted, there are only logarithmically many levels, and each suffix is moved logarithmically often. A level
keeps one entry a distinct suffix, so a passage with a million copies costs one.

A minimum that very many segments share (a passage in a third of all documents) would bring all the different surroundings of
that passage to one task. Such segments go on as 128-bit digests of their suffixes, dealt over tasks by digest; there equal
digests count as equal suffixes.

The family also lives on disk (add_batch): a batch of documents is judged against all batches before it, whose segments lie in
levels of the shared folder, and becomes a level there itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, list_sizes, remove, shuffle_partitions, text_of

LENGTH, GRAM = 400, 64
#: Bytes hashed at once; longer texts go in slices that overlap by LENGTH - 1 bytes.
SLICE = 1 << 20
#: Bytes of segments that make one batch of the index family.
BATCH = 1 << 21
#: Index tasks for each configured shuffle partition: ordering suffixes takes some 45 bytes of memory a byte.
FINER = 4


class Rolling:
    """Hashes of all substrings of one length, as differences of prefix sums modulo 2**64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 2**64, 256, np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = self._powers(self.base, n), self._powers(self.inverse, n)
        sums = np.zeros(n + 1, np.uint64)
        terms = self.letters[data]
        terms *= self.up[:n]
        np.cumsum(terms, out=sums[1:])
        out = sums[length:] - sums[: n - length + 1]
        out *= self.down[: n - length + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: A minimum with more segments than this is dealt over tasks by the suffixes' digests.
HOT = 20_000

#: Nearly every minimum of LENGTH - GRAM + 1 hashes is below this; the rest are counted one by one.
USUAL = np.uint64(2**64 * 8 // (LENGTH - GRAM + 1))


def occurs_twice(grams: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a run's minimum occurs more than once among the hashes of its windows (low to high)."""
    out, high = np.zeros(len(least), bool), high + LENGTH - GRAM
    place = np.flatnonzero(grams <= USUAL)
    values, rank = np.unique(grams[place], return_inverse=True)
    key = np.sort(rank.astype(np.int64) * len(grams) + place)
    usual = least <= USUAL
    own = np.searchsorted(values, least[usual]) * np.int64(len(grams))
    out[usual] = np.searchsorted(key, own + high[usual], "right") - np.searchsorted(key, own + low[usual]) > 1
    for i in np.flatnonzero(~usual):
        out[i] = np.count_nonzero(grams[low[i] : high[i] + 1] == least[i]) > 1
    return out


def segments(texts: Iterable[bytes], roll: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, minimum, first window, last window, whether its minimum occurs twice) arrays: the runs of windows that share their minimum."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        grams = roll(data, GRAM)
        least = sliding_min(grams, LENGTH - GRAM + 1)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(pieces)), sizes)[: len(least)]
        inside = np.arange(len(least)) + LENGTH <= (begin + sizes)[owner]
        at = np.flatnonzero(inside)
        least, owner = least[at], owner[at]
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else at
        last = np.concatenate([first[1:], [len(at)]]).astype(np.int64) - 1 if len(at) else at
        shift = np.array([p[1] for p in pieces]) - begin
        who = owner[first]
        twice = occurs_twice(grams, least[first], at[first], at[last])
        return np.array([p[0] for p in pieces])[who], least[first].view(np.int64), at[first] + shift[who], at[last] + shift[who], twice

    for number, text in enumerate(texts):
        for start in range(0, max(0, len(text) - LENGTH + 1), SLICE):
            pieces.append((number, start, text[start : start + SLICE + LENGTH - 1]))
            held += len(pieces[-1][2])
            if held >= SLICE:
                yield flush()
                pieces, held = [], 0
    if pieces:
        yield flush()


def _sorted_keys(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys): with the place of each key in its low bits where they fit, so that plain values are sorted, in place."""
    if bits + max(1, len(keys) - 1).bit_length() <= 64:
        low = np.uint64(max(1, len(keys) - 1).bit_length())
        keys <<= low
        keys |= np.arange(len(keys), dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << int(low)) - 1)).astype(np.int32)
        keys >>= low
        return order, keys
    order = np.argsort(keys, kind="stable").astype(np.int32)
    return order, keys[order]


def suffix_order(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at `at`, by their first LENGTH bytes; and for each place in it whether it equals the one before.

    Ranks of ever longer strings by doubling: that of 2 h bytes is the pair of the ranks of its halves of h bytes. A rank is the
    place of the first of its equals, so a string that equals no other keeps it, and only the others are sorted again.
    """
    n = len(data)
    bits = (n + 1).bit_length()
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    rank, held = np.zeros(n + LENGTH, np.int32), 5  # 0 beyond the end
    open_, known = np.arange(n, dtype=np.int32), None
    while True:
        order, key = _sorted_keys(key, 40 if known is None else 2 * bits)
        open_ = open_[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        places = np.arange(len(key), dtype=np.int32)
        if known is not None:  # places count from the first of what was equal so far
            base = key >> np.uint64(bits)
            fresh = np.ones(len(key), bool)
            fresh[1:] = base[1:] != base[:-1]
            places = places - np.maximum.accumulate(np.where(fresh, places, 0)) + base.astype(np.int32) - 1
        rank[open_] = np.maximum.accumulate(np.where(new, places, 0)) + 1
        equal = ~new
        equal[:-1] |= ~new[1:]
        open_ = np.sort(open_[equal])
        if held == LENGTH or not len(open_):
            break
        step = min(held, LENGTH - held)
        held, known = held + step, True
        key = (rank[open_].astype(np.uint64) << np.uint64(bits)) | rank[open_ + step].astype(np.uint64)
    order, key = _sorted_keys(rank[at].astype(np.uint64), bits)
    same = np.zeros(len(at), bool)
    same[1:] = key[1:] == key[:-1]
    return order, same


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers of the same order."""
    return np.ndarray(max(0, len(data) - 7), ">u8", data, strides=(1,))[at].astype(np.uint64)


def _compare(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of suffixes, by their first LENGTH bytes; in blocks, so that few bytes are held at once."""
    out = np.zeros(len(a_at), np.int8)
    for k in range(0, len(a_at), 4096):
        x, y = (np.lib.stride_tricks.sliding_window_view(d, LENGTH)[at[k : k + 4096]] for d, at in ((a, a_at), (b, b_at)))
        first = (np.arange(len(x)), (x != y).argmax(axis=1))
        out[k : k + 4096] = (x[first] > y[first]).astype(np.int8) - (x[first] < y[first])
    return out


class Level:
    """A suffix array: bytes, and the starts in them of distinct suffixes in alphabetical order, with the text and place each comes from.

    `word` holds the first eight bytes of each suffix, so most searches end without a look at the bytes.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray, told: np.ndarray) -> None:
        edges = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + LENGTH, minlength=len(data) + 1)
        held = np.cumsum(edges[:-1]) > 0  # bytes of no suffix that is left are left out
        self.data, self.at = data[held], (np.cumsum(held) - 1)[at]
        self.owner, self.start, self.told = owner, start, told  # told: reported as repeated
        self.word = _words(self.data, self.at)

    def __len__(self) -> int:
        return len(self.at)

    def find(self, data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of each suffix of `data` among those of the level, whether it is there), by binary search."""
        low, high = np.searchsorted(self.word, word, "left"), np.searchsorted(self.word, word, "right")
        equal, left = np.zeros(len(at), bool), np.flatnonzero(low < high)
        second = _words(data, at[left] + 8)
        while len(left):
            middle = (low[left] + high[left]) >> 1
            there = _words(self.data, self.at[middle] + 8)
            sign = (second > there).astype(np.int8) - (second < there)
            tied = np.flatnonzero(sign == 0)
            sign[tied] = _compare(data, at[left[tied]], self.data, self.at[middle[tied]])
            low[left], high[left] = np.where(sign > 0, middle + 1, np.where(sign, low[left], middle)), np.where(sign > 0, high[left], middle)
            equal[left[sign == 0]] = True
            on = low[left] < high[left]
            left, second = left[on], second[on]
        return low, equal

    def merge(self, other: Level) -> None:
        """Takes in another level, none of whose suffixes is here: one pass over both, without a sort."""
        place = self.find(other.data, other.at, other.word)[0] + np.arange(len(other))
        ours = np.ones(len(self) + len(other), bool)
        ours[place] = False
        other.at = other.at + len(self.data)
        for name in ("at", "owner", "start", "told", "word"):
            x, y = getattr(self, name), getattr(other, name)
            both = np.empty(len(ours), np.result_type(x, y))
            both[ours], both[place] = x, y
            setattr(self, name, both)
        self.data = np.concatenate([self.data, other.data])


class IndexFamily:
    """Levels whose sizes fall geometrically."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, data: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, start) of suffixes found repeated now: those of the batch, and those of earlier batches that had no match before.

        Only the batch itself is sorted. Its distinct suffixes are searched in each level; those that are in none become a
        level, which merges with those of about equal size, the smallest first.
        """
        order, same = suffix_order(data, at)
        at, owner, start = at[order], owner[order], start[order]
        matched = same.copy()
        matched[:-1] |= same[1:]
        out = [(owner[matched], start[matched])]
        at, owner, start, told = (x[~same] for x in (at, owner, start, matched))
        word, fresh = _words(data, at), np.ones(len(at), bool)
        for level in self.levels:
            place, own = level.find(data, at, word)
            old, quiet = place[own], own & ~told
            out.append((owner[quiet], start[quiet]))
            old = old[~level.told[old]]
            out.append((level.owner[old], level.start[old]))
            level.told[old] = True
            fresh &= ~own
        if fresh.any():
            new = Level(data, *(x[fresh] for x in (at, owner, start, told)))
            while self.levels and len(self.levels[-1]) <= 2 * len(new):
                large, small = sorted((self.levels.pop(), new), key=len, reverse=True)
                large.merge(small)
                new = large
            self.levels.append(new)
        return np.concatenate([o for o, _ in out]), np.concatenate([s for _, s in out])


class DigestFamily:
    """The same over digests of suffixes, in the order of the digests: for the parts of hot minima."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []  # digest, second digest, owner, start, reported

    def add(self, first: np.ndarray, second: np.ndarray, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((second, first))
        batch = [x[order] for x in (first, second, owner, start)]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (batch[0][1:] == batch[0][:-1]) & (batch[1][1:] == batch[1][:-1])
        matched, fresh = same[:-1] | same[1:], ~same[:-1]
        found = []
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], batch[0]), len(level[0]) - 1)
            hit = (level[0][at] == batch[0]) & (level[1][at] == batch[1])
            matched |= hit
            fresh &= ~hit
            old = np.unique(at[hit])
            old = old[~level[4][old]]
            level[4][old] = True
            found.append((level[2][old], level[3][old]))
        found.append((batch[2][matched], batch[3][matched]))
        if fresh.any():
            new = [x[fresh] for x in batch] + [matched[fresh]]
            while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
                both = [np.concatenate(x) for x in zip(self.levels.pop(), new, strict=True)]
                by = np.argsort(both[0], kind="stable")
                new = [x[by] for x in both]
            self.levels.append(new)
        return np.concatenate([o for o, _ in found]), np.concatenate([s for _, s in found])


def _runs(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to): window starts joined to the byte ranges that they cover."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(owner)]]).astype(np.int64) - 1 if len(at) else at
    return owner[at], start[at], start[end] + LENGTH


def _segments_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll = Rolling(1)
    for batch in batches:
        keys, texts = batch.column(0), (t.as_py() for t in batch.column(1).cast(pa.binary()))
        for number, *found in segments(texts, roll):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(number)), *map(pa.array, found)], names=["tkey", "least", "low", "high", "twice"])


def _marked(batch: pa.RecordBatch, mask: np.ndarray, hot: bool) -> pa.RecordBatch:
    rows = batch.filter(pa.array(mask))
    return rows.append_column("hot", pa.array(np.full(rows.num_rows, hot)))


def _shared_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by their minimum, those whose minimum occurs in more than one, or twice in one.

    The first HOT segments of a minimum go on as they are. If there are more, all of them, the first included, go on marked
    hot. The last row of a batch is held back until its successor is known.
    """
    held: pa.RecordBatch | None = None
    at, open_run = 0, False  # the held row's place in its run; whether it has a predecessor there
    begun: list[pa.RecordBatch] = []  # the current run's first HOT rows, up to the held one
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if not n:
            continue
        least = batch.column("least").to_numpy()
        same = least[1:] == least[:-1]
        shared = np.concatenate([[open_run], same]) | np.concatenate([same, [False]]) | batch.column("twice").to_numpy(zero_copy_only=False)
        run = np.concatenate([[0], np.cumsum(~same)])
        place = np.arange(n) - np.searchsorted(run, run)
        place[run == 0] += at
        body, early = batch.slice(0, n - 1), place[: n - 1] < HOT
        yield _marked(body, shared[: n - 1] & early, False)
        if not early.all():
            crossing = np.unique(run[: n - 1][place[: n - 1] == HOT])
            if 0 in crossing:
                yield from (_marked(x, np.ones(x.num_rows, bool), True) for x in begun)
            yield _marked(body, ~early | np.isin(run[: n - 1], crossing), True)
        begun = (begun if run[n - 1] == 0 else []) if place[n - 1] <= HOT else []
        if place[n - 1] <= HOT:
            begun.append(body.filter(pa.array((run[: n - 1] == run[n - 1]) & early)))
        held, at, open_run = batch.slice(n - 1), int(place[n - 1]), bool(n > 1 and same[-1]) or (n == 1 and open_run)
    if held is not None:
        one = np.ones(1, bool)
        if at < HOT:
            yield _marked(held, one & (open_run or held.column("twice")[0].as_py()), False)
        else:
            if at == HOT:
                yield from (_marked(x, np.ones(x.num_rows, bool), True) for x in begun)
            yield _marked(held, one, True)


_WINDOW = np.dtype([("first", "<u8"), ("second", "<u8"), ("start", "<i8")])


def _cut(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted segments out of their texts; hot ones become packed suffix digests, a row a part."""
    one, two = Rolling(2), Rolling(3)
    names = ["tkey", "least", "low", "bits", "hot"]
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for i in range(batch.num_rows):
            text, wanted = texts[i].as_py(), batch.column(3)[i].values
            rows: list[tuple[int, int, bytes, bool]] = []
            for low, high, least, hot in zip(*(wanted.field(k).to_pylist() for k in ("low", "high", "least", "hot")), strict=True):
                bits = text[low : high + LENGTH]
                if not hot:
                    rows.append((least, low, bits, False))
                    continue
                data = np.frombuffer(bits, np.uint8)
                found = np.empty(high - low + 1, _WINDOW)
                found["first"], found["second"], found["start"] = one(data, LENGTH), two(data, LENGTH), np.arange(low, high + 1)
                part = found["first"] % np.uint64(parts)
                rows += [((least * 31 + int(k) + 2**63) % 2**64 - 2**63, low, found[part == k].tobytes(), True) for k in np.unique(part)]
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), pa.binary()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)


def _family_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds the segments of one task to index families; yields repeated byte ranges.

    Whole segments and parts of hot ones have a family each: the first hot segments come as both.
    """
    whole, parts = IndexFamily(), DigestFamily()
    names: dict[bytes, int] = {}
    keys: list[bytes] = []
    known: dict[bytes, list] = {}  # segments by their bytes: first owner, its start, whether it is reported
    copies: list[tuple[int, int, int]] = []
    pending: list[tuple[int, int, bytes]] = []
    packed: list[tuple[int, bytes]] = []
    held = {False: 0, True: 0}

    def ranges(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in owner], pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["tkey", "low", "high"])

    def flush() -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(p[2] for p in pending), np.uint8)
        sizes = np.array([len(p[2]) for p in pending])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(pending)), sizes)[: len(data) - LENGTH + 1]
        at = np.flatnonzero(np.arange(len(owner)) + LENGTH <= (begin + sizes)[owner])
        who = owner[at]
        start = at - begin[who] + np.array([p[1] for p in pending])[who]
        yield ranges(*_runs(*whole.add(data, at, np.array([p[0] for p in pending])[who], start)))

    def flush_copies() -> Iterator[pa.RecordBatch]:
        if copies:
            yield ranges(*map(list, zip(*copies, strict=True)))
            copies.clear()

    def flush_parts() -> pa.RecordBatch:
        found = np.frombuffer(b"".join(p[1] for p in packed), _WINDOW)
        owner = np.repeat([p[0] for p in packed], [len(p[1]) // _WINDOW.itemsize for p in packed])
        return ranges(*_runs(*parts.add(found["first"].copy(), found["second"].copy(), owner, found["start"].copy())))

    for batch in batches:
        for key, low, bits, hot in zip(*(batch.column(c).to_pylist() for c in ("tkey", "low", "bits", "hot")), strict=True):
            own = names.get(key)
            if own is None:
                own = names[key] = len(keys)
                keys.append(key)
            if hot:
                packed.append((own, bits))
                held[True] += len(bits)
                if held[True] >= BATCH:
                    yield flush_parts()
                    packed, held[True] = [], 0
                continue
            if (first := known.get(bits)) is not None:
                if not first[2]:
                    copies.append((first[0], first[1], first[1] + len(bits)))
                    first[2] = True
                copies.append((own, low, low + len(bits)))
                continue
            known[bits] = [own, low, False]
            for cut in range(0, len(bits) - LENGTH + 1, BATCH):  # a long segment goes in overlapping slices
                pending.append((own, low + cut, bits[cut : cut + BATCH + LENGTH - 1]))
                held[False] += len(pending[-1][2])
                if held[False] >= BATCH:
                    yield from flush()
                    pending, held[False] = [], 0
        yield from flush_copies()
    if pending:
        yield from flush()
    if packed:
        yield flush_parts()


_SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _remove_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tkey, n_bytes, spans, n_removed, n_spans, kept_sha256, kept): merges each text's ranges and cuts them out."""
    names = ["tkey", "n_bytes", "spans", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = (pa.binary(), pa.int64(), _SPANS, pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        texts = batch.column(1).cast(pa.binary())
        for i in range(batch.num_rows):
            text, copies, ranges = texts[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py() or []
            if copies > 1 and len(text) >= LENGTH:  # all its strings start in its copies too
                ranges = [{"low": 0, "high": len(text)}]
            spans: list[dict[str, int]] = []
            for r in sorted(ranges, key=lambda r: r["low"]):
                if spans and r["low"] <= spans[-1]["high"]:
                    spans[-1]["high"] = max(spans[-1]["high"], r["high"])
                else:
                    spans.append(dict(r))
            edges = [0, *(e for r in spans for e in (r["low"], r["high"])), len(text)]
            left = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = "".join(p.decode("utf-8", "ignore") for p in left)
            rows.append((batch.column(0)[i].as_py(), len(text), spans, sum(r["high"] - r["low"] for r in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


_FOUND = "tkey binary, least bigint, low bigint, high bigint, twice boolean"
_BITS = "tkey binary, least bigint, low bigint, bits binary, hot boolean"


def _task_count(spark: SparkSession) -> int:
    """FINER times as many tasks as configured, never merged: a task's memory follows the suffixes that it indexes."""
    return FINER * shuffle_partitions(spark)


def _cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    parts = max(32, shuffle_partitions(texts.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, parts)

    return texts.join(wanted, "tkey").select("tkey", "text", "copies", "wanted").mapInArrow(run, _BITS)


def _match(bits: DataFrame) -> DataFrame:
    """(tkey, ranges): each text's repeated byte ranges, from segments."""
    ranges = bits.repartition(_task_count(bits.sparkSession), "least").mapInArrow(_family_udf, "tkey binary, low bigint, high bigint")
    return ranges.groupBy("tkey").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tkey, ranges): byte ranges of repeated strings, from distinct texts (tkey binary, text, copies).

    Every use of `texts` takes the same columns, so that Spark shuffles the texts once and reuses that.
    """
    own = texts.select("tkey", "text", "copies")
    found = own.mapInArrow(_segments_udf, _FOUND)
    shared = found.repartition("least").sortWithinPartitions("least").mapInArrow(_shared_udf, _FOUND + ", hot boolean")
    return _match(_cut_out(own, shared.groupBy("tkey").agg(F.collect_list(F.struct("low", "high", "least", "hot")).alias("wanted"))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a key of their text; the distinct texts with their number."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    keyed = own.withColumn("tkey", F.unhex(F.sha2("text", 256)))
    # The filter holds for all rows; joins would add it to some uses of `texts` only, and so prevent the reuse.
    return keyed, keyed.filter("tkey IS NOT NULL").groupBy("tkey").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _judge(keyed: DataFrame, texts: DataFrame, ranges: DataFrame) -> DataFrame:
    judged = texts.join(ranges, "tkey", "left").select("tkey", "text", "copies", "ranges")
    schema = "tkey binary, n_bytes bigint, spans array<struct<low:bigint,high:bigint>>, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
    results = judged.mapInArrow(_remove_udf, schema)
    return keyed.select("doc_id", "tkey").join(results, "tkey").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, spans) for every row of `docs`.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a 400-byte string over it starts anywhere
    else too, in the same document or another; strings that overlap count, and are judged on the input. Shorter
    texts keep all. kept_sha256 is of the bytes that are left; `text` is what they say, without the halves of characters at
    cuts. Equal texts are handled once, with their number; rows repeated or without id are rows like others. An empty table
    gives an empty result; other columns are ignored.
    """
    keyed, texts = _keyed(docs, id_col, text_col)
    return _judge(keyed, texts, repeated_spans(texts))


def add_batch(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As remove_repeats, for a batch of documents against itself and all batches added to `folder` before; then adds it there.

    The folder, a shared one, holds levels: tables of all segments of some batches. A batch becomes a level, and the two smallest
    levels are written as one while they are of about equal size, so a segment is rewritten logarithmically often. Documents of earlier
    batches aren't judged again. A level that is there twice, as after a loss between writing and deleting, counts once.
    """
    spark = docs.sparkSession
    keyed, texts = _keyed(docs, id_col, text_col)
    texts = cut(texts)
    wanted = texts.select("tkey", "text", "copies").mapInArrow(_segments_udf, _FOUND).groupBy("tkey").agg(F.collect_list(F.struct("low", "high", "least", F.lit(False).alias("hot"))).alias("wanted"))
    bits = cut(_cut_out(texts, wanted))
    levels = list_sizes(spark, folder, "level-")
    if levels:
        old = spark.read.parquet(*(path for path, _ in levels)).dropDuplicates(["tkey", "least", "low"]).select(*bits.columns)
        rivals = old.join(bits.select("least").distinct(), "least", "left_semi").select(*bits.columns)
        seen = old.select("tkey").distinct().withColumn("seen", F.lit(1))
        texts = texts.join(seen, "tkey", "left").select("tkey", "text", (F.col("copies") + F.coalesce("seen", F.lit(0))).alias("copies"))
        fresh = bits.join(old.select("tkey").distinct(), "tkey", "left_anti").select(*bits.columns)
        out = cut(_judge(keyed, texts, _match(fresh.unionByName(rivals))))
    else:
        fresh, out = bits, cut(_judge(keyed, texts, _match(bits)))
    fresh.write.parquet(f"{folder}/level-{uuid.uuid4().hex}")
    levels = sorted(list_sizes(spark, folder, "level-"), key=lambda x: x[1])
    while len(levels) > 1 and levels[1][1] <= 2 * max(1, levels[0][1]):
        pair = [path for path, _ in levels[:2]]
        spark.read.parquet(*pair).dropDuplicates(["tkey", "least", "low"]).write.parquet(f"{folder}/level-{uuid.uuid4().hex}")
        for path in pair:
            remove(spark, path)
        levels = sorted(list_sizes(spark, folder, "level-"), key=lambda x: x[1])
    return out
