"""Language identification with a bidirectional gated recurrent network over bytes.

A text is cut into pieces of some bytes, whole code points each; the network reads a piece in both directions, over
spaces and all, labels every byte with log probabilities of the languages, and a document's label pools those of all its
bytes. Pieces of many documents go through the network together, a byte position of all of them at a time.

It is trained in numpy by backpropagation through time, on a bounded, balanced sample of the same kind of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import as_row, quoted, row_again

#: Bytes of a piece.
PIECE = 120
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of texts, about, that go through the network together.
TOGETHER = 1 << 20
#: The name of the class for what is no language. It comes before all others.
JUNK = "\x00"
#: A byte's neighbours say much the same, so the evidence of so many bytes counts once.
ALIKE = 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, by the exponential, which numpy vectorises everywhere; the argument is clipped where the result is 1."""
    np.clip(x, -9, 9, out=x)
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    x *= 2
    x -= 1
    return x


class ByteGru:
    """Weights and passes of the network. Pieces of a batch are sorted by falling length, so step t works on the first rows only."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, k = languages, hidden, len(languages)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.w[f"v{d}"] = rng.normal(0, hidden**-0.5, (hidden, k)).astype(np.float32)
        self.w["c"] = np.zeros(k, np.float32)

    def _direction(self, d: str, data: np.ndarray, active: np.ndarray, keep: bool) -> tuple[np.ndarray, list[tuple]]:
        """States (steps, rows, hidden) over left-aligned bytes (rows, steps), and what the way back needs."""
        n, h = self.hidden, np.zeros((len(data), self.hidden), np.float32)
        states, kept = np.zeros((data.shape[1], len(data), n), np.float32), []
        x, u, v = self.w[f"x{d}"], np.ascontiguousarray(self.w[f"u{d}"][:, : 2 * n]), np.ascontiguousarray(self.w[f"u{d}"][:, 2 * n :])
        columns = np.ascontiguousarray(data.T)
        for t, m in enumerate(active):
            before = h[:m]
            gate = x.take(columns[t, :m], axis=0)
            zr = _sigmoid(gate[:, : 2 * n] + before @ u)
            z, r = zr[:, :n], zr[:, n:]
            new = _tanh(gate[:, 2 * n :] + (r * before) @ v)
            now = new - before
            now *= z
            now += before
            if keep:
                kept.append((before.copy(), z, r, new))
            states[t, :m] = now
            h[:m] = now
        return states, kept

    def _back(self, d: str, data: np.ndarray, active: np.ndarray, kept: list[tuple], given: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        n, u = self.hidden, self.w[f"u{d}"]
        gx, gu, flows = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), []
        flow = np.zeros((len(data), n), np.float32)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            before, z, r, new = kept[t]
            dh = flow[:m] + given[t, :m]
            dnew = dh * z * (1 - new * new)
            dz = dh * (new - before) * z * (1 - z)
            drb = dnew @ u[:, 2 * n :].T
            dr = drb * before * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            gu[:, : 2 * n] += before.T @ dzr
            gu[:, 2 * n :] += (r * before).T @ dnew
            flows.append(np.concatenate([dzr, dnew], 1))
            flow[:m] = dh * (1 - z) + drb * r + dzr @ u[:, : 2 * n].T
        letters, flows = np.concatenate([data[: active[t], t] for t in range(len(active) - 1, -1, -1)]), np.concatenate(flows)
        order = np.argsort(letters, kind="stable")
        first = np.flatnonzero(np.diff(letters[order].astype(np.int64), prepend=-1))
        gx[letters[order][first]] = np.add.reduceat(flows[order], first, axis=0)
        grads[f"x{d}"], grads[f"u{d}"] = gx, gu

    @staticmethod
    def layout(segments: list[bytes]) -> tuple[np.ndarray, ...]:
        """Bytes forwards and backwards (rows, steps), lengths, active rows a step, and where a byte stands backwards. Longest first."""
        sizes = np.array([len(s) for s in segments])
        steps = int(sizes[0])
        ahead = np.frombuffer(b"".join(s.ljust(steps, b"\0") for s in segments), np.uint8).reshape(-1, steps)
        place = np.clip(sizes[:, None] - 1 - np.arange(steps), 0, None)
        active = np.searchsorted(-sizes, -np.arange(steps), "left")
        return ahead, np.take_along_axis(ahead, place, 1), sizes, active, place

    def _run(self, laid: tuple[np.ndarray, ...], keep: bool = True) -> tuple[np.ndarray, ...]:
        ahead, behind, sizes, active, place = laid
        hf, kf = self._direction("f", ahead, active, keep)
        hb, kb = self._direction("b", behind, active, keep)
        rows = np.arange(len(sizes))[None, :]
        scores = hf @ self.w["vf"] + (hb @ self.w["vb"])[place.T, rows] + self.w["c"]
        scores -= scores.max(axis=2, keepdims=True)
        logs = scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))
        inside = np.arange(ahead.shape[1])[:, None] < sizes
        return logs, inside, hf, kf, hb, kb

    def label(self, pieces: list[bytes]) -> np.ndarray:
        """Summed log probabilities of all byte labels (pieces, languages)."""
        out = np.zeros((len(pieces), len(self.languages)), np.float32)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        for at in range(0, len(order), 2048):
            own = order[at : at + 2048]
            logs, inside, *_ = self._run(self.layout([pieces[i] for i in own]), keep=False)
            logs *= inside[:, :, None]
            out[own] = logs.sum(axis=0)
        return out

    def train(self, segments: list[bytes], labels: np.ndarray, steps: int = 110, batch: int = 256, rate: float = 0.02, seed: int = 6) -> None:
        """Adam on the mean cross-entropy of all byte labels."""
        rng, moments = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(segments), batch)
            pick = sorted(pick, key=lambda i: -len(segments[i]))
            laid = self.layout([segments[i] for i in pick])
            ahead, behind, sizes, active, place = laid
            logs, inside, hf, kf, hb, kb = self._run(laid)
            miss = np.exp(logs)
            miss[:, np.arange(batch), labels[pick]] -= 1
            miss *= (inside / sizes.sum())[:, :, None]
            grads = {"c": miss.sum((0, 1)), "vf": np.einsum("tbh,tbk->hk", hf, miss)}
            turned = np.zeros_like(miss)
            steps_, rows_ = np.nonzero(inside)
            turned[place.T[steps_, rows_], rows_] = miss[steps_, rows_]
            grads["vb"] = np.einsum("tbh,tbk->hk", hb, turned)
            self._back("f", ahead, active, kf, miss @ self.w["vf"].T, grads)
            self._back("b", behind, active, kb, turned @ self.w["vb"].T, grads)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 1.0 / (size + 1e-9)) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.w[k] -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


def cut_pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    """Pieces of at most `size` bytes that end where a code point does; together they are the text."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] & 0xC0 == 0x80 and end > at + size - 3:
            end -= 1
        out.append(text[at:end])
        at = end
    return out


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def training_pieces(labelled: DataFrame, per_language: int = 1500, documents: int = 240) -> list[tuple[str, bytes]]:
    """A bounded, balanced sample of (lang, piece), the same on every run; every language that occurs is in it.

    Of each language about `documents` documents are drawn by a hash of id and text, and of their pieces `per_language` by a hash
    of what they hold. Only this sample, and the number of documents of each language, reach the driver.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rate = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, documents / n))) for k, n in sorted(counts.items())))[F.col("lang")]
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rate * F.lit(float(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = cut_pieces(text.encode()) if LETTER.search(text) else []
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(parts), pa.string()), pa.array(parts, pa.binary())], names=["lang", "piece"])

    sample = drawn.select("lang", "text").mapInArrow(run, "lang string, piece binary").distinct()
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece"))
    rows = sample.withColumn("turn", turn).filter(F.col("turn") <= per_language).orderBy("lang", "turn").select("lang", "piece").collect()
    return [(r["lang"], bytes(r["piece"])) for r in rows]


def scrambled(pieces: list[bytes], seed: int = 7) -> list[bytes]:
    """What is no language, made from the pieces of languages: their letters in any order, over the piece or inside words, and random
    signs, digits and consonants of the same lengths."""
    rng, out = np.random.default_rng(seed), []
    signs, hard = list("!#$%&()*+,-./:;<=>?@[]^_{|}~0123456789"), list("bcdfghjklmnpqrstvwxz")
    mixed = signs + hard + list("aeiouAEIOUBCDFGHJKLMNPQRSTVWXZ")
    for n, piece in enumerate(pieces):
        text = piece.decode("utf-8", "ignore")
        if n % 4 == 0:
            made = "".join(rng.permutation(list(text)))
        elif n % 4 == 1:
            made = " ".join("".join(rng.permutation(list(w))) for w in text.split(" "))
        else:
            pool, spaced = (signs, hard, mixed)[n // 4 % 3], n % 4 == 2
            made = "".join(rng.choice(pool, len(text)))
            made = "".join(" " if spaced and a == " " else b for a, b in zip(text, made))
        out.append(made.encode()[:PIECE] or b"?")
    return out


def fit(labelled: DataFrame, junk: bool = False, **sample) -> ByteGru | None:
    """Trains on rows of (doc_id, text, lang); None if there are none. With `junk` there is a class more, learned from scrambled pieces."""
    rows = training_pieces(labelled, **sample)
    if not rows:
        return None
    if junk:
        made = scrambled([s for _, s in rows])
        # As many as of languages: what the class costs a clean text is small beside what the words of its language say.
        rows = [(JUNK, s) for s in made] + rows
    languages = sorted({lang for lang, _ in rows})
    model = ByteGru(languages)
    model.train([s for _, s in rows], np.searchsorted(languages, [lang for lang, _ in rows]), **({"steps": 220} if junk else {}))
    return model


def junk_evidence(sums: np.ndarray) -> np.ndarray:
    """How much more a text's bytes look like no language than like the best one, from summed log probabilities (junk first)."""
    return (sums[:, 0] - sums[:, 1:].max(axis=1)) / ALIKE if sums.shape[1] > 1 else np.zeros(len(sums))


def learned_limit(model: ByteGru, pieces: list[bytes], sizes: tuple[int, ...] = (8, 16, 32, 64, PIECE), share: float = 0.999, spare: float = 4.0) -> float:
    """The evidence above which a text is junk: `spare` times what all but one in a thousand of the known pieces stay below, at whatever length they are cut.

    Known pieces hold addresses, numbers and shouting too, hence not the highest of all. A whole text is many pieces, so one that is of a
    language stays far below; short ones give little evidence either way and stay.
    """
    cuts = [p[:n].decode("utf-8", "ignore").encode() for p in pieces for n in sizes]
    cuts = [c for c in cuts if LETTER.search(c.decode())]
    return spare * max(1.0, float(np.quantile(junk_evidence(model.label(cuts)), share))) if cuts else np.inf


def save_model(spark: SparkSession, model: ByteGru, path: str) -> None:
    """Stores the weights as a table, so that a model that is fitted once serves many jobs."""
    rows = [(name, list(w.shape), w.ravel().tolist(), model.languages) for name, w in model.w.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, weights array<float>, languages array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> ByteGru:
    rows = spark.read.parquet(path).collect()  # a row a weight matrix
    model = ByteGru(list(rows[0]["languages"]))
    model.w = {r["name"]: np.array(r["weights"], np.float32).reshape(r["shape"]) for r in rows}
    model.hidden = model.w["uf"].shape[0]
    return model


def predict(docs: DataFrame, model: ByteGru | None, carry: list[str], text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns `carry` of `docs`, and label and score of every row; `und` and 0 for a text that is null or has no letter, or without a model.

    With a third name, also the evidence that a text is in no language; the model then has a class for it, which is never a label.
    """
    own = docs.select(*dict.fromkeys([*carry, text_col]))
    schema = T.StructType([*(own.schema[c] for c in carry), T.StructField(names[0], T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])])
    junk = int(bool(model and model.languages[0] == JUNK))

    def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode() if model and t and LETTER.search(t) else b"" for t in rows.column(text_col).to_pylist()]
        parts = [cut_pieces(t) for t in texts]
        pieces = list(chain.from_iterable(parts))
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        sums = np.zeros((len(texts), len(model.languages) if model else 1))
        if pieces:
            np.add.at(sums, owner, model.label(pieces))
        against, sums = junk_evidence(sums) if junk else np.zeros(len(sums)), sums[:, junk:]
        mean = sums / np.maximum([[len(t)] for t in texts], 1)
        odds = np.exp(mean - mean.max(axis=1, keepdims=True))
        best, sure = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
        langs = [model.languages[b + junk] if t else "und" for t, b in zip(texts, best, strict=True)]
        scores = [float(p) if t else 0.0 for t, p in zip(texts, sure, strict=True)]
        found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(against, pa.float64())]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), *found[: len(names)]], names=[*carry, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(text_col)])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER)))
                yield judged(batch.slice(at, end - at))
                at = end

    return own.mapInArrow(run, schema)


def to_learn(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang) that have a language and aren't held out."""
    out = F.coalesce(held_out(), F.lit(False))
    return docs.filter(~out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def fit_on(docs: DataFrame, **sample) -> ByteGru | None:
    return fit(to_learn(docs), **sample)


def identify(docs: DataFrame, **sample) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs` (doc_id, text, lang).

    Learns from rows with a language whose crc32(doc_id) mod 3 is not 1; a null id is never held out. Null and
    empty texts and texts without letters get `und`, as all do if there is nothing to learn from. Repeated rows give
    repeated results; an empty table an empty one. Other columns are ignored.
    """
    return predict(docs, fit_on(docs, **sample), ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample) -> DataFrame:
    """The rows of `docs` in which the network recognises a language, with all their columns; where the language is null, the label takes its place.

    Rows without a letter go, and those that look more like scrambled letters and signs than like any language, by more than any
    known piece of a language does (learned_limit). If no row has a language to learn from, no row can be judged by
    one: those with a letter stay as they are. Columns may have any names: a row is carried as one.
    """
    has = F.col(text_col).rlike(r"\p{L}")
    packed = docs.select(as_row(docs).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(to_learn(packed), junk=True, **sample)
    if model is None:
        return docs.filter(has)
    limit = learned_limit(model, [s for _, s in training_pieces(to_learn(packed), **sample)])
    found = predict(packed.filter(F.col("text").isNotNull()), model, ["row"], names=("lang_pred", "score", "junk")).filter((F.col("lang_pred") != "und") & (F.col("junk") <= limit))
    filled = F.coalesce(F.col(f"row.{quoted(lang_col)}"), "lang_pred").alias(lang_col)
    return found.select(*(filled if c == lang_col else x for c, x in zip(docs.columns, row_again(docs))))
