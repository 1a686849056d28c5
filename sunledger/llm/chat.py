"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, as a whole, and the span of every turn's text is noted, in bytes. The
rendered text is encoded once, with offsets: the tokens of a byte-level vocabulary are pieces of the bytes, so their ends are
running sums of their lengths. The sorted turn spans meet the sorted token spans by binary search, which gives the tokens
under the loss and, where a token reaches over a turn's edge, the exact part of it.

Template: <s> + turns, a turn being [INST]role[/INST]text</s>. Inside roles and texts a backslash
becomes two, and a control string gets a backslash after its first character, so none is left
there and the original can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Encoder, default_tokenizer

#: The template's control strings.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile("|".join(map(re.escape, (BEGIN, END, OPEN, CLOSE))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    if not any(c in text for c in "\\<["):
        return text
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each turn's (escaped) text in its UTF-8 bytes."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        low = at + (len(head) if head.isascii() else len(head.encode()))
        spans.append((low, low + (len(body) if body.isascii() else len(body.encode()))))
        parts += (head, body, END)
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted, len(BEGIN))]


def align(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Which tokens (start, end) lie under any span, and for each span the characters that its tokens cover.

    Both arrays are sorted; the tokens of a span are found by binary search.
    """
    under = np.zeros(len(tokens), bool)
    covered: list[list[tuple[int, int]]] = []
    for low, high in spans:
        first = int(np.searchsorted(tokens[:, 1], low, "right"))
        last = int(np.searchsorted(tokens[:, 0], high, "left"))
        own = tokens[first:last]
        own = own[own[:, 1] > own[:, 0]] if high > low else own[:0]
        under[first:last] |= high > low
        pieces: list[tuple[int, int]] = []
        if len(own):
            a, b = np.maximum(own[:, 0], low), np.minimum(own[:, 1], high)
            reach = np.maximum.accumulate(b)
            new = np.concatenate([[True], a[1:] > reach[:-1]])
            at = np.flatnonzero(new)
            ends = reach[np.concatenate([at[1:], [len(a)]]) - 1]
            pieces = list(zip(a[at].tolist(), ends.tolist(), strict=True))
        covered.append(pieces)
    return under, covered


def format_chats(rows: DataFrame, tokenizer: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, ids, loss_mask, loss_spans): one row a conversation.

    `rows` has conv_id, turn, role and text. Turns are ordered by turn, ties by role and text; repeated rows
    are turns of their own. A null text or role counts as empty; rows with a null conv_id form one
    conversation, null turns come first. loss_mask has a flag for every token, loss_spans the characters of
    `formatted` under the loss. An empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = f"conv_id {chats.schema['conv_id'].dataType.simpleString()}, n_turns bigint, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<low:int,high:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                formatted, counts, ids, masks, pieces = [], [], [], [], []
                for turns in part.column(1).to_pylist():
                    chat = [(t["role"], t["text"]) for t in turns]
                    text, spans = render(chat)
                    own = np.array(encode(text), np.int32)
                    ends = np.cumsum(encode.lengths[own])
                    wanted = np.array([s for s, (role, _) in zip(spans, chat, strict=True) if role in learn], np.int64).reshape(-1, 2)
                    mask, found = align(np.stack([ends - encode.lengths[own], ends], 1), wanted)
                    found = np.array([p for one in found for p in one], np.int64).reshape(-1, 2)
                    if not text.isascii():  # bytes to characters
                        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
                        found = np.concatenate([[0], np.cumsum(first)])[found]
                    formatted.append(text)
                    counts.append(len(chat))
                    ids.append(own)
                    masks.append(mask)
                    pieces.append(found)
                low, high = np.concatenate([*pieces, np.zeros((0, 2), np.int64)]).astype(np.int32).T
                spans = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(formatted, pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.bool_()), pa.ListArray.from_arrays(_offsets(pieces), spans)]
                yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_spans"])

    return chats.mapInArrow(run, schema)


def _offsets(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(_offsets(parts), pa.array(np.concatenate(parts), kind))


def read_back_digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the formatted output."""
    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["low"] : s["high"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            found = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
