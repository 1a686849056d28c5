"""Media columns: telephony audio. G.711 by lookup tables, IMA ADPCM across blocks, resampled PCM.

A document's bytes become the samples of a small WAV file in one of three telephone codecs, chosen by
a checksum of the bytes. Reading such a column back parses the file, takes the payload out, decodes it
to 16-bit PCM at 8 kHz, resamples that to 16 kHz, and computes features. Mu-law and A-law expand by
a table of 256 entries; ADPCM has a state that runs through a block, so numpy steps through the nibbles
of all blocks of a batch at once. Everything is integer arithmetic, so equal bytes give equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

RATE, BLOCK = 8000, 192
#: WAV format tags (fixed values of the format): A-law, mu-law, IMA ADPCM.
CODECS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
#: IMA ADPCM: fixed values of the standard.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724,
    796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
    22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Payload bytes decoded at once.
AT_ONCE = 1 << 20


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, part = (code & 15) << 4, code >> 4 & 7
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
#: What a nibble adds to the predictor at each step index, and the index that follows.
_NIBBLE = np.arange(16)
_DELTA = (IMA_STEPS[:, None] >> 3) + sum(np.where(_NIBBLE & (4 >> k), IMA_STEPS[:, None] >> k, 0) for k in range(3))
IMA_DELTA = np.where(_NIBBLE & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
IMA_NEXT = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_MOVES[_NIBBLE & 7], 0, len(IMA_STEPS) - 1).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 192) bytes to (blocks, 377) samples: header sample, then two for each byte, low nibble first."""
    blocks = np.ascontiguousarray(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * body.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value
    for k, byte in enumerate(body):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            at = (index << 4) + nibble
            value += IMA_DELTA[at]
            np.clip(value, -32768, 32767, out=value)
            index = IMA_NEXT[at]
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T)


def decode(codec: str, payload: np.ndarray) -> np.ndarray:
    """16-bit PCM of a payload of whole blocks."""
    if codec == "ima_adpcm":
        return decode_adpcm(payload.reshape(-1, BLOCK)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[payload]


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 to 16 kHz: the samples, and between them the half-way value of a four-point cubic; the ends repeat."""
    wide = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    middle = (9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[::2], out[1::2] = pcm, np.clip(middle, -32768, 32767)
    return out


def pad(data: bytes) -> bytes:
    """Appends spaces up to a positive multiple of the block."""
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b" ")


def to_wav(codec: str, payload: bytes) -> bytes:
    adpcm = codec == "ima_adpcm"
    per_block = 2 * (BLOCK - 4) + 1
    extra = struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", CODECS[codec], 1, RATE, RATE * BLOCK // per_block if adpcm else RATE, BLOCK if adpcm else 1, 4 if adpcm else 8) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def from_wav(media: bytes) -> tuple[str, memoryview]:
    """The codec and the payload of a WAV file."""
    view, at, codec = memoryview(media), 12, ""
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if name == b"fmt ":
            tag = struct.unpack("<H", view[at + 8 : at + 10])[0]
            codec = next(k for k, v in CODECS.items() if v == tag)
        elif name == b"data":
            return codec, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text stored losslessly as telephone audio. A null text counts as empty."""
    names = list(CODECS)
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 500):
                raw = [t.as_py() for t in texts[at : at + 500]]
                media = [to_wav(names[zlib.crc32(x) % 3], x) for x in map(pad, raw)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def _features(codec: str, pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"codec={codec};samples={len(pcm)};seconds={len(pcm) / (2 * RATE):.3f};peak={int(np.abs(x).max())};rms={np.sqrt((x @ x) / len(x)):.3f};mean={x.mean():.3f};zero_crossings={turns};crc={zlib.crc32(pcm.tobytes())}"


def decoded(batch: list[bytes]) -> Iterator[tuple[str, memoryview, np.ndarray]]:
    """(codec, payload, 16 kHz PCM) of each file; the ADPCM blocks of all files are decoded together."""
    files = [from_wav(x) for x in batch]
    own = [i for i, (codec, _) in enumerate(files) if codec == "ima_adpcm"]
    sizes = np.array([len(files[i][1]) // BLOCK for i in own], np.int64)
    joined = decode_adpcm(np.frombuffer(b"".join(files[i][1] for i in own), np.uint8).reshape(-1, BLOCK)) if own else None
    ends = dict(zip(own, np.cumsum(sizes).tolist(), strict=True))
    for i, (codec, payload) in enumerate(files):
        if codec == "ima_adpcm":
            pcm = joined[ends[i] - len(payload) // BLOCK : ends[i]].ravel()
        else:
            pcm = decode(codec, np.frombuffer(payload, np.uint8))
        yield codec, payload, resample(pcm)


def read_media(media: DataFrame, with_media: bool = True) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, feature and pcm (16-bit, 16 kHz) to rows with a column `media`, which stays if wanted."""
    more = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string, pcm binary"
    kept = [c for c in media.columns if c != "media"] + ["media"] * with_media
    names = [*kept, *(x.split()[0] for x in more.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for codec, payload, pcm in decoded(batch.column("media").to_pylist()):
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), _features(codec, pcm), pcm.tobytes())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            found = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, names=names)

        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer()) for x in batch.column("media")])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE)))
                yield block(batch.slice(at, end - at))
                at = end

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.select(*kept).schema.fields)
    return media.mapInArrow(run, f"{schema}, {more}")


def store_audio(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes a table of the media: each file, its resampled PCM and features. Rows as in audio_digest."""
    read_media(to_media(docs, id_col, text_col)).write.parquet(path)


def audio_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each stored file holds when it is read back, and its resampled PCM (16-bit, 16 kHz), one row for every row of `docs`.

    Null and empty texts are one block of spaces. Rows repeated or without id are rows like others;
    equal texts give equal values. An empty table gives an empty result. Other columns are ignored.
    """
    media = to_media(docs, id_col, text_col)
    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return read_media(stored, with_media=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
