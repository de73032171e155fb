"""Telephony audio columns: G.711 codes, IMA ADPCM blocks and resampled PCM.

A document's UTF-8 bytes, padded with zero bytes to a positive multiple of 64,
are taken as mu-law codes (one byte is one sample) and stored as a WAV file of
8 kHz, format 7.  Decoding reads the file back, expands the codes through a
table of 256 samples, resamples to 16 kHz PCM, and also reads the same bytes as
A-law codes and as ADPCM blocks of 64 bytes.  ADPCM is sequential inside a block
only, so numpy decodes all blocks of a batch side by side.  The resampled PCM is
stored as a column of a table.

Null text counts as empty and gives 64 zero bytes.  Very long texts are converted
whole, alone in their chunk.  Equal texts give equal values; repeated rows stay;
null ids stay null; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, shared_dir

BLOCK = 64
RATE = 8000
_HEAD = struct.Struct("<4sI4s4sIHHIIHHH4sII4sI")  # RIFF, fmt (18 bytes), fact, data


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    high, value = (code >> 4) & 7, ((code & 15) << 4) + 8
    value = np.where(high > 0, (value + 256) << np.maximum(high - 1, 0), value)
    return np.where(code & 128, value, -value).astype(np.int16)


#: Fixed values of the IMA ADPCM format: the 89 step sizes and the index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

MULAW, ALAW = mulaw_table(), alaw_table()
#: The change of the predicted sample by step index and nibble, and the next index.
_nibble = np.arange(16)
DELTA = sum(np.where(_nibble & bit, STEPS[:, None] >> s, 0) for bit, s in ((4, 0), (2, 1), (1, 2))) + (STEPS[:, None] >> 3)
DELTA = (np.where(_nibble & 8, -DELTA, DELTA)).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_nibble & 7], 0, 88) * 16).astype(np.int32).ravel()


def store(payload: bytes) -> bytes:
    """A mu-law WAV file whose samples are the payload's bytes."""
    n = len(payload)
    return _HEAD.pack(b"RIFF", _HEAD.size - 8 + n, b"WAVE", b"fmt ", 18, 7, 1, RATE, RATE, 1, 8, 0, b"fact", 4, n, b"data", n) + payload


def load(media: bytes) -> bytes:
    """The samples of a WAV file as stored; chunks may come in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def resample2(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and the mean of it and the next (the last one twice)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: (n, b) bytes to (n, 1 + 2 * (b - 4)) samples, all blocks at once."""
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, nibble in ((0, body[k] & 15), (1, body[k] >> 4)):
            key = index + nibble
            value = np.clip(value + DELTA[key], -32768, 32767)
            index = NEXT[key]
            out[1 + 2 * k + half] = value
    return out.T


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a stored mu-law file."""
    prepare(docs.sparkSession)

    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            media = [store(raw[a:b] + bytes(-(b - a) % BLOCK if b > a else BLOCK)) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(raw: bytes, offsets: np.ndarray) -> tuple[list[bytes], list[bytes], list[str]]:
    """Payloads, PCM at twice the rate (16 bits, little-endian) and features of stored files."""
    at = offsets.tolist()
    payload = [load(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
    size = np.array([len(x) for x in payload])
    edge = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(payload), np.uint8)
    mu, al = MULAW[flat], ALAW[flat]
    ad = adpcm_blocks(flat.reshape(-1, BLOCK))
    level = np.add.reduceat(np.abs(mu.astype(np.int64)), edge)
    level_a = np.add.reduceat(np.abs(al.astype(np.int64)), edge)
    level_d = np.add.reduceat(np.abs(ad.astype(np.int64)).sum(1), edge // BLOCK)
    turn = np.zeros(len(mu), bool)
    turn[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    turn[edge] = False
    turns = np.add.reduceat(turn.astype(np.int64), edge)
    pcm = [resample2(mu[a : a + n]).astype("<i2").tobytes() for a, n in zip(edge.tolist(), size.tolist(), strict=True)]
    feature = [f"rate=16000;samples={2 * n};mulaw={a};alaw={b};adpcm={d};turns={t};pcm={zlib.crc32(p):08x}" for n, a, b, d, t, p in zip(size.tolist(), level.tolist(), level_a.tolist(), level_d.tolist(), turns.tolist(), pcm, strict=True)]
    return payload, pcm, feature


def decode_media(media: DataFrame) -> DataFrame:
    """Read stored files back: their payload, PCM and features."""
    prepare(media.sparkSession)

    def run(batches):
        for rows, data, offsets in chunks(batches, column="media"):
            payload, pcm, feature = decoded(data.tobytes(), offsets)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), rows.column("media"), pa.array(payload, pa.binary()), pa.array(pcm, pa.binary()), pa.array(feature)], ["doc_id", "n_bytes", "media", "payload", "pcm16k", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, pcm16k binary, feature string")


def convert(media: DataFrame) -> DataFrame:
    """Decode stored files, store the PCM with what describes it, and read that table.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm16k);
    the table is in the shared folder, its pages compressed, as PCM has four bytes a code.
    """
    spark = prepare(media.sparkSession)
    place = f"{shared_dir(spark)}/pcm-{uuid.uuid4().hex}"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm16k"]
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm16k binary"

    def run(batches):
        for rows, data, offsets in chunks(batches, column="media"):
            raw, at = data.tobytes(), offsets.tolist()
            payload, pcm, feature = decoded(raw, offsets)
            sha = [hashlib.sha256(x).hexdigest() for x in payload]
            own = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array([len(x) for x in payload], pa.int64()), pa.array(sha), pa.array([zlib.crc32(x[-BLOCK:]) for x in payload], pa.int64()), pa.array(np.diff(offsets)), pa.array(own), pa.array(feature), pa.array(pcm, pa.binary())], names)

    media.mapInArrow(run, kinds).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "5").option("parquet.enable.dictionary", "false").parquet(place)
    return spark.read.schema(kinds).parquet(place)


