"""Telephony audio as media columns: companded and ADPCM WAV, decoded by tables and resampled to 16-bit PCM.

A payload of bytes is kept losslessly as the 8-bit samples of a mu-law or A-law WAV, or as the 4-bit codes of an IMA
ADPCM WAV whose blocks carry a 4-byte header and 192 bytes of codes. The codec follows from the payload's CRC, so equal
payloads are stored alike. Nothing is shuffled: a very long document is a long row, many copies are many short ones.
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

from .common import arrow_limits, raw, save, slices

UNIT = 192
#: WAV format tags (fixed values).
ALAW, MULAW, ADPCM = 6, 7, 0x11
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm"}
#: IMA ADPCM step sizes and index changes (fixed values of the format).
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 255
    t = (((u & 15) << 3) + 132) << ((u >> 4) & 7)
    return np.where(u & 128, 132 - t, t - 132).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, low = (a >> 4) & 7, ((a & 15) << 4) + 8
    t = np.where(segment == 0, low, (low + 256) << np.maximum(segment - 1, 0))
    return np.where(a & 128, t, -t).astype(np.int16)


EXPAND = {MULAW: _mulaw(), ALAW: _alaw()}
_code = np.arange(16)
#: By 16 * index + code: what a code adds to the prediction, and 16 * the next index.
DELTA = ((STEPS[:, None] >> 3) + (_code & 4 > 0) * STEPS[:, None] + (_code & 2 > 0) * (STEPS[:, None] >> 1) + (_code & 1 > 0) * (STEPS[:, None] >> 2))
DELTA = np.where(_code & 8, -DELTA, DELTA).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_code & 7], 0, 88) * 16).astype(np.int32).ravel()
#: Half-sample interpolation: windowed sinc at 0.5, 1.5, ... as integers over 2**14, summing to one half.
TAPS = 6
#: Samples worked on at once, so that a long row takes little beyond its samples.
PIECE = 1 << 18
_h = np.sinc(np.arange(TAPS) + 0.5) * np.cos(np.pi * (np.arange(TAPS) + 0.5) / (2 * TAPS + 1)) ** 2
HALF = np.rint(_h / _h.sum() * 8192).astype(np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, 4 + w bytes) to samples (n, 1 + 2 w): one numpy step per code position, across all blocks."""
    n, width = len(blocks), blocks.shape[1] - 4
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    codes = np.empty((2 * width, n), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((2 * width + 1, n), np.int16)
    out[0] = value
    for t, code in enumerate(codes):
        k = index + code
        value = np.clip(value + DELTA[k], -32768, 32767)
        index = NEXT[k]
        out[t + 1] = value
    return np.ascontiguousarray(out.T)


def upsample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and a half-band filter with integer taps gives those between; PIECE samples at a time."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    for a in range(0, len(pcm), PIECE):
        n = min(PIECE, len(pcm) - a)
        x = np.zeros(n + 2 * TAPS, np.int32)
        low, high = max(0, a - TAPS), min(len(pcm), a + n + TAPS)
        x[low - a + TAPS : high - a + TAPS] = pcm[low:high]
        mid = np.full(n, 8192, np.int32)
        for j, h in enumerate(HALF):
            mid += h * (x[TAPS - j : TAPS - j + n] + x[TAPS + 1 + j : TAPS + 1 + j + n])
        out[2 * a + 1 : 2 * (a + n) : 2] = np.clip(mid >> 14, -32768, 32767)
    return out


def measured(pcm: np.ndarray) -> tuple[int, int, int]:
    """(peak, root mean square, zero crossings) of samples, from integers; PIECE samples at a time."""
    peak, power, cross = 0, 0, 0
    for a in range(0, len(pcm), PIECE):
        wide = pcm[a : a + PIECE].astype(np.int64)
        peak, power = max(peak, int(np.abs(wide).max())), power + int(wide @ wide)
        below = pcm[a : a + PIECE + 1] < 0
        cross += int(np.count_nonzero(below[1:] != below[:-1]))
    return peak, int((power / len(pcm)) ** 0.5), cross


def wav(tag: int, data: bytes, rate: int = 8000) -> bytes:
    """A mono WAV of the companded tags, ADPCM (blocks of 4 + UNIT bytes) or PCM (tag 1)."""
    block, bits, extra = {ADPCM: (UNIT + 4, 4, struct.pack("<HH", 2, 2 * UNIT + 1)), 1: (2, 16, b"")}.get(tag, (1, 8, struct.pack("<H", 0)))
    speed = rate * block // (2 * UNIT + 1) if tag == ADPCM else rate * block
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits) + extra
    return b"RIFF" + struct.pack("<I", 20 + len(form) + len(data) + (len(data) & 1)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def parse_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, data) by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data" and tag is not None:
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("WAV without format or data")


def pack(payload: bytes) -> bytes:
    """A payload (a positive multiple of UNIT bytes) as a WAV."""
    tag = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
    if tag == ADPCM:
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        return wav(tag, blocks.tobytes())
    return wav(tag, payload)


def unpack(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, payload) of a WAV made by pack."""
    tag, rate, data = parse_wav(media)
    if tag == ADPCM:
        data = np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes()
    return tag, rate, data


def store_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each whole text (null: empty), padded with blanks to a positive multiple of UNIT, as WAV.

    Rows are mapped one by one; repeated rows, null keys and clashing other columns are of no account.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = raw(b.column("text"))
            media = [pack(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT)) for t in texts]
            yield pa.record_batch([b.column("key"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def decode_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm) of stored media.

    ``pcm`` is a WAV of 16-bit samples at twice the stored rate. The feature holds the codec, samples, peak, root mean
    square and zero crossings of these samples, all from integers. ADPCM blocks of many rows are decoded together.
    """
    arrow_limits(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 1 << 20):
            stored = b.column("media").to_pylist()
            opened = [unpack(m) for m in stored]
            coded = [np.frombuffer(parse_wav(m)[2], np.uint8).reshape(-1, UNIT + 4) for m, o in zip(stored, opened, strict=True) if o[0] == ADPCM]
            decoded = adpcm_decode(np.concatenate(coded)) if coded else None
            rows, at = [], 0
            for m, (tag, rate, payload) in zip(stored, opened, strict=True):
                if tag == ADPCM:
                    n = len(payload) // UNIT
                    pcm, at = decoded[at : at + n].ravel(), at + n
                else:
                    pcm = EXPAND[tag][np.frombuffer(payload, np.uint8)]
                pcm = upsample(pcm)
                peak, rms, cross = measured(pcm)
                feature = f"{NAMES[tag]} rate={2 * rate} samples={len(pcm)} peak={peak} rms={rms} crossings={cross}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, wav(1, pcm.tobytes(), 2 * rate)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.record_batch([b.column("key"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"])

    kind = media.schema[key].dataType.simpleString()
    out = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return media.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(run, out).withColumnRenamed("key", key)


def store_pcm(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pcm) of stored media, written to the shared folder as 16-bit WAV and read back."""
    return save(decode_media(media, key).select(key, "pcm"), "pcm")


def op1_audio(spark, sf_dir: str) -> DataFrame:
    """Stores all documents as telephony audio in the shared folder, reads that back and digests what was read."""
    media = save(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return decode_media(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("pcm", 256).alias("pcm_sha256"))
