"""Telephony audio as media columns.

mu-law and A-law expand by lookup tables of 256 values (built from the laws of
ITU-T G.711); IMA ADPCM blocks are decoded by numpy with one lane a block, so that
a step of the loop advances every block of a batch. Samples are resampled by a
polyphase windowed sinc and stored as 16-bit PCM; containers are RIFF/WAVE files,
written and parsed here.

Defined results: null payload counts as empty; a container that cannot be parsed
has null samples; blobs of any length are taken whole; repeated rows have equal
values; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: WAVE format tags.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: IMA ADPCM step sizes and changes of the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

FRAME = 576
FILL = 255


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (u >> 4) & 7, (u & 15).astype(np.int32)
    size = (((mantissa << 3) + 132) << exponent) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((a >> 4) & 7).astype(np.int32), (a & 15).astype(np.int32)
    size = np.where(exponent, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0), (mantissa << 4) + 8)
    return np.where(a & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (int16) of mono IMA ADPCM blocks, an array of (blocks, bytes): 4 bytes of header, then two samples a byte, low nibble first."""
    n, size = blocks.shape
    value = blocks[:, 0:2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2], 0, 88).astype(np.int32)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        code = (codes[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        diff = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * ((code >> 1) & 1) + step * ((code >> 2) & 1)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def _taps(up: int, down: int, half: int = 8) -> np.ndarray:
    cut = max(up, down)
    t = np.arange(-half * cut, half * cut + 1) / cut
    h = np.sinc(t) * np.hanning(len(t) + 2)[1:-1]
    return h * up / h.sum()


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """int16 samples at up/down times the rate: each phase of the filter runs over the samples, none of the zeros between them."""
    if up == down or not len(x):
        return x
    h = _taps(up, down)
    centre = len(h) // 2
    n = -(-len(x) * up // down)
    out = np.empty(len(x) * up)
    for phase in range(up):
        taps = h[(centre + phase) % up :: up]
        first = (centre + phase) // up
        full = np.convolve(x.astype(np.float64), taps)
        out[phase::up] = full[first : first + len(x)] if len(full) >= first + len(x) else np.pad(full[first:], (0, first + len(x) - len(full)))
    return np.clip(np.rint(out[::down][:n]), -32768, 32767).astype(np.int16)


def write_wave(data: bytes, tag: int, rate: int = 8000, bits: int = 8, block: int = 1, per_block: int = 0) -> bytes:
    """A RIFF/WAVE file of mono audio; data as it is."""
    extra = struct.pack("<HH", 2, per_block) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block // max(per_block, 1), block, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(b: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(format tag, rate, block size, data) of a RIFF/WAVE file; None if it is none."""
    if not b or len(b) < 12 or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(b):
        name, n = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        if name == b"fmt " and n >= 16:
            tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", b, at + 8)
            fmt = tag, rate, block
        elif name == b"data" and fmt:
            return (*fmt, b[at + 8 : at + 8 + n]) if at + 8 + n <= len(b) else None
        at += 8 + n + (n & 1)
    return None


def samples(tag: int, block: int, data: bytes, tables: dict[int, np.ndarray]) -> np.ndarray | None:
    """int16 samples of stored data."""
    if tag in tables:
        return tables[tag][np.frombuffer(data, np.uint8)]
    if tag == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    if tag == ADPCM and block > 4:
        return decode_adpcm(np.frombuffer(data[: len(data) // block * block], np.uint8).reshape(-1, block)).reshape(-1)
    return None


def tables() -> dict[int, np.ndarray]:
    return {MULAW: mulaw_table(), ALAW: alaw_table()}


def expand_audio(df: DataFrame, media_col: str = "media", out_col: str = "pcm", rate: int = 16000) -> DataFrame:
    """df with each WAVE file's samples as little-endian 16-bit PCM at ``rate`` (null where it cannot be read). Integer ratios of rates are reduced first."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        luts = tables()
        for media in batches:
            out = []
            for b in media:
                wave = read_wave(b)
                x = wave and samples(wave[0], wave[2], wave[3], luts)
                g = np.gcd(rate, wave[1]) if wave and wave[1] else 0
                out.append(resample(x, rate // g, wave[1] // g).astype("<i2").tobytes() if x is not None and g else None)
            yield pd.Series(out, dtype=object)

    return df.withColumn(out_col, run(F.col(media_col)))


def store_bytes(df: DataFrame, payload_col: str = "payload", out_col: str = "media") -> DataFrame:
    """df with each payload as a mu-law WAVE file, a byte a sample: lossless."""

    @F.pandas_udf("binary")
    def run(payloads: pd.Series) -> pd.Series:
        return pd.Series([write_wave(b or b"", MULAW) for b in payloads], dtype=object)

    return df.withColumn(out_col, run(F.col(payload_col)))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Decoded ADPCM blocks at once: 4096 blocks make 9 MB of samples.
LANES = 4096


def adpcm_features(payloads: list[bytes]) -> list[str]:
    """Peak and mean level of each payload read as ADPCM blocks of FRAME bytes; blocks of all payloads are decoded side by side."""
    counts = np.array([len(p) // FRAME for p in payloads])
    peak, total, left = np.zeros(len(payloads), np.int64), np.zeros(len(payloads), np.int64), np.repeat(np.arange(len(payloads)), counts)
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    for at in range(0, len(blocks), LANES):
        level = np.abs(decode_adpcm(blocks[at : at + LANES]).astype(np.int32))
        np.maximum.at(peak, left[at : at + LANES], level.max(axis=1))
        np.add.at(total, left[at : at + LANES], level.sum(axis=1, dtype=np.int64))
    per = 1 + 2 * (FRAME - 4)
    return [f"{p}:{t // (c * per)}" for p, t, c in zip(peak, total, counts, strict=True)]


def digest_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as payloads: stored as mu-law files, read back, expanded and resampled to 16 kHz PCM."""
    luts = tables()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows, read = [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                n = max(FRAME, -(-len(raw) // FRAME) * FRAME)
                media = write_wave(raw + bytes([FILL]) * (n - len(raw)), MULAW)
                tag, rate, block, back = read_wave(media)
                x = samples(tag, block, back, luts)
                pcm = resample(x, 16000 // rate, 1).astype("<i2")
                level = x.astype(np.int64)
                crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                feature = f"{len(x)}:{int(np.abs(level).max())}:{int(np.sqrt((level * level).mean()))}:{crossings}:{zlib.crc32(pcm.tobytes())}:{int(np.abs(luts[ALAW][np.frombuffer(back, np.uint8)].astype(np.int64)).mean())}"
                read.append(back)
                rows.append([len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature])
            for row, f in zip(rows, adpcm_features(read), strict=True):
                row[-1] += ":" + f
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST.types[1:], strict=True))], schema=DIGEST)


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest_texts, DIGEST_DDL)
