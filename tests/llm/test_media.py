import hashlib
import random

import numpy as np
import pytest

from placeloom.llm import media
from placeloom.llm.media import ADPCM, INDEX, MULAW, PCM, STEPS


def test_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0x7F], mu[0xFF]) == (-32124, 32124, 0, 0)
    assert (a[0x2A], a[0xAA], a[0x55], a[0xD5]) == (-32256, 32256, -8, 8)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def one_block(b):
    value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
    out = [value]
    for byte in b[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(STEPS[index])
            diff = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(INDEX[code & 7])))
            out.append(value)
    return out


def test_adpcm_equals_a_loop():
    r = random.Random(1)
    blocks = [bytes(r.randrange(256) for _ in range(36)) for _ in range(20)]
    got = media.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 36))
    assert got.tolist() == [one_block(b) for b in blocks]


def test_resample_keeps_a_tone():
    t = np.arange(800)
    x = np.rint(8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    for up, down in ((2, 1), (1, 2), (3, 2)):
        y = media.resample(x, up, down).astype(float)
        want = 8000 * np.sin(2 * np.pi * 440 * np.arange(len(y)) * down / up / 8000)
        assert len(y) == -(-800 * up // down) and np.abs(y - want)[60:-60].max() < 160
    assert np.array_equal(media.resample(x, 2, 1)[::2], x)


def test_wave_round_trip():
    for data, tag, bits, block in ((b"\1\2\3", MULAW, 8, 1), (b"\1\2\3\4", PCM, 16, 2), (bytes(72), ADPCM, 4, 36)):
        assert media.read_wave(media.write_wave(data, tag, 8000, bits, block, 65 if tag == ADPCM else 0)) == (tag, 8000, block, data)
    assert media.read_wave(b"RIFFxxxx") is None and media.read_wave(None) is None


@pytest.mark.parametrize("rate", [8000, 16000])
def test_expand(spark, rate):
    df = spark.createDataFrame([(1, b"\x00\x80"), (2, None), (2, b"")], "id long, payload binary")
    rows = {(r.id, r.payload and bytes(r.payload)): r.pcm for r in media.expand_audio(media.store_bytes(df), rate=rate).collect()}
    assert len(rows[1, b"\x00\x80"]) == 4 * rate // 8000 and bytes(rows[2, None]) == b""
    bad = spark.createDataFrame([(1, b"nope")], "id long, media binary")
    assert media.expand_audio(bad).first().pcm is None


def test_query(spark, tmp_path):
    texts = [None, "", "x" * 576, "é" * 289, "long " * 100_000, "x" * 576]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, feature int").write.parquet(str(tmp_path / "documents.parquet"))
    rows = media.op5_telephony_audio(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_bytes) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), len(want) + 46)
    assert rows[2][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
