import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm import spm


@pytest.fixture(scope="module")
def table():
    return spm.load()


def brute(chars, t):
    """The best sum of scores by a full lattice."""
    best = [0.0] + [float("-inf")] * len(chars)
    for j in range(1, len(chars) + 1):
        for i in range(max(0, j - t.longest), j):
            found = t.prefixes.get(chars[i:j])
            if found:
                best[j] = max(best[j], best[i] + found[1])
            elif j == i + 1:
                best[j] = max(best[j], best[i] + t.unknown)
    return best[-1]


def score(ids, chars, t):
    """Sum of scores of ids; runs of byte pieces count for the characters that they spell."""
    total, at, i = 0.0, 0, 0
    kind = {b: k for k, b in enumerate(t.byte_ids)}
    by_id = {x[0]: x[1] for x in t.prefixes.values() if x}
    while i < len(ids):
        if ids[i] in kind:
            n = len(chars[at].encode())
            assert bytes(kind[b] for b in ids[i : i + n]) == chars[at].encode()
            total, at, i = total + t.unknown, at + 1, i + n
        else:
            total, at, i = total + by_id[ids[i]], at + len(t.as_bytes[ids[i]].decode()), i + 1
    assert at == len(chars)
    return total


def test_streaming_equals_full_lattice(table):
    r = random.Random(5)
    for n in [*range(1, 40), 200, 1500]:
        for alphabet in ("abcdefghijklmnopqrstuvwxyz", "therinationü☃", f"a{spm.SPACE}", "the and of中".replace(" ", spm.SPACE)):
            s = "".join(r.choice(alphabet) for _ in range(n))
            assert score(spm.viterbi(s, table), s, table) == pytest.approx(brute(s, table), abs=1e-6)


def test_window_is_bounded(table):
    """Few boundaries are held at any character of a long stretch, and its ids are those of the full lattice."""
    r = random.Random(7)
    for s in ("x" * 5000, "".join(r.choice("therination") for _ in range(5000)), "日本" * 1000):
        held = []
        ids = spm.viterbi(s, table, held.append)
        assert len(held) == len(s) and max(held) <= 4 * table.longest
        assert score(ids, s, table) == pytest.approx(brute(s, table), abs=1e-6)


def test_unknown_ids(table):
    codec = spm.Codec(table)
    assert codec.decode([-1, 10**6, *codec.encode("the cat")]) == "the cat"


def test_lanes_equal_the_window(table):
    r = random.Random(6)
    words = ["".join(r.choice(a) for _ in range(r.randint(1, 60))) for a in ("abcdeit", "therinationü☃中", f"th{spm.SPACE}") for _ in range(300)]
    codec = spm.Codec(table)
    flat, counts = codec._distinct(words)
    at = 0
    for w, n in zip(words, counts, strict=True):
        assert flat[at : at + n].tolist() == spm.viterbi(w, table)
        at += n


CODEC = spm.Codec(spm.load())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    assert CODEC.decode(CODEC.encode(text)) == text


def test_library_decodes_the_same(table):
    import sentencepiece

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL), spm.Codec(table)
    for text in ("  a  b\n c\tünd ☃x", "the cat sat", " x ", "日本語テキスト"):
        assert sp.decode(codec.encode(text)) == codec.decode(codec.encode(text)) == text


def test_rows(spark):
    long = "ab cd\n" * 60_000 + "x" * 50_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (None, "a▁b c")], "doc_id long, text string")
    rows = spm.decode_pieces(spm.encode_pieces(df)).collect()
    assert [r.decoded for r in rows] == [r.text for r in rows]
    assert rows[0].ids is None and rows[1].ids == [] and rows[2].ids == rows[3].ids
    assert spm.encode_pieces(df.limit(0)).count() == 0
