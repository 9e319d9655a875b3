import hashlib
import random

import numpy as np
import pytest

from placeloom.llm import fingerprint as fp


def slow_signature(text):
    words = fp._WORDS((text or "").lower())
    if not words:
        return b""
    h, _ = fp.shingle_hashes([text])
    a, b = fp.coefficients()
    x = [int(v) >> 33 for v in h]
    return b"".join(min((int(p) * (v % int(fp.PRIME)) + int(q)) % int(fp.PRIME) for v in x).to_bytes(4, "little") for p, q in zip(a, b, strict=True))


def test_signature_equals_brute_force(monkeypatch):
    texts = ["one two three four five six seven", "", None, "!!", "hi", "x " * 300, "é Ü ß ñ a b c d"]
    for step in (fp.STEP, 5):
        monkeypatch.setattr(fp, "STEP", step)
        got = fp.signatures(texts, *fp.coefficients())
        for t, s in zip(texts, got, strict=True):
            assert (s.tobytes() if s[0] != 0xFFFFFFFF else b"") == slow_signature(t)


def test_likeness_follows_jaccard():
    r = random.Random(1)
    words = [str(r.randrange(10**6)) for _ in range(2000)]
    other = words[:1700] + [str(r.randrange(10**6)) for _ in range(300)]
    a, b = (set(fp.shingle_hashes([" ".join(w)])[0].tolist()) for w in (words, other))
    s, t = fp.signatures([" ".join(words), " ".join(other)], *fp.coefficients())
    assert abs((s == t).mean() - len(a & b) / len(a | b)) < 0.2


@pytest.mark.parametrize("rows_each", [2000, 3])
def test_query(spark, tmp_path, rows_each, monkeypatch):
    monkeypatch.setattr(fp.with_next, "__defaults__", (rows_each,))
    r = random.Random(2)
    ids = r.sample(range(-50, 10**12), 37)
    rows = [(i, r.choice([None, "", "ab", "é" * 7, "word " * r.randrange(200)]), 0) for i in ids]
    where = str(tmp_path / str(rows_each))
    spark.createDataFrame(rows, "doc_id long, text string, next_text int").write.parquet(where + "/documents.parquet")
    got = {x.doc_id: x for x in fp.op7_minhash_fingerprints(spark, where).collect()}
    down = sorted(rows, reverse=True, key=lambda x: x[0])
    assert len(got) == len(rows)
    like = lambda x, y: float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean()) if x and y else float(x == y)
    for (i, t, _), (_, after, _) in zip(down, [*down[1:], down[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, nxt = slow_signature(t), slow_signature(edited), slow_signature(after)
        assert (x.fingerprint, x.edited_fingerprint) == (own.hex(), changed.hex())
        assert (x.near_edited, x.near_next) == (like(own, changed), like(own, nxt))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "n"), (5, "a"), (5, "b"), (2, "c")], "doc_id long, text string")
    for rows_each in (2000, 1):
        got = {r.text: r.n for r in fp.with_next(df, "doc_id", "text", {"n": "text"}, rows_each).collect()}
        assert got == {"a": "b", "b": "c", "c": "n", "n": "a"}
    assert fp.with_next(df.limit(0), "doc_id", "text", {"n": "text"}).count() == 0


def test_near_pairs(spark):
    r = random.Random(3)
    base = [str(r.randrange(10**6)) for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, "something else entirely here now"), (5, None)], "doc_id long, text string")
    got = {x.doc_id: x["class"] for x in fp.near_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_near_classes_equal_all_pairs(spark):
    r = random.Random(5)
    word = lambda: str(r.randrange(10**6))
    texts = []
    for size in (150, 40, 3, 1, 1):
        base = [word() for _ in range(300)]
        for k in range(size):
            w = list(base)
            if k % 3:  # a third are exact copies, the others differ in a word or two
                for _ in range(k % 3):
                    w[r.randrange(300)] = word()
            texts.append(" ".join(w))
    # a head that all texts of another group share: a hot shingle, but no near copies
    head = [word() for _ in range(60)]
    texts += [" ".join(head + [word() for _ in range(240)]) for _ in range(60)]
    ids = r.sample(range(10**6), len(texts))
    sets = [set(fp.shingle_hashes([t])[0].tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= fp.THRESHOLD:
                root[top(i)] = top(j)
    smallest = {}
    for i, d in enumerate(ids):
        smallest[top(i)] = min(smallest.get(top(i), d), d)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {x.doc_id: x["class"] for x in fp.near_classes(df).collect()}
    assert got == {d: smallest[top(i)] for i, d in enumerate(ids)}
