import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from placeloom.llm import lm


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def brute(rows):
    """Everything from plain counters; weights by EM on the exact estimates."""
    part = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    docs = {i: tokens(t) for i, t in rows}
    full, kept = ((Counter(), Counter(), Counter()), (Counter(), Counter(), Counter()))
    for i, ws in docs.items():
        for store, ok in ((full, part[i] != 0), (kept, part[i] > 1)):
            if ok:
                for u, w in zip(["^", *ws], ws, strict=False):
                    store[0][w] += 1
                    store[1][u] += 1
                    store[2][u, w] += 1
    n, v, kn = sum(full[0].values()), len(full[0]), sum(kept[0].values())
    rows_of = {}
    for i, ws in docs.items():
        if part[i] == 1:
            for u, w in zip(["^", *ws], ws, strict=False):
                c = kept[1][u]
                b = int(math.log2(c)) + 1 if c else 0
                rows_of.setdefault(b, []).append((kept[2][u, w] / c if c else 0, kept[0][w] / kn, 1 / (v + 1)))

    def em(ps, start, prior, rounds=60):
        w = start
        for _ in range(rounds):
            share = w * ps
            share /= share.sum(axis=1)[:, None]
            w = prior(share)
        return w

    every = np.array([p for ps in rows_of.values() for p in ps])
    whole = em(every, np.array([1 / 3] * 3), lambda s: (s.sum(axis=0) + 0.01) / (len(s) + 0.03))
    weights = {b: em(np.array(ps), whole, lambda s: (s.sum(axis=0) + 10 * whole) / (len(s) + 10)) for b, ps in rows_of.items()}
    out = {}
    for i, ws in docs.items():
        base = score = known = 0
        for u, w in zip(["^", *ws], ws, strict=False):
            base += math.log10((full[0][w] + 0.1) / (n + 0.1 * (v + 1)))
            known += full[0][w] > 0
            c = full[1][u]
            b = int(math.log2(c)) + 1 if c else 0
            l2, l1, l0 = weights.get(b, whole)
            if not c:
                l2, l1, l0 = 0, l1 / (l1 + l0), l0 / (l1 + l0)
            score += math.log10(l2 * (full[2][u, w] / c if c else 0) + l1 * full[0][w] / n + l0 / (v + 1))
        out[i] = (part[i] == 0, len(ws), known, n, base, score)
    return out


@pytest.mark.parametrize(("chunk", "bits", "group"), [(lm.CHUNK, 8, 512), (900, 2, 3)])
def test_scores_equal_counters(spark, tmp_path, chunk, bits, group, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    r = random.Random(1)
    vocab = ["".join(r.choice("abcÄé.") for _ in range(r.randint(1, 5))) for _ in range(150)]
    rows = [(i, r.choice([" ", "\n", "\x0b", "  "]).join(vocab[int(r.paretovariate(0.7)) % 150] for _ in range(r.randrange(60)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "A b " * 20_000)]
    where = str(tmp_path / str(chunk))
    spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, chunk string").write.parquet(where + "/documents.parquet")
    got = {x.doc_id: x for x in lm.interpolated_scores(lm.documents(spark, where), bits=bits, group=group).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, train, base, score) in want.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, train)
        assert x.base_score == pytest.approx(base, abs=1e-6 * n)
        assert x.score == pytest.approx(score, rel=0.01, abs=0.05)  # the weights come from cells, not from single tokens


def test_better_than_base_on_held_out(spark):
    rows = lm.op1_deleted_interpolation(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = lm.interpolated_scores(df).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and sum(r.doc_id is None for r in got) == 1
    assert lm.interpolated_scores(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(i, "x") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in lm.interpolated_scores(alone).collect())
