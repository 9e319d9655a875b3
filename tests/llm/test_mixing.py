import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.llm import mixing


def test_rake_meets_all_margins():
    r = np.random.default_rng(1)
    have = r.random((4, 3, 2)) + 0.1
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.3, 0.7])]
    w = mixing.rake(have, targets)
    for k, t in enumerate(targets):
        assert w.sum(axis=tuple(a for a in range(3) if a != k)) == pytest.approx(t, abs=1e-8)
    # raking keeps odds ratios inside the table
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert odds(w) == pytest.approx(odds(have))
    assert mixing.rake(np.zeros((2, 2)), targets[2:] * 2).sum() == 0


def test_probabilities():
    have, want = np.array([50.0, 30.0, 20.0]), np.array([0.2, 0.3, 0.5])
    p = mixing.probabilities(have, want, 0.3)
    kept = have / 100 * p
    assert kept.sum() == pytest.approx(0.3) and kept / kept.sum() == pytest.approx(want)
    p = mixing.probabilities(have, want, 0.8)
    assert p.max() == 1 and (have / 100 * p).sum() == pytest.approx(0.8)
    assert mixing.probabilities(have, want, 1.0) == pytest.approx([1, 1, 1])


def test_tokens_and_topic(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc \n", "é x y", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.tokens(F.col("text")).alias("n"), mixing.topic(F.col("text")).alias("t"))
    for r in df.collect():
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.t in ("symbols", "short-lined", "long-lined")


def test_query_equals_python(spark):
    sf = "/root/testdata/sf0.01"
    got = mixing.op9_raked_mixture(spark, sf).collect()
    names = list(mixing.TARGETS)
    levels = {c: [*mixing.TARGETS[c], "other"] for c in names}
    have = np.zeros([len(levels[c]) for c in names])
    place = lambda r: tuple(levels[c].index(r[c]) if r[c] in levels[c] else len(levels[c]) - 1 for c in names)
    for r in got:
        have[place(r)] += r.n_tokens
    want = mixing.rake(have, [np.array([*mixing.TARGETS[c].values(), 0]) for c in names])
    p = mixing.probabilities(have.reshape(-1), want.reshape(-1), mixing.KEEP).reshape(have.shape)
    for r in got:
        assert r.probability == pytest.approx(p[place(r)])
        draw = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        assert r.draw == pytest.approx(draw, abs=1e-15) and r.kept == (draw < r.probability)
    kept = sum(r.n_tokens for r in got if r.kept) / have.sum()
    assert len(got) == 1000 and abs(kept - mixing.KEEP) < 0.08


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", None, "en", 5), (1, "a b", None, "en", 5), (None, None, "new", "xx", None)], "doc_id long, text string, source string, lang string, kept int").withColumn("topic", F.lit("other"))
    got = mixing.mixed(df, mixing.TARGETS).collect()
    assert len(got) == 3 and len({r.draw for r in got}) == 2 and all(0 <= r.probability <= 1 for r in got)
    assert mixing.mixed(df.limit(0), mixing.TARGETS).count() == 0


def test_unlisted_values_are_sampled(spark):
    langs = ["en", "fr", "de", "es", None, "xx"]
    rows = [(i, "w " * (5 + i % 7), f"src{i % 20}" if i % 3 else ("hot" if i % 2 else None), langs[i // 3 % 6]) for i in range(3000)]
    rows += [(3000, None, "wordless", "en"), (3001, "", None, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("topic", F.lit("long-lined"))
    got = mixing.mixed(df, mixing.TARGETS).collect()
    assert len(got) == 3002 and all(r.probability > 0 for r in got)
    total, expected = sum(r.n_tokens for r in got), sum(r.n_tokens * r.probability for r in got)
    assert expected / total == pytest.approx(mixing.KEEP)
    for col in ("source", "lang"):
        unlisted = [r for r in got if r[col] not in mixing.TARGETS[col]]
        # wanted tokens (weight times present tokens): unlisted values as they are, the targets of the rest
        own = sum(r.n_tokens for r in unlisted) / total
        assert own > 0.3 and sum(r.n_tokens * r.weight for r in unlisted) / total == pytest.approx(own)
        for v, share in mixing.TARGETS[col].items():
            assert sum(r.n_tokens * r.weight for r in got if r[col] == v) / total == pytest.approx(share * (1 - own), abs=1e-6)


def test_room_and_zero_shares_of_other():
    have = np.array([60.0, 10.0, 30.0])
    assert mixing.with_other({"a": 0.5, "b": 0.5}, ["a", "b", "other"], have) == pytest.approx([0.35, 0.35, 0.3])
    assert mixing.with_other({"a": 0.5, "b": 0.4}, ["a", "b", "other"], have) == pytest.approx([0.5, 0.4, 0.1])
    assert mixing.with_other({"a": 0.5, "b": 0.5, "other": 0.0}, ["a", "b", "other"], have) == pytest.approx([0.5, 0.5, 0.0])
    assert mixing.with_other({"a": 0.5, "b": 0.5}, ["a", "b", "other"], np.array([6.0, 4.0, 0.0])) == pytest.approx([0.5, 0.5, 0.0])


def plain_raking(cells, targets, rounds=2000):
    """Dictionary cells scaled to each margin in turn, one after another."""
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(rounds):
        for axis, want in enumerate(targets):
            have = {}
            for k, v in w.items():
                have[k[axis]] = have.get(k[axis], 0) + v
            room = sum(want[c] for c, v in have.items() if v)
            w = {k: v * want[k[axis]] / room / have[k[axis]] if have[k[axis]] else 0 for k, v in w.items()}
    return w


def test_rake_equals_a_plain_loop():
    r = np.random.default_rng(3)
    have = r.random((5, 4, 3)) * (r.random((5, 4, 3)) < 0.8)
    have[2] = 0  # a category with a target and no tokens
    targets = [np.array([0.1, 0.2, 0.2, 0.3, 0.2]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.6, 0.3, 0.1])]
    want = plain_raking({k: float(have[k]) for k in np.ndindex(have.shape)}, [dict(enumerate(t)) for t in targets])
    got = mixing.rake(have, targets, 2000)
    assert all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
