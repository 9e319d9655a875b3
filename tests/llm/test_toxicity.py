import random

import numpy as np
import pytest

from placeloom.llm import toxicity as tx


def corpus(n, seed=1):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["zork", "zorky", "qwump"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels, [("en", "de", None)[i % 3] for i in range(n)]


@pytest.fixture(scope="module")
def model():
    return tx.fit(*corpus(800))


def slow_logit(m, text):
    """One text, one filter, one place at a time."""
    import pyarrow as pa

    w = tx.words(text)
    vec = m.table[tx.places(pa.array(w, pa.string()))].mean(axis=1) if w else np.zeros((0, tx.DIM))
    total = 0.0
    for k in range(len(tx.WIDTHS)):
        for f in range(tx.FILTERS):
            values = [sum(float(vec[t + j] @ m.kernel[:, c.start + f]) for kk, j, c in tx.COLUMNS if kk == k and t + j < len(w)) for t in range(len(w))] or [0.0]
            total += max(max(values) + float(m.bias[k, f]), 0) * float(m.out[k, f])
    return total * m.slope + m.offset


def test_held_out_accuracy(model):
    texts, labels, _ = corpus(400, seed=2)
    # other plain words than in training: only the marked ones are shared
    right = (tx.logits(model, texts) >= 0) == np.array(labels, bool)
    assert right.mean() > 0.9


def test_scores_equal_brute_force(model, monkeypatch):
    texts = [None, "", "zork", "a zork b", "!!", "one two three four five six seven zorky eight " * 3]
    want = [slow_logit(model, t) for t in texts]
    for size in (20_000, 7, 2):
        monkeypatch.setattr(tx, "SLICE", size)
        assert tx.logits(model, texts) == pytest.approx(want, abs=1e-3)


def test_one_class():
    assert tx.fit(["a"], [0], ["en"]).offset < 0
    assert tx.logits(tx.fit([], [], []), ["x", None]).shape == (2,)


def test_query(spark, tmp_path):
    texts, labels, langs = corpus(120)
    rows = [(i, t, lang, "s", "x") for i, (t, lang) in enumerate(zip(texts, langs, strict=True))] + [(1000, None, None, None, None), (1001, "zork " * 60_000, "en", None, None), (1001, "zork " * 60_000, "en", None, None), (None, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*((i, 1, y) for i, y in enumerate(labels)), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = tx.op10_conv_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 1001}) == 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " * (i + 1), "en") for i in range(100)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None)], "doc_id long, toxic int")
    one, two = tx.sample(docs, labels), tx.sample(docs.repartition(7).orderBy("text"), labels)
    assert one == two and len(one[0]) == 50
    few = tx.sample(docs, labels, chars=3000)[0]
    assert 0 < len(few) < 50 and sum(map(len, few)) <= 3000
    assert len(tx.sample(docs, labels, rows=7)[0]) <= 7
    assert tx.sample(docs.limit(0), labels) == ([], [], [])


def test_all_labelled_rows_train(spark, monkeypatch):
    """No row is left out by a bound on the sample, several shards and partitionings give one model, and it tells classes apart."""
    monkeypatch.setattr(tx, "SAMPLE", 50)
    texts, labels, langs = corpus(700, seed=3)
    docs = spark.createDataFrame([*((i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))), (3, "~ " + texts[3], "en"), (9000, "not labelled", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    coded = tx.labelled(docs, marks).collect()
    assert sorted(r.doc_id for r in coded) == list(range(700)) and all(r.text == texts[r.doc_id] for r in coded)
    one, two = tx.train(docs, marks, size=150), tx.train(docs.repartition(7), marks.repartition(3), size=150)
    monkeypatch.setattr(tx, "FAN", 2)  # averaged in levels
    levels = tx.train(docs, marks, size=150)
    assert abs(levels.table - one.table).max() < 1e-2
    assert (one.table == two.table).all() and one.thresholds == two.thresholds and one.slope == two.slope
    other, wanted, _ = corpus(300, seed=4)
    assert ((tx.logits(one, other) >= 0) == np.array(wanted, bool)).mean() > 0.9
    assert max(abs(tx.raw_logit(one, c) - z) for c, z in zip(tx.coded_texts(other), tx.logits(one, other), strict=True)) < 1e-3
