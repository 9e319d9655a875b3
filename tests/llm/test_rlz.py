import hashlib
import random
import re

import numpy as np
import pytest

from placeloom.llm import rlz


def brute(rows):
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for p in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][p : p + 20]), (i, p))
    out = {}
    for i, ws in words.items():
        gone = [False] * len(ws)
        for p in range(len(ws) - 19):
            if first[tuple(ws[p : p + 20])] < (i, p):
                gone[p : p + 20] = [True] * 20
        kept = [w for w, g in zip(ws, gone, strict=True) if not g]
        out[i] = (len(ws), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(60)]
    shared = [[r.choice(vocab) for _ in range(n)] for n in (19, 20, 21, 45, 90)]
    rows = []
    for i in r.sample(range(-100, 3000), 60):
        ws = []
        for _ in range(r.randrange(5)):
            ws += [r.choice(vocab) for _ in range(r.randrange(30))]
            if r.random() < 0.6:
                s = r.choice(shared)
                a = r.randrange(len(s))
                ws += s[a:] if r.random() < 0.5 else s
        rows.append((i, r.choice([" ", "\n", " \t "]).join(ws)))
    rows += [(5000, None), (5001, ""), (5002, "a " * 100), (5003, "a b c " * 40), (5004, rows[3][1]), (5005, "x"), (5006, "a " * 19), (5007, "a " * 20)]
    return rows


@pytest.mark.parametrize(("seed", "parts", "bits", "group"), [(1, 1, 8, 512), (2, 9, 2, 3), (3, 25, 1, 2)])
def test_equals_all_windows(spark, seed, parts, bits, group):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(parts)
    parsed = rlz.Parsed(docs, bits, group)
    assert parsed.blocks.count() > parts // 2
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in parsed.digests().collect()}
    assert got == brute(rows)


def greedy(rows):
    """Factors of every document by a plain parser: the longest match in the reference, word by word; the reference holds the first places of windows that occur again."""
    words = {i: (t or "").split() for i, t in rows}
    first, often = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 19):
            w = tuple(words[i][p : p + 20])
            first.setdefault(w, (i, p))
            often[w] = often.get(w, 0) + 1
    stretches = []  # (document, start, words) of the reference
    for i in sorted(words):
        run = None
        for p in range(len(words[i]) - 19):
            w = tuple(words[i][p : p + 20])
            if often[w] > 1 and first[w] == (i, p):
                run = p if run is None else run
                if not stretches or stretches[-1][:2] != (i, run):
                    stretches.append((i, run, None))
                stretches[-1] = (i, run, words[i][run : p + 20])
            else:
                run = None
    out = []
    for i in sorted(words):
        p = 0
        while p < len(words[i]):
            best = (19, None, None)
            for d, s, ws in stretches:
                for q in range(len(ws) - 19):
                    if (d, s + q) < (i, p) and ws[q : q + 20] == words[i][p : p + 20]:
                        n = 20
                        while q + n < len(ws) and p + n < len(words[i]) and ws[q + n] == words[i][p + n]:
                            n += 1
                        if n > best[0]:
                            best = (n, d, s + q)
            if best[1] is None:
                p += 1
            else:
                out.append((i, p, *best))
                p += best[0]
    return out


def test_factors_equal_a_greedy_parser(spark):
    rows = corpus(6)[:40]
    rows += [(4000, " ".join(f"a{i}" for i in range(20))), (4001, " ".join([f"a{i}" for i in range(20)] + [f"b{i}" for i in range(30)])), (4002, " ".join([f"a{i}" for i in range(20)] + [f"b{i}" for i in range(30)]))]
    parsed = rlz.Parsed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 3)
    got = sorted(map(tuple, parsed.factors().collect()))
    assert got == sorted(greedy(rows))
    assert [f[1:] for f in got if f[0] == 4002] == [(0, 20, 4000, 0), (20, 30, 4001, 20)]


def test_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = {tuple(r) for r in rlz.op4_lz_substrings(spark, sf).collect()}
    assert got == set(con.sql(rlz.OP4_SQL).fetchall())


def test_factors_point_to_equal_words(spark):
    rows = corpus(4)
    words = {i: (t or "").split() for i, t in rows}
    parsed = rlz.Parsed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = parsed.factors().collect()
    assert found
    for f in found:
        assert f.n_words >= 20 and (f.source_doc, f.source_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start : f.start + f.n_words] == words[f.source_doc][f.source_start : f.source_start + f.n_words]
    assert {x.doc_id: hashlib.sha256(x.kept.encode()).hexdigest() for x in parsed.kept().collect()} == {i: h for i, (_, _, h) in brute(rows).items()}


def test_rolling():
    h = np.arange(1, 50, dtype=np.uint64)
    for n in (1, 2, 5, 8, 20):
        got = rlz.rolling(h, n)
        assert len(got) == 50 - n and len(set(got.tolist())) == len(got)
        assert rlz.rolling(h[3:], n)[0] == got[3]


def test_rows(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (9, text)], "doc_id long, text string")
    got = sorted((x.doc_id or 10**9, x.n_removed) for x in rlz.Parsed(df).digests().collect())
    assert got == [(3, 0), (3, 0), (9, 30), (10**9, 30)]
    assert rlz.Parsed(df.limit(0)).digests().count() == 0
