import math
import random

import numpy as np
import pytest

from placeloom.llm import urls


def spam(r):
    return f"http://{''.join(r.choice('abcdef0123456789') for _ in range(20))}-win.biz/p?{'&'.join(f'k{i}={r.randrange(10**6)}' for i in range(4))}"


def ham(r):
    return f"https://www.{r.choice(['alpha', 'beta', 'gamma'])}.org/{r.choice(['about', 'news', 'docs'])}/{r.choice(['team', 'today'])}.html"


def test_trees_learn_on_held_out():
    r = random.Random(3)
    train = [(f(r), int(f is spam)) for f in (spam, ham) for _ in range(300)]
    m = urls.fit(*map(list, zip(*train, strict=True)))
    test = [(f(r), int(f is spam)) for f in (spam, ham) for _ in range(100)]
    p = urls.probability(m, [u for u, _ in test])
    assert ((p >= 0.5) == np.array([y for _, y in test], bool)).mean() > 0.97
    assert urls.probability(m, [None, "", "x" * 100_000]).shape == (3,)


def test_interaction():
    # neither feature alone decides: blocked if it has parameters and ends with a slash
    r = random.Random(4)
    rows = []
    for _ in range(800):
        q, s = r.random() < 0.5, r.random() < 0.5
        rows.append((f"http://h{r.randrange(50)}.net/abc{'/' if s else ''}{'?a=1' if q else ''}", int(q and s)))
    m = urls.fit(*map(list, zip(*rows, strict=True)))
    p = urls.probability(m, [u for u, _ in rows])
    assert ((p >= 0.5) == np.array([y for _, y in rows], bool)).mean() > 0.97


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for rule, _ in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


@pytest.mark.parametrize("sf", ["sf0.001", None])
def test_query(spark, tmp_path, sf):
    if sf is None:
        made = [None, "", "nourl", "http://EXAMPLE.com/en/7x", "http://xexample.com/en/7", "http://a.example.net/de/8", "ftp://net/de/", "http://a.org", "http://a.org?x=/es/", "a://b://c.com/en/", "http://com/en/\nx#f", "http://a.com/en/1", "http://a.com/en/1"]
        spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(made)], "page_id long, url string, host string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    where = str(tmp_path) if sf is None else f"/root/testdata/{sf}"
    got = urls.op2_boosted_urls(spark, where).collect()
    source = {r.page_id: r.url for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    assert len(got) == len(source)
    for r in got:
        assert (r.host, r.path, r.rule) == brute(source[r.page_id])
        assert r.verdict == (dict(urls.RULES)[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")


def test_no_labels(spark):
    df = spark.createDataFrame([("http://a.b/c",)], "url string")
    m = urls.train(urls.rule_labels(df, urls.RULES))
    assert urls.judge(df, m).first().verdict == "allow"
    assert urls.judge(df.limit(0), m).count() == 0


def walk(model, url):
    """The score of one URL by walking every tree from its root."""
    x = [*urls.lexical(url), *(r.get(s, model.rate) for r, s in zip(model.rates, urls.suffixes(url), strict=True))]
    z = model.prior
    for t in range(len(model.leaves)):
        node = 0
        for level in range(urls.DEPTH):
            f = model.feature[t][2**level - 1 + node]
            right = sum(e <= x[f] for e in model.edges[f]) > model.bin[t][2**level - 1 + node]
            node = 2 * node + right
        z += model.leaves[t][node]

    return 1 / (1 + math.exp(-z))


def test_scores_equal_trees_walked_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    model = urls.train(urls.rule_labels(pages, urls.RULES))
    source = {r.page_id: r.url for r in pages.collect()}
    got = urls.op2_boosted_urls(spark, sf).collect()
    for r in got:
        assert r.score == pytest.approx(walk(model, source[r.page_id]), abs=1e-9)
        assert r.rule or r.verdict == ("block" if walk(model, source[r.page_id]) >= 0.5 else "allow")


def test_first_split_is_the_best_of_all():
    """The root of the first tree: the gain of every feature and bin by plain sums."""
    r = random.Random(9)
    rows = [f"http://{'h' * r.randint(1, 9)}.net/{'a' * r.randint(0, 9)}{'?x=1' if r.random() < 0.5 else ''}" for _ in range(300)]
    labels = [int("?" in u or r.random() < 0.2) for u in rows]
    m = urls.fit(rows, labels)
    x = np.array([urls.lexical(u) for u in rows])
    p = np.mean(labels)
    best = None
    for f in range(x.shape[1]):
        for c in range(len(m.edges[f]) + 1):
            left = np.array([sum(e <= v for e in m.edges[f]) <= c for v in x[:, f]])
            g = np.array(labels) - p
            h = np.full(len(g), p * (1 - p))
            if h[left].sum() < 0.5 or h[~left].sum() < 0.5:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best or (0, 0, 0), (gain, -f, -c))
    if m.feature[0][0] < x.shape[1]:
        assert (m.feature[0][0], m.bin[0][0]) == (-best[1], -best[2])
