"""URL filter: gradient-boosted trees on lexical features, under a list of rules.

Features: lengths of URL, host, path and query, path depth, host labels, digit and
upper-case ratios, hyphens, escapes, entropy of characters, parameters, port,
fragment, scheme, and statistics of suffixes (the share of blocked URLs among
training URLs with the same last host label, last two host labels, and file
extension, shrunk to the overall share). Trees are grown level by level on
quantile bins with histograms of gradients and curvatures.

Training takes labelled URLs, at most ``SAMPLE`` rows of each class (those of the
smallest hash of the URL, whatever the table's size), on the driver. Scoring needs
no shuffle.

Rules are ``host/path`` strings with a verdict. A rule fits its host and all
subdomains if the URL's path starts with the rule's; the longest fitting rule wins
and overrides the trees.

Defined results: null URLs and URLs without ``://`` have empty host and path and
no rule, and are judged by the trees; without labels of both classes the score is
the share of blocked labels (0 without any, so: allow); long URLs are judged whole;
repeated rows are judged each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 10_000
TREES = 60
DEPTH = 3
BINS = 32
RATE = 0.2
#: Upper- and lower-case letters that host names fold (A-Z only).
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query: (host and path, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


# ---- features -----------------------------------------------------------------

_PARTS = re.compile(r"(?s)(?:(.*?)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?")
_EXTENSION = re.compile(r"\.([A-Za-z0-9]{1,6})/?$")


def _split(url: str | None) -> tuple[str, str, str, str, str]:
    m = _PARTS.match(url or "")
    return tuple(x or "" for x in m.groups())


def suffixes(url: str | None) -> tuple[str, str, str]:
    """Last host label, last two, file extension of the path."""
    _, host, path, _, _ = _split(url)
    labels = host.lower().split("@")[-1].split(":")[0].split(".")
    ext = _EXTENSION.search(path)
    return labels[-1], ".".join(labels[-2:]), ext[1].lower() if ext else ""


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None) -> list[float]:
    url = url or ""
    scheme, host, path, query, fragment = _split(url)
    n = max(len(url), 1)
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / n,
        sum(c.isdigit() for c in host) / max(len(host), 1), sum(c.isupper() for c in url) / n, host.count("-"), path.count("-") + path.count("_"),
        url.count("%"), entropy(url), entropy(host), query.count("&") + bool(query), query.count("="), float(":" in host), float(bool(fragment)),
        float(scheme == "https"), max(map(len, re.split(r"[^A-Za-z0-9]+", url)), default=0), float("@" in host), float(path.endswith("/")),
    ]


class Trees(NamedTuple):
    """edges: bin edges of each feature; nodes: (trees, 2**DEPTH - 1) feature and bin; leaves: (trees, 2**DEPTH)."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    leaves: np.ndarray
    prior: float
    rates: list[dict[str, float]]
    rate: float


def _rates(keys: np.ndarray, y: np.ndarray, rate: float) -> dict[str, float]:
    """Shrunk share of blocked rows for each suffix that three rows at least have."""
    sums: dict[str, list[float]] = {}
    for key, t in zip(keys, y, strict=True):
        own = sums.setdefault(key, [0.0, 0])
        own[0] += t
        own[1] += 1
    return {k: (a + 10 * rate) / (n + 10) for k, (a, n) in sums.items() if n >= 3}


def features(urls, rates: list[dict[str, float]], rate: float) -> np.ndarray:
    rows = [[*lexical(u), *(r.get(s, rate) for r, s in zip(rates, suffixes(u), strict=True))] for u in urls]
    return np.array(rows, np.float64).reshape(len(rows), -1)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), np.int64)


def fit(urls: list[str | None], blocked: list[int]) -> Trees:
    y = np.array(blocked, np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    none = Trees([], np.zeros((0, 0), int), np.zeros((0, 0), int), np.zeros((0, 0)), float(np.clip(math.log((rate + 1e-6) / (1 - rate + 1e-6)), -13, 13)), [{}, {}, {}], rate)
    if len(set(blocked)) < 2:
        return none
    own = np.array([suffixes(u) for u in urls], dtype=object)
    fold = np.arange(len(y)) % 5
    rates = [_rates(own[:, k], y, rate) for k in range(own.shape[1])]
    x = features(urls, rates, rate)
    for k in range(own.shape[1]):  # a training row's statistics come from the other folds, so they do not hold its label
        for f in range(5):
            other = _rates(own[fold != f, k], y[fold != f], rate)
            x[fold == f, x.shape[1] - own.shape[1] + k] = [other.get(s, rate) for s in own[fold == f, k]]
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    b = binned(x, edges)
    n, width = b.shape
    prior = math.log(rate / (1 - rate))
    z = np.full(n, prior)
    inner, last = 2**DEPTH - 1, 2**DEPTH
    feature, at_bin, leaves = np.zeros((TREES, inner), int), np.full((TREES, inner), BINS), np.zeros((TREES, last))
    slot = (np.arange(width) * BINS)[None, :] + b
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            count = 2**level
            key = (node[:, None] * (width * BINS) + slot).reshape(-1)
            gs = np.bincount(key, np.repeat(g, width), count * width * BINS).reshape(count, width, BINS)
            hs = np.bincount(key, np.repeat(h, width), count * width * BINS).reshape(count, width, BINS)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(hl < 0.5) | (ha - hl < 0.5)] = 0
            best = gain.reshape(count, -1).argmax(1)
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            f, c = np.where(useful, best // BINS, 0), np.where(useful, best % BINS, BINS)
            feature[t, count - 1 : 2 * count - 1], at_bin[t, count - 1 : 2 * count - 1] = f, c
            node = 2 * node + (b[np.arange(n), f[node]] > c[node])
        gsum, hsum = np.bincount(node, g, last), np.bincount(node, h, last)
        leaves[t] = RATE * gsum / (hsum + 1)
        z += leaves[t][node]
    return Trees(edges, feature, at_bin, leaves, prior, rates, rate)


def probability(m: Trees, urls) -> np.ndarray:
    z = np.full(len(urls), m.prior)
    if len(m.leaves) and len(urls):
        b = binned(features(urls, m.rates, m.rate), m.edges)
        at = np.arange(len(b))
        for t in range(len(m.leaves)):
            node = np.zeros(len(b), np.int64)
            for level in range(DEPTH):
                k = 2**level - 1 + node
                node = 2 * node + (b[at, m.feature[t, k]] > m.bin[t, k])
            z += m.leaves[t][node]
    return 1 / (1 + np.exp(-z))


# ---- rules and verdicts ---------------------------------------------------------


def host_and_path(url):
    """Columns: the host after the first ``://`` (A-Z lower-cased) and the path; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host, path, rules):
    """Column: the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), F.lit(rule)).otherwise(out)
    return out


def judge(df: DataFrame, model: Trees, rules=(), url_col: str = "url") -> DataFrame:
    """df with host, path, rule, score (probability of block) and verdict."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(probability(sent.value, urls.tolist()), dtype="float64")

    host, path = host_and_path(F.col(url_col))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    with_parts = df.withColumns({"host": host, "path": path}).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    return with_parts.withColumn("score", score(F.col(url_col))).withColumn("verdict", verdict)


def train(labelled: DataFrame, rows: int = SAMPLE) -> Trees:
    """Trees from columns url and blocked (0 or 1): at most ``rows`` distinct URLs of each class."""
    some = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked")).dropDuplicates(["url"])
    parts = [some.where(F.col("blocked") == c).orderBy(F.xxhash64("url"), "url").limit(rows) for c in (0, 1)]
    got = parts[0].unionByName(parts[1]).toPandas().sort_values("url")
    return fit(got["url"].tolist(), got["blocked"].tolist())


def rule_labels(pages: DataFrame, rules) -> DataFrame:
    """URLs that a rule decides, as labelled URLs."""
    host, path = host_and_path(F.col("url"))
    ruled = pages.select("url", rule_for(host, path, rules).alias("rule")).where("rule is not null")
    return ruled.select("url", F.col("rule").isin(*[r for r, what in rules if what == "block"]).cast("int").alias("blocked"))


def op2_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URLs are those that the rules decide; the trees carry their lexical traits to all others."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = train(rule_labels(pages, RULES))
    return judge(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
