r"""Toxicity by a convolutional text classifier in numpy.

Words (``\w+`` of the lower-cased text) have hashed embeddings: the mean of the
rows of one table to which the word, its prefixes and its suffix hash. Filters of
several widths run over the word sequence, each keeps its maximum over the whole
text, and a logistic layer scores the maxima. Max pooling sends a gradient to one
place a filter, so training touches few rows a step (Adagrad).

Training takes every labelled row (of rows that share an id the one with the smallest
text). Texts are dealt by hash into shards of about ``SHARD`` texts, and their words are
coded once, as the rows of the table that they hash to. In each of some rounds all shards
go through their texts from one model, and the models are averaged in levels of
``FAN`` (a row of the table by how often each shard has changed it). A fifth of the
rows is a fold that trains no weights: all of it is scored, counted in cells of
1/``CELLS`` of a logit, and gives the calibration (one slope and offset) and a
threshold for each language with enough labels (the global one else). ``fit`` does
the same for lists on one machine, ``sample`` draws a bounded list for it; the
queries use neither.
Scores never see labels, language, source or id; the threshold of a row's
language only decides its ``rejected`` flag.

Scoring needs no shuffle: each distinct word of a batch is projected through all
filters once, and texts are walked in slices of bounded size, so a text of any
length is scored whole.

Defined results: null and empty texts get the score of no words (the bias);
repeated rows score alike; without labels of both classes every score is the share
of label 1 (0 without any); an empty table gives an empty table; columns that
clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, pack, pack_sorted, save, small, trim, unpack, unpack_sorted

#: Texts and characters of a shard, about.
SHARD, SHARD_CHARS = 8192, 40_000_000
FAN = 16
CELLS = 256
#: Rounds over several shards; of one shard there are EPOCHS.
ROUNDS = 4
#: Rows and characters that sample() takes at most.
SAMPLE = 6000
SAMPLE_CHARS = 60_000_000
ROWS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 8
SLICE = 20_000
#: Characters of text that are tokenised at once.
CHARS = 1_000_000
_WORDS = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def places(vocab: pa.Array) -> np.ndarray:
    """Rows of the embedding table (1 and up; 0 is padding) for each word, two prefixes and a suffix."""
    found = []
    for k, part in enumerate((vocab, pc.utf8_slice_codeunits(vocab, 0, 5), pc.utf8_slice_codeunits(vocab, 0, 7), pc.utf8_slice_codeunits(vocab, -5))):
        d = part.dictionary_encode()
        h = pd.util.hash_array(np.array(d.dictionary.to_pylist(), dtype=object), categorize=False, hash_key=f"part {k} of a word"[:16].ljust(16))
        found.append((1 + (h >> np.uint64(20)) % np.uint64(ROWS - 1)).astype(np.int32)[d.indices.to_numpy(zero_copy_only=False)])
    return np.stack(found, axis=1)


class Model(NamedTuple):
    """table: (ROWS, DIM); kernel: (DIM, columns), the columns of width w and place j together; bias, out: a value for each filter."""

    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    slope: float
    thresholds: dict[str, float]
    threshold: float


def _columns() -> list[tuple[int, int, slice]]:
    """(width number, place in the filter, columns of the kernel)."""
    found, at = [], 0
    for k, w in enumerate(WIDTHS):
        for j in range(w):
            found.append((k, j, slice(at, at + FILTERS)))
            at += FILTERS
    return found


COLUMNS = _columns()


def _maps(projected: np.ndarray, k: int, n: int) -> np.ndarray:
    """Values of the filters of one width at each of n words; past the end all words are zero."""
    a = np.zeros((n, FILTERS), np.float32)
    for kk, j, cols in COLUMNS:
        if kk == k:
            a[: n - j] += projected[j:, cols]
    return a


def constant(rate: float) -> Model:
    return Model(np.zeros((ROWS, DIM), np.float32), np.zeros((DIM, COLUMNS[-1][2].stop), np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), float(np.clip(np.log((rate + 1e-6) / (1 - rate + 1e-6)), -13, 13)), 1.0, {}, 0.5)


def fit(texts: list[str | None], labels: list[int], langs: list[str | None], seed: int = 7) -> Model:
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    coded = coded_texts(texts)
    state = start(float(y.mean()), seed)
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 100 and len(set(y[::5])) == 2 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        descend(state, coded, y, rng.permutation(train), positive_weight(float(y.mean())))
    model = state.model()
    if not held.any():
        return model
    some = np.flatnonzero(held)
    raw = np.array([raw_logit(model, coded[d]) for d in some])
    return calibrated(model, raw, y[some], np.ones(len(some)), np.array([langs[d] if langs[d] is not None else "" for d in some], dtype=object))


def coded_texts(texts) -> list[np.ndarray]:
    """Of each text its words, each as the four places in the table in one number."""
    docs = [words(t) for t in texts]
    lens = [len(d) for d in docs]
    if not sum(lens):
        return [np.zeros(0, np.uint64) for _ in docs]
    d = pa.array(chain.from_iterable(docs), pa.string()).dictionary_encode()
    codes = np.ascontiguousarray(places(d.dictionary).astype(np.uint16)).view(np.uint64).reshape(-1)[d.indices.to_numpy(zero_copy_only=False)]
    return np.split(codes, np.cumsum(lens)[:-1])


class State:
    """What training changes: parameters and their sums of squared gradients (Adagrad); touched counts the changes of each row of the table."""

    def __init__(self, params: list[np.ndarray], sums: list[np.ndarray]) -> None:
        self.params, self.sums, self.touched = params, sums, np.zeros(ROWS, np.float32)

    def model(self) -> Model:
        table, kernel, bias, out, offset = self.params
        return Model(table, kernel, bias, out, float(offset[0]), 1.0, {}, 0.5)


def start(share: float, seed: int = 7) -> State:
    rng = np.random.default_rng(seed)
    shapes = ((ROWS, DIM), (DIM, COLUMNS[-1][2].stop), None, (len(WIDTHS), FILTERS))
    params = [np.zeros((len(WIDTHS), FILTERS), np.float32) if s is None else rng.normal(0, 0.3, s).astype(np.float32) for s in shapes]
    return State([*params, np.array([np.log(share / (1 - share))], np.float32)], [np.full(x.shape, 1e-3, np.float32) for x in params])


def positive_weight(share: float) -> float:
    return min(4.0, (1 - share) / share)


def pooled(own_projected: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of all filters over one text and the words at which they begin."""
    top = np.zeros((len(WIDTHS), FILTERS), np.float32)
    where = np.zeros((len(WIDTHS), FILTERS), np.int64)
    n = len(here)
    if n:
        projected = own_projected[here]
        for k in range(len(WIDTHS)):
            a = _maps(projected, k, n)
            where[k] = a.argmax(axis=0)
            top[k] = a[where[k], np.arange(FILTERS)]
    return top, where


def raw_logit(m: Model, codes: np.ndarray) -> float:
    own, place = np.unique(codes, return_inverse=True)
    top, _ = pooled(m.table[own.view(np.uint16).reshape(-1, 4)].mean(axis=1) @ m.kernel, place)
    return float((np.maximum(top + m.bias, 0) * m.out).sum()) * m.slope + m.offset


def descend(state: State, coded: list[np.ndarray], y: np.ndarray, order: np.ndarray, positive: float, rate: float = 0.15) -> None:
    """One pass over the texts of ``order``, 32 a step; changes the state."""
    table, kernel, bias, out, offset = state.params
    for at in range(0, len(order), 32):
        batch = order[at : at + 32]
        gk, gb, go, g0 = np.zeros_like(kernel), np.zeros_like(bias), np.zeros_like(out), 0.0
        wids, grads = [], []
        own, place = np.unique(np.concatenate([coded[d] for d in batch]), return_inverse=True)
        rows = own.view(np.uint16).reshape(-1, 4).astype(np.int32)
        own_vec = table[rows].mean(axis=1)
        own_projected = own_vec @ kernel
        ends = np.cumsum([len(coded[d]) for d in batch])
        for d, end in zip(batch, ends, strict=True):
            n = len(coded[d])
            here = place[end - n : end]
            top, where = pooled(own_projected, here)
            z = np.maximum(top + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(offset[0] + float((z * out).sum()), -30, 30)))
            g = float(p - y[d]) * (positive if y[d] > 0 else 1.0) / len(batch)
            go += g * z
            g0 += g
            ga = g * out * (z > 0)
            gb += ga
            if n:
                for k, j, cols in COLUMNS:
                    at_word = where[k] + j
                    ok = (at_word < n) & (ga[k] != 0)
                    if ok.any():
                        f = np.flatnonzero(ok)
                        gk[:, cols.start + f] += own_vec[here[at_word[ok]]].T * ga[k][ok]
                        wids.append(here[at_word[ok]])
                        grads.append(kernel[:, cols.start + f].T * ga[k][ok][:, None])
        for x, gx, s in zip((kernel, bias, out), (gk, gb, go), state.sums[1:], strict=True):
            s += gx * gx
            x -= rate * gx / np.sqrt(s)
        offset -= rate * 0.1 * g0
        if wids:
            r = rows[np.concatenate(wids)]
            gv = np.repeat(np.concatenate(grads) / r.shape[1], r.shape[1], axis=0)
            touched, inverse = np.unique(r.reshape(-1), return_inverse=True)
            gt = np.zeros((len(touched), DIM), np.float32)
            np.add.at(gt, inverse, gv)
            state.sums[0][touched] += gt * gt
            table[touched] -= rate * gt / np.sqrt(state.sums[0][touched])
            state.touched[touched] += 1


def calibrated(model: Model, raw: np.ndarray, t: np.ndarray, times: np.ndarray, langs: np.ndarray) -> Model:
    """Slope and offset by Newton steps on rows that have trained no weights (held near 1 and 0 by a prior), then thresholds with the best F1. times: how many rows each entry stands for."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = times * (p * (1 - p) + 1e-9)
        e = times * (p - t)
        g = np.array([(e * raw).sum() + 1.0 * (a - 1), e.sum() + 0.1 * b])
        h = np.array([[(w * raw * raw).sum() + 1.0, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    a = max(a, 0.05)
    score = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    whole = _threshold(score, t, times, 0.5)
    by_lang = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        if (times * t)[own].sum() >= 10 and (times * (1 - t))[own].sum() >= 10:
            by_lang[lang] = _threshold(score[own], t[own], times[own], whole)
    return model._replace(offset=a * model.offset + b, slope=a, thresholds=by_lang, threshold=whole)


def _threshold(score: np.ndarray, t: np.ndarray, times: np.ndarray, default: float) -> float:
    """Halfway between the scores around the cut with the best F1, among equals the one nearest to 0.5; between 0.3 and 0.7, so that a few labels can't push it to an edge."""
    s = np.unique(score)
    s = s[(s > 0.3) & (s < 0.7)]
    cuts = np.concatenate([[default], (s[1:] + s[:-1]) / 2]) if len(s) > 1 else np.array([default])
    f1 = np.array([2 * (times * t * (score >= c)).sum() / max((times * t).sum() + (times * (score >= c)).sum(), 1) for c in cuts])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])


def logits(m: Model, texts) -> np.ndarray:
    """Scores before the logistic function. Slices of SLICE words overlap by the widest filter less one."""
    docs = [words(t) for t in texts]
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    top = np.zeros((len(docs), len(WIDTHS), FILTERS), np.float32)
    if lens.sum():
        d = pa.array(chain.from_iterable(docs), pa.string()).dictionary_encode()
        pad = max(WIDTHS) - 1
        ends = np.cumsum(lens + pad) - pad
        begins = ends - lens
        codes = np.zeros(ends[-1] + pad, np.int32)  # 0: the padding after each text
        codes[np.repeat(begins - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())] = d.indices.to_numpy(zero_copy_only=False) + 1
        vec = m.table[places(d.dictionary)].mean(axis=1)
        projected = [np.concatenate([np.zeros((1, FILTERS), np.float32), vec @ m.kernel[:, cols]]) for _, _, cols in COLUMNS]
        some = np.flatnonzero(lens)
        top[some] = -np.inf
        for at in range(0, len(codes) - pad, SLICE):
            n = min(SLICE, len(codes) - pad - at)
            here = some[(ends[some] > at) & (begins[some] < at + n)]
            if not len(here):
                continue
            edges = np.stack([np.maximum(begins[here], at) - at, np.minimum(ends[here], at + n) - at], axis=1).reshape(-1)
            edges = edges[:-1] if edges[-1] == n else edges
            for k in range(len(WIDTHS)):
                a = np.zeros((n, FILTERS), np.float32)
                for (kk, j, _), p in zip(COLUMNS, projected, strict=True):
                    if kk == k:
                        a += p.take(codes[at + j : at + j + n], axis=0)
                top[here, k] = np.maximum(top[here, k], np.maximum.reduceat(a, edges, axis=0)[::2])
    z = np.maximum(top + m.bias, 0)
    return (z * m.out).sum(axis=(1, 2)) * m.slope + m.offset


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list, list, list]:
    """Texts, labels and languages of at most ``rows`` labelled documents of ``chars`` characters together: by the hash of doc_id, until one would not fit. Of rows with one id the smallest text."""
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = marked.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "h", "toxic").agg(F.max("n").alias("n")).orderBy("h", "doc_id").collect()  # at most ``rows`` numbers
    fits = np.cumsum([r["n"] for r in sizes]) <= chars
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r, ok in zip(sizes, fits, strict=True) if ok], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("toxic", marked.schema["toxic"].dataType)]))
    first = F.min(F.struct(F.col("text").alias("text"), F.col("lang").alias("lang"))).alias("d")
    got = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(first).select("doc_id", "toxic", "d.*").toPandas().sort_values("doc_id", key=lambda s: (s * 2654435761) % (1 << 32))
    return got["text"].tolist(), got["toxic"].clip(0, 1).tolist(), [x if isinstance(x, str) else None for x in got["lang"]]


SHARD_DDL = "shard long, held boolean, toxic binary, langs array<string>, lens binary, known binary, codes binary"


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "doc_id"])
    block = (rows["text"].str.len().fillna(0).cumsum() // CHARS).to_numpy()
    coded = [c for _, part in rows["text"].groupby(block, sort=False) for c in coded_texts([x if isinstance(x, str) else None for x in part])]
    known, codes = np.unique(np.concatenate(coded), return_inverse=True)
    langs = [x if isinstance(x, str) else None for x in rows["lang"]]
    out = pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "held": rows["held"].iloc[:1].to_numpy(), "toxic": [pack(rows["toxic"].to_numpy(np.uint8))], "langs": [langs], "lens": [pack(np.array([len(c) for c in coded], np.int64))], "known": [pack_sorted(known)], "codes": [pack(codes.astype(np.uint32))]})
    trim()
    return out


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            lens = unpack(row["lens"], np.int64)
            yield row["shard"], np.split(unpack_sorted(row["known"])[unpack(row["codes"], np.uint32)], np.cumsum(lens)[:-1]), unpack(row["toxic"], np.uint8).astype(np.float32), row["langs"]
    trim()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled document once (doc_id, text, lang, toxic); of rows with one id the smallest text."""
    marked = save(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").cast("long").alias("doc_id"), F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).cast("int").alias("toxic")), "labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(small(marked), "doc_id")
    # ids are counted first, so that only texts whose id is repeated are shuffled
    often = save(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    first = F.min(F.struct("text", "lang")).alias("d")
    more = own.join(small(often), "doc_id", "left_semi").groupBy("doc_id", "toxic").agg(first).select("doc_id", "d.text", "d.lang", "toxic")
    return own.join(small(often), "doc_id", "left_anti").select("doc_id", "text", "lang", "toxic").unionByName(more)


def _flat(state: State, n: int) -> list[np.ndarray]:
    """Sums whose quotients are averages: table and its sums by changes of a row, all else by texts."""
    t = state.touched[:, None]
    dense = np.concatenate([x.reshape(-1) for x in [*state.params[1:], *state.sums[1:]]])
    return [(state.params[0] * t).reshape(-1), (state.sums[0] * t).reshape(-1), state.touched, np.append(dense * np.float32(n), np.float32(n))]


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = 0.0
    for b in rows.sort_values("shard")["state"]:
        total = total + unpack(b, np.float32).astype(np.float64)
    return pd.DataFrame({"shard": [int(rows["part"].iloc[0])], "state": [pack(total.astype(np.float32))]})


def _round(shards: DataFrame, state: State, n: int, number: int, positive: float) -> State:
    """The average of what each of n shards makes of the state in one pass."""
    sent = shards.sparkSession.sparkContext.broadcast((state.params, state.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, coded, y, _ in _opened(batches):
            own = State(*([x.copy() for x in part] for part in sent.value))
            descend(own, coded, y, np.random.default_rng([number, shard]).permutation(len(y)), positive)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pack(np.concatenate(_flat(own, len(y))))], pa.binary())], names=["shard", "state"])

    done = shards.where("not held").mapInArrow(run, "shard long, state binary")
    while n > FAN:
        n = -(-n // FAN)
        done = done.withColumn("part", F.pmod("shard", F.lit(n))).groupBy("part").applyInPandas(_sum, "shard long, state binary")
    total = np.zeros(0)
    for row in sorted(done.collect(), key=lambda r: r["shard"]):  # FAN rows at most, each of the size of a model
        one = unpack(bytes(row["state"]), np.float32).astype(np.float64)
        total = total + one if len(total) else one
    sent.destroy()
    a, b = ROWS * DIM, 2 * ROWS * DIM
    t, dense = total[b : b + ROWS], total[b + ROWS : -1] / total[-1]
    hit = t > 0
    table, sums = state.params[0].copy(), state.sums[0].copy()
    table[hit] = total[:a].reshape(ROWS, DIM)[hit] / t[hit, None]
    sums[hit] = total[a:b].reshape(ROWS, DIM)[hit] / t[hit, None]
    like = [*state.params[1:], *state.sums[1:]]
    parts = [p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(dense, np.cumsum([x.size for x in like])[:-1]), like, strict=True)]
    return State([table, *parts[: len(state.params) - 1]], [sums, *parts[len(state.params) - 1 :]])


def train(docs: DataFrame, labels: DataFrame, size: int = SHARD) -> Model:
    """A model of every labelled row; ``size``: texts of a shard, about."""
    fold = F.xxhash64("doc_id", F.lit(1))
    rows = labelled(docs, labels).withColumn("h", F.xxhash64("doc_id")).withColumn("held", F.pmod(fold, F.lit(5)) == 0)
    counts = {(r["held"], r["toxic"]): r for r in rows.groupBy("held", "toxic").agg(F.count("*").alias("k"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).collect()}
    have = lambda *keys: sum(counts[k]["k"] for k in keys if k in counts)
    total, ones = sum(r["k"] for r in counts.values()), have((False, 1), (True, 1))
    if not 0 < ones < total:
        return constant(ones / total if total else 0.0)
    apart = total >= 100 and all((True, c) in counts and (False, c) in counts for c in (0, 1))
    rows = rows if apart else rows.withColumn("held", F.lit(False))
    n = max(1, -(-have((False, 0), (False, 1)) // size), -(-sum(r["n"] for k, r in counts.items() if not k[0]) // SHARD_CHARS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(n)))
    shards = save(dealt.groupBy("held", "shard").applyInPandas(_gather, SHARD_DDL), "shards")
    state = start(ones / total)
    for number in range(EPOCHS if n == 1 else ROUNDS):
        state = _round(shards, state, n, number, positive_weight(ones / total))
    model = state.model()
    return _held_back(shards, model) if apart else model


def _held_back(shards: DataFrame, model: Model) -> Model:
    """Calibrated on all rows of the fold: they come to the driver as counts of cells."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, coded, y, langs in _opened(batches):
            cells = [round(max(-30.0, min(30.0, raw_logit(sent.value, c))) * CELLS) for c in coded]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(y.astype(np.int32)), pa.array([x or "" for x in langs], pa.string())], names=["cell", "toxic", "lang"])

    scored = shards.where("held").mapInArrow(run, "cell long, toxic int, lang string")
    got = scored.groupBy("cell", "toxic", "lang").agg(F.count("*").alias("n")).orderBy("lang", "toxic", "cell").toPandas()
    return calibrated(model, got["cell"].to_numpy(float) / CELLS, got["toxic"].to_numpy(float), got["n"].to_numpy(float), got["lang"].to_numpy(object))


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df with ``score`` (0 to 1), ``predicted`` (score of 0.5 or more) and ``rejected`` (score at or over the language's threshold)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for texts in batches:
            block = (texts.str.len().fillna(0).cumsum() // CHARS).to_numpy()
            parts = [logits(m, part) for _, part in texts.groupby(block, sort=False)]
            trim()
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -30, 30))), dtype="float64")

    limit = F.lit(model.threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.coalesce(F.col(lang_col), F.lit("")) == lang, F.lit(value)).otherwise(limit)
    scored = df.withColumn("score", run(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("rejected", F.col("score") >= limit)


def op10_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = score_toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "rejected")
