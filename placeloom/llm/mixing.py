"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of the cells
are raked: weights are scaled in turn to each marginal's target shares until all
hold. A keep probability follows from the weights: ``min(1, s * weight)`` with the
scale s that makes the expected tokens ``keep`` of all tokens. Cells that reach
probability 1 are kept whole and the others are scaled further; weights that would
need copies of documents are so met as far as the cells allow. A document is kept
if a uniform number made from md5 of its id and a seed is below its probability:
the same in every run, on any engine.

Values of a marginal without a target share, nulls among them, fall into its category
"other". Where the targets leave no room to 1, "other" keeps the share of tokens that
it has and the targets hold for the rest, so that rows with such values are sampled
like the others and never dropped as a category. Cells number at most the product of
the targets' sizes plus one each, a bound that the parameters give and not the data:
they can be collected and joined by broadcast. All else is DataFrame expressions;
documents are not shuffled.

Defined results: null and empty texts have 0 tokens, their cell's probability and
their own draw; cells without tokens have probability ``keep`` unless a share of 0 is
given; null categories count as "other"; repeated rows are drawn alike; null ids draw
as the empty string; categories with targets but no tokens are left out and the other
shares scaled up; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

OTHER = "other"
KEEP = 0.6
SEED = "mix"
ROUNDS = 200
#: Shares of tokens wanted in the query and the pipeline.
TARGETS: dict[str, dict[str, float]] = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1},
    "topic": {"short-lined": 0.2, "long-lined": 0.6, "symbols": 0.2},
}


def tokens(text: Column) -> Column:
    r"""Number of words [^\x20\x09-\x0D]+."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A stand-in for a topic label, of the layout alone: mostly symbols and digits, short or long lines."""
    n = F.length(text)
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    lines = n - F.length(F.translate(text, "\n", "")) + 1
    return F.when(symbols * 10 > n, "symbols").when(n < lines * 120, "short-lined").otherwise("long-lined")


def rake(weights: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Scale an array until its sums along each axis are in the proportions of the targets. Axes' categories without mass are left out."""
    w = weights.astype(float)
    if not w.sum():
        return w
    w = w / w.sum()
    axes = range(w.ndim)
    wanted = []
    for k, t in enumerate(targets):
        have = w.sum(axis=tuple(a for a in axes if a != k)) > 0
        t = np.where(have, t, 0.0)
        wanted.append(t / t.sum() if t.sum() else have / have.sum())
    for _ in range(rounds):
        worst = 0.0
        for k, t in enumerate(wanted):
            own = w.sum(axis=tuple(a for a in axes if a != k))
            f = np.divide(t, own, out=np.zeros_like(t), where=own > 0)
            worst = max(worst, float(np.abs(own - t).max()))
            w = w * f.reshape([-1 if a == k else 1 for a in axes])
        if worst < 1e-10:
            break
    return w


def probabilities(have: np.ndarray, want: np.ndarray, keep: float) -> np.ndarray:
    """min(1, s * want / have), with s for which the expected share of kept tokens is ``keep`` (or all that is wanted, if less)."""
    share = have / have.sum() if have.sum() else have
    ratio = np.divide(want, share, out=np.zeros_like(want), where=share > 0)
    order = np.argsort(-ratio, kind="stable")
    full, rest = 0.0, float(want.sum())
    scale = 0.0
    for i in order:
        if ratio[i] <= 0 or rest <= 1e-15:
            break
        scale = (keep - full) / rest
        if scale * ratio[i] <= 1:
            break
        full, rest = full + float(share[i]), rest - float(want[i])
    return np.minimum(1.0, scale * ratio) if rest > 1e-15 else (ratio > 0).astype(float)


def with_other(targets: Mapping[str, float], levels: list[str], have: np.ndarray) -> np.ndarray:
    """Target shares of a marginal's levels. "other" without a target gets the room that the targets leave to 1, or else its share of have."""
    t = np.array([targets.get(v, 0.0) for v in levels])
    if OTHER in targets or not have.sum():
        return t
    room = 1 - t.sum()
    if room < 1e-9:
        room = float(have[-1] / have.sum())
        t = t / t.sum() * (1 - room) if t.sum() else t
    t[-1] = room
    return t


def mixed(df: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """df with n_tokens, weight (wanted over present share of the cell), probability, draw and kept.

    targets: column -> {value: share}. A marginal's shares that leave room to 1 leave it to "other"; if they
    leave none, "other" has its present share and the targets share what remains.
    """
    names = list(targets)
    levels = {c: [*targets[c], *([] if OTHER in targets[c] else [OTHER])] for c in names}
    cell = {c: F.when(F.col(c).isin(*targets[c]), F.col(c)).otherwise(OTHER) for c in names}
    counted = df.withColumn("n_tokens", tokens(F.col(text_col)))
    rows = counted.groupBy(*[e.alias(c) for c, e in cell.items()]).agg(F.sum("n_tokens").alias("n")).collect()
    have = np.zeros([len(levels[c]) for c in names])
    for r in rows:
        have[tuple(levels[c].index(r[c]) for c in names)] += r["n"] or 0
    shares = [with_other(targets[c], levels[c], have.sum(axis=tuple(a for a in range(have.ndim) if a != k))) for k, c in enumerate(names)]
    want = rake(have, shares)
    p = probabilities(have.reshape(-1), want.reshape(-1), keep).reshape(have.shape)
    some_wanted = reduce(np.multiply.outer, [np.array([targets[c].get(v, 1.0) > 0 for v in levels[c]]) for c in names])
    p = np.where((have == 0) & some_wanted, keep, p)
    share = have / have.sum() if have.sum() else have
    weight = np.divide(want, share, out=np.zeros_like(want), where=share > 0)
    some = [(*[levels[c][i] for c, i in zip(names, at, strict=True)], float(weight[at]), float(p[at])) for at in np.ndindex(have.shape)]
    schema = T.StructType([*[T.StructField(f"_cell_{c}", T.StringType()) for c in names], T.StructField("weight", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    cells = df.sparkSession.createDataFrame(some, schema)
    out = counted.drop("weight", "probability", "draw", "kept").withColumns({f"_cell_{c}": e for c, e in cell.items()}).join(F.broadcast(cells), [f"_cell_{c}" for c in names], "left").drop(*[f"_cell_{c}" for c in names])
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)
    return out.withColumn("draw", draw).withColumn("kept", F.col("draw") < F.col("probability"))


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang").withColumn("topic", topic(F.col("text")))
    return mixed(docs, TARGETS).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "draw", "kept")
