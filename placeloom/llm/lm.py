r"""Language-model scoring by deleted interpolation.

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one end token a
text. The model mixes maximum-likelihood estimates: of a token after the token
before it, of the token alone, and a uniform one,

    P(w | u) = l2(b) c(uw) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1),

where b is the frequency bucket of the context u (powers of two of c(u)). A tenth of
the training documents is deleted from the counts, and expectation-maximisation
finds the weights l(b) under which those documents are likeliest. Counts for scoring
are those of all training documents.

How it is spread: texts are packed into chunks of about ``CHUNK`` characters, written
once as a table (distinct token hashes and the sequence as places among them).
Each chunk asks for the counts of its distinct n-grams, summed over all chunks by
exchange.py: rows grow with the chunks and a task holds a bounded group of them. A
frequent n-gram is one entry a chunk, so no key is hot, and no vocabulary is ever
whole in one place.
For EM, the three estimates of every deleted token are counted in cells (bucket and
quarter octaves of the estimates' ratios), whose number is bounded; only cells and
counts reach the driver.

Tokens are told apart by 64-bit hashes.

Defined results: null and empty texts have the end token only; texts of any length
are scored whole; rows with a null id belong to training's kept part; repeated rows
count and score each; without training texts every count is 0 and scores come from
the uniform part; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, byte_words, documents, encode_words, few_rows, mix, pack, pack_sorted, save, unpack, unpack_sorted
from .exchange import ASK_DDL, BITS, GROUP, exchange, gathered, groups_of, split

CHUNK = 3_000_000
END, START = b" ", np.uint64(0x5354415254)
HELD_OUT, DELETED, KEPT = 0, 1, 2
BUCKETS = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)

CHUNK_DDL = "chunk string, deleted boolean, n_docs long, n_tokens long, train_docs long, train_tokens long, kept_docs long, kept_tokens long, ids binary, nulls binary, parts binary, lens binary, vocab binary, codes binary"


def _pack_chunk(ids: list, parts: list[int], docs: list[list[bytes]], deleted: bool) -> list:
    vocab, codes, lens = encode_words(docs)
    part = np.array(parts, np.uint8)
    train = part != HELD_OUT
    kept = part == KEPT
    none = np.array([i is None for i in ids], np.uint8)
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    return [f"{'d' if deleted else 'k'}-{uuid.uuid4().hex}", deleted, len(ids), int(lens.sum()), int(train.sum()), int(lens[train].sum()), int(kept.sum()), int(lens[kept].sum()), numbers.tobytes(), none.tobytes(), part.tobytes(), lens.tobytes(), pack_sorted(vocab), pack(codes)]


def _chunks(folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[bool, tuple[list, list, list]] = {True: ([], [], []), False: ([], [], [])}
        size = {True: 0, False: 0}
        for i, text in few_rows(batches):
            fold = None if i is None else zlib.crc32(str(i).encode()) % folds
            part = HELD_OUT if fold == held else DELETED if fold == held + 1 else KEPT
            own = open_[part == DELETED]
            own[0].append(i)
            own[1].append(part)
            own[2].append([*byte_words(text, lower=True), END])
            size[part == DELETED] += len(text or "") + 1
            if size[part == DELETED] >= CHUNK:
                yield arrow_rows([_pack_chunk(*own, part == DELETED)], CHUNK_DDL)
                own = None
                open_[part == DELETED], size[part == DELETED] = ([], [], []), 0
        for deleted, own in open_.items():
            if own[0]:
                yield arrow_rows([_pack_chunk(*own, deleted)], CHUNK_DDL)

    return run


class Chunk:
    """Tokens of a chunk and its distinct n-grams in hash order."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.nulls = np.frombuffer(row.nulls, np.uint8).astype(bool)
        self.parts = np.frombuffer(row.parts, np.uint8)
        self.lens = np.frombuffer(row.lens, np.int64)
        self.vocab = unpack_sorted(row.vocab)
        self.codes = unpack(row.codes, np.int32).astype(np.int64)
        starts = np.cumsum(self.lens) - self.lens
        self.starts = starts
        n = len(self.vocab)
        before = np.roll(self.codes, 1)
        before[starts] = n  # the start of a text as a context of its own
        self.before = before
        pair, self.pair_of = np.unique(before * np.int64(n + 1) + self.codes, return_inverse=True)
        u, w = pair // (n + 1), pair % (n + 1)
        hashes = mix(mix(np.append(self.vocab, START)[u]) * _ODD + self.vocab[w])
        order = np.argsort(hashes, kind="stable")
        self.pairs = hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair_of = rank[self.pair_of]

    def counts(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each n-gram occurs in kept and in deleted documents."""
        part = np.repeat(self.parts, self.lens)
        return tuple(np.bincount(places[part == p], minlength=size).astype(np.uint32) for p in (KEPT, DELETED))


class Sums:
    """Counts in kept and in deleted documents, summed; of words (table 0) and pairs (table 1)."""

    def merge(self, k: int, columns: list[np.ndarray], at: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.bincount(at, c, n).astype(np.uint64) for c in columns]

    def finish(self, k: int, merged: list[np.ndarray]) -> list[np.ndarray]:
        return merged

    def count(self, merged: list[np.ndarray]) -> int:
        """The words of training documents."""
        return int(np.count_nonzero(merged[0] + merged[1]))


def _ask(groups: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                c = Chunk(row)
                tables = []
                for h, places in ((c.vocab, c.codes), (c.pairs, c.pair_of)):
                    kept, deleted = c.counts(places, len(h))
                    tables.append([h, kept, deleted])
                yield from split(row.chunk, tables, groups, bits=bits)

    return run


class Counts:
    """Counts of a chunk's tokens over the corpus: of the token, its context, and both together."""

    def __init__(self, row, answers: pd.DataFrame, kept_docs: int, train_docs: int):
        self.chunk = c = Chunk(row)
        words, pairs = (np.stack(t).astype(np.float64) for t in gathered(answers))
        assert words.shape[1] == len(c.vocab) and pairs.shape[1] == len(c.pairs)
        first = np.array([[kept_docs], [train_docs - kept_docs]], np.float64)
        contexts = np.concatenate([words, first], axis=1)
        self.word, self.context, self.pair = words[:, c.codes], contexts[:, c.before], pairs[:, c.pair_of]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def estimates(word, context, pair, n: float, v: float) -> tuple[np.ndarray, np.ndarray, float]:
    return np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / max(n, 1), 1 / (v + 1)


NONE = -999  # the cell of an estimate that is zero


def _cells(n: float, v: float, kept_docs: int, train_docs: int):
    """Tokens of deleted documents in cells: bucket, and log2 of the estimates over the uniform one in quarters."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            c = Counts(row, right, kept_docs, train_docs)
            p2, p1, p0 = estimates(c.word[0], c.context[0], c.pair[0], n, v)
            r2, r1 = (np.where(p > 0, np.rint(4 * np.log2(np.where(p > 0, p, 1) / p0)), NONE).astype(np.int64) for p in (p2, p1))
            cells, times = np.unique(np.stack([bucket(c.context[0]), r2, r1]), axis=1, return_counts=True)
            out.append(pd.DataFrame({"b": cells[0], "r2": cells[1], "r1": cells[2], "n": times}))
        return pd.concat(out)

    return run


def learn(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of the pair, word and uniform estimates by EM from rows (bucket, r2, r1, times).

    Each bucket starts from, and is held near by 10 pseudo-tokens, the weights of all buckets together.
    """
    b, r2, r1, times = cells.T
    ratio = np.stack([np.where(r == NONE, 0, 2.0 ** (r / 4)) for r in (r2, r1)] + [np.ones(len(b))], axis=1)
    whole = np.array([1 / 3] * 3)
    for _ in range(rounds):
        share = whole * ratio
        share *= (times / share.sum(axis=1))[:, None]
        whole = (share.sum(axis=0) + 0.01) / (share.sum() + 0.03)
    out = np.tile(whole, (BUCKETS, 1))
    for k in np.unique(b).astype(int):
        own = b == k
        w, t = whole.copy(), times[own]
        for _ in range(rounds):
            share = w * ratio[own]
            share *= (t / share.sum(axis=1))[:, None]
            w = (share.sum(axis=0) + 10 * whole) / (t.sum() + 10)
        out[k] = w
    out[0, 1:] /= out[0, 1:].sum()
    out[0, 0] = 0
    return out


SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(weights: np.ndarray, n: float, v: float, kept_docs: int, train_docs: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            k = Counts(row, right, kept_docs, train_docs)
            word, context, pair = k.word.sum(axis=0), k.context.sum(axis=0), k.pair.sum(axis=0)
            p2, p1, p0 = estimates(word, context, pair, n, v)
            w = weights[bucket(context)]
            c = k.chunk
            add = lambda x: np.add.reduceat(x, c.starts)  # noqa: B023, E731
            base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
            score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            ids = pd.Series(c.ids, dtype="Int64").mask(c.nulls)
            out.append(pd.DataFrame({"doc_id": ids, "held_out": c.parts == HELD_OUT, "n_tokens": c.lens, "n_known": add((word > 0).astype(np.int64)), "train_tokens": int(n), "base_score": add(base), "score": add(score)}))
        return pd.concat(out)

    return run


def interpolated_scores(docs: DataFrame, folds: int = 10, held: int = 0, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """Score every text (doc_id, text); documents with crc32(doc_id) % folds == held teach nothing, those of the next fold are the deleted part."""
    chunks = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks(folds, held), CHUNK_DDL), "chunks")
    total = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train_docs", "train_tokens", "kept_docs", "kept_tokens")], F.count("*").alias("n")).first()
    answers, v = exchange(chunks.mapInPandas(_ask(groups_of(total["n"], group), bits), ASK_DDL), total["n"], Sums(), bits, group)
    sizes = total["kept_docs"], total["train_docs"]
    deleted = chunks.where("deleted")
    cells = deleted.groupBy("chunk").cogroup(answers.where("child LIKE 'd-%'").groupBy("child")).applyInPandas(_cells(total["kept_tokens"], v, *sizes), "b long, r2 long, r1 long, n long")
    table = np.array([tuple(r) for r in cells.groupBy("b", "r2", "r1").agg(F.sum("n")).orderBy("b", "r2", "r1").collect()], np.float64).reshape(-1, 4)
    weights = learn(table) if len(table) else np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("child")).applyInPandas(_scores(weights, total["train_tokens"], v, *sizes), SCORE_DDL)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(documents(spark, sf_dir))
