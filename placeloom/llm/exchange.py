"""Questions about hashes, combined over all chunks of a corpus and answered to each, with bounded fan-in.

A chunk asks tables: ascending distinct hashes with columns of numbers. The columns of equal hashes
are merged over all chunks, and each chunk gets the answer columns in the order of its hashes.

A chunk sends at most ``1 << BITS`` rows, one a range of the hash space, and at most about ``GROUP``
chunks meet in a range. With more chunks, groups of them are merged first and ask in their turn, in
ranges that are finer by ``BITS``; answers go back the same way. So the rows are (chunks) x (ranges of
a level) on each of log(chunks) levels, and a task holds the entries of one group in one range,
whatever the size of the corpus. A hash is one entry a chunk however often it occurs, so none is hot.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pack, pack_sorted, save, unpack, unpack_sorted

BITS = 8
GROUP = 512

ASK_DDL = "child string, part long, bucket long, ask binary"
ANSWER_DDL = "child string, bucket long, answer binary, stat long"

Table = list[np.ndarray]


class Fold(Protocol):
    def merge(self, k: int, columns: Table, at: np.ndarray, n: int) -> Table:
        """Columns of the entries of table k, whose hashes are numbers at of n, merged to n values each."""

    def finish(self, k: int, merged: Table) -> Table:
        """The answer columns."""

    def count(self, merged: Table) -> int:
        """How many of the hashes of table 0 count."""


def _pack(tables: list[Table], hashes: bool) -> bytes:
    def one(c: np.ndarray):
        return ("?", len(c), zstandard.compress(np.packbits(c).tobytes(), 1)) if c.dtype == bool else (c.dtype.str, len(c), pack(c))

    return pickle.dumps([([pack_sorted(t[0])] if hashes else []) + [one(c) for c in t[hashes:]] for t in tables])


def _unpack(b: bytes, hashes: bool) -> list[Table]:
    def one(kind: str, n: int, data: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool) if kind == "?" else unpack(data, np.dtype(kind))

    return [([unpack_sorted(t[0])] if hashes else []) + [one(*c) for c in t[hashes:]] for t in pickle.loads(b)]


def groups_of(children: int, group: int = GROUP) -> int:
    return -(-children // group)


def split(child: str, tables: list[Table], groups: int, level: int = 0, bits: int = BITS, under: int = 0) -> Iterator[pd.DataFrame]:
    """Rows of a child's tables (hashes, columns ...), whose hashes begin with the bits of the bucket ``under`` of the level before."""
    part, shift = zlib.crc32(child.encode()) % groups, 64 - bits * (level + 1)
    first = under << bits
    edges = np.array([(first + i) << shift for i in range(1 << bits)], np.uint64)
    cuts = [np.append(np.searchsorted(t[0], edges), len(t[0])) for t in tables]
    for at in range(0, 1 << bits, 64):
        rows = []
        for i in range(at, min(at + 64, 1 << bits)):
            own = [[c[cut[i] : cut[i + 1]] for c in t] for t, cut in zip(tables, cuts, strict=True)]
            if any(len(t[0]) for t in own):
                rows.append((child, part, first + i, _pack(own, True)))
        if rows:
            yield pd.DataFrame(rows, columns=["child", "part", "bucket", "ask"])


class _Met:
    """The asks of several children in one range: distinct hashes, merged columns, and where each child's entries lie."""

    def __init__(self, pdf: pd.DataFrame, fold: Fold):
        asks = [_unpack(b, True) for b in pdf["ask"]]
        self.hashes, self.merged, self.places = [], [], []
        for k in range(len(asks[0])):
            own = [a[k][0] for a in asks]
            both, at = np.unique(np.concatenate(own), return_inverse=True)
            self.hashes.append(both)
            self.merged.append(fold.merge(k, [np.concatenate([a[k][c] for a in asks]) for c in range(1, len(asks[0][k]))], at, len(both)))
            self.places.append(np.split(at, np.cumsum([len(x) for x in own])[:-1]))

    def answers(self, pdf: pd.DataFrame, tables: list[Table], stat: int) -> pd.DataFrame:
        """To each child its share of the answer columns of the distinct hashes."""
        out = [_pack([[c[places[i]] for c in t] for t, places in zip(tables, self.places, strict=True)], False) for i in range(len(pdf))]
        return pd.DataFrame({"child": pdf["child"], "bucket": pdf["bucket"], "answer": out, "stat": [stat] + [0] * (len(pdf) - 1)})


def _up(fold: Fold, groups: int, level: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        met = _Met(pdf, fold)
        return pd.concat(split(str(pdf["part"].iloc[0]), [[h, *m] for h, m in zip(met.hashes, met.merged, strict=True)], groups, level, bits, int(pdf["bucket"].iloc[0])))

    return run


def gathered(answers: pd.DataFrame) -> list[Table]:
    """Answer columns of each table from a child's rows (bucket, answer); no tables if nothing was asked."""
    parts = [_unpack(b, False) for b in answers.sort_values("bucket")["answer"]]
    return [[np.concatenate([p[k][c] for p in parts]) for c in range(len(parts[0][k]))] for k in range(len(parts[0]))] if parts else []


def exchange(asks: DataFrame, children: int, fold: Fold, bits: int = BITS, group: int = GROUP) -> tuple[DataFrame, int]:
    """Answers (child, bucket, answer) to asks made by split(child, tables, groups_of(children)), and the fold's count of the distinct hashes of table 0."""
    waiting = []
    while children > group:
        children = groups_of(children, group)
        level, groups = len(waiting) + 1, groups_of(children, group)
        waiting.append(save(asks, "asks"))
        asks = waiting[-1].groupBy("part", "bucket").applyInPandas(_up(fold, groups, level, bits), ASK_DDL)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        met = _Met(pdf, fold)
        return met.answers(pdf, [fold.finish(k, m) for k, m in enumerate(met.merged)], fold.count(met.merged[0]))

    def down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _Met(left, fold).answers(left, gathered(right), 0)

    answers = save(asks.groupBy("bucket").applyInPandas(answer, ANSWER_DDL), "answers")
    distinct = answers.agg(F.coalesce(F.sum("stat"), F.lit(0))).first()[0]
    for asked in reversed(waiting):
        above = answers.select(F.col("child").cast("long").alias("part"), F.shiftright("bucket", bits).alias("above"), "bucket", "answer")
        got = save(asked.groupBy("part", "bucket").cogroup(above.groupBy("part", "above")).applyInPandas(down, ANSWER_DDL), "answers")
        forget(asked)
        forget(answers)
        answers = got
    return answers.drop("stat"), distinct
