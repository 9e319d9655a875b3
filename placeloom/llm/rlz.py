r"""Substring deduplication by relative Lempel-Ziv parsing.

A word is in a duplicate span exactly if some window of ``WINDOW`` words over it starts
earlier (smaller doc_id, or the same document further left) elsewhere in the corpus. Spans
are found on the input, not on what is left.

The reference is the corpus without its repetitions: the stretches that windows make up
which occur again elsewhere, each where it occurs first. It is indexed by windows, in
blocks of the hash space; as a window is in the reference once, it leads to one place, and
the longest match of a text from there on goes as far as window after window leads on
along the reference. Each document is parsed greedily: at a word that begins a reference
window the longest match becomes a factor and the parse goes on behind it; other words are
literals. Matches below ``WINDOW`` words are not factors. A greedy factor can hide windows
that begin in it and end behind it, so these are looked up too at each factor's boundary.
Factors and boundary windows together are the duplicate spans.

How it is spread: documents are packed into chunks of about ``CHUNK`` characters, written
once as a table. Each chunk asks twice by exchange.py:

1. for the hashes of its minimizers (the smallest hash of eight words in every window):
   does it occur more than once? Equal windows have equal minimizers, so all others
   are unique;
2. for the hashes of the windows left, with their first place in the chunk: what is the
   first place in the corpus, their place in the reference?

Every hash is one entry a chunk however often it occurs, so no passage is hot, and a task
holds a bounded group of chunks in one block of the index. Words and windows are compared
by 64-bit hashes.

Defined results: null and empty texts have no words; texts of any length are parsed
whole; rows with equal doc_id and place do not start earlier than each other, so
repeated rows both stay; null ids come after all others; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, encode_words, mix, save
from .exchange import ASK_DDL, BITS, GROUP, exchange, gathered, groups_of, split

WINDOW = 20
SEED = 8
CHUNK = 4_000_000
LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)

CHUNK_DDL = "chunk string, n_words long, ids binary, nulls binary, sizes binary, texts binary"


def _pack_chunk(ids: list, texts: list[bytes]) -> list:
    none = np.array([i is None for i in ids], np.uint8)
    numbers = np.array([LAST if i is None else i for i in ids], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    words = sum(len(t.split()) for t in texts)
    return [uuid.uuid4().hex, words, numbers.tobytes(), none.tobytes(), sizes.tobytes(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CHUNK_DDL.split(", ")]
    ids, texts, size = [], [], 0
    for pdf in batches:
        for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1]) + 1
            if size >= CHUNK:
                yield pd.DataFrame([_pack_chunk(ids, texts)], columns=columns)
                ids, texts, size = [], [], 0
    if ids:
        yield pd.DataFrame([_pack_chunk(ids, texts)], columns=columns)


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over n neighbours, from each place on."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def _powers(n: int) -> np.uint64:
    p = np.uint64(1)
    with np.errstate(over="ignore"):
        for _ in range(n):
            p = p * _ODD
    return p


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive words from each place on (len(h) - n + 1 of them), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, parts = None, 0, h
    width = 1
    blocks = {}
    while width <= n:
        blocks[width] = parts
        if 2 * width <= n:
            parts = parts[: len(parts) - width] * _powers(width) + parts[width:]
        width *= 2
    for width in sorted(blocks, reverse=True):
        if n & width:
            piece = blocks[width]
            if out is None:
                out, have = piece, width
            else:
                m = len(h) - have - width + 1
                out = out[:m] * _powers(width) + piece[have : have + m]
                have += width
    return mix(out)


class Block:
    """Words of a chunk, its windows that lie in one document, and their minimizers."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.nulls = np.frombuffer(row.nulls, np.uint8).astype(bool)
        ends = np.cumsum(np.frombuffer(row.sizes, np.int64)).tolist()
        data = zstandard.ZstdDecompressor().decompress(row.texts) if ends[-1] else b""
        self.docs = [data[a:b].split() for a, b in zip([0, *ends], ends, strict=False)]
        vocab, codes, self.lens = encode_words(self.docs)
        self.words = vocab[codes]
        self.starts = np.cumsum(self.lens) - self.lens
        n = max(len(codes) - WINDOW + 1, 0)
        at = np.arange(n)
        self.doc_of = np.repeat(np.arange(len(self.lens)), self.lens)
        self.valid = self.doc_of[at] == self.doc_of[at + WINDOW - 1] if n else np.zeros(0, bool)
        seeds = rolling(self.words, SEED)
        self.least = np.where(self.valid, _slide(seeds, WINDOW - SEED + 1, np.minimum), np.uint64(0)) if n else np.zeros(0, np.uint64)
        # a seed is a minimizer where the largest window minimum around it is the seed itself
        pad = np.zeros(WINDOW - SEED, np.uint64)
        around = _slide(np.concatenate([pad, self.least, pad]), WINDOW - SEED + 1, np.maximum) if n else np.zeros(0, np.uint64)
        chosen = np.flatnonzero(around == seeds) if n else np.zeros(0, np.int64)
        self.seeds, self.seed_counts = np.unique(seeds[chosen], return_counts=True) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose minimizer occurs again: their places, distinct hashes, which hash each has, and the first doc_id and place of each hash."""
        some = self.seeds[repeated]
        if not len(some):
            none = np.zeros(0, np.int64)
            return none, np.zeros(0, np.uint64), none, none, none
        i = np.minimum(np.searchsorted(some, self.least), len(some) - 1)
        at = np.flatnonzero(self.valid & (some[i] == self.least))
        # windows in corpus order, so that the first of equal hashes is the earliest
        at = at[np.lexsort((at - self.starts[self.doc_of[at]], self.ids[self.doc_of[at]]))]
        hashes, first, which = np.unique(rolling(self.words, WINDOW)[at], return_index=True, return_inverse=True)
        lead = at[first]
        return at, hashes, which, self.ids[self.doc_of[lead]], lead - self.starts[self.doc_of[lead]]


class Often:
    """Of each seed one bit: it occurs twice or more."""

    def merge(self, k: int, columns: list[np.ndarray], at: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.minimum(np.bincount(at, columns[0], n), 2).astype(np.uint8)]

    def finish(self, k: int, merged: list[np.ndarray]) -> list[np.ndarray]:
        return [merged[0] > 1]

    def count(self, merged: list[np.ndarray]) -> int:
        return 0


class Earliest:
    """Of each window its place in the reference: the first doc_id, and the first place in that document."""

    def merge(self, k: int, columns: list[np.ndarray], at: np.ndarray, n: int) -> list[np.ndarray]:
        order = np.lexsort((columns[1], columns[0], at))
        first = order[np.append(True, at[order][1:] != at[order][:-1])[: len(at)]]
        return [c[first] for c in columns]

    def finish(self, k: int, merged: list[np.ndarray]) -> list[np.ndarray]:
        return merged

    def count(self, merged: list[np.ndarray]) -> int:
        return 0


def _ask_seeds(groups: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                b = Block(row)
                yield from split(row.chunk, [[b.seeds, np.minimum(b.seed_counts, 2).astype(np.uint8)]], groups, bits=bits)

    return run


def _column(answers: pd.DataFrame, step: int, which: int, kind) -> np.ndarray:
    tables = gathered(answers[answers["step"] == step])
    return tables[0][which] if tables else np.zeros(0, kind)


def _ask_windows(groups: int, bits: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=[c.split()[0] for c in ASK_DDL.split(", ")])]
        for row in left.itertuples():
            _, hashes, _, docs, places = Block(row).candidates(_column(right, 1, 0, bool))
            out += split(row.chunk, [[hashes, docs, places.astype(np.uint32)]], groups, bits=bits)
        return pd.concat(out)

    return run


class Parse:
    """Greedy factors of a block: start among its words, length, doc_id and place of the source; and its boundary windows (starts)."""

    def __init__(self, b: Block, answers: pd.DataFrame):
        at, _, which, _, _ = b.candidates(_column(answers, 1, 0, bool))
        docs, places = _column(answers, 2, 0, np.int64)[which], _column(answers, 2, 1, np.uint32).astype(np.int64)[which]
        doc, place = b.ids[b.doc_of[at]], at - b.starts[b.doc_of[at]]
        earlier = np.flatnonzero((docs < doc) | ((docs == doc) & (places < place)))
        earlier = earlier[np.argsort(at[earlier])]
        at, docs, places = at[earlier], docs[earlier], places[earlier]
        goes_on = (np.diff(at) == 1) & (np.diff(docs) == 0) & (np.diff(places) == 1) & (np.diff(b.doc_of[at]) == 0)
        # the last window that each one leads on to along the reference
        last = np.flatnonzero(np.append(~goes_on, True)[: len(at)])
        behind = at[last[np.searchsorted(last, np.arange(len(at)))]] + WINDOW if len(at) else at
        following = np.searchsorted(at, behind)
        chosen, i = [], 0
        while i < len(at):
            chosen.append(i)
            i = int(following[i])
        pick = np.array(chosen, np.int64)
        self.start, self.length, self.docs, self.places = at[pick], behind[pick] - at[pick], docs[pick], places[pick]
        inside = np.searchsorted(self.start, at, side="right") - 1
        self.boundary = at[at + WINDOW > (self.start + self.length)[inside]] if len(at) else at

    def gone(self, b: Block) -> np.ndarray:
        """Which words lie in a factor or in a boundary window."""
        return covered(b, np.append(self.start, self.boundary), np.append(self.length, np.full(len(self.boundary), WINDOW)))


def covered(b: Block, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch."""
    edge = np.zeros(len(b.words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


FACTOR_DDL = "doc_id long, start long, n_words long, source_doc long, source_start long"
KEPT_DDL = "doc_id long, n_words long, n_removed long, kept string"
DIGEST_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _factors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = [pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in FACTOR_DDL.split(", ")})]
    for row in left.itertuples():
        b = Block(row)
        p = Parse(b, right)
        own = b.doc_of[p.start]
        null = lambda x, none: pd.Series(x, dtype="Int64").mask(none)
        out.append(pd.DataFrame({"doc_id": null(b.ids[own], b.nulls[own]), "start": p.start - b.starts[own], "n_words": p.length, "source_doc": null(p.docs, p.docs == LAST), "source_start": p.places}))
    return pd.concat(out)


def _kept(digest: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            b = Block(row)
            gone = Parse(b, right).gone(b)
            removed = np.add.reduceat(np.append(gone, False), b.starts) * (b.lens > 0)
            texts = []
            for words, at, n, r in zip(b.docs, b.starts.tolist(), b.lens.tolist(), removed.tolist(), strict=True):
                left_ = words if not r else [w for w, g in zip(words, gone[at : at + n].tolist(), strict=True) if not g]
                text = b" ".join(left_)
                texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            out.append(pd.DataFrame({"doc_id": pd.Series(b.ids, dtype="Int64").mask(b.nulls), "n_words": b.lens, "n_removed": removed, "kept_sha256" if digest else "kept": texts}))
        return pd.concat(out)

    return run


class Parsed:
    """A corpus indexed and ready to be parsed: factors(), kept() and digests() of its documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, bits: int = BITS, group: int = GROUP):
        self.blocks = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(chunks, CHUNK_DDL), "blocks")
        n = self.blocks.count()
        groups = groups_of(n, group)
        seeds = exchange(self.blocks.mapInPandas(_ask_seeds(groups, bits), ASK_DDL), n, Often(), bits, group)[0].withColumn("step", F.lit(1))
        asked = self.blocks.groupBy("chunk").cogroup(seeds.groupBy("child")).applyInPandas(_ask_windows(groups, bits), ASK_DDL)
        windows = exchange(asked, n, Earliest(), bits, group)[0].withColumn("step", F.lit(2))
        self.answers = seeds.unionByName(windows)

    def _each(self, fn, ddl: str) -> DataFrame:
        return self.blocks.groupBy("chunk").cogroup(self.answers.groupBy("child")).applyInPandas(fn, ddl)

    def factors(self) -> DataFrame:
        """Greedy factors (doc_id, start, n_words) in words, and where each starts in its source."""
        return self._each(_factors, FACTOR_DDL)

    def kept(self) -> DataFrame:
        return self._each(_kept(False), KEPT_DDL)

    def digests(self) -> DataFrame:
        return self._each(_kept(True), DIGEST_DDL)


def op4_lz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Parsed(documents(spark, sf_dir)).digests()


#: The definition by all windows, for the tables as they are (ids neither null nor repeated).
OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, p AS pos, array_to_string(list_slice(ws, p, p + 19), ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS p FROM w)),
dup AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM win) WHERE r > 1),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
f AS (SELECT t.doc_id, t.pos, word, coalesce(max(if(dup.pos IS NULL, 0, 1)) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS 19 PRECEDING), 0) AS gone FROM t LEFT JOIN dup ON t.doc_id = dup.doc_id AND t.pos = dup.pos),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
