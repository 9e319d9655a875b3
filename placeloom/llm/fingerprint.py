"""Document fingerprints: MinHash signatures of word shingles, banded joins, verified Jaccard.

A shingle is five consecutive words (``\\w+`` of the lower-cased text; a shorter text
is one shingle). Each shingle hashes to 61 bits; ``PERMS`` universal hash functions
(a * x + b over a Mersenne prime of 31 bits) run over all shingles of a batch in
numpy and each document keeps its minima: the signature. The likeness of two
signatures is the share of equal minima.

``near_classes`` joins signatures on bands in Spark and verifies the Jaccard
similarity of the shingle sets. Equal shingle sets are one class with one
representative; see cluster.py for how a large bucket costs its size and no link
between different texts is lost.

Defined results: null and empty texts have no shingles and an empty fingerprint;
two empty fingerprints have likeness 1, an empty and another one 0; texts of any
length are hashed whole; equal texts have equal fingerprints; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import link
from .common import documents, mix, save

PERMS = 64
SHINGLE = 5
#: A Mersenne prime: hashes are taken modulo 2**31 - 1.
PRIME = np.uint64((1 << 31) - 1)
_WORDS = re.compile(r"\w+").findall
#: Shingles that one numpy step handles: PERMS x STEP x 8 bytes are 16 MB.
STEP = 32_768


def coefficients(n: int = PERMS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, int(PRIME), n, dtype=np.uint64), rng.integers(0, int(PRIME), n, dtype=np.uint64)


def shingle_hashes(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, one after another, and how many each text has."""
    docs = [_WORDS((t or "").lower()) for t in texts]
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    d = pa.array([w for ws in docs for w in ws], pa.string()).dictionary_encode()
    if not len(d):
        return np.zeros(0, np.uint64), np.zeros(len(docs), np.int64)
    h = pd.util.hash_array(np.array(d.dictionary.to_pylist(), dtype=object), categorize=False)[d.indices.to_numpy(zero_copy_only=False)]
    out = np.zeros(len(h), np.uint64)
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(h))  # words from here to the end of the text
    for j in range(size):
        ok = left > j
        out[ok] = mix(out[ok] * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -j)[ok] + np.uint64(j + 1))
    first = np.repeat(ends - lens, lens) == np.arange(len(h))
    keep = (left >= size) | first
    return out[keep], np.where(lens > 0, np.maximum(lens - size + 1, 1), 0)


def signatures(texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(texts, PERMS) minima as uint32; rows of texts without words are all ones."""
    h, counts = shingle_hashes(texts)
    sig = np.full((len(counts), len(a)), 0xFFFFFFFF, np.uint32)
    x = (h >> np.uint64(33)) % PRIME
    ends = np.cumsum(counts)
    begins = ends - counts
    some = np.flatnonzero(counts)
    for at in range(0, len(x), STEP):
        stop = min(at + STEP, len(x))
        here = some[(ends[some] > at) & (begins[some] < stop)]
        starts = np.maximum(begins[here], at) - at
        for k in range(len(a)):
            y = a[k] * x[at:stop] + b[k]
            y = (y & PRIME) + (y >> np.uint64(31))
            y = np.where(y >= PRIME, y - PRIME, y)
            sig[here, k] = np.minimum(sig[here, k], np.minimum.reduceat(y, starts).astype(np.uint32))
    return sig


@F.arrow_udf(T.BinaryType())
def _signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    a, b = coefficients()
    for texts in batches:
        parts = []
        for at in range(0, len(texts), 1000):
            part = texts.slice(at, 1000).to_pylist()
            sig = signatures(part, a, b)
            parts += [s.tobytes() if t and s[0] != 0xFFFFFFFF else b"" for s, t in zip(sig, part, strict=True)]
        yield pa.array(parts, pa.binary())


def minhash(text: Column) -> Column:
    """Signature of a text: PERMS little-endian 32-bit minima, or no bytes for a text without words."""
    return _signature(text)


@F.arrow_udf(T.DoubleType())
def likeness(left: pa.Array, right: pa.Array) -> pa.Array:
    """Share of equal minima of two signatures."""
    out = []
    for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
        x, y = x or b"", y or b""
        out.append(float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean()) if x and y else float(x == y))
    return pa.array(out, pa.float64())


# ---- near copies -------------------------------------------------------------

BANDS = 16
THRESHOLD = 0.8


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text: its node (hash of the shingle set), band keys and the distinct shingle hashes."""
    a, b = coefficients()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = batch.column("text").to_pylist()
            sig = signatures(texts, a, b)
            h, counts = shingle_hashes(texts)
            nodes, bands, sets, end = [], [], [], 0
            for s, n in zip(sig, counts.tolist(), strict=True):
                own = np.unique(h[end : end + n])
                end += n
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                sets.append(own.tobytes() if n else None)
                rows = s.reshape(BANDS, -1).astype(np.uint64)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(rows.shape[1]):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
                bands.append(key.view(np.int64).tolist() if n else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["doc_id", "node", "bands", "payload"])


def _compared(pairs: DataFrame, extras: bool, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sims, shared, more = [], [], []
                for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    s = both / (len(x) + len(y) - both)
                    sims.append(s if s >= threshold else None)
                    shared.append(both)
                    more.append(np.setdiff1d(x, y, assume_unique=True).view(np.int64).tolist() if extras else [])
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64()), pa.array(shared, pa.int64()), pa.array(more, pa.list_(pa.int64()))], names=["a", "b", "similarity", "shared", "extras"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary, similarity double, shared long, extras array<long>")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [np.frombuffer(p, np.int64) for p in part.column("payload").to_pylist()]
            which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(which)), pa.array(np.concatenate(sets))], names=["node", "shingle"])


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class): documents joined on signature bands, Jaccard of the shingle sets verified; class is the smallest doc_id."""
    found = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, "doc_id long, node binary, bands array<long>, payload binary"), "signatures")
    bands = found.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("key")).distinct()

    def payloads(nodes: DataFrame) -> DataFrame:
        return found.select("node", "payload").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("payload").alias("payload"))

    _, roots = link(bands, payloads, lambda pairs, extras: _compared(pairs, extras, threshold), lambda pool: pool.select("node", "payload").mapInArrow(_shingles, "node binary, shingle long"), threshold)
    first = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = first.join(first.groupBy("root").agg(F.min("first").alias("class")), "root").select("node", "class")
    return found.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class"))


# ---- the next document by descending id --------------------------------------


def with_next(df: DataFrame, key: str, tie: str, cols: dict[str, str], rows_each: int = 2000) -> DataFrame:
    """df with cols {name: column}: values of the row with the next smaller key (after the smallest key: of the largest).

    Rows are dealt out by ranges of the key, so a task holds a range and not the
    table; the head of each range is also sent, as a ghost, to the range before it.
    Rows with equal keys follow one another by the column tie, null keys come last.
    """
    n = df.count()
    parts = max(1, min(n // rows_each, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 50 * parts)).first()[0] or [])) if parts > 1 else []
    cut = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<long>")
    placed = df.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cut, lambda c: c <= F.col(key)))))
    heads = {r["_range"]: r["k"] for r in placed.groupBy("_range").agg(F.max(key).alias("k")).collect()}  # a row for each range
    order = sorted(heads, reverse=True)
    to = F.lit(None).cast("int")
    if order:
        before = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r, order[i - 1])])
        head = F.create_map(*[F.lit(x) for r in order for x in (r, heads[r])]) if any(k is not None for k in heads.values()) else F.lit(None)
        to = F.when(F.col(key).eqNullSafe(F.element_at(head, F.col("_range")) if len(order) > 1 or heads[order[0]] is not None else F.lit(None)), F.element_at(before, F.col("_range")))
    places = F.array_compact(F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost")), F.when(to.isNotNull(), F.struct(to.alias("at"), F.lit(1).alias("ghost")))))
    dealt = placed.withColumn("_p", F.explode(places)).withColumn("_at", F.col("_p.at")).withColumn("_ghost", F.col("_p.ghost"))
    w = W.partitionBy("_at").orderBy("_ghost", F.col(key).desc_nulls_last(), tie)
    return dealt.withColumns({name: F.lead(col).over(w) for name, col in cols.items()}).where("_ghost = 0").drop("_range", "_p", "_at", "_ghost")


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = docs.withColumn("sig", minhash(F.col("text")))
    both = with_next(signed, "doc_id", "text", {"next_text": "text", "next_sig": "sig"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    done = edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", minhash(F.col("edited")).alias("edited_sig"))
    return done.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), F.lower(F.hex("edited_sig")).alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
