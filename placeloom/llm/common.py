"""Helpers that several operators share: tables in the shared folder, tokens, compact arrays."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one if unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.placeloom.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="placeloom-")
        spark.conf.set("spark.placeloom.dir", base)
    return base


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CREATED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._placeloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by save() that no later result reads."""
    path = getattr(df, "_placeloom_path", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)


#: Bytes of files up to which a table made by save() is broadcast.
SMALL = 8_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was made by save() and its files are small; else as it is."""
    path = getattr(df, "_placeloom_path", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        if fs.getContentSummary(p).getLength() <= SMALL:
            return F.broadcast(df)
    return df


@atexit.register
def _clean() -> None:
    for spark, path in _CREATED:
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session has ended before us
            return


def trim() -> None:
    """Give free memory of this worker back: workers stay between tasks and stages, and count with their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def crc_mod(col: str, n: int):
    """crc32 of the column's text form, modulo n (null: null)."""
    return F.crc32(F.col(col).cast("string")) % n


def arrow_rows(rows: list[list], ddl: str) -> pa.RecordBatch:
    """Rows as a record batch of the columns ``name type, name type ...``."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def few_rows(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[tuple]:
    """Rows of record batches as tuples, n at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, n).columns), strict=True)


# ---- tokens -----------------------------------------------------------------


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ as UTF-8; lower changes A-Z only. bytes.split() and bytes.lower() know ASCII alone."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


def encode_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct words, the word sequence as places among them, words per document."""
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    d = pa.array(chain.from_iterable(docs), pa.binary()).dictionary_encode()
    h = pd.util.hash_array(np.array(d.dictionary.to_pylist(), dtype=object), categorize=False) if len(d.dictionary) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int32)
    rank[order] = np.arange(len(h), dtype=np.int32)
    return h[order], rank[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.zeros(0, np.int32), lens


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that any bits of the result can be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---- compact arrays: bytes of equal weight lie together and are compressed, so that small numbers in wide types
# cost about a byte in shuffles, in tables, and in the memory of the JVM that passes them on ----


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    n = len(planes) // np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(dtype).reshape(n)


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending uint64 as differences."""
    return pack(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def bucket_bounds(h: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit space begins in ascending h (n + 1 places)."""
    edges = np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(h, edges, side="left"), len(h))
