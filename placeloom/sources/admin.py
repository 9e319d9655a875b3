"""Administrative areas in an SQLite file: places, polygons (well-known binary), names, properties.

A partition reads a range of row ids. Polygons come from a table with a geometry column in
well-known binary; other geometries than polygons are dropped. SpatiaLite's own geometry blobs
are unwrapped. The file has to be readable by every executor.
"""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo

TABLES = {
    "place": "source string, id string, class string, type string",
    "name": "source string, id bigint, lang string, tag string, abbr string, name string",
    "property": "source string, id bigint, key string, value string",
    "shard": "source string, id string, geom binary",
    "point_in_polygon": "source string, id string, geom binary",
}


def rings(b: bytes | None) -> list[list[tuple[float, float]]] | None:
    """Rings of a polygon in well-known binary or a SpatiaLite blob; None for anything else."""
    if not b or len(b) < 9:
        return None
    if b[0] == 0 and len(b) > 43 and b[38] == 0x7C:  # SpatiaLite: start, byte order, reference system, envelope, mark
        order, at = "<" if b[1] == 1 else ">", 39
    else:
        order, at = "<" if b[0] == 1 else ">", 1
    kind, n = struct.unpack_from(f"{order}II", b, at)
    if kind != 3:
        return None
    at, out = at + 8, []
    for _ in range(n):
        (m,) = struct.unpack_from(f"{order}I", b, at)
        xy = struct.unpack_from(f"{order}{2 * m}d", b, at + 4)
        out.append(list(zip(xy[::2], xy[1::2], strict=True)))
        at += 4 + 16 * m
    return out


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows

    def _open(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}").fetchone()
        return [_Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)] or [_Range(0, 0)]

    def read(self, partition):
        with self._open() as db:
            yield from db.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class AdminTable(DataSource):
    @classmethod
    def name(cls):
        return "admin_sqlite"

    def schema(self):
        return TABLES[self.options["table"]]

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], schema.names, int(self.options.get("rows", "100000")))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(AdminTable)
    return spark.read.format("admin_sqlite").option("path", path).option("table", table).load()


@F.udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
def _rings(b):
    return rings(bytes(b)) if b is not None else None


def read_polygons(spark: SparkSession, path: str, table: str = "shard") -> DataFrame:
    """(source, id, rings, env) of a table's polygons. Decoded once, when the source is loaded."""
    return read_table(spark, path, table).select("source", "id", _rings("geom").alias("rings")).where("rings IS NOT NULL").withColumn("env", geo.envelope(F.col("rings")))
