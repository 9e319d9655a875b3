"""Map extracts in the public OSM PBF format as a Spark data source, in plain Python.

``spark.read.format("osm_pbf").option("path", file).option("kind", "nodes")`` (or "ways") gives
nodes (id, lat, lng, tags, dense) or ways (id, refs, locations, tags); relations are skipped. The
file is split at its blobs, so a partition reads a run of blobs and no more. The file has to be
readable by every executor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODES = "id bigint, lat double, lng double, tags map<string,string>, dense boolean"
WAYS = "id bigint, refs array<bigint>, locations array<struct<lat:double,lng:double>>, tags map<string,string>"


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[at]
        at += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def packed(b: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = varint(b, at)
        out.append(zigzag(v) if signed else v)
    return out


def running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def blobs(path: str) -> list[tuple[int, int]]:
    """Place and size of each data blob: only headers are read."""
    found = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            if header[1] == b"OSMData":
                found.append((f.tell(), header[3]))
            f.seek(header[3], 1)
    return found


def block(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("the blob is neither raw nor zlib data")


def elements(data: bytes, kind: str) -> Iterator[tuple]:
    """Rows of one block."""
    strings: list[str] = []
    groups, grain, lat0, lng0 = [], 100, 0, 0
    for number, value in fields(data):
        if number == 1:
            strings = [v.decode() for _, v in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number == 19:
            lat0 = value - (1 << 64) if value >> 63 else value
        elif number == 20:
            lng0 = value - (1 << 64) if value >> 63 else value
    place = lambda v, zero: (zero + grain * v) * 1e-9
    for group in groups:
        for number, value in fields(group):
            if kind == "nodes" and number == 1:
                f = dict(fields(value))
                tags = {strings[k]: strings[v] for k, v in zip(packed(f.get(2, b"")), packed(f.get(3, b"")), strict=True)}
                yield zigzag(f[1]), place(zigzag(f[8]), lat0), place(zigzag(f[9]), lng0), tags, False
            elif kind == "nodes" and number == 2:
                f = dict(fields(value))
                kv, at = packed(f.get(10, b"")), 0
                for i, lat, lng in zip(*(running(packed(f.get(n, b""), True)) for n in (1, 8, 9)), strict=True):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield i, place(lat, lat0), place(lng, lng0), tags, True
            elif kind == "ways" and number == 3:
                f = dict(fields(value))
                tags = {strings[k]: strings[v] for k, v in zip(packed(f.get(2, b"")), packed(f.get(3, b"")), strict=True)}
                at = [[place(v, zero) for v in running(packed(f[n], True))] if n in f else [] for n, zero in ((9, lat0), (10, lng0))]
                yield f[1], running(packed(f.get(8, b""), True)), [*zip(*at, strict=True)], tags


class _Run(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, splits: int):
        self.path, self.kind, self.splits = path, kind, splits

    def partitions(self):
        found = blobs(self.path)
        n = max(1, min(self.splits, len(found)))
        return [_Run(found[len(found) * i // n : len(found) * (i + 1) // n]) for i in range(n)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            for at, size in partition.places:
                f.seek(at)
                yield from elements(block(f.read(size)), self.kind)


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return WAYS if self.options.get("kind") == "ways" else NODES

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("kind", "nodes"), int(self.options.get("splits", "64")))


def read_pbf(spark: SparkSession, path: str, kind: str = "nodes"):
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osm_pbf").option("path", path).option("kind", kind).load()
