"""The index: tables of places, postings, vocabulary and tag postings, in a folder of Parquet files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Schemes of paths that count as remote.
REMOTE = ("http", "https", "s3", "s3a", "gs", "abfs", "abfss", "wasbs")
TABLES = ("pois", "postings", "tag_postings", "vocabulary")


def postings(pois: DataFrame) -> DataFrame:
    """(term, doc_id, positions, tf) of content. Positions of two values of a place are never neighbours."""
    values = pois.select("doc_id", F.posexplode("content").alias("value", "text"))
    words = values.select("doc_id", "value", F.posexplode(text.index_positions(F.col("text"))).alias("at", "term")).where(F.octet_length("term") <= text.TOKEN_BYTES)
    place = F.shiftleft(F.col("value").cast("bigint"), 32) + F.col("at")
    return words.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list(place)).alias("positions"), F.count("*").cast("int").alias("tf"))


def tag_postings(pois: DataFrame) -> DataFrame:
    """(tag, doc_id), distinct."""
    return pois.select(F.explode("indexed_tag").alias("tag"), "doc_id").distinct()


def vocabulary(post: DataFrame) -> DataFrame:
    """(term, df): places that hold each term."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


class PlaceIndex:
    """An index folder. Writing appends places that it lacks; a place that is imported again (or a batch that is written again after a failure) stays as it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PlaceIndex:
        """An index that exists; any file system that Spark reads."""
        index = cls(spark, path)
        index.pois.schema  # noqa: B018
        return index

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> PlaceIndex:
        """An index to write to; made by the first write if absent."""
        return cls(spark, path)

    @property
    def remote(self) -> bool:
        """Whether the folder lies in a store that is reached over a network by object: searches then look for whole words and phrases only."""
        return self.path.split("://")[0] in REMOTE if "://" in self.path else False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def pois(self) -> DataFrame:
        return self.table("pois")

    @property
    def postings(self) -> DataFrame:
        return self.table("postings")

    @property
    def tag_postings(self) -> DataFrame:
        return self.table("tag_postings")

    def vocabulary(self) -> DataFrame:
        """(term, df): each write has added the counts of its own places."""
        return self.table("vocabulary").groupBy("term").agg(F.sum("df").alias("df"))

    def count(self) -> int:
        return self.pois.count()

    def write(self, rows: DataFrame) -> None:
        """Append index rows whose doc_id the index lacks. Places are sorted by cell, postings by term; the places are written last, as they say what is there."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pois")
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            rows = rows.join(self.pois.select("doc_id"), "doc_id", "left_anti")
        words = postings(rows)
        # derived from what this call wrote would need its file list; the input is used once more instead
        words.repartitionByRange(F.col("term"), F.col("doc_id")).sortWithinPartitions("term", "doc_id").write.mode("append").parquet(f"{self.path}/postings")
        tag_postings(rows).repartitionByRange(F.col("tag"), F.col("doc_id")).sortWithinPartitions("tag", "doc_id").write.mode("append").parquet(f"{self.path}/tag_postings")
        vocabulary(words).write.mode("append").parquet(f"{self.path}/vocabulary")
        rows.repartitionByRange(F.col("s2key")).sortWithinPartitions("s2key").write.mode("append").parquet(f"{self.path}/pois")

    def compact(self, to: str | None = None) -> PlaceIndex:
        """The same rows in fewer, sorted files, in a new folder."""
        out = PlaceIndex(self.spark, to or f"{self.path}-{uuid.uuid4().hex[:8]}")
        for name, keys in (("pois", ["s2key"]), ("postings", ["term", "doc_id"]), ("tag_postings", ["tag", "doc_id"])):
            self.table(name).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{out.path}/{name}")
        self.vocabulary().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{out.path}/vocabulary")
        return out
