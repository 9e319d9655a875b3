"""Ingest as a stream: new files of elements are turned into index rows and appended, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import PlaceIndex

ELEMENTS = "id bigint, lat double, lng double, tags map<string,string>"


def ingest(spark: SparkSession, source: str, index: PlaceIndex, checkpoint: str, rows: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Read Parquet files of elements from a folder until there are no more, append what rows() makes of them, remember them in checkpoint."""
    stream = spark.readStream.schema(ELEMENTS).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: index.write(rows(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
