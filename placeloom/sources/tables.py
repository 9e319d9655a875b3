"""Saved tables: load if present, else build and save. For node locations, area polygons and converted extracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; made by build() the first time."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def require_locations(nodes: DataFrame, locations: DataFrame) -> DataFrame:
    """Nodes (id, tags) with lat and lng of locations (id, lat, lng); a node without a location fails the load."""
    both = nodes.join(locations, "id", "left")
    known = F.when(F.col("lat").isNotNull(), F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("node without a location: "), F.col("id").cast("string"))).cast("double"))
    return both.withColumn("lat", known)
