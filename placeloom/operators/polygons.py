"""Saved polygons that points are looked up in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import tables


class PolygonIndex:
    """Polygons (id, rings, env ...) in a folder, read if they are there and built and written if not."""

    def __init__(self, polygons: DataFrame):
        self.polygons = polygons

    @classmethod
    def load_or_build(cls, spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> PolygonIndex:
        return cls(tables.load_or_build(spark, path, build))

    def __len__(self) -> int:
        return self.polygons.count()

    def is_empty(self) -> bool:
        return self.polygons.isEmpty()

    def at(self, points: DataFrame, x: str, y: str, exact: bool = True, step: float = 1.0, most: int | None = None, key: str | None = None) -> DataFrame:
        """Points with each polygon over them; of a point (by its column key) the ``most`` polygons of the smallest ids, or all."""
        found = geo.polygons_at(points, self.polygons, x, y, exact, step)
        if most is None:
            return found
        return found.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("id"))).where(F.col("_n") <= most).drop("_n")
