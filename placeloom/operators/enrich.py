"""Administrative areas of places: which polygons hold them, their names and languages.

Tables: place (source, id, class, type), polygons (source, id, rings, env), name (source, id,
lang, tag, name), property (source, id, key, value). Ids are strings in place and polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, s2, text

#: Place types that are no administrative area; languages and tags of names; key of spoken languages; known languages.
EXCLUDED_TYPES = ("planet", "marketarea", "county", "timezone")
NAME_LANGUAGES = ("ara", "dan", "deu", "fra", "fin", "hun", "gre", "ita", "nld", "por", "rus", "ron", "spa", "eng", "swe", "tam", "tur", "zho")
NAME_TAGS = ("preferred", "default")
SPOKEN = "wof:lang_x_spoken"
KNOWN_LANGUAGES = ("eng", "zho", "cat", "ara", "dan", "nld", "fin", "fra", "deu", "ell", "hun", "ita", "por", "ron", "rus", "spa", "swe", "tam", "tur")
#: Level of the cells for which areas are looked up once.
LOOKUP_LEVEL = 15


def areas(polygons: DataFrame, place: DataFrame) -> DataFrame:
    """Polygons with class and type of their place; excluded and unknown types and places without source are dropped."""
    kept = place.where(~F.col("type").isin(*EXCLUDED_TYPES) & F.col("source").isNotNull())
    return polygons.join(kept, ["source", "id"])


def area_names(name: DataFrame) -> DataFrame:
    """(id long, names): folded lower-case names of each place, distinct and sorted."""
    kept = name.where((F.col("source") == "wof") & F.col("tag").isin(*NAME_TAGS) & F.col("lang").isin(*NAME_LANGUAGES))
    return kept.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.array_sort(F.collect_set(F.lower(text.fold(F.col("name"))))).alias("names"))


def spoken_languages(prop: DataFrame) -> DataFrame:
    """(id long, languages) of the property of spoken languages; of several rows the last value by text."""
    kept = prop.where((F.col("source") == "wof") & (F.col("key") == SPOKEN))
    return kept.groupBy(F.col("id").cast("bigint").alias("id")).agg(text.split_csv(F.max("value")).alias("languages"))


def known_languages(langs: Column) -> Column:
    return F.filter(langs, lambda x: x.isin(*KNOWN_LANGUAGES))


def area_ids(points: DataFrame, polygons: DataFrame, exact: bool = True, step: float = 1.0) -> DataFrame:
    """(cell, ids): for each distinct lookup cell of points (s2cell) the areas over its centre.

    exact: polygons, with coordinates as 32-bit floats; else envelopes. Cells without areas have no row.
    """
    cell = F.when(s2.level(F.col("s2cell")) > LOOKUP_LEVEL, s2.parent(F.col("s2cell"), LOOKUP_LEVEL)).otherwise(F.col("s2cell"))
    distinct = points.select(cell.alias("cell")).distinct()
    centred = s2.with_center(distinct, "cell", "_lat", "_lng")
    found = geo.polygons_at(centred, polygons, "_lng", "_lat", exact, step, narrow=exact)
    return found.groupBy("cell").agg(F.array_sort(F.collect_set(F.col("id").cast("bigint"))).alias("ids"))


def with_areas(points: DataFrame, polygons: DataFrame, place: DataFrame, name: DataFrame, prop: DataFrame, countries: list[int], exact: bool = True, step: float = 1.0) -> DataFrame:
    """POI rows (lat, lng, ...) with admins (names of all areas but the country) and languages of the country; both empty where no area is known.

    countries: ids of country places. The country of a point is the smallest of its ids among them.
    """
    cells = s2.with_cell(points, "lat", "lng", "_leaf")
    cell = s2.parent(F.col("_leaf"), LOOKUP_LEVEL)
    ids = area_ids(cells.select(F.col("_leaf").alias("s2cell")), areas(polygons, place), exact, step)
    country = F.array(*map(F.lit, countries)).cast("array<bigint>")
    ids = ids.withColumn("country", F.array_min(F.array_intersect("ids", country))).withColumn("others", F.array_except("ids", country))
    named = ids.select("cell", F.posexplode("others").alias("at", "id")).join(area_names(name), "id")
    named = named.groupBy("cell").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "names"))), lambda s: s["names"])).alias("admins"))
    langs = ids.select("cell", F.col("country").alias("id")).join(spoken_languages(prop), "id").select("cell", known_languages(F.col("languages")).alias("languages"))
    none = F.array().cast("array<string>")
    out = cells.withColumn("cell", cell).join(named, "cell", "left").join(langs, "cell", "left")
    return out.withColumns({"admins": F.coalesce("admins", none), "languages": F.coalesce("languages", none)}).drop("cell", "_leaf")
