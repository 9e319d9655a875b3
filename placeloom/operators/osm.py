"""Map elements to places: tag filters, names, way geometry, the index row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, s2, text
from ..functions.roads import permute_road

#: Tags that mark what is not a place of interest; tags that can be searched as key=value.
REJECTED = ("highway", "natural", "boundary", "admin_level")
INDEXED = ("natural", "amenity", "shop", "leisure", "tourism", "historic", "cuisine")
INDEXED_PREFIX = "diet:"

POI = ("poi_id", "names", "house_number", "road", "unit", "lat", "lng", "tags", "source")


def valid_tags(tags: Column) -> Column:
    """Some tags and none of REJECTED."""
    return F.coalesce((F.size(tags) > 0) & ~F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, REJECTED))), F.lit(False))


def names(tags: Column) -> Column:
    """Values of ``name`` and of keys that contain ``name:``, by key, with possessive variants."""
    some = F.map_filter(tags, lambda k, v: (k == "name") | k.contains("name:"))
    return text.possessive(F.transform(F.array_sort(F.map_entries(some)), lambda e: e["value"]))


def place_key(id_: Column, kind: Column) -> Column:
    """One number for an element: nodes and ways are numbered apart, so an id alone is not unique."""
    return F.shiftleft(id_.cast("bigint"), 1) + F.when(kind == "ways", 1).otherwise(0)


def pois(elements: DataFrame, source: str = "osm") -> DataFrame:
    """Places (POI) from (id, lat, lng, tags, kind): valid tags, and a name or both house number and street. poi_id is place_key; without a kind the ids are taken as they are."""
    t = F.col("tags")
    key = place_key(F.col("id"), F.col("kind")) if "kind" in elements.columns else F.col("id")
    out = elements.where(valid_tags(t)).select(
        key.alias("poi_id"), names(t).alias("names"), t["addr:housenumber"].alias("house_number"), t["addr:street"].alias("road"), t["addr:unit"].alias("unit"), "lat", "lng", "tags", F.lit(source).alias("source")
    )
    return out.where((F.size("names") > 0) | (F.col("house_number").isNotNull() & F.col("road").isNotNull()))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, points): each way's locations in order, embedded ones first, else its refs' nodes; unknown nodes are left out, repeated refs kept.

    ways: id, refs array<long>, locations array<struct<lat, lng>> or null. nodes: id, lat, lng. Hot nodes
    are one row of nodes each, so adaptive execution can split the refs that ask for them.
    """
    own = ways.where(F.size("locations") > 0).select("id", F.transform("locations", lambda p: F.struct(p["lat"].alias("x"), p["lng"].alias("y"))).alias("points"))
    asked = ways.where(~(F.coalesce(F.size("locations"), F.lit(0)) > 0)).select("id", F.posexplode("refs").alias("pos", "node"))
    found = asked.join(nodes.select(F.col("id").alias("node"), "lat", "lng"), "node")
    lists = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("x"), p["lng"].alias("y"))).alias("points"))
    return own.unionByName(lists)


def way_elements(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lat, lng, tags) of ways that have a point, at their centroids. Ways without valid tags are dropped before the join."""
    good = ways.where(valid_tags(F.col("tags")))
    placed = way_points(good, nodes).where(F.size("points") > 0).withColumn("c", geo.centroid(F.col("points")))
    return placed.select("id", F.col("c.x").alias("lat"), F.col("c.y").alias("lng")).join(good.select("id", "tags"), "id")


def elements(nodes: DataFrame, ways: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Nodes, dense nodes and ways as one table (id, lat, lng, tags, kind). ignore: of nodes, dense_nodes, ways."""
    kind = F.when(F.col("dense"), "dense_nodes").otherwise("nodes")
    points = nodes.select("id", "lat", "lng", "tags", kind.alias("kind"))
    lines = way_elements(ways, nodes).withColumn("kind", F.lit("ways"))
    return points.unionByName(lines).where(~F.col("kind").isin(*ignore) if ignore else F.lit(True))


def indexed_tags(tags: Column) -> Column:
    """``key=value`` of searchable tags, by key."""
    some = F.map_filter(tags, lambda k, v: k.isin(*INDEXED) | k.startswith(INDEXED_PREFIX))
    return F.transform(F.array_sort(F.map_entries(some)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def sorted_tags(tags: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(tags)))


def content(subs: Column, dedupe: bool = True) -> Column:
    """Searchable texts in order: names, house number, road spellings for each language, unit, admin names. subs: lang -> token -> substitutes."""
    none = F.array().cast("array<string>")
    roads = F.flatten(F.transform("languages", lambda lang: permute_road(F.col("road"), F.try_element_at(subs, lang), dedupe)))
    return F.concat(
        F.coalesce("names", none), F.array_compact(F.array("house_number")), F.when(F.col("road").isNotNull(), roads).otherwise(none), F.array_compact(F.array("unit")), F.coalesce("admins", none)
    )


def index_rows(enriched: DataFrame, subs: Column, dedupe: bool = True) -> DataFrame:
    """Rows of the place table from POI rows with admins and languages."""
    cells = s2.with_cell(enriched, "lat", "lng", "s2cell")
    return cells.select(
        F.col("poi_id").alias("doc_id"), content(subs, dedupe).alias("content"), indexed_tags(F.col("tags")).alias("indexed_tag"), "source", "s2cell",
        s2.ancestors(F.col("s2cell")).alias("s2cell_parents"), s2.sort_key(F.col("s2cell")).alias("s2key"), sorted_tags(F.col("tags")).alias("tags"),
    )


def counts(all_elements: DataFrame) -> DataFrame:
    """Elements of each kind."""
    return all_elements.groupBy("kind").agg(F.count("*").alias("n"))
