"""Every operator on projections of the driver's tables, with SQL that gives the same rows.

Places are parts (name, brand and type as tags) at positions that follow from their key; ways are
orders whose refs are parts; areas are nations as stripes of longitude, countries are regions.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, roads, s2, text
from .operators import enrich, osm, search
from .operators.polygons import PolygonIndex
from .operators.index import PlaceIndex, postings, tag_postings, vocabulary
from .plans.clauses import Box, Request, clauses, parse_request
from .plans.covering import covering

LAT, LNG = "(({k} * 37) % 17000) / 100.0D - 85", "(({k} * 91) % 36000) / 100.0D - 180"
SQL_LAT, SQL_LNG = LAT.replace("100.0D", "100.0::DOUBLE"), LNG.replace("100.0D", "100.0::DOUBLE")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nodes(spark, sf) -> DataFrame:
    tags = "map('name', p_name, 'shop', p_brand, 'amenity', p_type, 'addr:housenumber', cast(p_size AS string), if(p_partkey % 7 = 0, 'highway', 'note'), 'x', if(p_partkey % 5 = 0, 'diet:vegan', 'fixme'), 'yes')"
    return _t(spark, sf, "part").selectExpr("p_partkey AS id", f"{LAT.format(k='p_partkey')} AS lat", f"{LNG.format(k='p_partkey')} AS lng", f"{tags} AS tags", "p_partkey % 2 = 0 AS dense")


def _ways(spark, sf) -> DataFrame:
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    point = "array(named_struct('lat', 1D, 'lng', 2D))"
    return lines.selectExpr("l_orderkey AS id", "transform(r, x -> x.l_partkey) AS refs", f"if(l_orderkey % 97 = 0, {point}, cast(array() AS array<struct<lat: double, lng: double>>)) AS locations", "map('building', 'yes', 'name', concat('order ', l_orderkey)) AS tags")


def _pois(spark, sf) -> DataFrame:
    """Index rows of parts: content is the name."""
    rows = _nodes(spark, sf).selectExpr("id AS poi_id", "array(tags['name']) AS names", "cast(null AS string) AS house_number", "cast(null AS string) AS road", "cast(null AS string) AS unit", "lat", "lng", "tags", "'osm' AS source", "cast(array() AS array<string>) AS admins", "cast(array() AS array<string>) AS languages")
    return osm.index_rows(rows, _SUBS())


def _parts(spark, sf) -> DataFrame:
    """What text and tag search need of the index rows of parts."""
    rows = _nodes(spark, sf).where(F.col("tags")["name"].isNotNull())
    return rows.select(F.col("id").alias("doc_id"), F.array(F.col("tags")["name"]).alias("content"), osm.indexed_tags(F.col("tags")).alias("indexed_tag"))


def _placed(spark, sf) -> DataFrame:
    """_parts with cells and what results show."""
    cells = s2.with_cell(_nodes(spark, sf), "lat", "lng", "s2cell").select(F.col("id").alias("doc_id"), "s2cell", s2.ancestors(F.col("s2cell")).alias("s2cell_parents"), "tags", F.lit("osm").alias("source"))
    return _parts(spark, sf).join(cells, "doc_id")


def _SUBS():  # noqa: N802
    return roads.subs_map({k: roads.parse_lines(v) for k, v in roads.SAMPLE.items()})


def _doc_rows(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.array(F.coalesce("text", F.lit(""))).alias("content"))


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- elements to places --------------------------------------------------------

_WAY_REFS = "refs AS (SELECT l_orderkey AS id, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)"


@query("SELECT kind, count(*) AS n FROM (SELECT if(p_partkey % 2 = 0, 'dense_nodes', 'nodes') AS kind FROM part UNION ALL SELECT DISTINCT 'ways' || '' || '' FROM lineitem WHERE false UNION ALL SELECT 'ways' FROM (SELECT l_orderkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(p_partkey) > 0 OR l_orderkey % 97 = 0)) GROUP BY kind")
def agg1_set5_element_counts(spark, sf):
    return osm.counts(osm.elements(_nodes(spark, sf), _ways(spark, sf)))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 2 <> 0")
def src4_fil1_2_tag_filter(spark, sf):
    return osm.elements(_nodes(spark, sf), _ways(spark, sf), ignore=("dense_nodes", "ways")).where(osm.valid_tags(F.col("tags"))).select("id")


@query("SELECT p_partkey AS poi_id, p_name AS names, p_size::VARCHAR AS house_number, 'osm' AS source FROM part WHERE p_partkey % 7 <> 0")
def prj1_fil3_pois(spark, sf):
    return osm.pois(_nodes(spark, sf)).select("poi_id", F.array_join("names", "|").alias("names"), "house_number", "source")


@query(f"""WITH {_WAY_REFS}, found AS (SELECT refs.id, pos, {SQL_LAT.format(k='p_partkey')} AS lat, {SQL_LNG.format(k='p_partkey')} AS lng FROM refs JOIN part ON node = p_partkey WHERE refs.id % 97 <> 0)
SELECT id, string_agg(round(lat, 2)::VARCHAR || ' ' || round(lng, 2)::VARCHAR, ',' ORDER BY pos) AS points FROM found GROUP BY id UNION ALL SELECT DISTINCT l_orderkey, '1.0 2.0' FROM lineitem WHERE l_orderkey % 97 = 0""")
def j1_fil4_way_points(spark, sf):
    got = osm.way_points(_ways(spark, sf), _nodes(spark, sf))
    return got.select("id", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", F.round(p["x"], 2).cast("string"), F.round(p["y"], 2).cast("string"))), ",").alias("points"))


@query(f"""WITH {_WAY_REFS}, p AS (SELECT refs.id, pos, {SQL_LAT.format(k='p_partkey')} AS x, {SQL_LNG.format(k='p_partkey')} AS y FROM refs JOIN part ON node = p_partkey WHERE refs.id % 97 <> 0
UNION ALL SELECT DISTINCT l_orderkey, 1, 1.0, 2.0 FROM lineitem WHERE l_orderkey % 97 = 0),
q AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS "by", first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, count(*) OVER (PARTITION BY id) AS n FROM p WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT *, (x - x0) * ("by" - y0) - (bx - x0) * (y - y0) AS c, sqrt((bx - x) ** 2 + ("by" - y) ** 2) AS l FROM q),
s AS (SELECT id, any_value(n) AS n, any_value(x0) AS x0, any_value(y0) AS y0, sum(c) AS a, sum((x + bx - 2 * x0) * c) AS ax, sum((y + "by" - 2 * y0) * c) AS ay, sum(l) AS l, sum((x + bx) / 2 * l) AS lx, sum((y + "by") / 2 * l) AS ly FROM r GROUP BY id)
SELECT id, round(CASE WHEN n = 1 THEN x0 WHEN abs(a) > 1e-12 * l * l THEN x0 + ax / (3 * a) WHEN l > 0 THEN lx / l ELSE x0 END, 3) AS lat, round(CASE WHEN n = 1 THEN y0 WHEN abs(a) > 1e-12 * l * l THEN y0 + ay / (3 * a) WHEN l > 0 THEN ly / l ELSE y0 END, 3) AS lng FROM s""")
def fn11_agg11_centroid(spark, sf):
    got = osm.way_points(_ways(spark, sf), _nodes(spark, sf)).withColumn("c", geo.centroid(F.col("points")))
    return got.select("id", F.round("c.x", 3).alias("lat"), F.round("c.y", 3).alias("lng"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(['amenity=' || p_type, if(p_partkey % 5 = 0, 'diet:vegan=yes', NULL), 'shop=' || p_brand], lambda x: x IS NOT NULL), ',') AS indexed, array_to_string(list_sort(list_filter(['name=' || p_name, 'shop=' || p_brand, 'amenity=' || p_type, 'addr:housenumber=' || p_size, if(p_partkey % 7 = 0, 'highway=x', 'note=x'), if(p_partkey % 5 = 0, 'diet:vegan=yes', 'fixme=yes')], lambda x: x IS NOT NULL)), ',') AS tags FROM part")
def fil12_top4_indexed_tags(spark, sf):
    return _nodes(spark, sf).select("id", F.array_join(osm.indexed_tags(F.col("tags")), ",").alias("indexed"), F.array_join(F.transform(F.map_entries(osm.sorted_tags(F.col("tags"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("tags"))


# ---- text ------------------------------------------------------------------------

_WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: strlen(x) <= 40)"


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term")
def fn2_agg8_vocabulary(spark, sf):
    return vocabulary(postings(_doc_rows(spark, sf)))


@query(r"SELECT p_partkey AS id, array_to_string(list_slice(w, i, j), ' ') AS phrase, i, j FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), LATERAL (SELECT unnest(generate_series(1, len(w))) AS i), LATERAL (SELECT unnest(generate_series(i, len(w))) AS j)")
def fn3_subsequences(spark, sf):
    words = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(i, F.size("w")), lambda j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))))
    both = words.select("id", F.explode(F.arrays_zip(text.subsequences(F.col("w")).alias("phrase"), F.flatten(runs).alias("at"))).alias("x"))
    return both.select("id", F.array_join("x.phrase", " ").alias("phrase"), "x.at.i", "x.at.j")


@query(r"SELECT doc_id, md5(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[ \t\r\n]+', ' ', 'g')) AS h FROM documents")
def fn4_6_sanitize(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(text.sanitize(F.col("text"))).alias("h"))


@query(r"SELECT p_partkey AS id, unnest(if(p_partkey % 3 = 0, [p_name || '''s x', p_name || ' x', p_name || 's x'], [p_name || ' x'])) AS name FROM part")
def fn8_possessive(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "'s x").otherwise(" x"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(text.possessive(F.array(name))).alias("name"))


_LINES = ", ".join(f"('{lang}', {i}, '{line}')" for lang, lines in roads.SAMPLE.items() for i, line in enumerate(lines))


@query(f"WITH l(lang, no, line) AS (VALUES {_LINES}), p AS (SELECT lang, no, string_split(line, '|') AS parts FROM l), k AS (SELECT lang, no, parts, unnest(list_distinct(parts)) AS key FROM p), u AS (SELECT lang, key, no, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM k), f AS (SELECT lang, key, s, min(no * 1000 + i) AS seen FROM u GROUP BY ALL) SELECT lang, key, string_agg(s, '|' ORDER BY seen) AS subs FROM f GROUP BY lang, key")
def src9_fn9_agg7_dictionary(spark, sf):
    return roads.dictionary(roads.sample_lines(spark)).select("lang", "key", F.array_join("subs", "|").alias("subs"))


_ROAD_SQL = """WITH o(suffix, opt) AS (VALUES ('ave', 'ave'), ('ave', 'avenue'), ('ave', 'avn'), ('st', 'st'), ('st', 'street'), ('st', 'strt'), ('st', 'saint'), ('rd', 'rd'), ('rd', 'road'))
SELECT p_partkey AS id, p_name || ' ' || opt AS road FROM part JOIN o ON suffix = ['ave', 'st', 'rd'][p_partkey % 3 + 1]"""


@query(_ROAD_SQL)
def fn10_j11_permute_road(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, ("ave", "st", "rd"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    road = F.concat_ws("  ", F.upper("p_name"), suffix)
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(roads.permute_road(road, _SUBS()["eng"], dedupe=True)).alias("road"))


@query(_ROAD_SQL)
def fn10_permute_by_join(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, ("ave", "st", "rd"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", suffix).alias("road"), F.lit("eng").alias("lang"))
    got = roads.permute_rows(rows, roads.dictionary(roads.sample_lines(spark)), "id", "road", "lang")
    return got.select("id", F.explode("permutations").alias("road"))


@query(r"SELECT p_partkey AS id, round(pow(1.05, strlen(q)) * if(length(q) - length(regexp_replace(q, '[^0-9\s]', '', 'g')) < 3 AND length(regexp_replace(q, '[^0-9\s]', '', 'g')) > 0, 3, 1), 6) AS boost, regexp_replace(q, '[\s!-/:-@\[-`{-~]', '', 'g') = '' AS blank FROM (SELECT p_partkey, if(p_partkey % 3 = 0, p_partkey::VARCHAR, if(p_partkey % 3 = 1, p_name, 'é !')) AS q FROM part)")
def fn22_fil15_boost(spark, sf):
    q = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("é !")
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(text.boost(q), 6).alias("boost"), text.blank(q).alias("blank"))


# ---- cells ------------------------------------------------------------------------

_P, _T = str(s2.PLACE), str(s2.TURN)


def _cell_sql(levels: int = 30) -> str:
    """Leaf ids (unsigned, as HUGEINT) of parts by a step for each level."""
    sql = f"""SELECT id, f, least(greatest(floor((CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END) * 1073741824), 0), 1073741823)::BIGINT AS i,
    least(greatest(floor((CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END) * 1073741824), 0), 1073741823)::BIGINT AS j, 0::HUGEINT AS p, f % 2 AS o FROM
    (SELECT id, f, CASE f WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
    CASE f WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM
    (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN if(x < 0, 3, 0) WHEN abs(y) >= abs(z) THEN if(y < 0, 4, 1) ELSE if(z < 0, 5, 2) END AS f FROM
    (SELECT p_partkey AS id, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM (SELECT p_partkey, {SQL_LAT.format(k='p_partkey')} AS lat, {SQL_LNG.format(k='p_partkey')} AS lng FROM part))))"""
    for k in range(29, 29 - levels, -1):
        sql = f"SELECT id, f, i, j, p * 4 + t AS p, xor(o, {_T}[t + 1]) AS o FROM (SELECT *, {_P}[o * 4 + 2 * ((i >> {k}) & 1) + ((j >> {k}) & 1) + 1] AS t FROM ({sql}))"
    return sql


#: Ancestors at level 12: leaf ids hang on the last digit of a sine.
_SIGNED = "(CASE WHEN c >= 9223372036854775808 THEN c - 18446744073709551616 ELSE c END)::BIGINT"
_LEVEL12 = f"SELECT id, f::HUGEINT * 2305843009213693952 + (2 * p + 1) * {1 << 36} AS c FROM ({_cell_sql(12)})"


@query(f"SELECT id, {_SIGNED} AS cell FROM ({_LEVEL12})")
def fn14_15_cells(spark, sf):
    return s2.with_cell(_nodes(spark, sf), "lat", "lng", "leaf").select("id", s2.parent(F.col("leaf"), 12).alias("cell"))


@query(f"SELECT id, k AS level, {_SIGNED} AS cell FROM (SELECT id, k, (c // (2::HUGEINT ** (61 - 2 * k))::HUGEINT) * (2::HUGEINT ** (61 - 2 * k))::HUGEINT + (2::HUGEINT ** (60 - 2 * k))::HUGEINT AS c FROM ({_LEVEL12}), (SELECT unnest(generate_series(0, 11)) AS k))")
def fn16_17_ancestors(spark, sf):
    cells = s2.with_cell(_nodes(spark, sf), "lat", "lng", "leaf").select("id", s2.parent(F.col("leaf"), 12).alias("c"))
    up = cells.select("id", F.explode(s2.ancestors(F.col("c"))).alias("cell"))
    return up.select("id", s2.level(F.col("cell")).cast("long").alias("level"), "cell")


@query(f"SELECT p_partkey AS id, round({SQL_LAT.format(k='p_partkey')}, 4) + 0.0 AS lat, round({SQL_LNG.format(k='p_partkey')}, 4) + 0.0 AS lng FROM part")
def fn18_prj3_centers(spark, sf):
    leaf = s2.with_cell(_nodes(spark, sf).select("id", "lat", "lng"), "lat", "lng", "leaf").select("id", "leaf")
    got = s2.with_center(leaf, "leaf", "lat", "lng")
    return got.select("id", (F.round("lat", 4) + 0.0).alias("lat"), (F.when(F.round("lng", 4) == 180, -180.0).otherwise(F.round("lng", 4)) + 0.0).alias("lng"))


_BOX = Box(-60.0, -30.0, 75.0, 40.0)
_CELLS = [c % (1 << 64) for c in covering(_BOX)]


def _in_cells(c: str) -> str:
    """SQL: a level-12 cell is below one of the covering's cells."""
    return " OR ".join(f"({c} BETWEEN {x - (x & -x) + 1}::HUGEINT AND {x + (x & -x) - 1}::HUGEINT)" for x in _CELLS)


@query(f"SELECT id FROM ({_LEVEL12}) WHERE {_in_cells('c')}")
def fil14_fn19_bbox(spark, sf):
    cells = F.array(*[F.lit(c if c < 1 << 63 else c - (1 << 64)) for c in _CELLS])
    return _placed(spark, sf).where(F.arrays_overlap("s2cell_parents", cells)).select(F.col("doc_id").alias("id"))


# ---- areas -------------------------------------------------------------------------

#: Edges of the stripes in hundredths of degrees, by the arithmetic of the points: some points lie on them.
EDGE, SQL_EDGE = "({n} * 1440) / 100.0D - 180", "({n} * 1440) / 100.0::DOUBLE - 180"


def _polygons(spark, sf, shift: float = 0.0) -> DataFrame:
    west, east = (f"{EDGE.format(n=n)} + {shift}D" for n in ("n_nationkey", "(n_nationkey + 1)"))
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y}D)"
    ring = ", ".join([p(west, -85), p(east, -85), p(east, 85), p(west, 85), p(west, -85)])
    nations = _t(spark, sf, "nation").selectExpr("'wof' AS source", "cast(1000 + n_nationkey AS string) AS id", f"array(array({ring})) AS rings")
    world = ", ".join([p("-180D", -85), p("181D", -85), p("181D", 85), p("-180D", 85), p("-180D", -85)])
    regions = _t(spark, sf, "region").where("r_regionkey < 2").selectExpr("'wof' AS source", "cast(r_regionkey AS string) AS id", f"array(array({world})) AS rings")
    both = nations.unionByName(regions)
    return both.withColumn("env", geo.envelope(F.col("rings")))


def _place(spark, sf) -> DataFrame:
    nations = _t(spark, sf, "nation").selectExpr("'wof' AS source", "cast(1000 + n_nationkey AS string) AS id", "'area' AS class", "if(n_nationkey % 10 = 9, 'county', 'region') AS type")
    return nations.unionByName(_t(spark, sf, "region").selectExpr("'wof' AS source", "cast(r_regionkey AS string) AS id", "'area' AS class", "if(r_regionkey = 0, 'country', 'planet') AS type"))


def _names(spark, sf) -> DataFrame:
    n = _t(spark, sf, "nation")
    rows = n.selectExpr("'wof' AS source", "cast(1000 + n_nationkey AS string) AS id", "stack(3, 'eng', 'preferred', n_name, 'deu', 'default', concat('Ü ', n_name), 'xxx', 'preferred', 'no') AS (lang, tag, name)")
    return rows.unionByName(n.selectExpr("'wof' AS source", "cast(1000 + n_nationkey AS string) AS id", "'eng' AS lang", "'variant' AS tag", "'not this' AS name"))


def _props(spark, sf) -> DataFrame:
    return _t(spark, sf, "region").selectExpr("'wof' AS source", "cast(r_regionkey AS string) AS id", "'wof:lang_x_spoken' AS key", "'eng,xxx,fra' AS value")


_POINTS = f"SELECT p_partkey AS id, {SQL_LAT.format(k='p_partkey')} AS lat, {SQL_LNG.format(k='p_partkey')} AS lng FROM part"
_STRIPES = f"SELECT n_nationkey, n_name, {SQL_EDGE.format(n='n_nationkey')} AS west, {SQL_EDGE.format(n='(n_nationkey + 1)')} AS east FROM nation"


@query(f"SELECT id, (1000 + n_nationkey)::VARCHAR AS area FROM ({_POINTS}) JOIN ({_STRIPES}) ON lng BETWEEN west AND east AND lat BETWEEN -85 AND 85")
def j3_fn26_envelope_join(spark, sf):
    points = _nodes(spark, sf).select(F.col("id").alias("pid"), "lat", "lng")
    got = geo.polygons_at(points, _polygons(spark, sf).where("id >= 1000"), "lng", "lat", exact=False, step=5.0)
    return got.select(F.col("pid").alias("id"), F.col("id").alias("area"))


@query(f"SELECT id, (1000 + n_nationkey)::VARCHAR AS area FROM ({_POINTS}) JOIN ({_STRIPES}) ON lng BETWEEN west AND east AND lat BETWEEN -85 AND 85")
def j2_fn27_polygon_join(spark, sf):
    points = _nodes(spark, sf).select(F.col("id").alias("pid"), "lat", "lng")
    got = geo.polygons_at(points, _polygons(spark, sf).where("id >= 1000"), "lng", "lat", exact=True, step=5.0)
    return got.select(F.col("pid").alias("id"), F.col("id").alias("area"))


@query("SELECT (1000 + n_nationkey)::VARCHAR AS id, 'region' AS type FROM nation WHERE n_nationkey % 10 <> 9 UNION ALL SELECT r_regionkey::VARCHAR, 'country' FROM region WHERE r_regionkey = 0")
def src8_j4_fil6_areas(spark, sf):
    return enrich.areas(_polygons(spark, sf), _place(spark, sf)).select("id", "type")


@query("SELECT (1000 + n_nationkey)::BIGINT AS id, lower(n_name) || '|u ' || lower(n_name) AS names FROM nation")
def j5_fil7_agg5_names(spark, sf):
    return enrich.area_names(_names(spark, sf)).select("id", F.array_join("names", "|").alias("names"))


@query("SELECT r_regionkey::BIGINT AS id, 'eng|fra' AS languages FROM region")
def j6_fil8_fil11_languages(spark, sf):
    return enrich.spoken_languages(_props(spark, sf)).select("id", F.array_join(enrich.known_languages(F.col("languages")), "|").alias("languages"))


#: Stripes half a hundredth of a degree further east than the points' own grid and latitudes halved: no cell centre falls on the other side of an edge.
@query(f"SELECT id, coalesce(if(n_nationkey % 10 = 9, '', lower(n_name) || '|u ' || lower(n_name)), '') AS admins, 'eng|fra' AS languages FROM ({_POINTS}) LEFT JOIN ({_STRIPES}) ON lng > west + 0.005 AND lng < east + 0.005")
def j7_j8_agg6_enriched(spark, sf):
    points = _nodes(spark, sf).selectExpr("id", "lat / 2 AS lat", "lng")
    got = enrich.with_areas(points, _polygons(spark, sf, 0.005), _place(spark, sf), _names(spark, sf), _props(spark, sf), [0, 1], step=5.0)
    return got.select("id", F.array_join("admins", "|").alias("admins"), F.array_join("languages", "|").alias("languages"))


#: Triangles with a rectangular hole each, in hundredths of degrees, so that points on edges are exact: east of the hypotenuse and strictly in the hole is outside.
_X, _Y = "(p_partkey * 91) % 36000 - 18000", "(p_partkey * 37) % 17000 - 8500"


@query(f"SELECT p_partkey AS id, (1000 + n_nationkey)::VARCHAR AS area FROM part, LATERAL (SELECT n_nationkey, {_X} - (n_nationkey * 1440 - 18000) AS x, {_Y} + 8500 AS y FROM nation) WHERE x >= 0 AND y >= 0 AND x * 17000 + y * 1440 <= 1440 * 17000 AND NOT (x > 200 AND x < 500 AND y > 2000 AND y < 9000)")
def j2_fn27_triangles_with_holes(spark, sf):
    p = lambda x, y: f"named_struct('x', cast(n_nationkey * 1440 - 18000 + {x} AS double), 'y', cast({y} - 8500 AS double))"
    ring = lambda *ps: "array(" + ", ".join(p(*x) for x in ps) + ")"
    outer, hole = ring((0, 0), (1440, 0), (0, 17000), (0, 0)), ring((200, 2000), (500, 2000), (500, 9000), (200, 9000), (200, 2000))
    shapes = _t(spark, sf, "nation").selectExpr("cast(1000 + n_nationkey AS string) AS id", f"array({outer}, {hole}) AS rings").withColumn("env", geo.envelope(F.col("rings")))
    points = _t(spark, sf, "part").selectExpr("p_partkey AS pid", f"cast({_X} AS double) AS x", f"cast({_Y} AS double) AS y")
    return geo.polygons_at(points, shapes, "x", "y", step=500.0).select(F.col("pid").alias("id"), F.col("id").alias("area"))


@query(f"SELECT id, area FROM (SELECT id, (1000 + n_nationkey)::VARCHAR AS area, row_number() OVER (PARTITION BY id ORDER BY (1000 + n_nationkey)::VARCHAR) AS r FROM ({_POINTS}) JOIN ({_STRIPES}) ON lng BETWEEN west AND east AND lat BETWEEN -85 AND 85) WHERE r = 1")
def top3_first_polygon(spark, sf):
    """Of each point one polygon at most: points on an edge lie in two."""
    points = _nodes(spark, sf).select(F.col("id").alias("pid"), "lat", "lng")
    got = PolygonIndex(_polygons(spark, sf).where("id >= 1000")).at(points, "lng", "lat", step=5.0, most=1, key="pid")
    return got.select(F.col("pid").alias("id"), F.col("id").alias("area"))


@query("SELECT count(*) AS n, false AS empty FROM nation")
def agg12_src13_polygon_index(spark, sf):
    path = _folder(spark)
    PolygonIndex.load_or_build(spark, path, lambda: _polygons(spark, sf).where("id >= 1000"))
    saved = PolygonIndex.load_or_build(spark, path, lambda: 1 / 0)
    return spark.createDataFrame([(len(saved), saved.is_empty())], "n long, empty boolean")


@query("SELECT 2 * p_partkey AS doc_id, p_name AS content FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 2 * l_orderkey + 1, 'order ' || l_orderkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(p_partkey) > 0 OR l_orderkey % 97 = 0")
def snk2_fn13_place_keys(spark, sf):
    """Nodes and ways share numbers: each is a place of its own."""
    found = osm.pois(osm.elements(_nodes(spark, sf), _ways(spark, sf)))
    return found.select(F.col("poi_id").alias("doc_id"), F.col("names")[0].alias("content"))


@query("SELECT 1::BIGINT AS rank, (2 * min(l_orderkey) + 1)::BIGINT AS doc_id FROM lineitem JOIN part ON l_orderkey = p_partkey")
def snk8_search_after_reimport(spark, sf):
    """A way that has a node's number, found by its own name in an index that was written twice."""
    found = osm.pois(osm.elements(_nodes(spark, sf), _ways(spark, sf))).select(F.col("poi_id").alias("doc_id"), F.slice("names", 1, 1).alias("content"), F.array().cast("array<string>").alias("indexed_tag"), F.col("poi_id").alias("s2key"))
    index = PlaceIndex.create(spark, _folder(spark))
    index.write(found)
    index.write(found)
    shared = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_orderkey") == F.col("p_partkey")).agg(F.min("l_orderkey")).first()[0]
    best = search.ranked(index.postings, index.tag_postings, index.pois, [Request(1, f"order {shared} ")], 1, vocab=index.vocabulary())
    return best.select(F.col("rank").cast("long").alias("rank"), "doc_id")


@query("SELECT v AS text, CASE WHEN regexp_matches(v, '^\\+?[0-9]+$') THEN try_cast(v AS BIGINT) END AS id FROM (SELECT DISTINCT if(p_partkey % 2 = 0, p_partkey::VARCHAR, p_name) AS v FROM part)")
def fn25_parse_id(spark, sf):
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name"))
    return _t(spark, sf, "part").select(v.alias("text")).distinct().select("text", text.parse_id(F.col("text")).alias("id"))


# ---- search --------------------------------------------------------------------------

_POST = r"tok AS (SELECT p_partkey AS doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') AS w FROM part)), v AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM part)"
_IDF = "ln(1 + ((SELECT n FROM n) - {0} + 0.5) / ({0} + 0.5))"
_DOC_POST = rf"tok AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents), v AS (SELECT term, count(*) AS df FROM tok GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents)"


def _hits(spark, sf, requests, docs=False) -> DataFrame:
    """Places that meet all Must clauses, with their score."""
    if docs:
        post, tags = postings(_doc_rows(spark, sf)), spark.createDataFrame([], "tag string, doc_id long")
        n = _t(spark, sf, "documents").count()
    else:
        pois = _parts(spark, sf)
        post, tags, n = postings(pois), tag_postings(pois), pois.count()
    got = search.must_hits(requests, post, tags, vocabulary(post), F.lit(float(n)))
    return got.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {_POST} SELECT 1::BIGINT AS query_id, doc_id, round({1.05**5} * {_IDF.format('df')}, 4) AS score FROM (SELECT DISTINCT doc_id, term FROM tok) JOIN v USING (term) WHERE term = 'small'")
def qry5_exact(spark, sf):
    return _hits(spark, sf, [Request(1, "small")])


@query(f"WITH {_POST} SELECT DISTINCT 2::BIGINT AS query_id, doc_id, round({1.05**2}, 4) AS score FROM tok WHERE starts_with(term, 'ri')")
def qry6_prefix(spark, sf):
    return _hits(spark, sf, [Request(2, "ri", lenient=True)])


@query(f"WITH {_DOC_POST} SELECT DISTINCT 4::BIGINT AS query_id, doc_id, round({1.05**9 + 1.05**3}, 4) AS score FROM tok WHERE damerau_levenshtein(term, 'worhtless') <= 1 AND doc_id IN (SELECT doc_id FROM tok WHERE starts_with(term, 'the'))")
def qry4_fuzzy(spark, sf):
    return _hits(spark, sf, [Request(4, "worhtless the", lenient=True)], docs=True)


@query(f"WITH {_DOC_POST} SELECT DISTINCT 3::BIGINT AS query_id, doc_id, round({1.05**8}, 4) AS score FROM tok WHERE damerau_levenshtein(left(term, 7), 'thintino') <= 1 OR damerau_levenshtein(left(term, 8), 'thintino') <= 1 OR damerau_levenshtein(left(term, 9), 'thintino') <= 1")
def qry3_fuzzy_prefix(spark, sf):
    return _hits(spark, sf, [Request(3, "thintino", lenient=True)], docs=True)


@query("SELECT 7::BIGINT AS query_id, p_partkey AS doc_id, round(%s + %s, 4) AS score FROM part, (SELECT count(*)::DOUBLE AS n, count(*) FILTER (p_brand = 'Brand#13') AS b, count(*) FILTER (p_partkey %% 5 = 0) AS d FROM part) WHERE p_brand = 'Brand#13' AND p_partkey %% 5 = 0" % ("ln(1 + (n - b + 0.5) / (b + 0.5))", "ln(1 + (n - d + 0.5) / (d + 0.5))"))
def qry7_fil13_tags(spark, sf):
    return _hits(spark, sf, [Request(7, "", tags=("shop=Brand#13", "diet:vegan=yes"))])


def _phrases(spark, sf, request) -> DataFrame:
    pois = _parts(spark, sf)
    post = postings(pois)
    table = search.clause_table(spark, [request]).where("not must")
    got = search.phrase_hits(table, post, vocabulary(post), F.lit(float(pois.count())))
    return got.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {_POST} SELECT 8::BIGINT AS query_id, a.doc_id, round({1.05**10} * ({_IDF.format('va.df')} + {_IDF.format('vb.df')}), 4) AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN v va ON va.term = a.term JOIN v vb ON vb.term = b.term WHERE a.term = 'small' AND b.term = 'ring'")
def qry2_phrase(spark, sf):
    return _phrases(spark, sf, Request(8, "small ring", remote=True))


@query(f"WITH {_POST} SELECT 9::BIGINT AS query_id, a.doc_id, round({1.05**7} * {_IDF.format('va.df')}, 4) AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN v va ON va.term = a.term WHERE a.term = 'small' AND starts_with(b.term, 'r')")
def qry1_phrase_prefix(spark, sf):
    return _phrases(spark, sf, Request(9, "small r"))


def _ranked(spark, sf, requests, top=10) -> DataFrame:
    parts = _parts(spark, sf)
    pois = _placed(spark, sf) if any(r.box for r in requests) else parts
    got = search.ranked(postings(parts), tag_postings(parts), pois, requests, top)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def _search_sql(query_id: int, first: str, prefix: str, among: str = "SELECT p_partkey FROM part", top: int = 10) -> str:
    """Must: first exactly, prefix as a prefix; Should: both as a phrase prefix."""
    b1, b2, b3 = (text.boost_of(x) for x in (first, prefix, f"{first} {prefix}"))
    return f"""SELECT {query_id}::BIGINT AS query_id, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank, doc_id, round(s, 4) AS score FROM (
    SELECT a.doc_id, {b1} * {_IDF.format('va.df')} + {b2} + coalesce(max(CASE WHEN starts_with(p.term, '{prefix}') THEN {b3} * {_IDF.format('va.df')} END), 0) AS s
    FROM tok a JOIN v va ON va.term = a.term JOIN (SELECT DISTINCT doc_id FROM tok WHERE starts_with(term, '{prefix}')) b ON a.doc_id = b.doc_id LEFT JOIN tok p ON p.doc_id = a.doc_id AND p.pos = a.pos + 1
    WHERE a.term = '{first}' AND a.doc_id IN ({among}) GROUP BY a.doc_id, va.df) QUALIFY rank <= {top}"""


@query(f"WITH {_POST} {_search_sql(1, 'small', 'ri')}")
def qry8_top1_search(spark, sf):
    return _ranked(spark, sf, [Request(1, "small ri", lenient=True)])


@query(f"WITH {_POST}, cells AS ({_LEVEL12}) {_search_sql(2, 'large', 'bo', f'SELECT id FROM cells WHERE {_in_cells(chr(99))}')}")
def qry9_search_box(spark, sf):
    return _ranked(spark, sf, [Request(2, "large bo", lenient=True, box=_BOX)])


_BATCH = [("small", "ri"), ("red", "wi"), ("old", "ge"), ("blue", "an"), ("hot", "ro")]


@query(f"WITH {_POST} " + " UNION ALL ".join(f"(SELECT * FROM ({_search_sql(i, a, b)}))" for i, (a, b) in enumerate(_BATCH)))
def top1_batch_search(spark, sf):
    return _ranked(spark, sf, [Request(i, f"{a} {b}", lenient=True) for i, (a, b) in enumerate(_BATCH)])


@query("SELECT 'small ri' AS q, clause_id, kind, terms, must FROM (VALUES (0, 'exact', 'small', true), (1, 'phrase_prefix', 'small ri', false), (2, 'prefix', 'ri', true)) t(clause_id, kind, terms, must)")
def qry10_fn1_clauses(spark, sf):
    rows = [("small ri", c.clause_id, c.kind, " ".join(c.terms), c.must) for c in clauses(parse_request(0, " Small RI", leniency=True))]
    return spark.createDataFrame(rows, "q string, clause_id int, kind string, terms string, must boolean")


# ---- tables ------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A new folder for index tables, in the shared folder if there is one; deleted when the program ends, as results are read from it until then."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "placeloom")
    home = f"{base}/index-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, home)
    return f"{home}/index"


def _remove(spark, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended before us
        return


@query("SELECT p_partkey AS doc_id, p_name AS content, p_brand AS shop FROM part")
def snk1_3_src10_round_trip(spark, sf):
    index = PlaceIndex.create(spark, _folder(spark))
    index.write(_pois(spark, sf))
    return PlaceIndex.open(spark, index.path).pois.select("doc_id", F.array_join("content", "|").alias("content"), F.col("tags")["shop"].alias("shop"))


@query("SELECT p_partkey AS doc_id, p_name AS content, 1::BIGINT AS n FROM part")
def snk4_snk8_append_compact(spark, sf):
    index = PlaceIndex.create(spark, _folder(spark))
    rows = _pois(spark, sf)
    index.write(rows.where("doc_id % 2 = 0"))
    index.write(rows)
    index.write(rows)
    return index.compact().pois.groupBy("doc_id", F.array_join("content", "|").alias("content")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM part")
def agg4_count(spark, sf):
    index = PlaceIndex.create(spark, _folder(spark))
    index.write(_pois(spark, sf))
    return spark.createDataFrame([(index.count(),)], "n long")


@query(f"WITH {_POST} SELECT row_number() OVER (ORDER BY rank) AS rank, round({SQL_LAT.format(k='doc_id')}, 4) + 0.0 AS lat, round({SQL_LNG.format(k='doc_id')}, 4) + 0.0 AS lng, p_name AS name FROM ({_search_sql(1, 'small', 'ri')}) JOIN part ON p_partkey = doc_id")
def j10_prj3_results(spark, sf):
    parts, pois = _parts(spark, sf), _placed(spark, sf)
    best = search.ranked(postings(parts), tag_postings(parts), parts, [Request(1, "small ri", lenient=True)])
    got = search.results(best, pois)
    return got.select(F.col("rank").cast("long").alias("rank"), (F.round("lat", 4) + 0.0).alias("lat"), (F.when(F.round("lng", 4) == 180, -180.0).otherwise(F.round("lng", 4)) + 0.0).alias("lng"), F.col("tags")["name"].alias("name"))



def entry(spark: SparkSession) -> DataFrame:
    return j10_prj3_results(spark, "/root/testdata/sf0.001")
