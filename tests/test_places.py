import json
import math
import random
import sqlite3
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom import api, queries
from placeloom.functions import geo, roads, s2, text
from placeloom.operators import index as search_index
from placeloom.operators.index import PlaceIndex
from placeloom.plans import clauses as C
from placeloom.plans.covering import bounds, children, covering, normalized
from placeloom.sources import admin, pbf, tables
from placeloom.streaming.ingest import ingest

#: Published cells (id, latitude, longitude).
VECTORS = [
    (0x47A1CBD595522B39, 49.703498679, 11.770681595), (0x46525318B63BE0F9, 55.685376759, 12.588490937), (0x52B30B71698E729D, 45.486546517, -93.449700022), (0x46ED8886CFADDA85, 58.299984854, 23.049300056),
    (0x3663F18A24CBE857, 34.364439040, 108.330699969), (0x010A06C0A948CF5D, -30.694551352, -30.048758753), (0x2B2BFD076787C5DF, -25.285264027, 133.823116966), (0xB09DFF882A7809E1, -75.000000031, 0.000000133),
]


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_published_cells(spark):
    df = spark.createDataFrame([(signed(i), a, b) for i, a, b in VECTORS], "id long, lat double, lng double")
    got = s2.with_center(s2.with_cell(df, "lat", "lng", "cell"), "id", "lat2", "lng2").withColumn("up", s2.parent(F.col("id"), 15)).withColumn("level", s2.level(F.col("up"))).collect()
    for r in got:
        # the printed coordinates have nine decimals, a leaf is about a centimetre wide
        assert abs(r.cell - r.id) < 1 << 12 and abs(r.lat2 - r.lat) < 1e-8 and abs(r.lng2 - r.lng) < 1e-8 and r.level == 15


def test_centre_of_a_parent_has_that_parent(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(300)], "lat double, lng double")
    for level in (0, 3, 15, 29):
        up = s2.with_cell(df, "lat", "lng", "leaf").select(s2.parent(F.col("leaf"), level).alias("up"))
        again = s2.with_cell(s2.with_center(up, "up", "lat", "lng"), "lat", "lng", "leaf").where(s2.parent(F.col("leaf"), level) != F.col("up"))
        assert again.count() == 0


def test_coverings_hold_their_boxes(spark):
    r = random.Random(2)
    for _ in range(6):
        w, s = r.uniform(-170, 150), r.uniform(-80, 70)
        box = C.Box(w, s, w + 10 ** r.uniform(-2, 1.3), s + 10 ** r.uniform(-2, 1))
        cells = covering(box)
        assert 0 < len(cells) <= 64
        pts = [(r.uniform(box.min_lat, box.max_lat), r.uniform(box.min_lng, box.max_lng)) for _ in range(200)]
        leaves = s2.with_cell(spark.createDataFrame(pts, "lat double, lng double"), "lat", "lng", "c")
        held = leaves.where(F.arrays_overlap(s2.ancestors(F.col("c")), F.array(*map(F.lit, cells))))
        assert held.count() == 200


def test_normalized():
    face = 1 << 60
    assert normalized(children(face)) == [face]
    assert normalized([face, children(face)[2]]) == [face]
    lo, hi, west, east = bounds((2 << 61) | face)
    assert hi == 90 and (west, east) == (-180, 180) and lo < 36


def test_box_and_clauses():
    assert C.parse_box("3,4,1,2,9") == C.Box(1, 2, 3, 4)
    assert C.parse_box("1,2,x,4") is None and C.parse_box("1,2") is None and C.parse_box(None) is None
    kinds = lambda q, **k: [(c.kind, " ".join(c.terms)) for c in C.clauses(C.Request(0, q, **k))]
    assert kinds("o'hare 3.5") == [("exact", "o'hare"), ("phrase_prefix", "o'hare 3.5"), ("exact", "3.5")]
    assert kinds("fremont avenue", lenient=True)[0] == ("prefix", "fremont") or kinds("fremont avenue", lenient=True)[0] == ("exact", "fremont")
    assert kinds("restaurant museums", lenient=True) == [("fuzzy", "restaurant"), ("phrase_prefix", "restaurant museums"), ("prefix", "museums")]
    assert kinds("museum restaurant", lenient=True)[-1] == ("fuzzy_prefix", "restaurant")
    assert kinds("a b", remote=True)[1] == ("phrase", "a b") and kinds("- !") == [] and kinds("x", tags=("a=b",))[-1] == ("tag", "a=b")
    assert text.boost_of("a b") == pytest.approx(3 * 1.05**3) and text.boost_of("abc") == pytest.approx(1.05**3) and text.boost_of("12") == pytest.approx(3 * 1.05**2)
    r = C.parse_request(1, "  Café's ", "a=b,c=d", None, "1,2,3,4")
    assert (r.q, r.tags, r.lenient) == ("cafe's", ("a=b", "c=d"), False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=3), max_size=6))
def test_runs(tokens):
    n = len(tokens)
    assert len(text.runs(tokens)) == n * (n + 1) // 2


def test_roads(spark):
    subs = roads.parse_lines(["a|b", "b|c|b", "x"])
    assert subs == {"a": ["a", "b"], "b": ["a", "b", "c"], "c": ["b", "c", "b"], "x": ["x"]}
    df = spark.createDataFrame([("b  Ä", "t"), ("q", "none"), ("", "t"), (None, "t")], "road string, lang string")
    m = roads.subs_map({"t": subs})
    got = [r.p for r in df.select(roads.permute_road(F.col("road"), F.try_element_at(m, F.col("lang"))).alias("p")).collect()]
    assert got[0] == [f"{x} {y}" for x in ("b", "a", "b", "c") for y in ("a", "a", "b")] and got[1] == ["q"] and got[2] == [""]


def test_geometry(spark):
    square = "array(array(struct(0D x, 0D y), struct(4D x, 0D y), struct(4D x, 4D y), struct(0D x, 4D y), struct(0D x, 0D y)), array(struct(1D x, 1D y), struct(2D x, 1D y), struct(2D x, 2D y), struct(1D x, 2D y), struct(1D x, 1D y)))".replace("0D x", "0D AS x")
    import re

    square = re.sub(r"(\d)D (AS )?([xy])", r"\1D AS \3", square)
    pts = [(3.0, 3.0, True), (4.0, 2.0, True), (0.0, 0.0, True), (1.5, 1.5, False), (5.0, 2.0, False), (1.0, 1.5, True)]
    df = spark.createDataFrame(pts, "x double, y double, inside boolean").withColumn("rings", F.expr(square))
    assert all(r.inside == r.got for r in df.select("inside", geo.in_polygon(F.col("x"), F.col("y"), F.col("rings")).alias("got")).collect())
    shapes = {"[(0,0),(2,0),(2,2),(0,2)]": (1, 1), "[(0,0),(2,0)]": (1, 0), "[(3,4)]": (3, 4), "[(5,5),(5,5)]": (5, 5), "[(0,0),(4,0),(4,0)]": (2, 0)}
    rows = [([{"x": float(x), "y": float(y)} for x, y in eval(k)], [float(v) for v in want]) for k, want in shapes.items()]
    df = spark.createDataFrame(rows, "points array<struct<x:double,y:double>>, want array<double>").withColumn("c", geo.centroid(F.col("points")))
    assert all((r.c.x, r.c.y) == pytest.approx(tuple(r.want)) for r in df.collect())
    assert spark.sql("SELECT cast(array() AS array<struct<x:double,y:double>>) AS points").select(geo.centroid(F.col("points")).alias("c")).first().c is None


def test_centroid_of_a_long_way(spark, tmp_path):
    r = random.Random(4)
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(1, i, r.randrange(2000), 1) for i in range(10_500)] + [(2, i, k, 1) for i, k in enumerate((1, 500, 1200))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.id: (r.lat, r.lng) for r in queries.fn11_agg11_centroid(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2}
    for way in got:
        pts = [((k * 37) % 17000 / 100 - 85, (k * 91) % 36000 / 100 - 180) for w, _, k, _ in lines if w == way]
        (x0, y0), area, ax, ay = pts[0], 0.0, 0.0, 0.0
        for (x, y), (u, v) in zip(pts, [*pts[1:], pts[0]], strict=True):
            c = (x - x0) * (v - y0) - (u - x0) * (y - y0)
            area, ax, ay = area + c, ax + (x + u - 2 * x0) * c, ay + (y + v - 2 * y0) * c
        assert abs(area) > 1 and got[way] == pytest.approx((x0 + ax / (3 * area), y0 + ay / (3 * area)), abs=2e-3)


# ---- sources -----------------------------------------------------------------------


def number(n):
    out = b""
    while True:
        out += bytes([(n & 127) | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(k, v):
    return number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v


def zig(n):
    return (n << 1) ^ (n >> 63) if n < 0 else n << 1


def deltas(values):
    return b"".join(number(zig(b - a)) for a, b in zip([0, *values], values, strict=False))


def extract(path):
    strings = ["", "name", "Café", "building", "yes", "shop"]
    table = b"".join(field(1, s.encode()) for s in strings)
    dense = field(1, deltas([10, 11, 12])) + field(8, deltas([10_000_000, 10_000_000, 20_000_000])) + field(9, deltas([0, 20_000_000, 20_000_000])) + field(10, b"".join(map(number, [1, 2, 5, 4, 0, 0, 0])))
    node = field(1, zig(13)) + field(2, number(1)) + field(3, number(2)) + field(8, zig(-50_000_000)) + field(9, zig(-70_000_000))
    way = field(1, 99) + field(2, number(3) + number(1)) + field(3, number(4) + number(2)) + field(8, deltas([10, 11, 12, 77]))
    data = field(1, table) + field(2, field(2, dense)) + field(2, field(1, node)) + field(2, field(3, way)) + field(2, field(4, field(1, 5)))
    with open(path, "wb") as f:
        for kind, body in (("OSMHeader", field(1, b"x")), ("OSMData", field(2, len(data)) + field(3, zlib.compress(data))), ("OSMData", field(1, field(1, table)))):
            head = field(1, kind.encode()) + field(3, len(body))
            f.write(struct.pack(">I", len(head)) + head + body)


def areas_file(path):
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE place(source, id, class, type); CREATE TABLE name(source, id, lang, tag, abbr, name); CREATE TABLE property(source, id, key, value); CREATE TABLE shard(source, id, geom)")
    ring = [(-1.0, -1.0), (3.0, -1.0), (3.0, 3.0), (-1.0, 3.0), (-1.0, -1.0)]
    wkb = struct.pack("<BIII", 1, 3, 1, 5) + struct.pack("<10d", *(c for p in ring for c in p))
    point = struct.pack("<BIdd", 1, 1, 0.0, 0.0)
    db.executemany("INSERT INTO place VALUES (?,?,?,?)", [("wof", "7", "a", "region"), ("wof", "1", "a", "country"), ("wof", "8", "a", "county")])
    db.executemany("INSERT INTO shard VALUES (?,?,?)", [("wof", i, wkb) for i in "718"] + [("wof", "7", point)])
    db.executemany("INSERT INTO name VALUES (?,?,?,?,?,?)", [("wof", 7, "eng", "preferred", None, "Málaga"), ("wof", 1, "eng", "preferred", None, "Country"), ("wof", 7, "xyz", "preferred", None, "no")])
    db.execute("INSERT INTO property VALUES ('wof', 1, 'wof:lang_x_spoken', 'eng,cat')")
    db.commit()
    db.close()


def test_build_and_search(spark, tmp_path):
    extract(tmp_path / "x.pbf")
    areas_file(tmp_path / "a.db")
    nodes, ways = (pbf.read_pbf(spark, str(tmp_path / "x.pbf"), k) for k in ("nodes", "ways"))
    assert [(r.id, round(r.lat, 6), round(r.lng, 6), r.tags, r.dense) for r in nodes.orderBy("id").collect()] == [(10, 1.0, 0.0, {"name": "Café", "shop": "yes"}, True), (11, 1.0, 2.0, {}, True), (12, 2.0, 2.0, {}, True), (13, -5.0, -7.0, {"name": "Café"}, False)]
    assert ways.first().refs == [10, 11, 12, 77]
    t = {k: admin.read_table(spark, str(tmp_path / "a.db"), k) for k in ("place", "name", "property")}
    polygons = admin.read_polygons(spark, str(tmp_path / "a.db"))
    assert polygons.count() == 3
    index = api.build_index(spark, str(tmp_path / "index"), nodes, ways, t["place"], polygons, t["name"], t["property"], [1], roads.SAMPLE)
    rows = {r.doc_id: r for r in index.pois.collect()}
    assert rows.keys() == {20, 26, 199}
    assert rows[20].content == ["Café", "malaga"] and rows[26].content == ["Café"] and rows[20].indexed_tag == ["shop=yes"]
    assert [r.doc_id for r in index.postings.where("term = 'malaga'").orderBy("doc_id").collect()] == [20, 199]
    got = json.loads(api.respond(index, "Malaga"))
    assert len(got["features"]) == 2 and got["features"][0]["s2cell"] > 0 and got["metadata"]["query"]["q"] == "Malaga"
    assert len(json.loads(api.respond(index, "mal", leniency=True, bbox="-1,0.5,1,1.5"))["features"]) == 1
    assert len(json.loads(api.respond(index, "malaga", tags="shop=yes"))["features"]) == 1
    assert json.loads(api.respond(index, "nothing here"))["features"] == [] and json.loads(api.respond(index, ""))["features"] == []
    assert PlaceIndex.open(spark, index.compact(str(tmp_path / "small")).path).count() == 3


def test_saved_tables(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(Exception, match="without a location: 2"):
        tables.require_locations(nodes, spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lng double")).collect()


def test_stream_appends(spark, tmp_path):
    rows = lambda df: df.select(F.col("id").alias("doc_id"), F.array(F.col("tags")["name"]).alias("content"), F.array().cast("array<string>").alias("indexed_tag"), F.col("id").alias("s2key"))
    index = PlaceIndex.create(spark, str(tmp_path / "index"))
    for i in range(2):
        spark.createDataFrame([(i, 0.0, 0.0, {"name": f"n{i}"})], "id long, lat double, lng double, tags map<string,string>").write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), index, str(tmp_path / "state"), rows).awaitTermination()
    assert sorted(r.term for r in index.postings.collect()) == ["n0", "n1"]


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.Q[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = sorted(got.columns)
    show = lambda v: "none" if v is None or v is pd.NA or v != v else str(round(v, 4) + 0.0) if isinstance(v, float) else str(v)
    whole = lambda v: float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v  # noqa: E731  nullable integers come as floats
    flat = lambda df: sorted(tuple(show(whole(v)) for v in r) for r in df[key].astype(object).itertuples(index=False))
    assert flat(got) == flat(want)


def test_scripts_fold(spark):
    words = {"Москва": "Moskva", "Щука Юг": "Shchuka Iug", "Αθήνα": "Athena", "Ψυχή Ωμέγα": "Psukhe Omega", "Café Ж": "Cafe Zh", "東京 مكة": "東京 مكة", "plain": "plain"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.f for r in df.select("w", text.fold("w").alias("f")).collect()} == words
    assert all(text.fold_text(w) == f for w, f in words.items())


def test_service_and_remote(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    rows = spark.createDataFrame([(1, ["red mill"], ["shop=a"], 0, "osm", {"name": "red mill"})], "doc_id long, content array<string>, indexed_tag array<string>, s2key long, source string, tags map<string,string>")
    rows = rows.withColumn("s2cell", F.lit(s2.from_lat_lng(1.0, 2.0)).cast("long") if hasattr(s2, "from_lat_lng") else F.lit(1152921504606846977)).withColumn("s2cell_parents", F.array("s2cell"))
    index = PlaceIndex.create(spark, str(tmp_path / "index"))
    index.write(rows)
    server = api.serve(index, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda q: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{q}")
    got = ask("/search?q=red%20mi&leniency=true")
    assert got.headers["Access-Control-Allow-Origin"] == "*" and len(json.loads(got.read())["features"]) == 1
    for path, status in (("/search?tags=a", 500), ("/search?q=a&leniency=maybe", 500), ("/else", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path)
        assert e.value.code == status
    server.shutdown()
    assert not index.remote and PlaceIndex(spark, "s3a://bucket/index").remote and PlaceIndex(spark, "https://host/index").remote
    far = PlaceIndex(spark, index.path)
    far.__class__ = type("Far", (PlaceIndex,), {"remote": True})
    assert api.search(far, "red mi", lenient=True).count() == 0 and api.search(far, "red mill", lenient=True).count() == 1


def test_expansions(spark):
    """The last word of a phrase stands for the first terms only; None takes all."""
    from placeloom.operators import search

    pois = spark.createDataFrame([(i, [f"red m{i:02d}"], []) for i in range(60)], "doc_id long, content array<string>, indexed_tag array<string>")
    post = search_index.postings(pois)
    table = search.clause_table(spark, [C.Request(1, "red m")]).where("not must")
    n = F.lit(60.0)
    for most, count in ((50, 50), (7, 7), (None, 60)):
        assert search.phrase_hits(table, post, search_index.vocabulary(post), n, None, most).count() == count
