"""Commands: build an index from an extract and an area database, query it, compact it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .functions.roads import LANGUAGES, SAMPLE, read_dictionaries
from .operators.index import PlaceIndex
from .sources import admin, pbf


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="placeloom")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("--areas", required=True, help="SQLite file of administrative areas")
    build.add_argument("--index", required=True)
    build.add_argument("--dictionaries", help="folder with <language>/street_types.txt")
    build.add_argument("--countries", default="", help="comma list of country ids")
    build.add_argument("--ignore", action="append", default=[], choices=["nodes", "dense_nodes", "ways"])
    build.add_argument("--envelopes", action="store_true", help="areas by envelope, not by polygon")
    build.add_argument("--source", default="osm")
    build.add_argument("extract")
    query = sub.add_parser("query")
    query.add_argument("--index", required=True)
    query.add_argument("--bbox")
    query.add_argument("--tags")
    query.add_argument("q", nargs="?", help="without it, a query is read from each line of the input until an empty one")
    serve = sub.add_parser("serve")
    serve.add_argument("--index", required=True)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=3000)
    compact = sub.add_parser("compact")
    compact.add_argument("--index", required=True)
    compact.add_argument("--to")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("placeloom").getOrCreate()
    if a.command == "build":
        lines: dict[str, list[str]] = dict(SAMPLE)
        if a.dictionaries:
            lines = {lang: [] for lang in LANGUAGES}
            for r in read_dictionaries(spark, a.dictionaries).orderBy("lang", "line_no").collect():  # a few hundred lines a language
                lines[r.lang].append(r.line)
        tables = {t: admin.read_table(spark, a.areas, t) for t in ("place", "name", "property")}
        nodes, ways = (pbf.read_pbf(spark, a.extract, k) for k in ("nodes", "ways"))
        api.build_index(spark, a.index, nodes, ways, tables["place"], admin.read_polygons(spark, a.areas), tables["name"], tables["property"], [int(c) for c in a.countries.split(",") if c], lines, a.source, tuple(a.ignore), not a.envelopes)
    elif a.command == "query":
        index = PlaceIndex.open(spark, a.index)
        for q in [a.q] if a.q is not None else iter(lambda: sys.stdin.readline().strip(), ""):
            print(api.respond(index, q, a.tags, True, a.bbox), flush=True)
    elif a.command == "serve":
        api.serve(PlaceIndex.open(spark, a.index), a.host, a.port).serve_forever()
    else:
        print(PlaceIndex.open(spark, a.index).compact(a.to).path)


if __name__ == "__main__":
    main()
