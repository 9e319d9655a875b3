"""The public surface: build an index, search it, answer service requests as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from .functions.roads import parse_lines, subs_map
from .operators import enrich, osm
from .operators.index import PlaceIndex
from .operators.search import EXPANSIONS, ranked, results
from .plans.clauses import Request, parse_request


def build_index(spark: SparkSession, path: str, nodes: DataFrame, ways: DataFrame, place: DataFrame, polygons: DataFrame, name: DataFrame, prop: DataFrame, countries: list[int], dictionaries: dict[str, list[str]], source: str = "osm", ignore: tuple[str, ...] = (), exact: bool = True) -> PlaceIndex:
    """Elements to an index: places, their areas and languages, road spellings, tables. dictionaries: lang -> lines."""
    found = osm.pois(osm.elements(nodes, ways, ignore), source)
    known = enrich.with_areas(found, polygons, place, name, prop, countries, exact)
    index = PlaceIndex.create(spark, path)
    index.write(osm.index_rows(known, subs_map({k: parse_lines(v) for k, v in dictionaries.items()})))
    return index


def search_batch(index: PlaceIndex, requests: Sequence[Request], top: int = 10, exact_box: bool = False, regions: Sequence = (), expansions: int | None = EXPANSIONS) -> DataFrame:
    """Result rows of many requests in one plan. A remote index is asked for whole words and phrases. regions (factors for boxes) are taken and change nothing."""
    requests = [replace(r, remote=r.remote or index.remote) for r in requests]
    return results(ranked(index.postings, index.tag_postings, index.pois, requests, top, exact_box, index.vocabulary(), expansions), index.pois)


def search(index: PlaceIndex, q: str, lenient: bool = False, tags: str | None = None, bbox: str | None = None) -> DataFrame:
    """Result rows of one request as the service reads it."""
    return search_batch(index, [parse_request(0, q, tags, lenient, bbox)])


def respond(index: PlaceIndex, q: str, tags: str | None = None, leniency: bool | None = None, bbox: str | None = None) -> str:
    """The service's JSON: metadata with the query, and features without scores; cell ids are unsigned, tags are pairs."""
    rows = search(index, q, bool(leniency), tags, bbox).collect()  # at most ten
    features = [{"source": r.source, "admins": r.admins, "s2cell": r.s2cell % (1 << 64), "lat": r.lat, "lng": r.lng, "tags": sorted(map(list, r.tags.items()))} for r in rows]
    return json.dumps({"metadata": {"query": {"q": q, "tags": tags, "leniency": leniency, "bbox": bbox}}, "features": features}, ensure_ascii=False)


def handler(index: PlaceIndex) -> type[BaseHTTPRequestHandler]:
    """Answers ``GET /search?q=&tags=&leniency=&bbox=`` with respond()'s JSON, any error with status 500 and its text, other paths with 404; any origin may read."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            asked = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            status, kind = 200, "application/json"
            if url.path != "/search":
                status, kind, body = 404, "text/plain", "not found"
            else:
                try:
                    body = respond(index, asked["q"], asked.get("tags"), {"true": True, "false": False, None: None}[asked.get("leniency")], asked.get("bbox"))
                except Exception as e:  # noqa: BLE001  the service maps every error to one status
                    status, kind, body = 500, "text/plain", f"{type(e).__name__}: {e}"
            data = body.encode()
            self.send_response(status)
            for name, value in (("Content-Type", f"{kind}; charset=utf-8"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(data)))):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(index: PlaceIndex, host: str = "127.0.0.1", port: int = 3000) -> ThreadingHTTPServer:
    """A server that is bound and not yet running: call serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(index))
