"""The engine over HTTP: queries and updates, uploads, tasks and accounts.

``Api.handle`` answers a request given as plain values, so it can stand behind any server;
``serve`` puts it behind the one of the standard library.  Signing in at providers is not here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import QUAD, QUADS_DDL
from .plans.sparql import Engine
from .plans.sparql.parser import SparqlError
from .plans.updates import apply_update
from .sources import rdf
from .sources.files import parse_file
from .streaming.store import KnowledgeBase

CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Accept, Content-Type"}
#: Media types by the form of a query, the first one being the default.
SOLUTIONS = {"application/sparql-results+json": rdf.json_chunks, "application/json": rdf.json_chunks, "application/sparql-results+xml": rdf.xml_chunks, "text/csv": None, "text/tab-separated-values": None}
BOOLEANS = {"application/sparql-results+json": "json", "application/json": "json", "application/sparql-results+xml": "xml", "text/boolean": "text"}
TRIPLES = {"application/n-triples": None, "text/plain": None, "text/turtle": None}


@dataclass
class Response:
    status: int
    kind: str = "text/plain"
    body: Iterator[str] | tuple = ()


def accepted(accept: str | None, offered: dict) -> str | None:
    """The offered media type that a request likes best, None if it likes none."""
    if not accept:
        return next(iter(offered))
    wishes = []
    for part in accept.split(","):
        kind, *parameters = (x.strip() for x in part.split(";"))
        weight = next((float(p[2:]) for p in parameters if p.startswith("q=")), 1.0)
        wishes.append((-weight, kind.lower()))
    for _, kind in sorted(wishes, key=lambda w: w[0]):
        for own in offered:
            if kind in (own, "*/*", own.split("/")[0] + "/*"):
                return own
    return None


def table_lines(terms: DataFrame, kind: str) -> Iterator[str]:
    """CSV of plain values, or TSV of terms, line by line."""
    from .model import lexical

    def cell(x: str | None) -> str:
        if x is None:
            return ""
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\r\n') else x

    if kind == "text/csv":
        yield ",".join(terms.columns) + "\r\n"
        for row in terms.select(*[lexical(F.col(f"`{c}`")) for c in terms.columns]).toLocalIterator():
            yield ",".join(map(cell, row)) + "\r\n"
    else:
        yield "\t".join(f"?{c}" for c in terms.columns) + "\n"
        for row in terms.toLocalIterator():
            yield "\t".join(x or "" for x in row) + "\n"


class Api:
    """``base`` holds the quads; ``tasks`` and ``accounts`` give rows to list."""

    def __init__(self, base: KnowledgeBase, tasks=lambda: [], accounts=lambda: [], sources: tuple = ()):
        self.base, self.tasks, self.accounts, self.sources = base, tasks, accounts, list(sources)

    def handle(self, method: str, path: str, params: dict[str, str], kind: str = "", body: bytes = b"", accept: str | None = None) -> Response:
        if method == "OPTIONS":
            return Response(204)
        route = {"/sparql": self.sparql, "/file": self.upload, "/system-tasks": self.listed, "/data-services": self.listed}.get(path.rstrip("/"))
        if route is None:
            return Response(404, body=("unknown path",))
        try:
            return route(method, path.rstrip("/"), params, kind.partition(";")[0].strip().lower(), body, accept)
        except SparqlError as e:
            return Response(400, body=(f"Malformed query: {e}",))

    def sparql(self, method: str, path: str, params: dict[str, str], kind: str, body: bytes, accept: str | None) -> Response:
        if method == "POST" and kind == "application/x-www-form-urlencoded":
            params = {k: v[0] for k, v in parse_qs(body.decode()).items()}
        elif method == "POST" and kind in ("application/sparql-query", "application/sparql-update"):
            params = {"query" if kind.endswith("query") else "update": body.decode()}
        if "query" in params:
            return self.query(params["query"], accept)
        if "update" in params:
            return self.update(params["update"]) if method == "POST" else Response(405, body=("updates must be posted",))
        return Response(400, body=("a query or an update is needed",))

    def query(self, text: str, accept: str | None) -> Response:
        engine = Engine(self.base.quads())
        form = engine.parse(text).form
        offered = {"SELECT": SOLUTIONS, "ASK": BOOLEANS}.get(form, TRIPLES)
        kind = accepted(accept, offered)
        if kind is None:
            return Response(415, body=(f"{form} has no form that is accepted",))
        if form == "SELECT":
            terms = engine.solutions(text)
            return Response(200, kind, SOLUTIONS[kind](terms) if SOLUTIONS[kind] else table_lines(terms, kind))
        if form == "ASK":
            return Response(200, kind, (rdf.boolean_document(engine.ask(text), BOOLEANS[kind]),))
        triples = engine.construct(text) if form == "CONSTRUCT" else engine.describe(text)
        return Response(200, kind, (f"{r.s} {r.p} {r.o} .\n" for r in triples.toLocalIterator()))

    def update(self, text: str) -> Response:
        """Apply an update by way of the sources; what is stored is the difference it makes."""
        before = self.base.quads()
        diff = Engine(before).update(text)
        if diff is None:
            return Response(204)
        after, outcome = apply_update(before, diff, self.sources)
        key = list(QUAD)
        change = after.join(before, key, "left_anti").withColumn("op", F.lit(1)).unionByName(before.join(after, key, "left_anti").withColumn("op", F.lit(-1)))
        failed = outcome.where("not ok and errors <> ''").select("s", "p", "o", "g", "side", "errors")
        errors = failed.limit(101).collect()
        self.base.commit(change)
        if errors:
            return Response(200, "application/json", (json.dumps({"failed": [r.asDict() for r in errors[:100]], "more": len(errors) > 100}),))
        return Response(204)

    def upload(self, method: str, path: str, params: dict[str, str], kind: str, body: bytes, accept: str | None) -> Response:
        """A document of any supported kind; its graph is replaced."""
        if method != "POST":
            return Response(405, body=("documents must be posted",))
        rows = list(parse_file(f"urn:upload:{quote(params.get('name', 'document'))}", body))
        faults = [r[4] for r in rows if r[4]]
        good = [r[:4] for r in rows if not r[4]]
        if not good:
            return Response(415, body=("; ".join(faults) or "nothing that can be read",))
        self.base.ingest(self.base.spark.createDataFrame(good, QUADS_DDL))
        return Response(204)

    def listed(self, method: str, path: str, params: dict[str, str], kind: str, body: bytes, accept: str | None) -> Response:
        """JSON:API resources of tasks, or of accounts."""
        name, rows = ("system-task", self.tasks()) if path == "/system-tasks" else ("data-service", self.accounts())
        found = [{"id": str(r["id"]), "type": name, "attributes": {k: v for k, v in r.items() if k != "id"}} for r in rows]
        return Response(200, "application/vnd.api+json", (json.dumps({"data": found}, default=str),))


def serve(api: Api, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for ``api``; ``serve_forever`` runs it.  Bodies are sent in chunks as they come."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def respond(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            got = api.handle(self.command, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, self.headers.get("Content-Type", ""), body, self.headers.get("Accept"))
            self.send_response(got.status)
            for k, v in CORS.items():
                self.send_header(k, v)
            if got.status == 204:
                self.end_headers()
                return
            self.send_header("Content-Type", got.kind + "; charset=utf-8")
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            for piece in got.body:
                raw = piece.encode()
                if raw:
                    self.wfile.write(f"{len(raw):X}\r\n".encode() + raw + b"\r\n")
            self.wfile.write(b"0\r\n\r\n")

        do_GET = do_POST = do_OPTIONS = respond

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
