"""The engine over HTTP, by plain values and through a socket."""

import json
import threading
import urllib.request

import pytest

from noetica.api import Api, accepted, serve
from noetica.model import QUADS_DDL
from noetica.plans.sparql import select
from noetica.streaming.store import KnowledgeBase


@pytest.fixture
def api(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    base.ingest(spark.createDataFrame([("<a>", "<p>", '"x, y"', "<g>"), ("<b>", "<p>", "<a>", "<g>")], QUADS_DDL))
    return Api(base, tasks=lambda: [{"id": 7, "status": "done"}])


def text_of(response):
    return "".join(response.body)


def test_queries(api):
    ask = lambda q, accept=None, method="GET": api.handle(method, "/sparql", {"query": q}, accept=accept)
    got = json.loads(text_of(ask("SELECT ?s ?o WHERE { ?s <p> ?o }")))
    assert len(got["results"]["bindings"]) == 2 and got["head"]["vars"] == ["s", "o"]
    assert sorted(text_of(ask("SELECT ?s ?o WHERE { ?s <p> ?o }", "text/csv")).splitlines()) == ['a,"x, y"', "b,a", "s,o"]
    assert "<uri>b</uri>" in text_of(ask("SELECT ?s WHERE { ?s <p> <a> }", "application/sparql-results+xml"))
    assert text_of(ask("SELECT ?s WHERE { ?s <p> <a> }", "text/tab-separated-values")) == "?s\n<b>\n"
    assert json.loads(text_of(ask("ASK { <a> <p> ?x }")))["boolean"] is True
    assert text_of(ask("CONSTRUCT { ?o <q> ?s } WHERE { ?s <p> ?o FILTER(isIRI(?o)) }")) == "<a> <q> <b> .\n"
    assert text_of(ask("DESCRIBE <b>")) == "<b> <p> <a> .\n"
    assert ask("SELECT nonsense").status == 400 and ask("ASK { ?s ?p ?o }", "image/png").status == 415
    assert api.handle("GET", "/nowhere", {}).status == 404 and api.handle("OPTIONS", "/sparql", {}).status == 204
    assert accepted("text/csv;q=0.5, */*;q=0.1", {"a/b": 1, "text/csv": 1}) == "text/csv"


def test_updates_and_uploads(api, spark):
    post = lambda path, kind, body, params=None: api.handle("POST", path, params or {}, kind, body)
    assert api.handle("GET", "/sparql", {"update": "INSERT DATA { <x> <p> <y> }"}).status == 405
    assert post("/sparql", "application/sparql-update", b"INSERT DATA { GRAPH <urn:noetica:personal#userGraph> { <x> <p> <y> } }").status == 204
    assert select(api.base.quads(), "SELECT ?o WHERE { <x> <p> ?o }").collect()[0].o == "y"
    card = b"BEGIN:VCARD\nUID:1\nFN:Jo\nEND:VCARD"
    assert post("/file", "text/vcard", card, {"name": "a.vcf"}).status == 204
    assert select(api.base.quads(), "SELECT ?n WHERE { ?a schema:name ?n }").collect()[0].n == "Jo"
    assert post("/file", "", b"junk", {"name": "a.bin"}).status == 415 and post("/file", "", b"junk", {"name": "a.zip"}).status == 415
    assert json.loads(text_of(api.handle("GET", "/system-tasks", {})))["data"] == [{"id": "7", "type": "system-task", "attributes": {"status": "done"}}]


def test_through_a_socket(api):
    server = serve(api, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/sparql"
        request = urllib.request.Request(url, b"query=ASK+%7B+%3Cb%3E+%3Cp%3E+%3Ca%3E+%7D", {"Content-Type": "application/x-www-form-urlencoded", "Accept": "text/boolean"})
        with urllib.request.urlopen(request) as answer:
            assert answer.read() == b"true" and answer.headers["Access-Control-Allow-Origin"] == "*"
    finally:
        server.shutdown()


def test_services(spark):
    one = spark.createDataFrame([("<a>", "<p>", "<b>", "<g>")], QUADS_DDL)
    two = spark.createDataFrame([("<b>", "<q>", "<c>", "<h>"), ("<z>", "<q>", "<c>", "<h>")], QUADS_DDL)
    got = select(one, "SELECT ?x ?z WHERE { ?x <p> ?y SERVICE <urn:two> { ?y <q> ?z } }", services={"<urn:two>": two}).collect()
    assert [(r.x, r.z) for r in got] == [("a", "c")]
    assert select(one, "SELECT ?x WHERE { ?x <p> ?y SERVICE SILENT <urn:none> { ?y <q> ?z } }").count() == 1
    with pytest.raises(Exception, match="unknown service"):
        select(one, "SELECT ?x WHERE { SERVICE <urn:none> { ?x <q> ?z } }")


def test_optional_with_two_filters(spark):
    quads = spark.createDataFrame([(f"<s{i}>", "<v>", f'"{i}"^^<http://www.w3.org/2001/XMLSchema#integer>', "<g>") for i in range(5)], QUADS_DDL)
    got = select(quads, "SELECT ?a ?b WHERE { ?a <v> ?x OPTIONAL { ?b <v> ?y FILTER(?y > ?x) FILTER(?y < ?x + 2) } }").collect()
    assert sorted((r.a, r.b or "") for r in got) == [("s0", "s1"), ("s1", "s2"), ("s2", "s3"), ("s3", "s4"), ("s4", "")]
