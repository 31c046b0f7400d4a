"""Parsers, files, results and streams."""

import io
import json
import zipfile

import pytest

from noetica.model import QUADS_DDL, SCHEMA, TYPE
from noetica.operators import places
from noetica.plans import sparql
from noetica.sources import files, personal, rdf
from noetica.streaming import pipeline

CARD = b"BEGIN:VCARD\r\nVERSION:3.0\r\nUID:1\r\nFN:Ann \r\n Lee\r\nN:Lee;Ann;;;\r\nEMAIL:Ann@X.org\r\nTEL;TYPE=CELL:06 12 34 56 78\r\nADR:;;1 Rue;Paris;;75001;France\r\nBDAY:1970-03-04\r\nNICKNAME:An,Annie\r\nEND:VCARD\r\n"
EVENT = b"BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:e\nSUMMARY:Talk\\, long\nDTSTART:20240102T101500Z\nDURATION:P1W2D\nLOCATION:Room\nX-APPLE-STRUCTURED-LOCATION;X-TITLE=\"a:b\":geo:48.85,2.35\nATTENDEE;CN=Bob:mailto:bob@x.org\nEND:VEVENT\nEND:VCALENDAR"
MAIL = b"From: \"Ann Lee\" <ann@x.org>\nTo: bob@x.org\nCc: Carl <carl@x.org>\nSubject: Hi\nDate: Tue, 02 Jan 2024 10:00:00 +0000\nMessage-ID: <m1@x.org>\n\nbody\n"
SOCIAL = json.dumps({"id": "7", "name": "Party", "start_time": "2024-01-02T10:00:00+0100", "place": {"id": "9", "name": "Bar", "location": {"latitude": 1.5, "longitude": 2.5}}, "attending": {"data": [{"id": "3", "name": "Zoe"}]}}).encode()


def s(name):
    return f"<{SCHEMA}{name}>"


def test_parsers():
    card = personal.parse_vcard(CARD, "u:c")
    have = {(p, o) for _, p, o, _ in card}
    assert {(s("name"), '"Ann Lee"'), (s("email"), "<mailto:ann@x.org>"), (s("telephone"), "<tel:+33612345678>"), (s("alternateName"), '"Annie"')} <= have
    assert any(p == s("birthDate") and o.startswith('"--03-04"') for p, o in have) and (s("name"), '"France"') in have
    event = {(p, o.split("^^")[0]) for _, p, o, _ in personal.parse_ical(EVENT, "u:e")}
    assert {(s("name"), '"Talk, long"'), (s("startDate"), '"2024-01-02T10:15:00Z"'), (s("duration"), '"P9DT0H0M0S"'), (s("geo"), "<geo:48.85,2.35>")} <= event
    mail = personal.parse_email(MAIL, "u:m")
    assert [q[0] for q in mail if q[1] == s("headline")] == ["<mid:m1@x.org>"] and sum(q[1] == s("recipient") for q in mail) == 2
    social = {(p, o.split("^^")[0]) for _, p, o, _ in personal.parse_social(SOCIAL, "u:s")}
    assert {(s("startDate"), '"2024-01-02T10:00:00+01:00"'), (s("geo"), "<geo:1.5,2.5>"), (s("name"), '"Zoe"')} <= social
    for parse in (personal.parse_vcard, personal.parse_ical):
        assert parse(b"", "u:x") == [] and parse(b"\xff\xfe junk", "u:x") == []


def test_vcard_write_back():
    new, results = personal.apply_to_vcard(CARD.decode(), [(s("alternateName"), '"An"'), (s("telephone"), "<tel:+33612345678>"), (s("birthDate"), '"x"')], [(s("jobTitle"), '"Chef"'), (s("alternateName"), '"Nan"')])
    assert "NICKNAME:Annie,Nan" in new and "TITLE:Chef" in new and "TEL" not in new
    assert [e for *_, e in results] == [None, None, "not supported", None, None]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.vcf").write_bytes(CARD)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("m.eml", MAIL)
        z.writestr("skip.bin", b"x")
    (tmp_path / "in" / "deep" / "b.zip").write_bytes(inner.getvalue())
    (tmp_path / "in" / "deep" / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "in" / "e.ics").write_bytes(EVENT)
    got = files.read_documents(spark, str(tmp_path / "in"))
    assert got.select("g").distinct().count() == 3
    base = pipeline.KnowledgeBase(spark, str(tmp_path / "kb"))

    def mark(spark, quads, diff):
        return sparql.construct(quads, "CONSTRUCT { ?s <urn:seen> ?o } WHERE { ?s a ?o }").selectExpr("s", "p", "o", "'<urn:marks>' g", "1 op")

    run = pipeline.run_stream(files.stream_documents(spark, str(tmp_path / "in")), base, [mark], str(tmp_path / "ck"), once=True)
    run.awaitTermination(120)
    assert base.quads().where("g <> '<urn:marks>'").count() == got.distinct().count()
    assert base.quads().where("p = '<urn:seen>'").count() == got.where(f"p = '{TYPE}'").select("s", "o").distinct().count()
    assert base.ingest(got).isEmpty()


def test_rdf(spark, tmp_path):
    quads = spark.createDataFrame([("<u:a>", "<u:p>", '"x \\"y\\""@en', "<u:g>"), ("_:b", "<u:p>", "<u:c>", None)], QUADS_DDL)
    rdf.write_nquads(quads, str(tmp_path / "nq"))
    assert sorted(map(str, rdf.read_nquads(spark, str(tmp_path / "nq")).collect())) == sorted(map(str, quads.collect()))
    triples = rdf.parse_turtle('@prefix e: <http://e/> .\ne:a a e:B ; e:c "x"@en, 4 .\ne:d e:f [ e:g e:h ] .')
    assert len(triples) == 5 and ("<http://e/a>", "<http://e/c>", '"x"@en') in triples
    (tmp_path / "d.rj").write_text(json.dumps({"u:s": {"u:p": [{"value": "v", "type": "literal", "lang": "en"}, {"value": "u:o", "type": "uri"}]}}))
    assert {r.o for r in rdf.read_rdf_json(spark, str(tmp_path / "d.rj")).collect()} == {'"v"@en', "<u:o>"}
    terms = spark.createDataFrame([("<u:a>", '"1"^^<u:t>'), ("_:b", None)], "x string, y string")
    bindings = json.loads(rdf.results_document(terms))["results"]["bindings"]
    assert {"x": {"type": "uri", "value": "u:a"}, "y": {"type": "literal", "value": "1", "datatype": "u:t"}} in bindings
    assert "<uri>u:a</uri>" in rdf.results_xml(terms)
    assert rdf.graphml([("n", {"k": "<v>"})], [("n", "n", {})]).count("&lt;v&gt;") == 1


def test_location_history(spark, tmp_path):
    rows = [{"timestampMs": "1704103200000", "latitudeE7": 488500000, "longitudeE7": 23500000, "accuracy": 20}, {"timestampMs": "bad", "latitudeE7": 1, "longitudeE7": 1}]
    (tmp_path / "h.json").write_text(json.dumps({"locations": rows}))
    got = files.read_location_history(spark, str(tmp_path / "h.json")).collect()
    assert [(r.lon, r.lat, r.acc) for r in got] == [(2.35, 48.85, 20.0)]


def test_cached_geocoder(spark):
    from pyspark.sql import functions as F

    calls = []

    def ask(misses):
        calls.append(misses.count())
        return misses.withColumn("value", F.upper("k"))

    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    empty = spark.createDataFrame([], "k string, value string, modified_at timestamp")
    first, cache = places.cached(asked, empty, "k", ask, F.current_timestamp())
    again, _ = places.cached(asked, cache, "k", ask, F.current_timestamp())
    assert calls == [2, 0] and sorted(r.value for r in first.collect()) == sorted(r.value for r in again.collect()) == ["A", "A", "B"]


@pytest.mark.parametrize("write", [rdf.results_document, rdf.results_xml])
def test_results_are_whole_or_an_error(spark, write):
    terms = spark.createDataFrame([(f"<u:{i}>",) for i in range(3)], "x string")
    assert all(f"u:{i}" in write(terms, 3) for i in range(3))
    with pytest.raises(ValueError, match="more than 2 solutions"):
        write(terms, 2)
