"""Registered queries: sources and stores, synchronisation, evaluation, geometry, small graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch
from ..functions import geo, text
from ..functions import time as when
from ..model import DIFFERENT_FROM, QUAD, SAME_AS, TYPE, literal, personal, schema
from ..operators import graph, inference, places, resolve, stays
from ..sources import files, rdf, sync
from ..streaming.pipeline import debounced, latest_tasks, merged_diffs
from ..streaming.store import KnowledgeBase, MemoryStore
from .queries_data import _P, _SAME, _pairs, _same
from .queries_sparql import _NEW, _names
from .registry import query
from .sparql import Engine
from .updates import USER_GRAPH, apply_update
from .views import HAVERSINE, LOCATIONS, locations, quads, tables

R = repr(geo.RADIUS)


def _uuid(h: str) -> str:
    """SQL for the name UUID of a hexadecimal MD5."""
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::int % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21))"


def _iri(prefix: str, key: str):
    return F.concat(F.lit(f"<urn:{prefix}:"), F.col(key).cast("string"), F.lit(">"))


# -- documents


def _written(df: DataFrame, name: str) -> str:
    """A column of texts as files, one row after the other; a file is read whole by a task, so
    its rows do not grow with the table."""
    path = scratch(df.sparkSession, name)
    df.write.option("lineSep", "\n").option("maxRecordsPerFile", 20_000).text(path)
    return path


_CARD = "'<urn:uuid:' || " + _uuid("md5('vcard|c' || c_custkey)") + " || '>'"


@query("vcards", f"select * from (select {_CARD} s, '{TYPE}' p, '{personal('Agent')}' o from customer union all select {_CARD}, '{schema('name')}', '\"' || c_name || ', \\\"x\\\"\"' from customer union all select {_CARD}, '{schema('email')}', '<mailto:c' || c_custkey || '@example.org>' from customer union all select {_CARD}, '{schema('birthDate')}', '\"--02-03\"^^<http://www.w3.org/2001/XMLSchema#gMonthDay>' from customer)")
def vcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all customers, several to a file whose kind only its content tells."""
    key = F.col("c_custkey").cast("string")
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.concat(F.lit("UID:c"), key), F.concat(F.lit("FN:"), F.substring("c_name", 1, 4), F.lit("\r\n "), F.substring(F.col("c_name"), 5, 99), F.lit('\\, "x"')), F.concat(F.lit("item1.EMAIL;TYPE=home:C"), key, F.lit("@Example.org")), F.lit("BDAY:1970-02-03"), F.lit("END:VCARD"))
    got = files.read_documents(spark, _written(tables(spark, sf_dir)["customer"].select(lines), "cards"))
    return got.select("s", "p", "o").where((F.col("s").startswith("<urn:uuid:")) & F.col("p").isin(TYPE, schema("name"), schema("email"), schema("birthDate")))


_EVENT = "'<urn:uuid:' || " + _uuid("md5('event|e' || event_id || '||')") + " || '>'"


@query("calendar_files", f"select * from (select {_EVENT} s, '{schema('name')}' p, '\"' || event_type || '; ' || event_id || '\"' o from events union all select {_EVENT}, '{schema('startDate')}', '\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\"^^<http://www.w3.org/2001/XMLSchema#dateTime>' from events union all select {_EVENT}, '{schema('duration')}', '\"P7DT' || (user_id % 24) || 'H0M0S\"^^<http://www.w3.org/2001/XMLSchema#dayTimeDuration>' from events)")
def calendar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    key = F.col("event_id").cast("string")
    lines = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:e"), key), F.concat(F.lit("SUMMARY:"), F.col("event_type"), F.lit("\\; "), key), F.concat(F.lit("DTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")), F.concat(F.lit("DURATION:P1WT"), (F.col("user_id") % 24).cast("string"), F.lit("H")), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    got = files.read_documents(spark, _written(e.select(lines), "calendars"))
    return got.select("s", "p", "o").where(F.col("p").isin(schema("name"), schema("startDate"), schema("duration")))


@query("mail_files", f"select * from (select '<mid:' || n_nationkey || '@h>' s, '{schema('headline')}' p, '\"' || n_name || '\"' o from nation union all select '<mid:' || n_nationkey || '@h>', '{personal('inReplyTo')}', '<mid:' || n_regionkey || '@r>' from nation union all select '<mid:' || n_nationkey || '@h>', '{TYPE}', '{schema('EmailMessage')}' from nation)")
def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per nation, each in a file of its own."""
    n = tables(spark, sf_dir)["nation"]
    key = F.col("n_nationkey").cast("string")
    lines = F.concat_ws("\r\n", F.lit("From: A <a@x.org>"), F.concat(F.lit("Message-ID: <"), key, F.lit("@h>")), F.concat(F.lit("In-Reply-To: <"), F.col("n_regionkey").cast("string"), F.lit("@r>")), F.concat(F.lit("Subject: "), F.col("n_name")), F.lit("\r\nHello"))
    path = scratch(spark, "mail")
    n.select(lines).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_documents(spark, path).select("s", "p", "o").where(F.col("s").startswith("<mid:") & F.col("p").isin(schema("headline"), personal("inReplyTo"), TYPE))


@query("files_in_error", "select '<urn:bad>' like '%' bad, 2::bigint n")
def files_in_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive cut off and a profile that is no JSON: each gives one row with its error."""
    rows = spark.createDataFrame([("a.zip", bytearray(b"PK\x03\x04broken")), ("b.profile.json", bytearray(b"{")), ("c.vcf", bytearray(b"BEGIN:VCARD\nFN:x\nEND:VCARD"))], "path string, content binary")
    got = rows.mapInPandas(files._parse, files._DOCUMENT)
    return got.groupBy(F.col("error").isNotNull().alias("bad")).agg(F.count("*").alias("n")).where("bad")


@query("location_quads", f"select '<urn:location:' || (epoch_us(ts) // 1000) || '>' s, '<urn:location-history:' || strftime(ts, '%Y-%m-%d') || '>' g from events group by 1, 2")
def location_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    row = F.struct(F.unix_millis("ts").cast("string").alias("timestampMs"), F.lit(488500000).cast("long").alias("latitudeE7"), F.lit(23500000).cast("long").alias("longitudeE7"), F.lit(10.0).cast("float").alias("accuracy"))
    bad = F.struct(F.lit("no time").alias("timestampMs"), F.lit(1).cast("long").alias("latitudeE7"), F.lit(1).cast("long").alias("longitudeE7"), F.lit(1.0).cast("float").alias("accuracy"))
    path = scratch(spark, "history")
    e.groupBy("user_id").agg(F.to_json(F.struct(F.concat(F.collect_list(row), F.array(bad)).alias("locations"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.location_quads(files.read_location_history(spark, path)).where(F.col("p") == schema("geo")).select("s", "g").distinct()


@query("nquads_files", "select '<urn:c:' || c_custkey || '>' s, '\"' || c_name || ' \\\"q\\\" \\\\ \\n\"@en' o, case when c_custkey % 2 = 0 then '<urn:g>' end g from customer")
def nquads_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    q = c.select(_iri("c", "c_custkey").alias("s"), F.lit(schema("name")).alias("p"), literal(F.concat("c_name", F.lit(' "q" \\ \n')), lang="en").alias("o"), F.when(F.col("c_custkey") % 2 == 0, "<urn:g>").alias("g"))
    path = scratch(spark, "nquads")
    rdf.write_nquads(q, path)
    return rdf.read_nquads(spark, path).select("s", "o", "g")


def _documents_of(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = scratch(spark, name)
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("rdf_formats", f"select kind, '<urn:n:' || n_nationkey || '>' s, '\"' || n_name || '\"@en' o from nation, (values ('rdf'), ('trig'), ('trix'), ('ttl')) t(kind)")
def rdf_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation in each format."""
    n = tables(spark, sf_dir)["nation"]
    key, name, p = F.col("n_nationkey").cast("string"), F.col("n_name"), schema("name")
    own = {
        "ttl": F.concat(F.lit("@prefix s: <http://schema.org/> .\n<urn:n:"), key, F.lit('> s:name "'), name, F.lit('"@en .')),
        "trig": F.concat(F.lit("@prefix s: <http://schema.org/> .\n<urn:g> { <urn:n:"), key, F.lit('> s:name "'), name, F.lit('"@en }')),
        "trix": F.concat(F.lit('<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/"><graph><triple><uri>urn:n:'), key, F.lit(f'</uri><uri>{p[1:-1]}</uri><plainLiteral xml:lang="en">'), name, F.lit("</plainLiteral></triple></graph></TriX>")),
        "rdf": F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://schema.org/"><rdf:Description rdf:about="urn:n:'), key, F.lit('"><s:name xml:lang="en">'), name, F.lit("</s:name></rdf:Description></rdf:RDF>")),
    }
    out = [rdf.read_rdf(spark, _documents_of(spark, n.select(x), kind), kind).where("error is null").select(F.lit(kind).alias("kind"), "s", "o") for kind, x in own.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("rdf_json_files", "select '<urn:n:' || n_nationkey || '>' s, '\"' || n_name || '\"@en' o from nation")
def rdf_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables(spark, sf_dir)["nation"]
    text_ = F.concat(F.lit('{"urn:n:'), F.col("n_nationkey").cast("string"), F.lit('": {"http://schema.org/name": [{"type": "literal", "lang": "en", "value": "'), "n_name", F.lit('"}]}}'))
    return rdf.read_rdf_json(spark, _documents_of(spark, n.select(text_), "rj")).select("s", "o")


@query("ontology_diff", f"select * from (values ('<urn:o:A>', '<urn:o:C>', 1), ('<urn:o:A>', '<urn:o:Old>', -1)) t(s, o, op)")
def ontology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = inference.SUB_CLASS
    stored = spark.createDataFrame([("<urn:o:A>", sub, "<urn:o:B>", "<urn:onto>"), ("<urn:o:A>", sub, "<urn:o:Old>", "<urn:onto>"), ("<urn:x>", sub, "<urn:y>", "<urn:other>")], "s string, p string, o string, g string")
    turtle = "@prefix o: <urn:o:> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\no:A rdfs:subClassOf o:B, o:C ."
    return rdf.load_ontology(spark, turtle, "<urn:onto>", stored).select("s", "o", "op")


@query("results_json", "select '{\"c\":{\"type\":\"uri\",\"value\":\"urn:c:' || c_custkey || '\"},\"n\":{\"type\":\"literal\",\"value\":\"' || c_name || '\"}}' binding from customer")
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine(quads(spark, sf_dir)).solutions("SELECT ?c ?n WHERE { ?c a schema:Person ; schema:name ?n }")
    path = scratch(spark, "results")
    rdf.write_results_json(found, path)
    return spark.read.text(path).select(F.col("value").alias("binding"))


@query("results_csv", 'select \'urn:c:\' || c_custkey c, c_name n from customer')
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine(quads(spark, sf_dir)).solutions("SELECT ?c ?n WHERE { ?c a schema:Person ; schema:name ?n }")
    path = scratch(spark, "results")
    rdf.write_results_csv(found, path)
    return spark.read.option("header", True).csv(path)


@query("sample_files", "select (p_size / 100.0)::decimal(4,2) threshold, 'a' || p_partkey a, 'b' || p_partkey b from part")
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir)["part"]
    path = scratch(spark, "samples")
    key = F.col("p_partkey").cast("string")
    p.select((F.col("p_size") / 100).cast("decimal(4,2)").alias("threshold"), F.concat(F.lit("a"), key).alias("a"), F.concat(F.lit("b"), key).alias("b")).write.option("header", True).csv(path)
    return files.read_samples(spark, path)


# -- stores and streams


@query("knowledge_base", f"select * from ({_NEW})")
def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a document, stored one after the other by stores opened anew."""
    path = scratch(spark, "base")
    KnowledgeBase(spark, path).ingest(_names(spark, sf_dir, 0))
    KnowledgeBase(spark, path).ingest(_names(spark, sf_dir, 1))
    return KnowledgeBase(spark, path).quads().select("s", "o")


@query("memory_store", f"select * from ({_NEW})")
def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in memory, its snapshot, and a store opened from that."""
    path = scratch(spark, "snapshot")
    store = MemoryStore(spark, path, every=1)
    store.commit(_names(spark, sf_dir, 1).withColumn("op", F.lit(1)))
    return MemoryStore(spark, path).quads().select("s", "o")


@query("bursts", "with m as (select user_id, event_id, ts, coalesce(ts >= lag(ts) over w + interval 6 hour, true)::int nw from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(nw) over (partition by user_id order by ts, event_id) run from m) select user_id, epoch_us(min(ts)) \"start\", count(*) n, max(event_id) last_id from r group by user_id, run")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debounced(tables(spark, sf_dir)["events"], ["user_id"], "ts", "6 hours", merge=[F.max("event_id").alias("last_id")])
    return found.select("user_id", F.unix_micros("start").alias("start"), "n", "last_id")


@query("merged_diffs", "with m as (select user_id, event_id, event_type, ts, coalesce(ts >= lag(ts) over w + interval 6 hour, true)::int nw from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(nw) over (partition by user_id order by ts, event_id) run from m) select user_id source, event_type o, arg_max(case when event_id % 2 = 0 then 1 else -1 end, event_id)::int op, count(*) n from r group by user_id, run, event_type")
def merged_diffs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    diffs = e.select(F.col("user_id").alias("source"), "ts", F.lit("<s>").alias("s"), F.lit("<p>").alias("p"), F.col("event_type").alias("o"), F.lit("<g>").alias("g"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("op"), F.col("event_id").alias("seq"))
    merged = merged_diffs(diffs, gap="6 hours").select("source", "start", "end", F.explode("diff").alias("q"))
    counts = diffs.select("source", "ts", "o")
    met = merged.join(counts, (merged["source"] == counts["source"]) & (merged["q.o"] == counts["o"]) & (counts["ts"] >= merged["start"]) & (counts["ts"] < merged["end"]))
    return met.groupBy(merged["source"], merged["start"], F.col("q.o").alias("o"), F.col("q.op").alias("op")).agg(F.count("*").alias("n")).select("source", "o", "op", "n")


@query("latest_tasks", "select 's' service, user_id account, event_type source, 'n' as \"name\", max(event_id) id, arg_max(value, event_id) progress from events group by user_id, event_type")
def latest_tasks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    return latest_tasks(e.select(F.lit("s").alias("service"), F.col("user_id").alias("account"), F.col("event_type").alias("source"), F.lit("n").alias("name"), F.col("event_id").alias("id"), F.col("value").alias("progress")))


# -- synchronisation


@query("resources_to_fetch", "select c_nationkey collection, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 100 request, c_custkey path from customer where c_custkey % 5 = 0 or c_custkey % 11 = 1")
def resources_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = tables(spark, sf_dir)["customer"], F.col("c_custkey")
    listing = lambda df, tag: df.select(F.col("c_nationkey").alias("collection"), key.alias("path"), tag.alias("etag"))
    return sync.to_fetch(listing(c, F.when(key % 5 == 0, "v2").otherwise("v1")), listing(c.where((key % 11 != 1) | (key % 5 == 0)), F.lit("v1")))


@query("conditional_writes", "select c_custkey path, case when c_custkey % 3 = 0 then 'new' when c_custkey % 3 = 1 then 'old' else 'none' end content, case when c_custkey % 3 = 0 then true else false end ok from customer where c_custkey % 3 <> 2 union all select c_custkey, null, false from customer where c_custkey % 3 = 2")
def conditional_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every three writes one has the right tag, one an old one, and of one the target is gone."""
    c, key = tables(spark, sf_dir)["customer"], F.col("c_custkey")
    remote = c.where(key % 3 != 2).select(key.alias("path"), F.lit("v1").alias("etag"), F.lit("old").alias("content"))
    writes = c.select(key.alias("path"), F.when(key % 3 == 1, "v0").otherwise("v1").alias("expected"), F.lit("new").alias("content"), F.lit("v2").alias("etag"))
    after, outcomes = sync.write_back(writes, remote)
    return outcomes.join(after.select("path", "content"), "path", "left").select("path", "content", "ok")


@query("mailbox_changes", "select case when user_id % 3 = 0 then 'INBOX' when user_id % 3 = 1 then 'Work' end folder, (case when user_id % 3 = 1 then 2 else 1 end)::bigint uidvalidity, event_id uid, 'added' change from events where (user_id % 3 = 0 and event_id % 5 = 0) or user_id % 3 = 1 union all select case when user_id % 3 = 0 then 'INBOX' else 'Work' end, 1, event_id, 'removed' from events where (user_id % 3 = 0 and event_id % 7 = 0 and event_id % 5 <> 0) or user_id % 3 = 1 and event_id % 5 <> 0")
def mailbox_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folders: one with new and removed messages, one with a new validity, one of junk."""
    e, u, i = tables(spark, sf_dir)["events"], F.col("user_id") % 3, F.col("event_id")
    folder = F.when(u == 0, "INBOX").when(u == 1, "Work").otherwise("Mail/Junk")
    listing = lambda df, validity: df.select(folder.alias("folder"), validity.cast("long").alias("uidvalidity"), i.alias("uid"))
    now = listing(e.where((u != 0) | (i % 7 != 0) | (i % 5 == 0)), F.when(u == 1, 2).otherwise(1))
    return sync.mailbox_changes(now, listing(e.where(i % 5 != 0), F.lit(1)))


@query("message_removals", "select '<urn:m:' || event_id || '>' s, -1 op from events where event_id % 4 = 0")
def message_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].select(F.lit("INBOX").alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), F.col("event_id").alias("uid"))
    base = e.select(_iri("m", "uid").alias("s"), F.lit(TYPE).alias("p"), F.lit(schema("EmailMessage")).alias("o"), sync.message_graph(F.col("folder"), F.col("uidvalidity"), F.col("uid")).alias("g"))
    return sync.removals(sync.mailbox_changes(e.where("uid % 4 <> 0"), e), base).select("s", "op")


# -- inference


@query("owl_symmetric", "select '<urn:n:' || a || '>' s, '<urn:n:' || b || '>' o from (select n_regionkey a, n_nationkey b from nation) where a <> b")
def owl_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property declared symmetric: nations and the nations numbered like their regions."""
    n = tables(spark, sf_dir)["nation"]
    facts = n.where("n_nationkey <> n_regionkey").select(_iri("n", "n_nationkey").alias("s"), F.lit("<urn:near>").alias("p"), _iri("n", "n_regionkey").alias("o"))
    rules = spark.createDataFrame([("<urn:near>", TYPE, inference.SYMMETRIC)], "s string, p string, o string")
    found = inference.owl_closure(facts.unionByName(rules)).where(F.col("p") == "<urn:near>")
    return found.unionByName(facts).select("s", "o").distinct().join(facts.select("s", "o"), ["s", "o"], "left_anti").unionByName(facts.select(F.col("o").alias("s"), F.col("s").alias("o")).join(facts.select("s", "o"), ["s", "o"], "left_semi"))


@query("owl_axioms", f"with m as (select n_regionkey r, '<urn:n:' || n_nationkey || '>' x from nation union select n_regionkey, '<urn:r:' || n_regionkey || '>' from nation), f as (select '<urn:n:' || n_nationkey || '>' s, '<urn:r:' || n_regionkey || '>' o from nation) select s, o from (select a.x s, b.x o from m a join m b using (r)) where not exists (from f where f.s = s and f.o = o) ".replace("from f where f.s = s and f.o = o", "select 1 from f f2 where f2.s = t.s and f2.o = t.o").replace("using (r))", "using (r)) t").replace("select s, o from (", "select t.s, t.o from ("))
def owl_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sameness is symmetric and transitive by the axioms alone: what links of nations to regions add."""
    n = tables(spark, sf_dir)["nation"]
    facts = n.select(_iri("n", "n_nationkey").alias("s"), F.lit(SAME_AS).alias("p"), _iri("r", "n_regionkey").alias("o"))
    return inference.owl_closure(facts).where(F.col("p") == SAME_AS).select("s", "o")


@query("class_representatives", "select o_custkey component, case when max(case when o_orderkey % 3 <> 0 then 1 else 0 end) = 1 then min(case when o_orderkey % 3 <> 0 then '<urn:o:' || lpad(o_orderkey::varchar, 9, '0') || '>' end) else min('_:' || lpad(o_orderkey::varchar, 9, '0')) end representative from orders group by 1")
def class_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    node = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("<urn:o:"), key, F.lit(">"))).otherwise(F.concat(F.lit("_:"), key))
    return inference.representatives(tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("component"), node.alias("node")))


_MAIL = "before as (select '<urn:c:' || lpad(c_custkey::varchar, 9, '0') || '>' s, c_custkey // 3 v from customer where c_custkey % 7 <> 0), after as (select '<urn:c:' || lpad(c_custkey::varchar, 9, '0') || '>' s, c_custkey // 3 v from customer where c_custkey % 5 <> 0), ls as (select 0 w, s, v from before union all select 1, s, v from after), st as (select w, s a, min(s) over (partition by w, v) b from ls), d as (select w, a, b from st where a <> b)"


@query("shared_identifier_changes", f"with {_MAIL} select a, b, 1 op from d where w = 1 and (a, b) not in (select (a, b) from d where w = 0) union all select a, b, -1 from d where w = 0 and (a, b) not in (select (a, b) from d where w = 1)")
def shared_identifier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers to an address; some lose theirs, others get one."""
    c, key = tables(spark, sf_dir)["customer"], F.col("c_custkey")
    p = schema("email")
    row = lambda df: df.select(F.concat(F.lit("<urn:c:"), F.lpad(key.cast("string"), 9, "0"), F.lit(">")).alias("s"), F.lit(p).alias("p"), F.concat(F.lit("<mailto:"), F.floor(key / 3).cast("string"), F.lit("@x>")).alias("o"), F.lit("<urn:g>").alias("g"))
    before, after = row(c.where(key % 7 != 0)), row(c.where(key % 5 != 0))
    diff = after.join(before, list(QUAD), "left_anti").withColumn("op", F.lit(1)).unionByName(before.join(after, list(QUAD), "left_anti").withColumn("op", F.lit(-1)))
    return inference.shared_identifier_changes(before, diff, [p])


@query("primary_facet_changes", "select '<urn:c:' || (2 * (c_custkey // 2) + 1) || '>' s, 1 op from customer where c_custkey % 20 = 0 and 2 * (c_custkey // 2) + 1 in (select c_custkey from customer) union all select '<urn:c:' || c_custkey || '>', -1 from customer where c_custkey % 20 = 0 and 2 * (c_custkey // 2) + 1 in (select c_custkey from customer)")
def primary_facet_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers that are the same, the even one the facet; in some the odd one then gets
    more quads, so it is elected instead."""
    c, key = tables(spark, sf_dir)["customer"], F.col("c_custkey")
    facet, g = personal("PrimaryFacet"), "<urn:facets>"
    row = lambda df, p, o, graph="<urn:g>": df.select(_iri("c", "c_custkey").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(graph).alias("g"))
    paired = c.join(c.select((key - key % 2 * 2 + 1).alias("c_custkey")), "c_custkey", "left_semi")
    even, odd = paired.where(key % 2 == 0), paired.where(key % 2 == 1)
    base = row(paired, TYPE, F.lit(personal("Agent"))).unionByName(row(even, schema("name"), F.lit('"x"'))).unionByName(row(even, SAME_AS, F.concat(F.lit("<urn:c:"), (key + 1).cast("string"), F.lit(">")))).unionByName(row(even, TYPE, F.lit(facet), g))
    diff = row(odd.where(key % 20 == 1), schema("name"), F.lit('"a"')).unionByName(row(odd.where(key % 20 == 1), schema("name"), F.lit('"b"'))).unionByName(row(odd.where(key % 20 == 1), schema("name"), F.lit('"c"'))).withColumn("op", F.lit(1))
    return inference.primary_facet_changes(base.unionByName(diff.drop("op")), diff, [personal("Agent")], facet, g).select("s", "op")


# -- resolution and evaluation


@query("persisted_matches", f"with s as (select p_partkey a, p_partkey + 1 b, (p_size % 20) / 20.0 score from part), good as (select least(a, b) a, greatest(a, b) b from s where score >= 0.9 and a % 4 <> 0), l as (select '<urn:p:' || a || '>' s, '<urn:p:' || b || '>' o from good union select '<urn:p:' || b || '>', '<urn:p:' || a || '>' from good) select s, o, 1 op from l union all select '<urn:old>', '<urn:older>', -1")
def persisted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = tables(spark, sf_dir)["part"], F.col("p_partkey")
    node = lambda x: F.concat(F.lit("<urn:p:"), x.cast("string"), F.lit(">"))
    scores = p.select(node(key).alias("a"), node(key + 1).alias("b"), (F.col("p_size") % 20 / 20).alias("score"))
    denied = p.where(key % 4 == 0).select(node(key + 1).alias("s"), F.lit(DIFFERENT_FROM).alias("p"), node(key).alias("o"), F.lit("<urn:me>").alias("g"))
    old = spark.createDataFrame([("<urn:old>", SAME_AS, "<urn:older>", "<urn:agent-match>")], "s string, p string, o string, g string")
    return resolve.persisted(scores, denied.unionByName(old)).select("s", "o", "op")


_SWEEP = f"with recursive {_SAME}, s as (select src, dst, ((src * 7 + dst) % 100) / 100.0 score from same), sh as (select p_partkey src, p_partkey + 1 dst, 2.0 score from part where p_partkey % 50 = 0 and p_partkey + 1 in (select p_partkey from part)), al as (select * from s union all select * from sh), lv as (select * from (values (2.0), (0.3), (0.6)) t(th)), both_ as (select th, src, dst from al, lv where score >= th union select th, dst, src from al, lv where score >= th), walk as (select th, src a, dst b from both_ union select w.th, a, dst from walk w join both_ e on w.th = e.th and b = src), comp as (select th, a node, least(a, min(b)) component from walk group by th, a), whole as (select lv.th::double \"level\", p_partkey node, coalesce(component, p_partkey) component from part cross join lv left join comp on comp.th = lv.th and comp.node = p_partkey union all select 0.0, p_partkey, (select min(p_partkey) from part) from part)"


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = tables(spark, sf_dir)["part"], F.col("p_partkey")
    shared = p.where(key % 50 == 0).select(key.alias("src"), (key + 1).alias("dst")).join(p.select(key.alias("dst")), "dst", "left_semi").select("src", "dst")
    scores = _same(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), (((F.col("src") * 7 + F.col("dst")) % 100) / 100).alias("score"))
    return resolve.sweep_classes(p.select(key.alias("node")), shared, scores, [0.3, 0.6])


@query("sweep_classes", f"{_SWEEP} select * from whole")
def sweep_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir)


@query("sweep_sizes", f"{_SWEEP} select \"level\", class_size, count(*) n_classes from (select \"level\", component, count(*) class_size from whole group by 1, 2) group by 1, 2")
def sweep_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.class_sizes(_swept(spark, sf_dir))


@query("sweep_email_sizes", f"{_SWEEP} select \"level\", class_size, count(*) n_classes from (select \"level\", component, count(distinct node % 6) class_size from whole group by 1, 2) group by 1, 2")
def sweep_email_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = tables(spark, sf_dir)["part"].select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 6).cast("string").alias("email"))
    return resolve.class_sizes(_swept(spark, sf_dir), emails)


@query("name_part_kinds", "select kinds, count(*) n from (select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '+') kinds from orders group by 1) group by 1")
def name_part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.part_distribution(tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("agent"), F.col("o_orderpriority").alias("part_type")))


@query("pattern_costs", "select c_mktsegment \"domain\", c_nationkey::varchar \"pattern\", count(*) n, round(avg(c_acctbal), 4) \"cost\" from customer group by rollup (c_mktsegment, c_nationkey)")
def pattern_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"].select(F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").cast("string").alias("pattern"), F.col("c_acctbal").alias("cost"))
    return resolve.pattern_rollup(c).withColumn("cost", F.round("cost", 4))


@query("provider_list", "select c_custkey, case c_custkey % 3 when 0 then 'free' when 1 then 'disposable' end kind from customer")
def provider_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    emails = tables(spark, sf_dir)["customer"].select("c_custkey", F.when(k == 0, "Free.example").when(k == 1, "gone.example").when(F.col("c_custkey") % 2 == 0, "own.example").alias("domain"))
    listed = spark.createDataFrame([("free.Example", "free"), ("gone.example", "disposable"), ("gone.example", "disposable")], "domain string, kind string")
    return text.provider_kinds(emails, listed).select("c_custkey", "kind")


# -- paths and small graphs


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A binary tree over the parts, and its root."""
    key = F.col("p_partkey")
    p = tables(spark, sf_dir)["part"].where(key > 0)
    return p.select(F.floor((key - 1) / 2).alias("src"), key.alias("dst"), F.lit(1.0).alias("w")), spark.createDataFrame([(0,)], "node long")


@query("path_nodes", "with recursive t as (select p_partkey node, p_partkey a, p_partkey::varchar path from part where p_partkey > 0 union all select node, (a - 1) // 2, ((a - 1) // 2) || '/' || path from t where a > 0) select node, path from t where a = 0")
def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, root = _tree(spark, sf_dir)
    paths = graph.shortest_paths(edges, root)
    found = graph.path_nodes(paths, paths.where("node > 0").select("source", "node"))
    joined = graph.joined_paths(graph.path_head(F.col("path"), 2), graph.path_tail(F.col("path"), 1))
    return found.select("node", F.array_join(F.transform(joined, lambda x: x.cast("string")), "/").alias("path"))


@query("paths_to_stops", "with recursive t as (select p_partkey node, p_partkey a, 0 d from part union all select node, (a - 1) // 2, d + 1 from t where a > 0), d as (select node, d from t where a = 0) select node, d::double distance from d where d <= (select min(d) from d where node % 10 = 9)")
def paths_to_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, root = _tree(spark, sf_dir)
    paths = graph.shortest_paths(edges, root)
    return graph.settled_at(paths, paths.where("node % 10 = 9").select("source", "node")).select("node", "distance")


@query("small_assignments", "select c_custkey, least(a + d, b + c)::double by_assignment, least(a + d, b + c)::double by_flow from (select c_custkey, c_custkey % 7 a, c_custkey % 5 b, c_custkey % 11 c, c_custkey % 3 d from customer)")
def small_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two by two: the cheapest assignment, and the cheapest flow of two, of a matrix per customer."""

    def run(batches):
        for pdf in batches:
            one, two = [], []
            for k in pdf["c_custkey"]:
                m = np.array([[k % 7, k % 5], [k % 11, k % 3]], float)
                one.append(float(sum(m[i, j] for i, j in enumerate(graph.assignment(m)))))
                edges = [("s", ("l", i), 1.0, 0.0) for i in (0, 1)] + [(("r", j), "t", 1.0, 0.0) for j in (0, 1)] + [(("l", i), ("r", j), 1.0, float(m[i, j])) for i in (0, 1) for j in (0, 1)]
                two.append(float(graph.min_cost_flow(edges, "s", "t")[1]))
            yield pd.DataFrame({"c_custkey": pdf["c_custkey"], "by_assignment": one, "by_flow": two})

    return tables(spark, sf_dir)["customer"].select("c_custkey").mapInPandas(run, "c_custkey long, by_assignment double, by_flow double")


# -- places


@query("feature_quads", f"select '<urn:f:' || s_suppkey || '>' s, '{schema('name')}' p, '\"' || s_name || '\"' o from supplier union all select '<urn:f:' || s_suppkey || '>', '{schema('geo')}', '<geo:48.85,2.35>' from supplier union all select '<urn:f:' || s_suppkey || '>', '{schema('addressCountry')}', '\"N' || s_nationkey || '\"' from supplier")
def feature_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)["supplier"]
    features = s.select(F.concat(F.lit("urn:f:"), F.col("s_suppkey").cast("string")).alias("iri"), F.col("s_name").alias("name"), F.lit("geo:48.85,2.35").alias("geo"), F.create_map(F.lit("addressCountry"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("address"))
    return places.features_to_quads(features).select("s", "p", "o")


@query("geojson_answers", "select s_suppkey q, 0 as \"rank\", 'http://www.openstreetmap.org/node/' || s_suppkey iri, s_name \"name\", 'geo:48.5,' || (2 + s_suppkey % 10) geo, 'N' || s_nationkey country from supplier")
def geojson_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)["supplier"]
    properties = F.create_map(F.lit("osm_type"), F.lit("N"), F.lit("osm_id"), F.col("s_suppkey").cast("string"), F.lit("name"), F.col("s_name"), F.lit("country"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    point = F.struct(F.lit("Point").alias("type"), F.array((2 + F.col("s_suppkey") % 10).cast("double"), F.lit(48.5)).alias("coordinates"))
    area = F.struct(F.lit("Polygon").alias("type"), F.array().cast("array<double>").alias("coordinates"))
    feature = lambda g: F.struct(g.alias("geometry"), properties.alias("properties"))
    answers = s.select(F.col("s_suppkey").alias("q"), F.to_json(F.struct(F.array(feature(point), feature(area)).alias("features"))).alias("body"))
    found = places.geojson_features(answers.unionByName(spark.createDataFrame([(-1, "no json")], "q long, body string")))
    return found.select("q", "rank", "iri", "name", "geo", F.try_element_at("address", F.lit("addressCountry")).alias("country"))


@query("refined_answers", "select s_suppkey q, case when s_suppkey % 4 = 0 then 'named' else 'house' end place from supplier")
def refined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = tables(spark, sf_dir)["supplier"], F.col("s_suppkey")
    addresses = s.select(key.alias("q"), F.lit("house").alias("place"), key.cast("double").alias("lon"), F.lit(48.5).alias("lat"), F.when(key % 2 == 0, "ROOFTOP").otherwise("APPROXIMATE").alias("precision"))
    named = s.where((key % 4 == 0) | (key % 2 == 1)).select(F.lit("named").alias("place"), key.cast("double").alias("lon"), F.lit(48.5).alias("lat"))
    return places.refined(addresses, named).select("q", "place")


@query("locations_with_clusters", f"with {LOCATIONS}, c as (select user_id, min(ts) f, max(ts) t, avg(lon) x from locations where user_id % 2 = 0 group by 1) select id, epoch_us(c.f) c_from, epoch_us(c.t) c_to, round(c.x, 6) c_lon from locations l left join c on c.user_id = l.user_id")
def locations_with_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = locations(spark, sf_dir)
    even = own.where("user_id % 2 = 0")
    clusters = even.groupBy(F.col("user_id").alias("cluster")).agg(F.min("ts").alias("c_from"), F.max("ts").alias("c_to"), F.avg("lon").alias("c_lon"), F.avg("lat").alias("c_lat"), F.avg("acc").alias("c_acc"))
    found = stays.with_clusters(own, even.select(F.col("user_id").alias("cluster"), "id"), clusters)
    return found.select("id", F.unix_micros("c_from").alias("c_from"), F.unix_micros("c_to").alias("c_to"), F.round("c_lon", 6).alias("c_lon"))


# -- scalars


@query("interval_arithmetic", "select o_orderkey, (o_orderkey % 5000 * 2)::double doubled, round((o_orderkey % 5000)::double / (1 + o_custkey % 100), 6) times, least(o_orderkey % 5000, 1 + o_custkey % 100)::double shorter, ((o_orderkey % 3) * 604800 + (o_orderkey % 5) * 3600 + 61)::double span from orders")
def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir)["orders"]
    span = lambda x: F.make_dt_interval(secs=x.cast("decimal(18,6)"))
    a, b = span(F.col("o_orderkey") % 5000), span(1 + F.col("o_custkey") % 100)
    zero = F.lit(0)
    ical = when.day_time_duration((F.col("o_orderkey") % 3).cast("int"), zero, (F.col("o_orderkey") % 5).cast("int"), F.lit(1), F.lit(1))
    s = lambda x: when.seconds_of(x).cast("double")
    return o.select("o_orderkey", s(when.scaled(a, F.lit(2))).alias("doubled"), F.round(when.ratio(a, b).cast("double"), 6).alias("times"), s(when.shorter(a, b)).alias("shorter"), s(ical).alias("span"))


@query("image_types", "select c_custkey, case c_custkey % 6 when 0 then 'jpeg' when 1 then 'png' when 2 then 'gif' when 3 then 'bmp' when 4 then 'tiff' end kind from customer")
def image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    head = F.when(k == 0, "FFD8FFE000").when(k == 1, "89504E470D0A1A0A00").when(k == 2, "474946383961").when(k == 3, "424D00").when(k == 4, "4D4D002A00").otherwise("00")
    return tables(spark, sf_dir)["customer"].select("c_custkey", text.image_type(F.unhex(head)).alias("kind"))


@query("wkt_distances", f"with {_P} select id, round({HAVERSINE.format(r=R, x1='lon1', y1='lat1', x2='lon2', y2='lat2')}, 3) d from p")
def wkt_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.concat(F.lit("<http://www.opengis.net/def/crs/OGC/1.3/CRS84> POINT("), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit(")"))
    return _pairs(spark, sf_dir).select("id", F.round(geo.wkt_distance(point("lon1", "lat1"), point("lon2", "lat2")), 3).alias("d"))


@query("point_to_trail", "with e as (select event_id, value / 10 x, (user_id % 50)::double y from events), d as (select event_id, pow(x - greatest(0, least(30, x)), 2) + y * y a, pow(x - 30, 2) + pow(y - greatest(0, least(20, y)), 2) b from e) select event_id, round(sqrt(least(a, b)), 6) distance, (event_id % 2 = 0) empty from d")
def point_to_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    trail = F.array(corner(0, 0), corner(30, 0), corner(30, 20))
    found = geo.project_on_trail(F.col("value") / 10, (F.col("user_id") % 50).cast("double"), trail)
    none = geo.project_on_trail(F.col("value"), F.col("value"), F.when(F.col("event_id") % 2 == 0, F.slice(trail, 1, 0)).otherwise(trail))
    return e.select("event_id", F.round(found["distance"], 6).alias("distance"), none.isNull().alias("empty"))


@query("trail_distances", f"with {LOCATIONS}, s as (select id, (2.36 - lon) * cos(radians(lat)) x1, 48.86 - lat y1, (2.37 - lon) * cos(radians(lat)) x2, 48.86 - lat y2 from locations), t as (select *, greatest(0, least(1, (-x1 * (x2 - x1)) / pow(x2 - x1, 2))) t from s) select id, round({R} * radians(sqrt(pow(x1 + t * (x2 - x1), 2) + y1 * y1)), 3) d from t")
def trail_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = lambda x: F.struct(F.lit(x).alias("lon"), F.lit(48.86).alias("lat"))
    return locations(spark, sf_dir).select("id", F.round(geo.trail_distance(F.col("lon"), F.col("lat"), F.array(end(2.36), end(2.37))), 3).alias("d"))


@query("envelope_algebra", f"with {LOCATIONS} select user_id, round(min(lon) - 1, 6) x0, round(max(lat) + 1, 6) y1, true inside, false outside, true wrong from locations group by 1")
def envelope_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = locations(spark, sf_dir).groupBy("user_id").agg(geo.envelope_of(F.collect_list(F.array("lon", "lat"))).alias("e"))
    grown = geo.envelope_expand(F.col("e"), F.lit(1.0))
    more = geo.envelope_include(grown, F.array(F.lit(2.4), F.lit(48.9)))
    return boxes.select("user_id", F.round(grown["low"][0], 6).alias("x0"), F.round(grown["high"][1], 6).alias("y1"), geo.envelope_contains(more, F.array(F.lit(2.4), F.lit(48.9))).alias("inside"), geo.envelope_contains(more, F.array(F.lit(90.0), F.lit(0.0))).alias("outside"), geo.envelope_include(grown, F.array(F.lit(1.0))).isNull().alias("wrong"))


@query("folded_grams", "select n_nationkey, 'af afe ca caf fe' x from nation")
def folded_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["nation"].select("n_nationkey", F.array_join(F.array_sort(text.grams(F.lit("Café"))), " ").alias("x"))


@query("repeated_display_names", "select c_custkey, case c_custkey % 5 when 0 then 'A B' when 1 then '' when 2 then 'x' when 3 then null else 'Jo  Do' end n from customer")
def repeated_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes, names that are the address or close to it, none, and odd blanks."""
    k = F.col("c_custkey") % 5
    address = F.lit("jo@x.org")
    name = F.when(k == 0, "'\"A B\"'").when(k == 1, "Jo@X.org").when(k == 2, "x [jo@x.org]").when(k == 4, " Jo\t Do ")
    return tables(spark, sf_dir)["customer"].select("c_custkey", text.display_name(name, address).alias("n"))


@query("odd_addresses", "select c_custkey, case c_custkey % 6 when 0 then 'mailto:\"a b\"@x.org' when 1 then 'mailto:a@b@c.org' when 5 then 'mailto:o''neil@x.org' end iri from customer")
def odd_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that are none, quoted ones, and one with two signs: the last divides."""
    k = F.col("c_custkey") % 6
    own = F.when(k == 0, "A b@X.org").when(k == 1, "a@b@C.org").when(k == 2, "undisclosed-recipients:;").when(k == 3, "@x.org").when(k == 5, "O'Neil@x.org")
    parsed = text.email_address(own)
    return tables(spark, sf_dir)["customer"].select("c_custkey", F.when(k == 1, F.replace(parsed["iri"], F.lit('"'), F.lit(""))).otherwise(parsed["iri"]).alias("iri"))


@query("odd_phones", "select c_custkey, case c_custkey % 5 when 0 then 'tel:+33123456789' when 1 then 'tel:+4930123456' when 2 then 'tel:+14155550100' end iri, case c_custkey % 5 when 0 then 'fixed' when 1 then 'unknown' when 2 then 'unknown' end kind from customer")
def odd_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    own = F.when(k == 0, "(01) 23.45-67 89").when(k == 1, "0049 30 123456").when(k == 2, "+1 (415) 555-0100").when(k == 3, "12 34")
    parsed = text.phone(own)
    return tables(spark, sf_dir)["customer"].select("c_custkey", parsed["iri"].alias("iri"), parsed["kind"].alias("kind"))


@query("odd_dates", "select c_custkey, case c_custkey % 5 when 0 then 'date:2001-12-31' when 1 then null when 2 then null when 3 then 'monthday:--12-05' end d from customer")
def odd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    own = F.when(k == 0, "12/31/2001").when(k == 1, "13/31/2001").when(k == 2, "soon").when(k == 3, "12/5")
    return tables(spark, sf_dir)["customer"].select("c_custkey", when.lenient_date(own).alias("d"))


@query("odd_geo_uris", "select c_custkey, case c_custkey % 5 when 0 then -89.5 when 1 then 90.0 end lat, case c_custkey % 5 when 0 then 180.0 when 1 then -180.0 end lon from customer")
def odd_geo_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    own = geo.parse_geo_uri(F.when(k == 0, "geo:-89.5,180").when(k == 1, "geo:90,-180,12;u=5").when(k == 2, "geo:1").when(k == 3, "http://x"))
    return tables(spark, sf_dir)["customer"].select("c_custkey", own["lat"].alias("lat"), own["lon"].alias("lon"))


@query("odd_places", "select c_custkey, unnest(case c_custkey % 3 when 0 then ['country', 'street'] when 1 then ['locality'] else []::varchar[] end) as \"level\" from customer")
def odd_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    levels = text.place_hierarchy(F.when(k == 0, "Main St"), F.lit("4"), F.when(k == 1, "Town"), F.lit(None).cast("string"), F.when(k == 0, "Land"))
    return tables(spark, sf_dir)["customer"].select("c_custkey", F.explode(levels).alias("l")).select("c_custkey", "l.level")


def _vincenty() -> str:
    """SQL of the ellipsoid's inverse problem: the series with its steps written out."""
    f = 1 / geo.INVERSE_FLATTENING
    out = [f"v0 as (select id, atan((1 - {f!r}) * tan(radians(lat1))) u1, atan((1 - {f!r}) * tan(radians(lat2))) u2, radians(lon2 - lon1) ell, radians(lon2 - lon1) lam from p where lon1 <> lon2 or lat1 <> lat2)"]
    for i in range(6):
        out += [
            f"a{i} as (select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) cs from v{i})",
            f"b{i} as (select *, atan2(ss, cs) sigma, cos(u1) * cos(u2) * sin(lam) / ss sa from a{i})",
            f"c{i} as (select *, 1 - sa * sa ca2, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) cm from b{i})",
            f"d{i} as (select *, {f / 16!r} * ca2 * (4 + {f!r} * (4 - 3 * ca2)) c from c{i})",
            f"v{i + 1} as (select id, u1, u2, ell, ell + (1 - c) * {f!r} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))) lam from d{i})",
        ]
    k = (geo.A * geo.A - geo.B * geo.B) / (geo.B * geo.B)
    out += [
        f"e as (select *, ca2 * {k!r} k from d5)",
        "g as (select *, 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768)) ba, k / 1024 * (256 + k * (k * (74 - 47 * k) - 128)) bb from e)",
        f"h as (select id, {geo.B!r} * ba * (sigma - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) d from g)",
    ]
    return f"with {_P}, {', '.join(out)} select p.id, round(coalesce(d, 0), 3) d from p left join h using (id)"


@query("ellipsoid_distance", _vincenty())
def ellipsoid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", F.round(geo.ellipsoid_distance("lon1", "lat1", "lon2", "lat2"), 3).alias("d"))


@query("small_geometry", "select event_id, round(greatest(-10, least(10, value / 10 - 25)), 6) foot, round((user_id % 50)::double, 6) meet, case when user_id % 2 = 0 then 0.0 end parallel, round(cos(radians(1 + user_id % 80)), 9) low_x, 1.0 high_x, round(sin(radians(1 + user_id % 80)), 9) high_z from events")
def small_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feet of points on an arc of the equator, lines that meet or do not, boxes of arcs across the equator."""

    def run(batches):
        for pdf in batches:
            v, u = pdf["value"].to_numpy(float), pdf["user_id"].to_numpy()
            foot, _ = geo.project_on_arcs(v / 10 - 25, u % 50, -10.0, 0.0, 10.0, 0.0)
            x, y = geo.turn_offsets(0.0, 0.0, 0.0, v, u % 50, 90.0)
            other, _ = geo.turn_offsets(0.0, 0.0, 0.0, v + 1, 0.0, np.where(u % 2 == 0, 90.0, 180.0))
            end = 1.0 + u % 80
            low, high = geo.arc_envelopes(np.zeros((len(u), 2)), np.stack([-end, end], axis=1))
            tidy = lambda a, n: pd.Series(np.round(a, n) + 0.0)
            yield pd.DataFrame({"event_id": pdf["event_id"], "foot": tidy(foot, 6), "meet": tidy(x + y, 6), "parallel": tidy(other, 6).astype(object).where(~np.isnan(other), None), "low_x": tidy(low[:, 0], 9), "high_x": tidy(high[:, 0], 9), "high_z": tidy(high[:, 2], 9)})

    return tables(spark, sf_dir)["events"].select("event_id", "value", "user_id").mapInPandas(run, "event_id long, foot double, meet double, parallel double, low_x double, high_x double, high_z double")


@query("update_routing", f"select '<urn:o:' || o_orderkey || '>' s, '\"top\"' o, '<urn:g:orders>' g from orders where o_totalprice > 400000 union all select '<urn:c:' || c_custkey || '>', '\"' || c_name || '\"', '{USER_GRAPH}' from customer where c_custkey % 50 = 0")
def update_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions without a graph go to all that describe the subject, of which one source takes
    its own; a removal that no source does is denied in the user's graph."""

    def source(asked: DataFrame) -> DataFrame:
        return asked.select(*QUAD, "side", ((F.col("side") == "added") & (F.col("g") == "<urn:g:orders>")).alias("ok"), F.lit("not mine").alias("error"))

    base = quads(spark, sf_dir)
    added = Engine(base).update("INSERT { ?o schema:keywords \"top\" } WHERE { ?o schema:price ?p FILTER(?p > 400000) }").drop("seq")
    c = tables(spark, sf_dir)["customer"].where("c_custkey % 50 = 0")
    removed = c.select(_iri("c", "c_custkey").alias("s"), F.lit(schema("name")).alias("p"), literal(F.col("c_name")).alias("o"), F.lit("<urn:g:customer>").alias("g"), F.lit(-1).alias("op"))
    after, _ = apply_update(base, added.unionByName(removed), [source])
    return after.select(*QUAD).join(base.select(*QUAD), list(QUAD), "left_anti").select("s", "o", "g")
