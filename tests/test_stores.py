"""Stores that are opened again, streams that are stopped and started, and what plans must not hold."""

import types

import pytest
from pyspark.sql import functions as F

from noetica import checkpoints
from noetica.model import QUADS_DDL, SAME_AS, disjoint
from noetica.plans import registry
from noetica.plans.sparql import Engine, select
from noetica.streaming import pipeline
from noetica.streaming.store import KnowledgeBase, MemoryStore


def quads(spark, rows):
    return spark.createDataFrame(rows, QUADS_DDL)


def held(base):
    return sorted(map(tuple, base.quads().collect()))


def test_base_is_there_again(spark, tmp_path):
    path = str(tmp_path / "kb")
    one, two = ("<a>", "<p>", "<b>", "<g1>"), ("<c>", "<p>", "<d>", "<g2>")
    KnowledgeBase(spark, path).ingest(quads(spark, [one, two]))
    again = KnowledgeBase(spark, path)
    assert held(again) == [one, two]
    before = dict(again.state["folders"])
    again.ingest(quads(spark, [("<a>", "<p>", "<new>", "<g1>")]))
    assert held(KnowledgeBase(spark, path)) == [("<a>", "<p>", "<new>", "<g1>"), two]
    # the bucket of the other graph is where it was
    assert sum(before[b] == f for b, f in again.state["folders"].items()) == 1
    assert again.quads(["<g2>"]).collect()[0].s == "<c>"


def test_base_keeps_no_old_folders(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    for i in range(8):
        base.ingest(quads(spark, [("<a>", "<p>", f"<o{i}>", "<g>")]))
    assert len(base.files.names("data")) <= 4 and len([n for n in base.files.names("manifest") if n.endswith(".json")]) <= 3
    assert held(base) == [("<a>", "<p>", "<o7>", "<g>")]


def test_second_writer_is_refused(spark, tmp_path):
    one, two = KnowledgeBase(spark, str(tmp_path / "kb")), KnowledgeBase(spark, str(tmp_path / "kb"))
    one.ingest(quads(spark, [("<a>", "<p>", "<b>", "<g>")]))
    with pytest.raises(RuntimeError, match="another writer"):
        two.ingest(quads(spark, [("<x>", "<p>", "<y>", "<g>")]))
    assert held(KnowledgeBase(spark, str(tmp_path / "kb"))) == [("<a>", "<p>", "<b>", "<g>")]


def stream(spark, folder):
    return spark.readStream.schema(QUADS_DDL).option("maxFilesPerTrigger", 1).json(str(folder))


def put(spark, folder, rows):
    quads(spark, rows).coalesce(1).write.mode("append").json(str(folder))


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "kb"), str(tmp_path / "cp")
    put(spark, folder, [("<a>", "<p>", "<b>", "<g1>")])
    pipeline.run_stream(stream(spark, folder), KnowledgeBase(spark, path), [], checkpoint, once=True).awaitTermination()
    put(spark, folder, [("<c>", "<p>", "<d>", "<g2>")])
    pipeline.run_stream(stream(spark, folder), KnowledgeBase(spark, path), [], checkpoint, once=True).awaitTermination()
    assert held(KnowledgeBase(spark, path)) == [("<a>", "<p>", "<b>", "<g1>"), ("<c>", "<p>", "<d>", "<g2>")]


def test_batch_that_failed_half_way_is_taken_up(spark, tmp_path):
    """The first enricher is stored, the second fails; the batch comes again and each counts once."""
    folder, path, checkpoint, calls = tmp_path / "in", str(tmp_path / "kb"), str(tmp_path / "cp"), []
    put(spark, folder, [("<a>", "<p>", "<b>", "<g>")])

    def marks(name, fail=False):
        def enrich(spark_, base, diff):
            calls.append((name, diff.count()))
            if fail and len([c for c in calls if c[0] == name]) == 1:
                raise ValueError("no luck")
            return diff.where(F.col("p") == "<p>").select("s", F.lit(f"<{name}>").alias("p"), "o", F.lit("<own>").alias("g"), "op")

        return enrich

    chain = [marks("one"), marks("two", fail=True)]
    with pytest.raises(Exception, match="no luck"):
        pipeline.run_stream(stream(spark, folder), KnowledgeBase(spark, path), chain, checkpoint, once=True).awaitTermination()
    assert len(held(KnowledgeBase(spark, path))) == 2
    pipeline.run_stream(stream(spark, folder), KnowledgeBase(spark, path), chain, checkpoint, once=True).awaitTermination()
    assert [p for _, p, _, _ in held(KnowledgeBase(spark, path))] == ["<one>", "<p>", "<two>"]
    assert calls == [("one", 1), ("two", 2), ("two", 2)]
    # a batch that is known counts no more
    assert KnowledgeBase(spark, path).ingest(quads(spark, [("<x>", "<p>", "<y>", "<z>")]), [], "documents", -1).isEmpty()


def test_memory_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "snap"), every=2)
    row = lambda o: quads(spark, [("<a>", "<p>", o, "<g>")]).withColumn("op", F.lit(1))
    store.commit(row("<1>"))
    assert MemoryStore(spark, str(tmp_path / "snap")).quads().isEmpty()
    store.commit(row("<2>"))
    assert held(MemoryStore(spark, str(tmp_path / "snap"))) == held(store) and len(held(store)) == 2


def test_open_clusters_are_given_out(spark, tmp_path):
    """The last stay of a user comes when the user has been idle for long, not with the next location."""
    rows = [("a", i, f"2024-01-01 {10 + i // 60:02d}:{i % 60:02d}:00") for i in range(0, 60, 5)]
    late = [("b", 1000, "2024-01-05 10:00:00"), ("b", 1001, "2024-01-05 10:01:00")]
    for k, own in enumerate([rows, late, [("c", 2000, "2024-01-09 10:00:00")]]):
        spark.createDataFrame(own, "user_id string, id long, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    raw = spark.readStream.schema("user_id string, id long, ts string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    located = raw.select("user_id", "id", F.to_timestamp("ts").alias("ts"), F.lit(2.35).alias("lon"), F.lit(48.85).alias("lat"), F.lit(20.0).alias("acc")).withWatermark("ts", "1 minute")
    query = pipeline.streaming_stays(located).writeStream.format("memory").queryName("stays_given_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("stays_given_out").collect()
    assert [(r.user_id, r.n_points) for r in got] == [("a", 12)]


def test_merged_diffs_last_operation_counts(spark):
    rows = [("s", f"2024-01-01 00:00:0{t}", "<a>", "<p>", "<o>", None, op, t) for t, op in ((1, 1), (5, -1))] + [("s", "2024-01-01 00:00:05", "<b>", "<p>", "<o>", "<g>", 1, 9), ("s", "2024-01-01 01:00:00", "<a>", "<p>", "<o>", None, 1, 10)]
    diffs = spark.createDataFrame(rows, "source string, ts string, s string, p string, o string, g string, op int, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = pipeline.merged_diffs(diffs).orderBy("start").collect()
    assert [[(q.s, q.op) for q in r.diff] for r in got] == [[("<a>", -1), ("<b>", 1)], [("<a>", 1)]]


def test_progress(spark):
    own = pipeline.Progress({"q": 100})
    own.onQueryStarted(types.SimpleNamespace(id=1, name="q", timestamp="t0"))
    own.onQueryProgress(types.SimpleNamespace(progress=types.SimpleNamespace(id=1, name="q", numInputRows=40, processedRowsPerSecond=20.0, timestamp="t1")))
    assert own.status()[0]["progress"] == 40 and own.status()[0]["seconds_left"] == 3.0
    own.onQueryTerminated(types.SimpleNamespace(id=1, exception=None))
    assert own.status()[0]["status"] == "done"


def test_no_folder_of_one_machine_on_a_cluster():
    spark = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared_dir(spark)


# -- plans


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(f"<n{i}>", "<in>", f"<r{i % 3}>", "<g>") for i in range(9)] + [(f"<r{i}>", "<name>", f'"R{i}"', "<g>") for i in range(3)] + [("<n1>", "<near>", "<n2>", "<h>"), ("<n1>", "<near>", "<n2>", "<g>")]
    return quads(spark, rows)


UNSURE = [
    "SELECT * WHERE { ?n <in> ?x OPTIONAL { ?n <in> ?r FILTER(?r = <r1>) } { ?r <name> ?l } }",
    "SELECT * WHERE { ?n <in> ?x OPTIONAL { ?n <near> ?m } OPTIONAL { ?m <in> ?r } }",
    "SELECT * WHERE { VALUES (?n ?r) { (<n1> UNDEF) (UNDEF <r2>) } ?n <in> ?r }",
    "SELECT * WHERE { ?n <in> ?r OPTIONAL { ?n <near> ?m } MINUS { ?m <in> ?r } }",
    "SELECT * WHERE { ?n <in> ?r OPTIONAL { ?n <near> ?m } FILTER NOT EXISTS { ?m <in> ?z } }",
    "SELECT * WHERE { ?n <in> ?r OPTIONAL { ?n <near> ?m } FILTER(?n = <n5> || EXISTS { ?m <in> <r2> }) }",
    "SELECT * WHERE { { ?n <in> ?r } UNION { ?m <near> ?n } OPTIONAL { ?r <name> ?l } { ?r <name> ?k } }",
    "SELECT * WHERE { ?a <near> ?b . ?c <name> ?d }",
]


def solutions(rows, pattern):
    """Basic patterns by brute force: the triples as bindings."""
    out = []
    for t in rows:
        b = {}
        if all(b.setdefault(p, x) == x if p.startswith("?") else p == x for p, x in zip(pattern, t, strict=True)):
            out.append(b)
    return out


def compatible(a, b):
    return all(b.get(k, v) == v for k, v in a.items())


def joined(a, b):
    return [{**x, **y} for x in a for y in b if compatible(x, y)]


def optional(a, b):
    return [z for x in a for z in ([{**x, **y} for y in b if compatible(x, y)] or [x])]


def test_unbound_variables_by_brute_force(graph):
    triples = sorted({tuple(r)[:3] for r in graph.collect()})
    q = lambda *p: solutions(triples, p)
    near, name, inside = lambda a, b: q(a, "<near>", b), lambda a, b: q(a, "<name>", b), lambda a, b: q(a, "<in>", b)
    want = [
        joined(optional(inside("?n", "?x"), [b for b in inside("?n", "?r") if b["?r"] == "<r1>"]), name("?r", "?l")),
        optional(optional(inside("?n", "?x"), near("?n", "?m")), inside("?m", "?r")),
        joined([{"?n": "<n1>"}, {"?r": "<r2>"}], inside("?n", "?r")),
        [a for a in optional(inside("?n", "?r"), near("?n", "?m")) if not any(compatible(a, b) and set(a) & set(b) for b in inside("?m", "?r"))],
        [a for a in optional(inside("?n", "?r"), near("?n", "?m")) if not any(compatible(a, b) for b in inside("?m", "?z"))],
        [a for a in optional(inside("?n", "?r"), near("?n", "?m")) if a["?n"] == "<n5>" or any(compatible(a, b) for b in inside("?m", "<r2>"))],
        joined(optional(inside("?n", "?r") + near("?m", "?n"), name("?r", "?l")), name("?r", "?k")),
        joined(near("?a", "?b"), name("?c", "?d")),
    ]
    for text, rows in zip(UNSURE, want, strict=True):
        df = Engine(graph).solutions(text)
        got = sorted(str(sorted((f"?{k}", v) for k, v in r.asDict().items() if v is not None)) for r in df.collect())
        assert got == sorted(str(sorted(b.items())) for b in rows), text


@pytest.mark.parametrize("text", UNSURE)
def test_no_cartesian_product(graph, text):
    plan = Engine(graph).solutions(text)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_many_unsure_variables(graph):
    """Above PARTS variables the rows are not parted; the solutions are the same."""
    text = "SELECT * WHERE { ?n <in> ?x OPTIONAL { ?n <near> ?m } OPTIONAL { ?m <in> ?r } }"
    from noetica.plans.sparql import engine

    want = sorted(map(str, Engine(graph).solutions(text).collect()))
    old, engine.PARTS = engine.PARTS, 0
    try:
        assert sorted(map(str, Engine(graph).solutions(text).collect())) == want
    finally:
        engine.PARTS = old


def test_disjoint_is_not_inherited(spark, graph):
    marked = disjoint(graph.where("g = '<g>'"))
    assert Engine(marked).disjoint and not Engine(marked.where("true")).disjoint and not Engine(marked.union(marked)).disjoint
    twice = marked.unionByName(marked)
    assert select(twice, "SELECT * WHERE { ?a <near> ?b }").count() == 1


def test_long_closures(spark):
    """A chain longer than the rounds that follow the frontier, and a cycle."""
    n = 40
    chain = quads(spark, [(f"<c{i}>", "<next>", f"<c{i + 1}>", "<g>") for i in range(n)] + [(f"<c{n}>", "<next>", "<c35>", "<g>")])
    got = lambda text: sorted(r[0] for r in select(chain, text).collect())
    assert got("SELECT ?x WHERE { <c0> <next>+ ?x }") == sorted(f"c{i}" for i in range(1, n + 1))
    assert got("SELECT ?x WHERE { ?x <next>+ <c3> }") == ["c0", "c1", "c2"]
    assert got("SELECT ?x WHERE { <c40> <next>* ?x }") == sorted(f"c{i}" for i in range(35, n + 1))
    assert select(chain, f"SELECT ?x ?y WHERE {{ VALUES ?x {{ <c0> <c39> }} ?x <next>+ ?y }}").count() == n + 6


def test_all_queries_are_named_once():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and SAME_AS.startswith("<")
