"""SPARQL, diffs, graphs, inference and resolution on small inputs."""

import itertools
import random

import numpy as np
import pytest

from noetica.functions import geo, prob, text
from noetica.model import DIFFERENT_FROM, QUADS_DDL, SAME_AS, TYPE, apply_diff, compose, document_diff, negate
from noetica.operators import alignment, graph, inference, relational, resolve, stays
from noetica.plans import queries_data, registry, sparql, updates
from noetica.plans.sparql.parser import Parser, SparqlError

XSD = "http://www.w3.org/2001/XMLSchema#"


@pytest.fixture(scope="module")
def quads(spark):
    rows = [
        ("<u:a>", "<u:p>", "<u:b>", "<u:g1>"), ("<u:b>", "<u:p>", "<u:c>", "<u:g1>"), ("<u:c>", "<u:p>", "<u:a>", "<u:g1>"), ("<u:a>", "<u:name>", '"Ann"@en', "<u:g1>"),
        ("<u:b>", "<u:age>", f'"7"^^<{XSD}integer>', "<u:g2>"), ("<u:a>", "<u:age>", f'"12.5"^^<{XSD}decimal>', "<u:g2>"), ("<u:a>", "<u:p>", "<u:b>", "<u:g2>"),
    ]
    return spark.createDataFrame(rows, QUADS_DDL)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT ?x ?y WHERE { ?x <u:p> ?y }", [("u:a", "u:b"), ("u:b", "u:c"), ("u:c", "u:a")]),
        ("SELECT ?x WHERE { <u:a> <u:p>+ ?x }", [("u:a",), ("u:b",), ("u:c",)]),
        ("SELECT ?x ?n WHERE { ?x <u:age> ?a OPTIONAL { ?x <u:name> ?n } FILTER(?a > 5) }", [("u:a", "Ann"), ("u:b", None)]),
        ("SELECT ?x WHERE { ?x <u:p> ?y FILTER NOT EXISTS { ?x <u:name> ?n } }", [("u:b",), ("u:c",)]),
        ("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) WHERE { ?x <u:age> ?a }", [("2", "19.5")]),
        ("SELECT ?g (COUNT(?x) AS ?n) WHERE { GRAPH ?g { ?x ?p ?y } } GROUP BY ?g HAVING(COUNT(?x) > 3)", [("u:g1", "4")]),
        ("SELECT ?x ?z WHERE { VALUES ?x { <u:a> <u:c> } ?x <u:p>/^<u:p> ?z }", [("u:a", "u:a"), ("u:c", "u:c")]),
        ("SELECT ?x WHERE { { ?x <u:age> ?a } UNION { ?x <u:name> ?n } MINUS { ?x <u:age> 7 } }", [("u:a",), ("u:a",)]),
        ('SELECT (UCASE(STR(?n)) AS ?u) (LANG(?n) AS ?l) WHERE { ?x <u:name> ?n FILTER(REGEX(?n, "^a", "i")) }', [("ANN", "en")]),
        ("SELECT DISTINCT ?x WHERE { ?x <u:p> ?y } ORDER BY DESC(?x) LIMIT 1", [("u:c",)]),
    ],
)
def test_select(quads, query, want):
    assert sorted(map(tuple, sparql.select(quads, query).collect()), key=str) == sorted(want, key=str)


def test_other_forms(quads):
    assert sparql.ask(quads, "ASK { ?x <u:age> 7 }") and not sparql.ask(quads, "ASK { ?x <u:age> 8 }")
    assert sparql.construct(quads, "CONSTRUCT { ?y <u:q> ?x } WHERE { ?x <u:p> ?y }").count() == 3
    assert sparql.describe(quads, "DESCRIBE <u:b>").count() == 2
    with pytest.raises(SparqlError):
        Parser("SELECT ?x WHERE { SERVICE <u:s> { ?x ?p ?o } }").query()


def test_update_routing(spark, quads):
    diff = sparql.update(quads, 'DELETE DATA { <u:a> <u:name> "Ann"@en } ; INSERT DATA { <u:b> <u:name> "Bob" }')

    def source(asked):
        return asked.selectExpr("s", "p", "o", "g", "side", "side = 'added' and g = '<u:g1>' as ok", "'no' as error")

    after, outcome = updates.apply_update(quads, diff.drop("seq"), [source])
    rows = {(r.s, r.p, r.o, r.g) for r in after.collect()}
    assert ("<u:b>", "<u:name>", '"Bob"', "<u:g1>") in rows
    assert any(r[0] == "<u:a>" and "negation" in r[1] and r[3] == updates.USER_GRAPH for r in rows)
    assert outcome.where("side = 'removed' and not ok").count() == 1


def test_diff_algebra(spark):
    rnd = random.Random(2)
    make = lambda n: spark.createDataFrame([(f"<s{rnd.randint(0, 9)}>", "<p>", f"<o{rnd.randint(0, 3)}>", "<g>") for _ in range(n)], QUADS_DDL)
    old, new = make(20).distinct(), make(20)
    got = {tuple(r) for r in apply_diff(old, document_diff(new, old)).collect()}
    assert got == {tuple(r) for r in new.collect()}
    steps = spark.createDataFrame([("s", "p", "o", "g", op, seq) for seq, op in enumerate((1, -1, 1))] + [("t", "p", "o", "g", -1, 9)], QUADS_DDL + ", op int, seq long")
    assert {(r.s, r.op) for r in compose(steps).collect()} == {("s", 1), ("t", -1)}
    df = spark.createDataFrame([(SAME_AS,), ("<u:p q>",)], "p string").select("p", negate(negate(__import__("pyspark").sql.functions.col("p"))).alias("back"))
    assert all(r.p == r.back for r in df.collect())
    assert spark.createDataFrame([(SAME_AS,)], "p string").select(negate(__import__("pyspark").sql.functions.col("p"))).first()[0] == DIFFERENT_FROM


def test_components_and_closure(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(df).collect()} == {(n, find(n)) for n in parent}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    assert {tuple(r) for r in graph.transitive_closure(df).collect()} == reach
    assert graph.connected_components(df.limit(0)).count() == 0


def test_small_graphs():
    assert graph.min_cost_flow([(0, 1, 1, 0), (1, 2, 1, 4), (1, 3, 1, 10), (2, 4, 1, 1), (3, 4, 1, 3)], 0, 4)[:2] == (1, 5)
    rng = np.random.default_rng(0)
    for _ in range(60):
        r, c = map(int, rng.integers(1, 6, 2))
        cost = rng.random((r, c))
        got = sum(cost[i, j] for i, j in enumerate(graph.assignment(cost)) if j >= 0)
        k = min(r, c)
        best = min(sum(cost[i, p[n]] for n, i in enumerate(rows)) for rows in itertools.combinations(range(r), k) for p in itertools.permutations(range(c), k))
        assert abs(got - best) < 1e-9
    net = {0: [(1.0, 1), (4.0, 2)], 1: [(1.0, 2)], 2: []}
    distance, parent, target = graph.dijkstra(lambda n: net[n], [0], lambda n: n == 2)
    assert distance[2] == 2 and graph.path_to(parent, target) == [0, 1, 2]


def test_alignment():
    places = lambda q, t: [m and (m.lo, m.hi) for m in alignment.align(q, t)]
    assert places(["JOHN", "SMITH"], "SMITH.JOHN") == [(6, 9), (0, 4)]
    assert places(["gbbbg", "gaaaaaa"], "gbbbg.gaaaaaa") == [(0, 4), (6, 12)]
    assert places(["aaaaaa", "bbbbbbbbbbb", "aaaaaa"], "aaaaaa.bbbbbbbbbbb") == [(0, 5), (7, 17), None]
    assert places(["abbbbb", "aaaaaa"], "abbb") == [(0, 3), None]
    assert alignment.local("xxabcx", "yabcy") == (3, (2, 5), (1, 4))


def test_inference(spark):
    rows = [("<c>", inference.INVERSE_OF, "<p>"), ("<q>", TYPE, inference.SYMMETRIC), ("<t>", TYPE, inference.TRANSITIVE), ("<x>", "<p>", "<y>"), ("<x>", "<q>", "<z>"), ("<1>", "<t>", "<2>"), ("<2>", "<t>", "<3>"), ("<3>", "<t>", "<1>")]
    got = {tuple(r) for r in inference.owl_closure(spark.createDataFrame(rows, "s string, p string, o string")).collect()}
    assert {("<y>", "<c>", "<x>"), ("<z>", "<q>", "<x>"), ("<1>", "<t>", "<3>"), ("<1>", "<t>", "<1>"), ("<p>", inference.INVERSE_OF, "<c>")} <= got
    support = spark.createDataFrame([("s", "p", "o", "g", 1)], QUADS_DDL + ", n long")
    changes = spark.createDataFrame([("s", "p", "o", "g", -1), ("t", "p", "o", "g", 1)], QUADS_DDL + ", op int")
    now, diff = inference.counted(support, changes)
    assert {r.s for r in now.collect()} == {"t"} and {(r.s, r.op) for r in diff.collect()} == {("s", -1), ("t", 1)}


def test_blocking(spark):
    entries = spark.createDataFrame(list(enumerate(["John Doe", "Does John", "Alice Wonders", "Alic Wondrs"], 1)), "id long, text string")
    for q, want in {"John": {1, 2}, "Doe": {1, 2}, "Alice": {3, 4}, "Wonders": {3}}.items():
        asked = spark.createDataFrame([(0, q)], "id long, text string")
        assert {r.e for r in relational.blocking_pairs(asked, entries, 80).collect()} == want


def test_agents(spark):
    names = spark.createDataFrame([("a", "Jean Dupont", 5), ("b", "Dupont, Jean", 0), ("c", "Marie Curie", 2), ("d", "Paul Martin", 1)], "agent string, name string, msg_count long")
    assert [(r.a, r.b) for r in resolve.match_agents(names).collect()] == [("a", "b")]
    assert resolve.match_agents(names, spark.createDataFrame([("b", "a")], "src string, dst string")).count() == 0


def test_probabilistic_alignment(spark):
    facts = spark.createDataFrame([("x1", "email", "m1"), ("x2", "email", "m1"), ("x2", "name", "n2"), ("x1", "name", "n1"), ("x3", "name", "n3")], "x string, p string, y string")
    eq = spark.createDataFrame([("n1", "n2", 0.8), ("n2", "n1", 0.8)], "y string, y2 string, eq double")
    got = {(r.x, r.x2): r.score for r in resolve.paris(facts, eq).collect()}
    pos = (1 - 0.99) * (1 - 0.97007 * 0.8)
    neg = (1 - 0.87314 * 0.0) * (1 - 0.80435 * 0.2)
    assert got.keys() == {("x1", "x2"), ("x2", "x1")} and abs(got["x1", "x2"] - (1 - pos) * neg) < 1e-9


def test_stays():
    rows = [(i, 60.0 * i, 2.35, 48.85, 20.0) for i in range(40)]
    rows += [(100 + i, 2400 + 120.0 * i, 2.35 + 0.01 * i, 48.85, 20.0) for i in range(1, 20)]
    rows += [(200 + i, 5000 + 60.0 * i, 2.6, 48.9, 20.0) for i in range(40)]
    long_ = [c for c in stays.clusters_of(rows) if c.last - c.first >= stays.MIN_STAY]
    assert len(long_) == 2 and [len(c.ids) for c in long_] == [40, 40]
    lon, lat, var = long_[0].centre()
    assert abs(lon - 2.35) < 1e-9 and abs(var - 400) < 1e-6
    kept = stays.trellis([(r[0], r[1], r[2], r[3], None) for r in rows])
    assert [i for i, _ in kept] == [r[0] for r in rows[1:]]
    assert stays.trellis([]) == []


def test_geodesy(spark):
    d, a1, _ = geo.ellipsoid_inverse([2.35], [48.85], [2.36], [48.86])
    lon, lat = geo.ellipsoid_direct([2.35], [48.85], a1, d)
    assert abs(lon[0] - 2.36) < 1e-9 and abs(lat[0] - 48.86) < 1e-9
    rnd = random.Random(3)
    for _ in range(200):
        x, y, e, u = rnd.uniform(-180, 180), rnd.uniform(-89, 90), rnd.choice([None, rnd.uniform(0, 2e4)]), rnd.choice([None, rnd.uniform(0, 1e5)])
        uri = geo.geo_uri_of(x, y, e, u)
        assert "e" not in uri[4:].replace("u=", "") and float(uri[4:].split(",")[0]) == y
    assert geo.project_on_arc(0, 1, -10, 0, 10, 0) == pytest.approx((0, 0), abs=1e-9)
    low, high = geo.arc_envelope([(-10, 60), (10, 60)])
    assert high[2] > np.sin(np.radians(60)) and low[1] < 0 < high[1]


def test_near_pairs(spark):
    rnd = random.Random(4)
    points = [(i, rnd.uniform(-180, 180), rnd.choice([rnd.uniform(-80, 80), 60 + rnd.random() / 100])) for i in range(150)] + [(900, 179.9999, 10.0), (901, -179.9999, 10.0)]
    got = {(r.a, r.b) for r in relational.near_pairs(spark.createDataFrame(points, "id long, lon double, lat double"), 50_000.0).collect()}
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and stays.haversine_of(a[1], a[2], b[1], b[2]) <= 50_000}
    assert got == want and (900, 901) in got


def test_draws_and_similarity():
    draws = prob.Draws(1)
    weights = np.array([10, 5, 15])
    n = np.bincount(draws.weighted(weights, 200_000), minlength=3) / 200_000
    assert abs(n - weights / 30).mean() <= 0.01
    pairs = draws.ordered_pairs(6, 50_000)
    assert (pairs[:, 0] < pairs[:, 1]).all() and len({tuple(p) for p in pairs.tolist()}) == 15
    weighted = draws.weighted_ordered_pairs(np.array([5, 15, 10]), 200_000)
    share = np.array([(weighted == p).all(axis=1).mean() for p in ((0, 1), (0, 2), (1, 2))])
    assert abs(share - np.array([75, 50, 150]) / 275).mean() <= 0.01
    assert abs(text.jaro_winkler_of("martha", "marhta") - 0.9611) < 1e-3 and text.jaro_winkler_of("", "") == 1.0
    assert text.unquote_text("\"'a'\"") == "a"


def test_merged_lists(spark):
    import pandas as pd

    rnd = random.Random(2)
    lists = [[(k, n, r, float(rnd.randint(0, 9) * 2000)) for k in "abc" for r in range(rnd.randint(0, 8))] for n in (1, 2)]
    columns = ["key", "list", "rank", "distance"]
    frames = [spark.createDataFrame(rows, "key string, list int, rank int, distance double") for rows in lists]
    got = relational.merge_ranked_lists(*frames, "key", "rank").orderBy("key", "rank").collect()
    want = []
    for k in "abc":
        one, two = (pd.DataFrame([x for x in rows if x[0] == k], columns=columns) for rows in lists)
        want += [(k, r.list, i, r.distance) for i, r in enumerate(relational.merge_ranked(one, two).itertuples(), 1)]
    assert [(r.key, r["list"], r["rank"], r.distance) for r in got] == want


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "met John Doe today"), (2, "alice"), (3, ""), (4, None)], "id int, text string")
    entries = spark.createDataFrame([(10, "John Doe"), (11, "Alice Wonders")], "id int, text string")
    assert {tuple(r) for r in relational.phrase_search(texts, entries).collect()} == {(1, 1, 2, 10), (2, 0, 1, 11)}
    assert {tuple(r) for r in relational.phrase_search(texts, entries, nested=True).collect()} == {(1, 1, 1, 10), (1, 2, 1, 10), (1, 1, 2, 10), (2, 0, 1, 11)}
    assert relational.phrase_search(texts.limit(0), entries).count() == 0


def test_part_types(spark):
    rnd = random.Random(4)
    evidence = [(f"p{rnd.randint(0, 12)}", f"p{rnd.randint(0, 12)}", float(rnd.randint(1, 5))) for _ in range(14)]
    known = {"p0": "given", "p1": "family", "p9": "given"}
    want = resolve.infer_part_types(evidence, known)
    got = resolve.part_types(spark.createDataFrame(evidence, "a string, b string, cost double"), spark.createDataFrame(list(known.items()), "part string, type string"))
    assert {r.part: (r.type, r.distance) for r in got.collect()} == want


def test_global_clusters(spark):
    rnd = np.random.default_rng(5)
    points = np.stack([2 + rnd.random(60) * 0.02, 48 + rnd.random(60) * 0.02], axis=1)
    want = {i: min(c) for c in stays.greedy_clusters(points, 200.0) for i in c}
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    assert {r.id: r.cluster for r in stays.global_clusters(df, 200.0).collect()} == want


def test_closure_doubles(spark):
    chain = [(i, i + 1) for i in range(20)] + [(20, 17), (30, 30), (30, 30)]
    got = {tuple(r) for r in graph.transitive_closure(spark.createDataFrame(chain, "src int, dst int")).collect()}
    want = set(chain)
    while more := {(a, d) for a, b in want for c, d in chain if b == c} - want:
        want |= more
    assert got == want


def test_shortest_paths_without_bound(spark, monkeypatch):
    n, sizes = 900, [random.Random(i).randint(1, 50) for i in range(900)]
    part = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "p_partkey long, p_size int").coalesce(1)
    monkeypatch.setattr(queries_data, "tables", lambda *_: {"part": part})
    want, *_ = graph.dijkstra(lambda i: [(1 + sizes[i] % 7, (i * 5 + 2) % n), (9, (i + 1) % n)], [0])
    assert len(want) == n and max(want.values()) > 60
    got = registry.queries()["shortest_paths_whole"](spark, "").collect()
    assert len(got) == n and {r.node: r.distance for r in got} == want
    got = registry.queries()["shortest_paths"](spark, "").collect()  # its SQL stops at 60
    assert {r.node: r.distance for r in got} == {i: d for i, d in want.items() if d <= 60}
