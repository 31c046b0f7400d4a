"""What grows with the input: operators on tables that once made them grow faster, or differ."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noetica.operators import places


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reverse_sorts_no_candidates(spark):
    """Many points and places at few positions: the nearest, the least of equal ones, and no sort of candidates."""
    rnd = random.Random(1)
    spots = [(2.35 + rnd.uniform(0, 0.02), 48.85 + rnd.uniform(0, 0.02)) for _ in range(12)]
    points = [(i, *rnd.choice(spots)) for i in range(300)]
    named = [(1000 - i, *rnd.choice(spots[3:])) for i in range(200)]
    got = places.reverse(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(named, "place long, lon double, lat double"), 400.0)
    from noetica.operators.stays import haversine_of

    want = {}
    for i, x, y in points:
        near = sorted((round(float(haversine_of(x, y, a, b)), 6), p) for p, a, b in named)
        if near[0][0] <= 400:
            want[i] = near[0]
    assert {r.id: (round(r.distance, 6), r.place) for r in got.collect()} == want
    assert "SortAggregate" not in plan_of(got)


def test_geometry_in_arrays():
    """A hundred thousand feet, turns and boxes at once, the same as one by one."""
    import time

    from noetica.functions import geo

    rng = np.random.default_rng(3)
    n = 100_000
    lon, lat, a, b = rng.uniform(-170, 170, n), rng.uniform(-80, 80, n), rng.uniform(-170, 170, (n, 2)), rng.uniform(-80, 80, (n, 2))
    a[:50, 1], b[:50, 1] = a[:50, 0], b[:50, 0]  # arcs without length
    heading = np.where(np.arange(n) % 3 == 0, 0.0, 75.0)
    began = time.process_time()
    x, y = geo.project_on_arcs(lon, lat, a[:, 0], b[:, 0], a[:, 1], b[:, 1])
    low, high = geo.arc_envelopes(a, b)
    tx, ty = geo.turn_offsets(lon, lat, 0.0, a[:, 0], b[:, 0], heading)
    assert time.process_time() - began < 5
    for i in range(200):
        assert geo.project_on_arc(lon[i], lat[i], a[i, 0], b[i, 0], a[i, 1], b[i, 1]) == pytest.approx((x[i], y[i]), abs=1e-9)
        one = geo.arc_envelope(list(zip(a[i], b[i], strict=True)))
        assert np.allclose(one, (low[i], high[i]), atol=1e-12)
        # a box holds its arc, and touches it
        t = np.linspace(0, 1, 2000)[:, None]
        ends = geo._units(a[i], b[i])
        arc = geo._normed(ends[0] * (1 - t) + ends[1] * t)[0]
        assert (arc >= low[i] - 1e-9).all() and (arc <= high[i] + 1e-9).all() and np.allclose(arc.min(axis=0), low[i], atol=1e-2) and np.allclose(arc.max(axis=0), high[i], atol=1e-2)
        turn = geo.turn_offset((lon[i], lat[i]), 0.0, (a[i, 0], b[i, 0]), heading[i])
        assert (turn is None) == (i % 3 == 0) == bool(np.isnan(tx[i])) and (turn is None or turn == pytest.approx((tx[i], ty[i])))


def test_shares_of_zero(spark):
    """A weight of zero has a share of zero, not null."""
    from noetica.functions import prob

    df = spark.createDataFrame([(1, 0.0), (1, 3.0), (1, 1.0), (2, 0.0), (2, 5.0)], "k long, w double").withColumn("lw", prob.log_weight(F.col("w")))
    got = sorted((r.k, r.w, round(r.share, 9)) for r in prob.normalised(df, ["k"], "lw", "share").collect())
    assert got == [(1, 0.0, 0.0), (1, 1.0, 0.25), (1, 3.0, 0.75), (2, 0.0, 0.0), (2, 5.0, 1.0)]


def test_place_ids_are_made_once(spark):
    """Ids are chained, and the expression does not hold a parent's again and again."""
    import hashlib
    import uuid

    from noetica.functions import text

    df = spark.createDataFrame([("Main St", "4", "Town", "R", "Land"), (None, "4", None, "R", None), (None, None, None, None, None)], "s string, n string, l string, r string, c string")
    levels = text.place_hierarchy(*(F.col(c) for c in "snlrc"))
    own = lambda *x: str(uuid.UUID(bytes=hashlib.md5("/".join(x).encode()).digest(), version=3))
    chain, want = None, []
    for level, name in (("country", "Land"), ("region", "R"), ("locality", "Town"), ("street", "4 Main St")):
        parent, chain = chain, own(*([chain] if chain else []), level, name)
        want.append((level, name, chain, parent))
    got = [[tuple(x) for x in r.p] for r in df.select(levels.alias("p")).collect()]
    assert got == [want, [("region", "R", own("region", "R"), None)], []]
    assert df.select(levels.alias("p"))._jdf.queryExecution().analyzed().toString().count("md5") < 20


def test_equal_parts_are_added_before(spark):
    """Parts that an agent has again and again, and many agents with one part: the plain result, no group per agent."""
    from noetica.operators import resolve

    rnd = random.Random(5)
    words = ["anna", "annna", "anne", "bernd", "berndt", "dora", "dorra", "x"]
    rows = [(f"a{rnd.randrange(6)}", rnd.choice(words), float(rnd.randrange(4))) for _ in range(400)] + [(f"b{i}", "one", 2.0) for i in range(200)]
    found = resolve.deduplicate_parts(spark.createDataFrame(rows, "agent string, part string, weight double"))
    got = {}
    for r in found.collect():
        got.setdefault(r.agent, {})[r.part] = r.weight
    assert got == {a: dict(resolve.merge_similar_parts([(p, w) for b, p, w in rows if b == a])) for a in {r[0] for r in rows}}
    assert "FlatMapGroupsInPandas" not in plan_of(found) and plan_of(found).count("HashAggregate") >= 2


def test_equal_texts_are_aligned_once(monkeypatch):
    import pandas as pd

    from noetica.operators import resolve

    asked = []
    monkeypatch.setattr(resolve, "align", lambda queries, text: asked.append(text) or [None] * len(queries))
    resolve._aligned.cache_clear()
    resolve._local_parts.func(pd.Series([["JANE", "DOE"]] * 500 + [None]), pd.Series(["JANE.DOE"] * 500 + ["X"]))
    resolve._aligned.cache_clear()
    assert asked == ["JANE.DOE", "X"]


def test_near_names_as_one_by_one():
    """Blocks of names give the pairs and scores of the plain function, both ways, with repeated and many terms."""
    from noetica.functions.text import jaro_winkler_of
    from noetica.operators import resolve

    rnd = random.Random(8)
    words = ["".join(rnd.choice("abc1") for _ in range(rnd.randint(1, 7))) for _ in range(60)] + ["x" * 70, "meier", "meyer", "maier"]
    there, back = resolve.jaro_winkler_matrices(words[:60], words[20:60])
    for i, a in enumerate(words[:60]):
        for j, b in enumerate(words[20:60]):
            assert there[i, j] == jaro_winkler_of(a, b) and back[i, j] == jaro_winkler_of(b, a)
    idf = {w: rnd.choice([0.0, 0.5, 1.0, 3.0, rnd.random()]) for w in words}
    names = [[(w, idf[w]) for w in rnd.choices(words, k=rnd.choice([0, 1, 2, 2, 3, 4, 6]))] for _ in range(90)]
    i, j, *scores, shared = resolve._near_in_block(names[:50], names[40:], 0.8)
    got = {(a, b): (s, t, bool(z)) for a, b, s, t, z in zip(i, j, *scores, shared, strict=True)}
    for a, x in enumerate(names[:50]):
        for b, y in enumerate(names[40:]):
            s, t = (resolve.soft_tf_idf_of([w for w, _ in p], [w for w, _ in q], idf) for p, q in ((x, y), (y, x)))
            assert ((a, b) in got) == (max(s, t) >= 0.8)
            if (a, b) in got:
                assert got[a, b] == (pytest.approx(s), pytest.approx(t), bool({w for w, _ in x} & {w for w, _ in y}))
    assert len(got) > 10


def test_match_agents_pairs_no_strangers(spark, monkeypatch):
    """Agents that share a frequent term only are not scored in full, and the result stays that of all candidates."""
    from noetica.operators import resolve

    rnd = random.Random(2)
    rows = [(f"s{k}", f"Supplier#{k * 37 % 1000:09d}", 2) for k in range(40)] + [(f"t{k}", f"supplier nr {k * 37 % 1000:09d}", 0) for k in range(40)]
    rows += [(f"p{k}", f"{rnd.choice(['Anna', 'Ana', 'Jürgen'])} {rnd.choice(['Meier', 'Meyer', 'Maier'])}", rnd.choice([0, 1])) for k in range(20) for _ in range(2)]
    names = spark.createDataFrame(rows, "agent string, name string, msg_count long")
    weights = resolve.name_weights(names)
    terms = resolve.term_weights(weights)
    want = {(r.a, r.b): round(r.score, 9) for r in resolve.score_pairs(resolve.candidate_pairs(terms), weights, resolve.term_idf(terms)).where("score >= 0.9").collect()}
    scored, plain = [], resolve.score_pairs
    monkeypatch.setattr(resolve, "score_pairs", lambda pairs, *rest: scored.append(pairs.count()) or plain(pairs, *rest))
    got = {(r.a, r.b): round(r.score, 9) for r in resolve.match_agents(names).collect()}
    assert got == want and len(want) > 40 and sum(scored) < 400


def test_only_counted_frontiers_are_sent(spark, monkeypatch):
    """No table of edges or paths goes through the driver, however small its files are."""
    from noetica.operators import graph

    n = 4000
    edges = spark.range(1, n).select(F.floor((F.col("id") - 1) / 2).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    plans, real = [], graph._stepped
    monkeypatch.setattr(graph, "SENT_ROWS", 100)
    monkeypatch.setattr(graph, "_stepped", lambda f, k, t, on: plans.append((k, plan_of(real(f, k, t, on)))) or real(f, k, t, on))
    paths = graph.shortest_paths(edges, spark.createDataFrame([(0,)], "node long"))
    walks = graph.path_nodes(paths, paths.select("source", "node"))
    got = {r.node: r.path for r in walks.collect()}
    assert len(got) == n and got[n - 1][0] == 0 and all(p[i] == (p[i + 1] - 1) // 2 for p in got.values() for i in range(len(p) - 1))
    assert any(k > 100 for k, _ in plans) and any(k <= 100 for k, _ in plans)
    for k, plan in plans:
        assert ("BroadcastHashJoin" in plan) == (k <= 100)


def test_documents_are_parsed_in_little_memory():
    """A file of many cards or events takes a small multiple of its size; one in error still gives no quads."""
    import tracemalloc

    from noetica.sources import files, personal

    def card(i):
        return f"BEGIN:VCARD\r\nUID:c{i}\r\nFN:Name {i}\r\nEMAIL:c{i}@x.org\r\nEND:VCARD\r\n"

    def event(i):
        return f"BEGIN:VEVENT\r\nUID:e{i}\r\nSUMMARY:s{i}\r\nDTSTART:20240101T000000Z\r\nEND:VEVENT\r\n"

    for name, one, each in (("a.vcf", card, 5), ("a.ics", event, 3)):
        data = "".join(map(one, range(30_000))).encode()
        tracemalloc.start()
        n = sum(1 for _ in files.parse_file(name, data))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 30_000 * each and peak < 6 * len(data)
    got = list(files.parse_file("a.vcf", "".join(map(card, range(3))).encode()))
    assert [q[:4] for q in got] == personal.parse_vcard("".join(map(card, range(3))).encode(), "a.vcf")

    def broken(data, iri):
        yield from personal.vcard_quads(data, iri)
        raise ValueError("late")

    old, personal.PARSERS["text/vcard"] = personal.PARSERS["text/vcard"], broken
    try:
        assert [q[4] for q in files.parse_file("a.vcf", "".join(map(card, range(20_000))).encode())] == ["ValueError: late"]
    finally:
        personal.PARSERS["text/vcard"] = old


@pytest.mark.parametrize("where", ["plain", "date line", "pole", "kept"])
def test_global_clusters_over_tiles(spark, monkeypatch, where):
    """Tiles as small as they can be, at the date line and a pole: the greedy result, and no pairs written."""
    from noetica.operators import stays

    rnd = random.Random(where)
    if where == "pole":
        points = [(rnd.uniform(-180, 180), 90 - abs(rnd.gauss(0, 0.01))) for _ in range(250)]
    else:
        points = [(((180.0 if where == "date line" else 2.0) + rnd.gauss(0, 0.06) + 180) % 360 - 180, 48 + rnd.gauss(0, 0.04)) for _ in range(900)]
    points += points[:20]
    if where == "kept":
        monkeypatch.setattr(stays, "KEPT_NEIGHBOURS", 10)
    array = np.array(points)
    want = {i: min(c) for c in stays.greedy_clusters(array, 150.0) for i in c}
    tiles = stays._tiled(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double"), 150.0)
    assert tiles.where("core").count() == len(points) and (where == "pole" or tiles.select("band", "cell").distinct().count() > 4)
    written, real = [], stays.saved
    monkeypatch.setattr(stays, "saved", lambda df, name: (lambda out: written.append(out.count()) or out)(real(df, name)))
    df = spark.createDataFrame([*((i, *p) for i, p in enumerate(points)), (5000, None, 1.0)], "id long, lon double, lat double")
    assert {r.id: r.cluster for r in stays.global_clusters(df, 150.0).collect()} == want | {5000: 5000}
    assert sum(written) == len(points)


@pytest.mark.parametrize("where", ["plain", "date line", "pole"])
def test_near_pairs_send_points_to_five_cells(spark, where):
    from noetica.operators import relational
    from noetica.operators.stays import haversine_of

    rnd = random.Random(where)
    if where == "pole":
        points = [(rnd.uniform(-180, 180), rnd.choice([-1, 1]) * (89 - abs(rnd.gauss(0, 0.5)))) for _ in range(300)]
        metres = 60_000.0
    else:
        points = [(((180.0 if where == "date line" else 2.0) + rnd.gauss(0, 0.06) + 180) % 360 - 180, 48 + rnd.gauss(0, 0.04)) for _ in range(300)]
        metres = 800.0
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if haversine_of(*points[i], *points[j]) <= metres}
    found = relational.near_pairs(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double"), metres)
    rows = [(r.a, r.b) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 20
    sent = []

    def walk(node):
        if node.nodeName() == "Generate":
            sent.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.finalPhysicalPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(found._jdf.queryExecution().executedPlan())
    assert sent and max(sent) <= 5 * 300


def test_direct_prefers_the_same_name(spark):
    """Names of the same grams: the one that is the text comes first, whatever its number."""
    names = [(k, f"Supplier#{k:09d}") for k in (11, 111, 1111, 11111, 111111)]
    g = spark.createDataFrame([(k, n, 2.0, 48.0) for k, n in names], "place long, name string, lon double, lat double")
    q = spark.createDataFrame([(k, n.lower(), None, None) for k, n in names], "q long, text string, lon double, lat double")
    got = places.direct(q, g, k=3)
    assert {r.q: r.place for r in got.where("rank = 1").collect()} == {k: k for k, _ in names}
    assert all(r.n == 3 for r in got.groupBy("q").agg(F.count("*").alias("n")).collect())
    at = spark.createDataFrame([(1, "supplier#000001111", 3.0, 48.0)], "q long, text string, lon double, lat double")
    far = g.unionByName(spark.createDataFrame([(9, "Supplier#000011111", 3.0, 48.0)], g.schema))
    assert [r.place for r in places.direct(at, far).orderBy("rank").collect()][:2] == [9, 1111]


def test_no_shuffle_by_property(spark):
    """Triples of one property are not gathered in one task to meet the ontology."""
    from noetica.operators import inference

    ontology = spark.createDataFrame([("<p>", inference.DOMAIN, "<A>"), ("<p>", inference.RANGE, "<B>"), ("<A>", inference.SUB_CLASS, "<C>")], "s string, p string, o string")
    triples = spark.range(50).select(F.concat(F.lit("<s"), "id", F.lit(">")).alias("s"), F.lit("<p>").alias("p"), F.concat(F.lit("<o"), F.col("id") % 5, F.lit(">")).alias("o"))
    found = inference.rdfs_closure(triples, ontology)
    assert found.groupBy("o").count().collect() and {(r.o, r["count"]) for r in found.groupBy("o").count().collect()} == {("<A>", 50), ("<B>", 5), ("<C>", 50)}
    import re

    assert not re.search(r"hashpartitioning\((p|o)#\d+, ", plan_of(found))
