"""Operators that were made for size against their plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noetica.functions import text
from noetica.functions.prob import hellinger_of
from noetica.operators import graph, inference, resolve, stays


def plain_clusters(rows, lookup, threshold, distance):
    """Sequential clustering with every member measured anew at each step."""
    open_, closed, number = [], [], 0
    for i, t, lon, lat, acc in rows:
        within = [c for c in open_ if abs(t - c["last"]) <= lookup]
        beyond = [c for c in open_ if abs(t - c["last"]) > lookup]
        kept, gone = (beyond[:1], beyond[1:]) if not within and beyond else (within, beyond)
        closed += gone
        for c in kept:
            m = np.array([*c["m"], (lon, lat, max(acc, 1e-9) ** 2)])
            p = 1 / m[:, 2]
            x, y, v = p @ m[:, 0] / p.sum(), p @ m[:, 1] / p.sum(), len(m) / p.sum()
            if (hellinger_of(distance(m[:, 0], m[:, 1], np.full(len(m), x), np.full(len(m), y)), v, m[:, 2]) <= threshold).all():
                break
        else:
            c = {"n": number, "m": [], "ids": []}
            number += 1
            kept = [*kept, c]
        c["m"].append((lon, lat, max(acc, 1e-9) ** 2))
        c["ids"].append(i)
        c["last"] = t
        open_ = sorted(kept, key=lambda k: (-k["last"], -k["n"]))
    return closed + sorted(open_, key=lambda k: (k["last"], k["n"]))


@pytest.mark.parametrize("distance", [stays.ellipsoid_of, stays.haversine_of])
@pytest.mark.parametrize("seed", range(4))
def test_bounds_change_no_cluster(distance, seed):
    rnd = random.Random(seed)
    lon, lat, t, rows = 2.0, [48.0, 0.0, 88.9, -60.0][seed], 0.0, []
    for i in range(400):
        t += rnd.choice([30, 200, 900, 5000])
        if rnd.random() < 0.1:
            lon, lat = lon + rnd.uniform(-0.02, 0.02), lat + rnd.uniform(-0.02, 0.02)
        if rnd.random() < 0.01:
            lon += 2
        rows.append((i, t, lon + rnd.gauss(0, 2e-4), lat + rnd.gauss(0, 2e-4), rnd.choice([0, 10, 20, 50, 200])))
    want = [c["ids"] for c in plain_clusters(rows, stays.LOOKUP, stays.LAMBDA, distance)]
    assert [c.ids for c in stays.clusters_of(rows, stays.LOOKUP, distance)] == want
    # the state of a stream gives the same clusters
    own, out = stays.SequentialClustering(distance=distance), []
    for r in rows:
        out += own.add(*r)
        if r[0] % 97 == 0:
            own = stays.SequentialClustering(distance=distance, open_=[stays.Cluster(**c.state()) for c in own.open], number=own.number)
    assert [c.ids for c in out + own.finish()] == want


@pytest.mark.parametrize("seed", range(3))
def test_greedy_clusters_in_rounds(spark, seed):
    rnd = random.Random(seed)
    if seed == 0:  # a chain, where every choice depends on the one before
        points = [(2.0 + 0.001 * i, 48.0) for i in range(60)]
    else:
        points = [(2 + rnd.uniform(0, 0.02 * seed), 48 + rnd.uniform(0, 0.02)) for _ in range(150)]
    array = np.array(points)
    want = {i: min(c) for c in stays.greedy_clusters(array, 150.0) for i in c}
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double")
    assert {r.id: r.cluster for r in stays.global_clusters(df, 150.0).collect()} == want


def grams_of(term):
    return {term[i : i + n] for n in (2, 3) for i in range(len(term) - n + 1)}


def test_match_agents_brute_force(spark):
    rnd = random.Random(4)
    first, last = ["anna", "anne", "bernd", "berndt", "carla", "dora"], ["meier", "meyer", "schmidt", "schmitt", "wolf"]
    rows = [(f"a{i}", f"{rnd.choice(first).title()} {rnd.choice(last).title()}", rnd.choice([0, 1, 3])) for i in range(30) for _ in range(rnd.randint(1, 2))]
    names = spark.createDataFrame(rows, "agent string, name string, msg_count long")
    weights = {}
    for r in resolve.name_weights(names).collect():
        weights.setdefault(r.agent, {})[r.name.lower()] = r.weight
    of_agent = {a: {} for a in weights}
    for a, own in weights.items():
        for name, w in own.items():
            for t in set(name.split()):
                of_agent[a][t] = min(1.0, of_agent[a].get(t, 0) + w)
    total = {}
    for own in of_agent.values():
        for t, w in own.items():
            total[t] = total.get(t, 0) + w
    idf = {t: np.log(len(weights) / w) for t, w in total.items()}
    similar = lambda q, e: q == e or len(grams_of(q) & grams_of(e)) >= max(1, len(grams_of(q)) * 70 // 100)
    want = {}
    for a in weights:
        for b in weights:
            if a < b and any(similar(x, y) or similar(y, x) for x in of_agent[a] for y in of_agent[b]):
                good = sum(v * w * resolve.soft_tf_idf_of(x.split(), y.split(), idf) for x, v in weights[a].items() for y, w in weights[b].items())
                score = min(1.0, good / sum(v * w for v in weights[a].values() for w in weights[b].values()))
                if score >= 0.9:
                    want[a, b] = round(score, 9)
    got = {(r.a, r.b): round(r.score, 9) for r in resolve.match_agents(names).collect()}
    assert got == want and len(want) > 3


def test_term_weighted_scores(spark):
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    terms = spark.createDataFrame([("x", "anna", 1.0), ("x", "wolf", 0.5), ("y", "anna", 1.0), ("y", "wolf", 1.0), ("z", "qqq", 1.0)], "agent string, term string, weight double")
    idf = spark.createDataFrame([("anna", 1.0), ("wolf", 2.0), ("qqq", 1.0)], "term string, idf double")
    got = {r.b: r.score for r in resolve.term_weighted_scores(pairs, terms, idf).collect()}
    assert got["y"] == 1.0 and got["z"] == 0.0


def test_local_parts_without_providers(spark):
    rows = [("a", ["jane", "doe"], "jane.doe", "firm.example"), ("b", ["jane"], "jane", "gmail.com")]
    df = spark.createDataFrame(rows, "agent string, parts array<string>, local string, domain string")
    got = resolve.local_part_matches(df).collect()
    assert [r.agent for r in got] == ["a"] and [(m.part, m.lo, m.hi) for m in got[0].found] == [("jane", 0, 3), ("doe", 5, 7)]


def jaro_winkler_plain(a, b):
    """Jaro's matches by position sets, Winkler's boost from 0.7 on."""
    if not a and not b:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    reach, used, pairs = max(len(large) // 2 - 1, 0), set(), []
    for i, c in enumerate(small):
        free = [j for j in range(len(large)) if abs(i - j) <= reach and j not in used and large[j] == c]
        if free:
            used.add(free[0])
            pairs.append((i, free[0]))
    if not pairs:
        return 0.0
    m = len(pairs)
    other = [large[j] for j in sorted(used)]
    t = sum(small[i] != c for (i, _), c in zip(pairs, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return jaro if jaro < 0.7 else jaro + min(0.1, 1 / len(large)) * prefix * (1 - jaro)


def test_jaro_winkler_and_parts(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))) for _ in range(120)]
    df = spark.createDataFrame([(a, b) for a in words[:40] for b in words[40:80]], "a string, b string").withColumn("s", text.jaro_winkler("a", "b"))
    assert all(abs(r.s - jaro_winkler_plain(r.a, r.b)) < 1e-12 for r in df.collect())
    rows = [(f"g{i % 5}", w, float(rnd.randint(1, 9))) for i, w in enumerate(words) if w]
    got = {}
    for r in resolve.deduplicate_parts(spark.createDataFrame(rows, "agent string, part string, weight double")).collect():
        got.setdefault(r.agent, {})[r.part] = r.weight
    for agent in {a for a, *_ in rows}:
        left, merged = sorted(((p, w) for a, p, w in rows if a == agent), key=lambda x: (-x[1], x[0])), {}
        for p, w in left:
            near = next((q for q in merged if jaro_winkler_plain(p, q) >= 0.9), p)
            merged[near] = merged.get(near, 0.0) + w
        assert got[agent] == merged


def test_facets_only_where_touched(spark):
    """Classes that no change touches keep even a facet that is wrong."""
    rows = [("<a>", "<p>", "<1>", "<g>"), ("<b>", "<p>", "<1>", "<g>")]
    quads = spark.createDataFrame([*rows, *[(s, "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", o, g) for s, o, g in (("<a>", "<T>", "<g>"), ("<b>", "<T>", "<g>"), ("<b>", "<Facet>", "<f>"), ("<a>", "<Facet>", "<f>"))], ("<a>", "<http://www.w3.org/2002/07/owl#sameAs>", "<b>", "<g>")], "s string, p string, o string, g string")
    far = spark.createDataFrame([("<z>", "<p>", "<1>", "<g>", 1)], "s string, p string, o string, g string, op int")
    near = spark.createDataFrame([("<b>", "<p>", "<1>", "<g>", 1)], "s string, p string, o string, g string, op int")
    assert inference.primary_facet_changes(quads, far, ["<T>"], "<Facet>", "<f>").isEmpty()
    got = [(r.s, r.op) for r in inference.primary_facet_changes(quads, near, ["<T>"], "<Facet>", "<f>").collect()]
    assert got == [("<b>", -1)]


def test_all_pairs(spark):
    left, right = spark.range(7).withColumnRenamed("id", "a"), spark.range(30).withColumnRenamed("id", "b")
    assert graph.all_pairs(left, right).distinct().count() == 210
    assert graph.all_pairs(left, right.withColumn("c", F.lit(None))).count() == 210
