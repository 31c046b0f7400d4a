"""The quad model: terms, vocabulary, negation, and the algebra of diffs.

A quad table has four string columns ``s, p, o, g``.  Terms are written as in N-Triples:
``<iri>``, ``_:label``, ``"text"``, ``"text"@en``, ``"1"^^<datatype>``; so term equality is
string equality, and joins on any position are plain equi-joins.  A diff has a column
``op`` (+1 added, -1 removed) besides, and ``seq`` where diffs are composed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "http://schema.org/"
PERSONAL = "urn:noetica:personal#"
GEO = "http://www.opengis.net/ont/geosparql#"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "schema": SCHEMA, "personal": PERSONAL, "geo": GEO}

TYPE, SAME_AS, DIFFERENT_FROM = f"<{RDF}type>", f"<{OWL}sameAs>", f"<{OWL}differentFrom>"
NEGATION = f"{PERSONAL}negation/"
QUAD = ("s", "p", "o", "g")
QUADS_DDL = "s string, p string, o string, g string"
INTEGERS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger")
NUMERIC = ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger")


def schema(name: str) -> str:
    return f"<{SCHEMA}{name}>"


def personal(name: str) -> str:
    return f"<{PERSONAL}{name}>"


# -- terms


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def literal(value: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    escaped = F.replace(F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    tail = f"@{lang}" if lang else f"^^<{XSD}{datatype}>" if datatype else ""
    return F.concat(F.lit('"'), escaped, F.lit('"' + tail))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def lexical(term: Column) -> Column:
    """IRI without brackets, or the text of a literal."""
    text = F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    text = F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(is_literal(term), text).when(is_iri(term), F.regexp_extract(term, r"^<(.*)>$", 1)).otherwise(term)


def lang_of(term: Column) -> Column:
    return F.when(is_literal(term), F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1))


def datatype_of(term: Column) -> Column:
    typed = F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1)
    plain = F.when(lang_of(term) != "", F.lit(f"{RDF}langString")).otherwise(F.lit(f"{XSD}string"))
    return F.when(is_literal(term), F.when(typed != "", typed).otherwise(plain))


def number_of(term: Column) -> Column:
    """The value of a numeric literal, null for any other term."""
    return F.when(datatype_of(term).isin([XSD + n for n in NUMERIC]), lexical(term).try_cast("double"))


def integer_of(term: Column) -> Column:
    """The value of a literal of a whole type as a decimal, null for any other term."""
    return F.when(datatype_of(term).isin([XSD + n for n in INTEGERS]), lexical(term).try_cast("decimal(38,0)"))


# -- tables without doubles


def disjoint(quads: DataFrame) -> DataFrame:
    """``quads`` marked as holding no triple twice, be it in two graphs; queries then need no
    distinct.  The mark is on this very DataFrame: what is derived from it does not carry it."""
    out = quads.select("*")
    out.__dict__["_disjoint"] = True
    return out


def are_disjoint(quads: DataFrame) -> bool:
    return bool(quads.__dict__.get("_disjoint"))


def checked_disjoint(quads: DataFrame) -> DataFrame:
    """``quads``, marked if that holds: one aggregation over all triples."""
    twice = quads.groupBy("s", "p", "o").agg(F.count("*").alias("n")).where("n > 1")
    return disjoint(quads) if twice.isEmpty() else quads


# -- negation


def negate(p: Column) -> Column:
    """The predicate that denies ``p``; denying twice gives ``p`` back."""
    inner = F.regexp_extract(p, r"^<(.*)>$", 1)
    mirrored = iri(F.concat(F.lit(NEGATION), F.url_encode(inner)))
    back = iri(F.try_url_decode(F.substring(inner, len(NEGATION) + 1, 1 << 30)))
    return F.when(p == SAME_AS, F.lit(DIFFERENT_FROM)).when(p == DIFFERENT_FROM, F.lit(SAME_AS)).when(inner.startswith(NEGATION), back).otherwise(mirrored)


# -- diffs


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Balanced union, so that the plan's depth is logarithmic."""
    if not frames:
        raise ValueError("nothing to unite")
    while len(frames) > 1:
        frames = [reduce(DataFrame.unionByName, frames[i : i + 2]) for i in range(0, len(frames), 2)]
    return frames[0]


def document_diff(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Quads to add and to remove so that the graphs of ``new`` hold just its quads.

    What some graph denies (same subject and object, negated predicate) is not added.
    """
    graphs = new.select("g").distinct()
    mine = existing.join(graphs, "g", "left_semi").select(*QUAD)
    added = new.select(*QUAD).distinct().join(mine, list(QUAD), "left_anti")
    denied = existing.select("s", negate(F.col("p")).alias("p"), "o")
    added = added.join(denied, ["s", "p", "o"], "left_anti")
    removed = mine.join(new.select(*QUAD), list(QUAD), "left_anti")
    return added.select(*QUAD, F.lit(1).alias("op")).unionByName(removed.select(*QUAD, F.lit(-1).alias("op")))


def denied(quads: DataFrame, existing: DataFrame) -> DataFrame:
    """Those of ``quads`` that ``existing`` denies in any graph."""
    against = existing.select("s", negate(F.col("p")).alias("p"), "o")
    return quads.join(against, ["s", "p", "o"], "left_semi")


def insertable(quads: DataFrame, existing: DataFrame) -> DataFrame:
    """Those of ``quads`` that are new and not denied."""
    against = existing.select("s", negate(F.col("p")).alias("p"), "o")
    return quads.select(*QUAD).distinct().join(existing.select(*QUAD), list(QUAD), "left_anti").join(against, ["s", "p", "o"], "left_anti")


def compose(diffs: DataFrame) -> DataFrame:
    """One operation per quad: that of the largest ``seq``."""
    return diffs.groupBy(*QUAD).agg(F.max_by("op", "seq").alias("op"))


def apply_diff(quads: DataFrame, diff: DataFrame) -> DataFrame:
    gone = diff.where("op < 0").select(*QUAD)
    new = diff.where("op > 0").select(*QUAD)
    return quads.select(*QUAD).join(gone, list(QUAD), "left_anti").unionByName(new).distinct()


def merge_results(results: DataFrame) -> DataFrame:
    """Outcome per quad and side over all sources.

    An addition succeeds if some source took it; a removal fails if some source failed.
    """
    key = [*QUAD, "side"]
    ok = F.when(F.col("side") == "added", F.bool_or("ok")).otherwise(F.bool_and("ok"))
    errors = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("error")))), "; ")
    return results.groupBy(*key).agg(ok.alias("ok"), errors.alias("errors"))


# -- the driver's tables as quads


def table_quads(tables: dict[str, DataFrame]) -> DataFrame:
    """Agents, places and messages seen in the relational tables.

    One branch per predicate, with the predicate as a literal: a filter on ``p`` then prunes
    whole scans at planning time.  Keys are unique and every graph has its own subjects or
    predicates, so the table is marked disjoint.
    """
    c, n, r, o, s, li = (tables[x] for x in ("customer", "nation", "region", "orders", "supplier", "lineitem"))

    def branch(df: DataFrame, key: str, kind: str, p: str, obj: Column, graph: str) -> DataFrame:
        return df.select(iri(F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))).alias("s"), F.lit(p).alias("p"), obj.alias("o"), F.lit(f"<urn:g:{graph}>").alias("g"))

    ref = lambda kind, key: iri(F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string")))
    return disjoint(union_all(
        [
            branch(c, "c_custkey", "c", TYPE, F.lit(schema("Person")), "customer"),
            branch(c, "c_custkey", "c", schema("name"), literal(F.col("c_name")), "customer"),
            branch(c, "c_custkey", "c", schema("homeLocation"), ref("n", "c_nationkey"), "customer"),
            branch(n, "n_nationkey", "n", TYPE, F.lit(schema("Country")), "nation"),
            branch(n, "n_nationkey", "n", schema("name"), literal(F.col("n_name"), lang="en"), "nation"),
            branch(n, "n_nationkey", "n", schema("containedInPlace"), ref("r", "n_regionkey"), "nation"),
            branch(r, "r_regionkey", "r", TYPE, F.lit(schema("Place")), "region"),
            branch(r, "r_regionkey", "r", schema("name"), literal(F.col("r_name")), "region"),
            branch(s, "s_suppkey", "s", TYPE, F.lit(schema("Organization")), "supplier"),
            branch(s, "s_suppkey", "s", schema("name"), literal(F.col("s_name")), "supplier"),
            branch(s, "s_suppkey", "s", schema("homeLocation"), ref("n", "s_nationkey"), "supplier"),
            branch(o, "o_orderkey", "o", TYPE, F.lit(schema("EmailMessage")), "orders"),
            branch(o, "o_orderkey", "o", schema("sender"), ref("c", "o_custkey"), "orders"),
            branch(o, "o_orderkey", "o", schema("price"), literal(F.col("o_totalprice"), "double"), "orders"),
            branch(o, "o_orderkey", "o", schema("keywords"), literal(F.col("o_orderpriority")), "orders"),
            branch(li.select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "o", schema("recipient"), ref("s", "l_suppkey"), "lineitem"),
        ]
    ))
