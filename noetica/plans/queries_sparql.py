"""Registered queries: SPARQL over the tables' quads, and the algebra of diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import QUAD, SAME_AS, TYPE, apply_diff, compose, document_diff, insertable, lexical, literal, merge_results, negate, schema
from .registry import query
from .sparql import Engine, construct, select
from .views import quads, tables


def _run(text: str, numbers: tuple[str, ...] = (), floats: tuple[str, ...] = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = select(quads(spark, sf_dir), text)
        return df.select(*[(F.round(F.col(c).cast("double"), 4) if c in floats else F.col(c).cast("bigint" if c in numbers else "string")).alias(c) for c in df.columns])

    return run


def _sparql(name: str, text: str, sql: str, numbers: tuple[str, ...] = (), floats: tuple[str, ...] = ()) -> None:
    query(name, sql)(_run(text, numbers, floats))


_sparql(
    "bgp_star",
    "SELECT ?c ?name ?nation WHERE { ?c a schema:Person ; schema:name ?name ; schema:homeLocation ?n . ?n schema:name ?nation }",
    "select 'urn:c:' || c_custkey c, c_name \"name\", n_name nation from customer join nation on c_nationkey = n_nationkey",
)
_sparql(
    "bgp_path",
    "SELECT ?c ?region WHERE { ?c a schema:Person ; schema:homeLocation/schema:containedInPlace/schema:name ?region }",
    "select 'urn:c:' || c_custkey c, r_name region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
)
_sparql(
    "bgp_optional",
    "SELECT ?c ?o WHERE { ?c a schema:Person OPTIONAL { ?o schema:sender ?c ; schema:price ?p FILTER(?p > 400000) } }",
    "select 'urn:c:' || c_custkey c, 'urn:o:' || o_orderkey o from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000",
)
_sparql(
    "bgp_union",
    "SELECT ?a ?n WHERE { { ?a a schema:Person ; schema:name ?n } UNION { ?a a schema:Organization ; schema:name ?n } }",
    "select 'urn:c:' || c_custkey a, c_name n from customer union all select 'urn:s:' || s_suppkey, s_name from supplier",
)
_sparql(
    "graph_var",
    "SELECT ?g (COUNT(?s) AS ?n) WHERE { GRAPH ?g { ?s schema:name ?x } } GROUP BY ?g",
    "select * from (select 'urn:g:customer' g, count(*) n from customer union all select 'urn:g:nation', count(*) from nation union all select 'urn:g:region', count(*) from region union all select 'urn:g:supplier', count(*) from supplier)",
    numbers=("n",),
)
_sparql(
    "graph_constant",
    "SELECT ?s ?x WHERE { GRAPH <urn:g:nation> { ?s schema:name ?x } }",
    "select 'urn:n:' || n_nationkey s, n_name x from nation",
)
_sparql(
    "filter_or",
    "SELECT ?o ?k WHERE { ?o schema:keywords ?k FILTER(?k = \"1-URGENT\" || ?k = \"2-HIGH\") }",
    "select 'urn:o:' || o_orderkey o, o_orderpriority k from orders where o_orderpriority in ('1-URGENT', '2-HIGH')",
)
_sparql(
    "filter_functions",
    'SELECT ?s (UCASE(SUBSTR(?n, 1, 4)) AS ?u) (STRLEN(?n) AS ?l) WHERE { ?s a schema:Organization ; schema:name ?n FILTER(REGEX(?n, "7$") && CONTAINS(?n, "#") && STRSTARTS(?n, "Supp")) }',
    "select 'urn:s:' || s_suppkey s, upper(substr(s_name, 1, 4)) u, length(s_name)::bigint l from supplier where s_name like '%7' and s_name like 'Supp%#%'",
    numbers=("l",),
)
_sparql(
    "lang_datatype",
    "SELECT ?l ?d (COUNT(*) AS ?n) WHERE { ?s schema:name ?x BIND(LANG(?x) AS ?l) BIND(STR(DATATYPE(?x)) AS ?d) } GROUP BY ?l ?d",
    "select * from (select '' l, 'http://www.w3.org/2001/XMLSchema#string' d, (select count(*) from customer) + (select count(*) from region) + (select count(*) from supplier) n union all select 'en', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', count(*) from nation)",
    numbers=("n",),
)
_sparql(
    "not_exists",
    "SELECT ?c WHERE { ?c a schema:Person FILTER NOT EXISTS { ?o schema:sender ?c ; schema:keywords \"1-URGENT\" } }",
    "select 'urn:c:' || c_custkey c from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
)
_sparql(
    "exists",
    "SELECT ?c WHERE { ?c a schema:Person FILTER EXISTS { ?o schema:sender ?c ; schema:keywords \"1-URGENT\" } }",
    "select 'urn:c:' || c_custkey c from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
)
_sparql(
    "minus",
    "SELECT ?n WHERE { ?n a schema:Country MINUS { ?n schema:containedInPlace <urn:r:2> } }",
    "select 'urn:n:' || n_nationkey n from nation where n_regionkey <> 2",
)
_sparql(
    "minus_disjoint",
    "SELECT ?n WHERE { ?n a schema:Country MINUS { ?x a schema:Place } }",
    "select 'urn:n:' || n_nationkey n from nation",
)
_sparql(
    "subselect",
    "SELECT ?c ?name ?n WHERE { ?c schema:name ?name { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o schema:sender ?c } GROUP BY ?c HAVING (COUNT(?o) > 12) } }",
    "select 'urn:c:' || c_custkey c, c_name \"name\", n from customer join (select o_custkey, count(*) n from orders group by 1 having count(*) > 12) on c_custkey = o_custkey",
    numbers=("n",),
)
_sparql(
    "aggregates",
    "SELECT ?c (SUM(?p) AS ?total) (AVG(?p) AS ?mean) (MIN(?p) AS ?low) (MAX(?p) AS ?high) (COUNT(DISTINCT ?k) AS ?kinds) WHERE { ?o schema:sender ?c ; schema:price ?p ; schema:keywords ?k } GROUP BY ?c",
    "select 'urn:c:' || o_custkey c, round(sum(o_totalprice), 4) total, round(avg(o_totalprice), 4) mean, min(o_totalprice) low, max(o_totalprice) high, count(distinct o_orderpriority) kinds from orders group by 1",
    numbers=("kinds",),
    floats=("total", "mean", "low", "high"),
)
_sparql(
    "group_concat",
    'SELECT ?r (GROUP_CONCAT(?x; SEPARATOR="|") AS ?names) (SAMPLE(?x) AS ?one) WHERE { ?n a schema:Country ; schema:containedInPlace ?r ; schema:name ?x } GROUP BY ?r',
    "select 'urn:r:' || n_regionkey r, string_agg(n_name, '|' order by n_name) \"names\", min(n_name) one from nation group by 1",
)
_sparql(
    "values_bind",
    'SELECT ?c ?x WHERE { VALUES (?c ?x) { (<urn:c:1> "a") (<urn:c:2> UNDEF) (<urn:c:none> "b") } ?c a schema:Person }',
    "select 'urn:c:' || c_custkey c, case c_custkey when 1 then 'a' end x from customer where c_custkey in (1, 2)",
)
_sparql(
    "if_coalesce",
    'SELECT ?o (IF(?p > 250000, "large", "small") AS ?size) (COALESCE(?none, ?k) AS ?v) WHERE { ?o schema:price ?p ; schema:keywords ?k }',
    "select 'urn:o:' || o_orderkey o, case when o_totalprice > 250000 then 'large' else 'small' end \"size\", o_orderpriority v from orders",
)
_sparql(
    "path_star",
    "SELECT ?x ?y WHERE { ?x a schema:Country . ?x schema:containedInPlace* ?y }",
    "select 'urn:n:' || n_nationkey x, 'urn:n:' || n_nationkey y from nation union all select 'urn:n:' || n_nationkey, 'urn:r:' || n_regionkey from nation",
)
_sparql(
    "path_plus_inverse",
    "SELECT ?r (COUNT(DISTINCT ?c) AS ?n) WHERE { ?r ^(schema:homeLocation|schema:containedInPlace)+ ?c . ?c a schema:Person } GROUP BY ?r",
    "select * from (select 'urn:r:' || n_regionkey r, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1 union all select 'urn:n:' || c_nationkey, count(*) from customer group by 1)",
    numbers=("n",),
)
_sparql(
    "path_negated",
    "SELECT ?s ?o WHERE { ?s !(<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>|schema:name|schema:sender|schema:price|schema:keywords|schema:recipient) ?o }",
    "select 'urn:c:' || c_custkey s, 'urn:n:' || c_nationkey o from customer union all select 'urn:s:' || s_suppkey, 'urn:n:' || s_nationkey from supplier union all select 'urn:n:' || n_nationkey, 'urn:r:' || n_regionkey from nation",
)
_sparql(
    "distinct_order_limit",
    "SELECT DISTINCT ?name WHERE { ?s a schema:Person ; schema:name ?name } ORDER BY DESC(?name) LIMIT 7 OFFSET 3",
    'select distinct c_name "name" from customer order by 1 desc limit 7 offset 3',
)
_sparql(
    "error_drops_row",
    "SELECT ?o WHERE { ?o schema:price ?p ; schema:keywords ?k FILTER(?p / (?p - ?p) > 1 || ?k = \"5-LOW\") }",
    "select 'urn:o:' || o_orderkey o from orders where o_orderpriority = '5-LOW'",
)


_sparql(
    "optional_unbound_join",
    "SELECT ?n ?r ?x WHERE { ?n a schema:Country OPTIONAL { ?n schema:containedInPlace ?r FILTER(?r = <urn:r:2>) } { ?r a schema:Place ; schema:name ?x } }",
    "select 'urn:n:' || n_nationkey n, 'urn:r:' || r_regionkey r, r_name x from nation, region where n_regionkey <> 2 or r_regionkey = 2",
)
_sparql(
    "values_undef_join",
    "SELECT ?n ?r WHERE { VALUES (?n ?r) { (<urn:n:1> UNDEF) (UNDEF <urn:r:2>) (<urn:n:3> <urn:r:4>) } ?n schema:containedInPlace ?r }",
    "select 'urn:n:' || n_nationkey n, 'urn:r:' || n_regionkey r from nation where n_nationkey = 1 union all select 'urn:n:' || n_nationkey, 'urn:r:' || n_regionkey from nation where n_regionkey = 2 union all select 'urn:n:' || n_nationkey, 'urn:r:' || n_regionkey from nation where n_nationkey = 3 and n_regionkey = 4",
)
_sparql(
    "optional_after_optional",
    "SELECT ?n ?r ?x WHERE { ?n a schema:Country OPTIONAL { ?n schema:containedInPlace ?r FILTER(?r = <urn:r:1>) } OPTIONAL { ?r schema:name ?x . ?r a schema:Place } }",
    "select 'urn:n:' || n_nationkey n, 'urn:r:' || r_regionkey r, r_name x from nation, region where n_regionkey <> 1 or r_regionkey = 1",
)
_sparql(
    "minus_unbound",
    "SELECT ?n ?r WHERE { ?n a schema:Country OPTIONAL { ?n schema:containedInPlace ?r FILTER(?r != <urn:r:3>) } MINUS { ?r schema:name \"ASIA\" } }",
    "select 'urn:n:' || n_nationkey n, case when n_regionkey <> 3 then 'urn:r:' || n_regionkey end r from nation where n_regionkey = 3 or n_regionkey not in (select r_regionkey from region where r_name = 'ASIA')",
)
_sparql(
    "exists_or",
    "SELECT ?c WHERE { ?c a schema:Person FILTER(?c = <urn:c:1> || EXISTS { ?o schema:sender ?c ; schema:keywords \"1-URGENT\" } || !EXISTS { ?p schema:sender ?c }) }",
    "select 'urn:c:' || c_custkey c from customer where c_custkey = 1 or c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') or c_custkey not in (select o_custkey from orders)",
)
_sparql(
    "exists_bound",
    "SELECT ?n ?e WHERE { ?n a schema:Country BIND(EXISTS { ?s schema:homeLocation ?n . ?s a schema:Organization } AS ?e) }",
    "select 'urn:n:' || n_nationkey n, case when n_nationkey in (select s_nationkey from supplier) then 'true' else 'false' end e from nation",
)
_sparql(
    "count_distinct_all",
    "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?c a schema:Person OPTIONAL { ?o schema:sender ?c ; schema:price ?p FILTER(?p > 400000) } }",
    "select count(*) n from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000",
    numbers=("n",),
)
_sparql("count_global", "SELECT (COUNT(*) AS ?n) WHERE { ?c a schema:Person }", "select count(*) n from customer", numbers=("n",))
_sparql(
    "sum_integers",
    "SELECT (SUM(?x) AS ?total) (SUM(?x + 1) AS ?more) WHERE { VALUES ?x { 9007199254740993 1 } }",
    "select '9007199254740994' total, '9007199254740996' more",
)
_sparql(
    "closure_in_graphs",
    "SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x schema:containedInPlace+ ?y } }",
    "select 'urn:g:nation' g, 'urn:n:' || n_nationkey x, 'urn:r:' || n_regionkey y from nation",
)
_sparql(
    "closure_from_term",
    "SELECT ?y WHERE { <urn:c:1> (schema:homeLocation|schema:containedInPlace)+ ?y }",
    "select 'urn:n:' || c_nationkey y from customer where c_custkey = 1 union all select 'urn:r:' || n_regionkey from customer join nation on n_nationkey = c_nationkey where c_custkey = 1",
)
_sparql(
    "closure_to_term",
    "SELECT ?x WHERE { ?x (schema:homeLocation|schema:containedInPlace)* <urn:r:2> }",
    "select 'urn:r:2' x union all select 'urn:n:' || n_nationkey from nation where n_regionkey = 2 union all select 'urn:c:' || c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey = 2 union all select 'urn:s:' || s_suppkey from supplier join nation on n_nationkey = s_nationkey where n_regionkey = 2",
)


@query("default_graph_union", "select count(*) n from customer")
def default_graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that stand in two graphs count once."""
    q = quads(spark, sf_dir)
    twice = q.where(F.col("p") == TYPE).unionByName(q.where(F.col("p") == TYPE).withColumn("g", F.lit("<urn:copy>")))
    return select(twice, "SELECT (COUNT(*) AS ?n) WHERE { ?c a schema:Person }").select(F.col("n").cast("bigint").alias("n"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of three types at blank nodes and IRIs, with times."""
    o = tables(spark, sf_dir)["orders"]
    k = F.col("o_orderkey")
    node = F.when(k % 2 == 0, F.concat(F.lit("_:o"), k.cast("string"))).otherwise(F.concat(F.lit("<urn:o:"), k.cast("string"), F.lit(">")))
    value = F.when(k % 3 == 0, literal(k % 10, "integer")).when(k % 3 == 1, F.concat(F.lit('"'), (k % 10).cast("string"), F.lit('.0"^^<http://www.w3.org/2001/XMLSchema#decimal>'))).otherwise(literal((k % 10).cast("double"), "double"))
    time = literal(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "dateTime")
    row = lambda p, x: o.select(node.alias("s"), F.lit(p).alias("p"), x.alias("o"), F.lit("<urn:g>").alias("g"))
    return row("<urn:value>", value).unionByName(row("<urn:at>", time))


@query("blank_and_numeric", "select count(*) n, sum(case when o_orderkey % 3 = 0 then 1 else 0 end)::bigint whole from orders where o_orderkey % 2 = 0 and o_orderkey % 10 = 4")
def blank_and_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = select(_measures(spark, sf_dir), "SELECT (COUNT(*) AS ?n) (SUM(IF(DATATYPE(?v) = xsd:integer, 1, 0)) AS ?whole) WHERE { ?s <urn:value> ?v FILTER(isBlank(?s) && ?v = 4) }")
    return df.select(F.col("n").cast("bigint").alias("n"), F.col("whole").cast("bigint").alias("whole"))


@query("time_functions", "select year(o_orderdate)::bigint y, month(o_orderdate)::bigint m, day(o_orderdate)::bigint d, hour(o_orderdate)::bigint h, count(*) n from orders group by 1, 2, 3, 4")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = select(_measures(spark, sf_dir), "SELECT ?y ?m ?d ?h (COUNT(*) AS ?n) WHERE { ?s <urn:at> ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) } GROUP BY ?y ?m ?d ?h")
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in df.columns])


@query("own_functions", "select 'urn:o:' || o_orderkey s, (epoch_ms(date_trunc('second', o_orderdate)) - epoch_ms(timestamp '2020-01-01')) ms from orders where o_orderkey % 2 = 1")
def own_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'SELECT ?s (<urn:noetica:personal#durationInMillis>("2020-01-01T00:00:00Z"^^xsd:dateTime, ?t) AS ?ms) WHERE { ?s <urn:at> ?t FILTER(isIRI(?s)) }'
    return select(_measures(spark, sf_dir), text).select("s", F.col("ms").cast("bigint").alias("ms"))


@query("ask_exists", "select exists(select 1 from orders where o_totalprice > 500000) as answer")
def ask_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Engine(quads(spark, sf_dir)).solutions("SELECT ?o WHERE { ?o schema:price ?p FILTER(?p > 500000) } LIMIT 1")
    return found.agg((F.count("*") > 0).alias("answer"))


@query("construct_quads", "select distinct '<urn:c:' || o_custkey || '>' s, '<urn:knows>' p, '<urn:s:' || l_suppkey || '>' o from orders join lineitem on o_orderkey = l_orderkey")
def construct_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct(quads(spark, sf_dir), "CONSTRUCT { ?c <urn:knows> ?s } WHERE { ?o schema:sender ?c ; schema:recipient ?s }")


@query("describe_resource", "select '<urn:n:3>' s, * from (select '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' p, '<http://schema.org/Country>' o union all select '<http://schema.org/name>', '\"' || n_name || '\"@en' from nation where n_nationkey = 3 union all select '<http://schema.org/containedInPlace>', '<urn:r:' || n_regionkey || '>' from nation where n_nationkey = 3)")
def describe_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(quads(spark, sf_dir)).describe("DESCRIBE <urn:n:3>")


@query("prebound_variables", "select 'urn:c:' || o_custkey c, count(*) n from orders where o_custkey in (1, 4, 7) group by 1")
def prebound_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = select(quads(spark, sf_dir), "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o schema:sender ?c } GROUP BY ?c", bind={"?c": ["<urn:c:1>", "<urn:c:4>", "<urn:c:7>"]})
    return df.select("c", F.col("n").cast("bigint").alias("n"))


@query("quad_pattern_scan", "select '<urn:o:' || o_orderkey || '>' s, '<urn:g:orders>' g from orders where o_custkey = 7")
def quad_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).where((F.col("p") == schema("sender")) & (F.col("o") == "<urn:c:7>")).select("s", "g")


@query("union_sources", "select 'c' src, count(*) n from customer union all select 's', count(*) from supplier union all select 'p', count(*) from part")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..model import union_all

    t = tables(spark, sf_dir)
    return union_all([t[n].select(F.lit(n[0]).alias("src")) for n in ("customer", "supplier", "part")]).groupBy("src").agg(F.count("*").alias("n"))


# -- diffs


def _names(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Two versions of a document of names: the later one renames every tenth customer."""
    c = tables(spark, sf_dir)["customer"]
    name = F.when((F.col("c_custkey") % 10 == 0) & F.lit(shift == 1), F.concat(F.col("c_name"), F.lit("x"))).otherwise(F.col("c_name"))
    kept = c if shift == 0 else c.where("c_custkey % 7 <> 0")
    return kept.select(F.concat(F.lit("<urn:c:"), F.col("c_custkey").cast("string"), F.lit(">")).alias("s"), F.lit(schema("name")).alias("p"), literal(name).alias("o"), F.lit("<urn:doc>").alias("g"))


_OLD = "select '<urn:c:' || c_custkey || '>' s, '\"' || c_name || '\"' o from customer"
_NEW = "select '<urn:c:' || c_custkey || '>' s, '\"' || c_name || case when c_custkey % 10 = 0 then 'x' else '' end || '\"' o from customer where c_custkey % 7 <> 0"


@query("doc_diff", f"with a as ({_OLD}), b as ({_NEW}) select s, o, 1 op from (select * from b except select * from a) union all select s, o, -1 from (select * from a except select * from b)")
def doc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_diff(_names(spark, sf_dir, 1), _names(spark, sf_dir, 0)).select("s", "o", "op")


@query("diff_apply", f"select * from ({_NEW})")
def diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _names(spark, sf_dir, 0)
    return apply_diff(old, document_diff(_names(spark, sf_dir, 1), old)).select("s", "o")


@query("negation_filtered_insert", "select '<urn:c:' || c_custkey || '>' s from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0")
def negation_filtered_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    same = lambda df, p: df.select(F.concat(F.lit("<urn:c:"), F.col("c_custkey").cast("string"), F.lit(">")).alias("s"), p.alias("p"), F.lit("<urn:me>").alias("o"), F.lit("<urn:g>").alias("g"))
    existing = same(c.where("c_custkey % 2 = 0"), negate(F.lit(SAME_AS)))
    return insertable(same(c.where("c_custkey % 3 = 0"), F.lit(SAME_AS)), existing).select("s")


@query("negate_predicates", "select * from (values ('<http://www.w3.org/2002/07/owl#differentFrom>', true), ('<urn:noetica:personal#negation/http%3A%2F%2Fschema.org%2Fname>', true)) t(denied, back)")
def negate_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(SAME_AS,), (schema("name"),)], "p string").withColumn("denied", negate(F.col("p")))
    return df.select("denied", (negate(F.col("denied")) == F.col("p")).alias("back"))


@query("diff_compose", "select user_id::varchar s, arg_max(case when event_type in ('click', 'view') then 1 else -1 end, event_id) op from events group by 1")
def diff_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    op = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    diffs = e.select(F.col("user_id").cast("string").alias("s"), F.lit("<p>").alias("p"), F.lit("<o>").alias("o"), F.lit("<g>").alias("g"), op.alias("op"), F.col("event_id").alias("seq"))
    return compose(diffs).select("s", "op")


@query("update_merge", "select event_type s, case when user_id % 2 = 0 then 'added' else 'removed' end side, case when user_id % 2 = 0 then bool_or(value > 400) else bool_and(value > 1) end ok from events group by user_id, 1, 2")
def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    even = F.col("user_id") % 2 == 0
    results = e.select(F.col("event_type").alias("s"), F.col("user_id").cast("string").alias("p"), F.lit("<o>").alias("o"), F.lit("<g>").alias("g"), F.when(even, "added").otherwise("removed").alias("side"), F.when(even, F.col("value") > 400).otherwise(F.col("value") > 1).alias("ok"), F.lit("failed").alias("error"))
    return merge_results(results).select("s", "side", "ok")


@query("sparql_update_diff", "select '<urn:o:' || o_orderkey || '>' s, '\"' || o_orderpriority || '\"' o, -1 op from orders where o_totalprice > 400000 union all select '<urn:o:' || o_orderkey || '>', '\"top\"', 1 from orders where o_totalprice > 400000")
def sparql_update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'DELETE { GRAPH <urn:g:orders> { ?o schema:keywords ?k } } INSERT { GRAPH <urn:g:orders> { ?o schema:keywords "top" } } WHERE { ?o schema:keywords ?k ; schema:price ?p FILTER(?p > 400000) }'
    return Engine(quads(spark, sf_dir)).update(text).select("s", "o", "op")


@query("set_operations", "select c_nationkey k from customer intersect select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 0")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    both = t["customer"].select(F.col("c_nationkey").alias("k")).intersect(t["supplier"].select("s_nationkey"))
    return both.subtract(t["nation"].where("n_regionkey = 0").select("n_nationkey"))


@query("type_counts", "select * from (select 'http://schema.org/Person' kind, count(*) n from customer union all select 'http://schema.org/Organization', count(*) from supplier union all select 'http://schema.org/EmailMessage', count(*) from orders union all select 'http://schema.org/Country', count(*) from nation union all select 'http://schema.org/Place', count(*) from region)")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).where(F.col("p") == TYPE).groupBy(lexical(F.col("o")).alias("kind")).agg(F.count("*").alias("n"))


@query("quad_count_by_graph", "select * from (select '<urn:g:customer>' g, 3 * count(*) n from customer union all select '<urn:g:nation>', 3 * count(*) from nation union all select '<urn:g:region>', 2 * count(*) from region union all select '<urn:g:supplier>', 3 * count(*) from supplier union all select '<urn:g:orders>', 4 * count(*) from orders union all select '<urn:g:lineitem>', count(*) from (select distinct l_orderkey, l_suppkey from lineitem))")
def quad_count_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).select(*QUAD).groupBy("g").agg(F.count("*").alias("n"))
