"""Forward chaining on quads, shared identifiers, and primary facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import saved
from ..model import DIFFERENT_FROM, OWL, RDF, RDFS, SAME_AS, TYPE, apply_diff, is_blank, is_iri
from .graph import SENT_ROWS, connected_components, reachable, transitive_closure

INVERSE_OF, SYMMETRIC, TRANSITIVE = f"<{OWL}inverseOf>", f"<{OWL}SymmetricProperty>", f"<{OWL}TransitiveProperty>"
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = (f"<{RDFS}{x}>" for x in ("subClassOf", "subPropertyOf", "domain", "range"))
EQUIVALENT_CLASS, EQUIVALENT_PROPERTY = f"<{OWL}equivalentClass>", f"<{OWL}equivalentProperty>"
AXIOMS = [
    (INVERSE_OF, TYPE, SYMMETRIC),
    (EQUIVALENT_CLASS, TYPE, SYMMETRIC), (EQUIVALENT_CLASS, TYPE, TRANSITIVE), (EQUIVALENT_CLASS, SUB_PROPERTY, SUB_CLASS),
    (EQUIVALENT_PROPERTY, TYPE, SYMMETRIC), (EQUIVALENT_PROPERTY, TYPE, TRANSITIVE), (EQUIVALENT_PROPERTY, SUB_PROPERTY, SUB_PROPERTY),
    (SAME_AS, TYPE, SYMMETRIC), (SAME_AS, TYPE, TRANSITIVE), (DIFFERENT_FROM, TYPE, SYMMETRIC),
    (f"<{OWL}FunctionalProperty>", SUB_CLASS, f"<{RDF}Property>"), (f"<{OWL}InverseFunctionalProperty>", SUB_CLASS, f"<{RDF}Property>"),
]


def owl_closure(triples: DataFrame) -> DataFrame:
    """All triples that inverse, symmetric and transitive properties add (semi-naive).

    Every rule is run with its last new premises only; a round's new triples are written to
    the shared folder.  Only IRI objects turn around.
    """
    spark = triples.sparkSession
    axioms = spark.createDataFrame(AXIOMS, "s string, p string, o string")
    known = saved(triples.select("s", "p", "o").unionByName(axioms).distinct(), "owl")
    delta = known
    start = known
    while not delta.isEmpty():
        turn = lambda df: df.select(F.col("o").alias("s"), "p", F.col("s").alias("o")).where(is_iri(F.col("s")))
        found = []
        for new, old in ((delta, known), (known, delta)):
            properties = new.where((F.col("p") == TYPE) & (F.col("o") == SYMMETRIC)).select(F.col("s").alias("p"))
            found.append(turn(old.join(properties, "p", "left_semi")))
            inverses = new.where(F.col("p") == INVERSE_OF).select(F.col("s").alias("q"), F.col("o").alias("p"))
            found.append(turn(old.join(inverses, "p").select("s", F.col("q").alias("p"), "o")))
            transitive = known.where((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE)).select(F.col("s").alias("p"))
            a = new.join(transitive, "p", "left_semi")
            b = old.join(transitive, "p", "left_semi").select("p", F.col("s").alias("o"), F.col("o").alias("_next"))
            found.append(a.join(b, ["p", "o"]).select("s", "p", F.col("_next").alias("o")))
        fresh = delta.where((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE)).select(F.col("s").alias("p"))
        a = known.join(fresh, "p", "left_semi")
        found.append(a.join(a.select("p", F.col("s").alias("o"), F.col("o").alias("_next")), ["p", "o"]).select("s", "p", F.col("_next").alias("o")))
        new = found[0]
        for f in found[1:]:
            new = new.unionByName(f)
        delta = saved(new.distinct().join(known, ["s", "p", "o"], "left_anti"), "owl")
        known = known.unionByName(delta)
    return known.join(start, ["s", "p", "o"], "left_anti")


def rdfs_closure(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """What subclasses, subproperties, domains and ranges add to ``triples``.

    The ontology is closed first; each instance triple then meets its small tables once.  They
    are counted and sent to all tasks: a shuffle by property or class would put all triples of
    one into one task.
    """

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= SENT_ROWS else df

    def pairs(p: str, a: str, b: str) -> DataFrame:
        return ontology.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))

    def closed(p: str, a: str, b: str) -> DataFrame:
        return transitive_closure(pairs(p, "src", "dst")).select(F.col("src").alias(a), F.col("dst").alias(b))

    classes, properties = sent(saved(closed(SUB_CLASS, "o", "sup"), "rdfs")), sent(saved(closed(SUB_PROPERTY, "p", "sup"), "rdfs"))
    base = triples.select("s", "p", "o")
    widened = base.unionByName(base.join(properties, "p").select("s", F.col("sup").alias("p"), "o"))
    of_subject = widened.join(sent(pairs(DOMAIN, "p", "c")), "p").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))
    of_object = widened.join(sent(pairs(RANGE, "p", "c")), "p").where(is_iri(F.col("o")) | is_blank(F.col("o"))).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))
    typed = widened.where(F.col("p") == TYPE).unionByName(of_subject).unionByName(of_object)
    types = typed.unionByName(typed.join(classes, "o").select("s", "p", F.col("sup").alias("o")))
    return widened.unionByName(types).distinct().join(base.hint("merge"), ["s", "p", "o"], "left_anti")


def shared_identifiers(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """``(a, b)`` of subjects that share a value of an identifying property, both ways, self
    pairs included."""
    own = quads.where(F.col("p").isin(predicates)).select("s", "p", "o").distinct()
    other = own.select(F.col("s").alias("b"), "p", "o")
    return own.join(other, ["p", "o"]).select(F.col("s").alias("a"), "b").distinct()


def shared_identifier_stars(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """The same classes as edges to the least subject of each value: linear, whatever its size."""
    own = quads.where(F.col("p").isin(predicates)).select("s", "p", "o").distinct()
    return own.withColumn("least", F.min("s").over(Window.partitionBy("p", "o"))).where("s <> least").select(F.col("s").alias("src"), F.col("least").alias("dst")).distinct()


def shared_identifier_changes(quads: DataFrame, diff: DataFrame, predicates: list[str]) -> DataFrame:
    """``a, b, op``: pairs of ``shared_identifier_stars`` that a diff of quads adds or removes.

    ``quads`` are those before the diff.  Only values that the diff touches are looked at: the
    star of a value is taken before and after it.
    """
    wanted = lambda df: df.where(F.col("p").isin(predicates))
    values = wanted(diff).select("p", "o").distinct()
    before = wanted(quads).join(values, ["p", "o"], "left_semi").select("s", "p", "o", "g").distinct()
    after = apply_diff(before, wanted(diff))
    # a link that another, untouched value gives as well stays
    links = lambda df: df.select("s", "p", "o").distinct().withColumn("least", F.min("s").over(Window.partitionBy("p", "o"))).where("s <> least")
    touched = links(before).select(F.col("s").alias("a"), F.col("least").alias("b")).unionByName(links(after).select(F.col("s").alias("a"), F.col("least").alias("b"))).distinct()
    rest = wanted(quads).join(values, ["p", "o"], "left_anti")
    of = lambda c, out: rest.join(touched.select(F.col(c).alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias(c), "p", F.col("o").alias(out))
    other = touched.join(of("a", "o"), "a").join(of("b", "o"), ["b", "p", "o"]).select("a", "b").distinct()
    was, now = (links(df).select(F.col("s").alias("a"), F.col("least").alias("b")).distinct().join(other, ["a", "b"], "left_anti") for df in (before, after))
    return now.join(was, ["a", "b"], "left_anti").withColumn("op", F.lit(1)).unionByName(was.join(now, ["a", "b"], "left_anti").withColumn("op", F.lit(-1)))


def differing(same: DataFrame, different: DataFrame) -> DataFrame:
    """``(a, b)`` whose classes of sameness hold members said to differ; both are ``(src, dst)``."""
    classes = connected_components(same)
    named = different
    for side in ("src", "dst"):
        named = named.join(classes.select(F.col("node").alias(side), F.col("component").alias(f"{side}_class")), side, "left").withColumn(f"{side}_class", F.coalesce(f"{side}_class", side))
    clash = named.select(F.col("src_class").alias("x"), F.col("dst_class").alias("y"))
    clash = clash.union(clash.select("y", "x")).distinct()
    members = classes.unionByName(different.select(F.col("src").alias("node")).union(different.select("dst")).distinct().join(classes, "node", "left_anti").select("node", F.col("node").alias("component")))
    return clash.join(members.select(F.col("component").alias("x"), F.col("node").alias("a")), "x").join(members.select(F.col("component").alias("y"), F.col("node").alias("b")), "y").select("a", "b").distinct()


def counted(support: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New support of inferred quads, and a diff of those that came or went.

    ``support``: quads and ``n``; ``changes``: quads and ``op`` (one row per derivation).
    """
    key = ["s", "p", "o", "g"]
    sums = support.select(*key, "n", F.lit(0).alias("d")).unionByName(changes.select(*key, F.lit(0).alias("n"), F.col("op").alias("d"))).groupBy(*key).agg(F.sum("n").alias("before"), (F.sum("n") + F.sum("d")).alias("n"))
    now = sums.where("n > 0").select(*key, "n")
    diff = sums.where("(before > 0) <> (n > 0)").select(*key, F.when(F.col("n") > 0, 1).otherwise(-1).alias("op"))
    return now, diff


def primary_facets(same: DataFrame, descriptions: DataFrame, members: DataFrame) -> DataFrame:
    """Per class of sameness the member with most descriptions; ties to the smaller name.

    ``same``: (src, dst); ``descriptions``: (node), one row each; ``members``: (node).
    """
    classes = connected_components(same)
    counts = descriptions.groupBy("node").agg(F.count("*").alias("n"))
    own = members.distinct().join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("component")).join(counts, "node", "left").select("node", "component", F.coalesce("n", F.lit(0)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "node"))
    return own.withColumn("rank", rank).where("rank = 1").select("component", F.col("node").alias("facet"), "n")


def primary_facet_changes(quads: DataFrame, diff: DataFrame, types: list[str], facet: str, graph: str) -> DataFrame:
    """The diff that elects primary facets anew where ``diff`` touched a resource.

    ``quads`` are those after the diff.  The classes of sameness (by sameAs) that touched
    resources are in are found from these resources outwards; in each, of the members of one of
    ``types`` the one with most quads is the facet (ties to the smaller name).  Facets of
    ``graph`` that are no longer right are taken back, others are left alone.
    """
    touched = diff.select(F.col("s").alias("node")).union(diff.where((F.col("p") == SAME_AS) & is_iri(F.col("o"))).select("o")).distinct()
    same = quads.where(F.col("p") == SAME_AS).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    gone = diff.where((F.col("p") == SAME_AS) & (F.col("op") < 0)).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    both = same.unionByName(gone)
    both = both.union(both.select("dst", "src"))
    reached = reachable(both, touched).select(F.col("dst").alias("node")).union(touched).distinct()
    members = saved(quads.where((F.col("p") == TYPE) & F.col("o").isin(types)).select(F.col("s").alias("node")).distinct().join(reached, "node", "left_semi"), "members")
    own = same.join(reached.select(F.col("node").alias("src")), "src", "left_semi")
    described = quads.join(members.select(F.col("node").alias("s")), "s", "left_semi").where(~((F.col("p") == TYPE) & (F.col("o") == facet))).select(F.col("s").alias("node"))
    elected = primary_facets(own, described, members).select(F.col("facet").alias("s"), F.lit(TYPE).alias("p"), F.lit(facet).alias("o"), F.lit(graph).alias("g"))
    old = quads.where((F.col("p") == TYPE) & (F.col("o") == facet) & (F.col("g") == graph)).join(reached.select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o", "g")
    key = ["s", "p", "o", "g"]
    return elected.join(old, key, "left_anti").withColumn("op", F.lit(1)).unionByName(old.join(elected, key, "left_anti").withColumn("op", F.lit(-1)))


def representatives(classes: DataFrame) -> DataFrame:
    """Per component its first member that is no blank node (a blank one if there is none)."""
    return classes.groupBy("component").agg(F.min(F.struct(is_blank(F.col("node")).alias("blank"), F.col("node").alias("node")))["node"].alias("representative"))
