"""SPARQL algebra to DataFrames: one builder per node, the rest is Catalyst's.

Solutions are DataFrames with a column of terms per variable.  Variables that may be
unbound are tracked.  Joins on those that are always bound are plain equi-joins; where a
shared variable may be unbound, the rows are parted by which are, and each two parts meet in
an equi-join on what is bound in both.  What has nothing in common meets by blocks
(``all_pairs``), so no plan holds a Cartesian product.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...checkpoints import saved
from ...functions.time import duration_iso, duration_millis
from ...model import PERSONAL, QUAD, XSD, are_disjoint, datatype_of, integer_of, is_blank, is_iri, is_literal, lang_of, lexical, literal, number_of
from ...operators.graph import all_pairs, reachable, transitive_closure
from .parser import Parser, Query, SparqlError


@dataclass
class Rows:
    """Solutions: variables (with ``?``) are columns without it."""

    df: DataFrame
    variables: list[str]
    maybe: frozenset[str] = frozenset()


def col(variable: str) -> Column:
    return F.col(f"`{variable[1:]}`")


@dataclass
class Value:
    kind: str  # term, num, bool, str
    column: Column
    exact: Column | None = None  # of a number: its value as a whole decimal, null if it is none

    def whole(self) -> Column | None:
        return integer_of(self.column) if self.kind == "term" else self.exact

    def num(self) -> Column:
        if self.kind == "num":
            return self.column
        if self.kind == "term":
            return number_of(self.column)
        return F.lit(None).cast("double")

    def str(self) -> Column:
        if self.kind == "term":
            return lexical(self.column)
        return self.column.cast("string")

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "num":
            return (self.column != 0) & ~F.isnan(self.column)
        if self.kind == "str":
            return F.length(self.column) > 0
        kind, text = datatype_of(self.column), lexical(self.column)
        return F.when(kind == f"{XSD}boolean", text.isin("true", "1")).when(number_of(self.column).isNotNull(), number_of(self.column) != 0).when(is_literal(self.column), F.length(text) > 0)

    def term(self) -> Column:
        if self.kind == "term":
            return self.column
        if self.kind == "str":
            return literal(self.column)
        if self.kind == "bool":
            return literal(self.column, "boolean")
        whole = self.column == F.floor(self.column)
        plain = F.when(whole, literal(self.column.try_cast("bigint"), "integer")).otherwise(literal(self.column, "decimal"))
        return plain if self.exact is None else F.when(self.exact.isNotNull(), literal(self.exact, "integer")).otherwise(plain)


#: Variables that may be unbound up to which rows are parted by them.
PARTS = 4


def renamed(df: DataFrame, variables: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c if "?" + c in variables else c) for c in df.columns])


def split(df: DataFrame, variables: list[str], maybe: frozenset[str]) -> list[tuple[DataFrame, set[str]]]:
    """``df`` parted by which of the variables that may be unbound are, with those bound."""
    unsure = [v for v in variables if v in maybe]
    out = []
    for pattern in product((True, False), repeat=len(unsure)):
        part = df
        for v, bound in zip(unsure, pattern, strict=True):
            part = part.where(col(v).isNotNull() if bound else col(v).isNull())
        out.append((part, {v for v in variables if v not in maybe} | {v for v, bound in zip(unsure, pattern, strict=True) if bound}))
    return out


class Engine:
    """Queries over a quad table.

    ``disjoint`` says that no triple stands twice, be it in two graphs, so the union of graphs
    needs no distinct; by default the table says so itself (``model.disjoint``).
    """

    def __init__(self, quads: DataFrame, prefixes: dict[str, str] | None = None, disjoint: bool | None = None, services: dict[str, DataFrame] | None = None):
        self.disjoint = are_disjoint(quads) if disjoint is None else disjoint
        self.quads, self.prefixes = quads.select(*QUAD), prefixes
        #: Quad tables by the IRIs (with brackets) that SERVICE names them by.
        self.services = services or {}
        self.counter = 0

    # -- entry points

    def parse(self, text: str) -> Query:
        return Parser(text, self.prefixes, services=True).query()

    def solutions(self, text: str, bind: dict[str, list[str]] | None = None) -> DataFrame:
        """Terms of a SELECT; ``bind`` gives variables their values beforehand."""
        q = self.parse(text)
        if q.form != "SELECT":
            raise SparqlError("a SELECT query is needed")
        for name, values in (bind or {}).items():
            q = replace(q, where=("join", ("values", [name], [[v] for v in values]), q.where))
        return self.query(q).df

    def ask(self, text: str) -> bool:
        return not self.build(self.parse(text).where, None).df.limit(1).isEmpty()

    def construct(self, text: str) -> DataFrame:
        q = self.parse(text)
        rows = self.modified(q, self.build(q.where, None))
        return self.instantiated(rows, [(*t, None) for t in q.template]).select("s", "p", "o").distinct()

    def describe(self, text: str) -> DataFrame:
        q = self.parse(text)
        found = [t for t in q.resources if not t.startswith("?")]
        triples = self.quads.select("s", "p", "o").distinct()
        out = triples.where(F.col("s").isin(found))
        names = [t for t in q.resources if t.startswith("?")]
        if names:
            rows = self.build(q.where, None).df
            for v in names:
                out = out.union(triples.join(rows.select(col(v).alias("s")).distinct(), "s", "left_semi").select("s", "p", "o"))
        return out.distinct()

    def update(self, text: str) -> DataFrame:
        """What an update adds and removes: quads with ``op`` and ``seq``; nothing is applied.

        Quads without a graph have a null ``g``.
        """
        spark, out = self.quads.sparkSession, None
        for seq, u in enumerate(Parser(text, self.prefixes, services=True).update()):
            rows = self.build(u.where, None) if u.where else Rows(spark.range(1).select(F.lit(1).alias("_one")), [])
            for op, template in ((-1, u.delete), (1, u.insert)):
                if template:
                    own = self.instantiated(rows, template).distinct().select(*QUAD, F.lit(op).alias("op"), F.lit(2 * seq + (op > 0)).cast("long").alias("seq"))
                    out = own if out is None else out.unionByName(own)
        return out

    # -- patterns

    def fresh(self) -> str:
        self.counter += 1
        return f"_x{self.counter}"

    def build(self, node: tuple, graph: str | None) -> Rows:
        return getattr(self, "on_" + node[0])(node, graph)

    def triples(self, graph: str | None) -> DataFrame:
        if graph is None:
            df = self.quads.select("s", "p", "o")
            return df if self.disjoint else df.distinct()
        if graph.startswith("?"):
            return self.quads
        return self.quads.where(F.col("g") == graph).select("s", "p", "o")

    def pattern(self, t: tuple, graph: str | None, met: Rows | None = None) -> Rows:
        """Solutions of a triple pattern; a closure starts from a bound end, be it a term or a
        variable that ``met`` binds."""
        s, p, o = t
        if isinstance(p, tuple):
            pairs = self.path(p, graph, self.seed(s, met), self.seed(o, met)) if p[0] in ("plus", "star") else self.path(p, graph)
            source, places = pairs, [("x", s), ("y", o)]
            if p[0] in ("star", "maybe"):
                for here, there in ((s, o), (o, s)):
                    if not here.startswith("?"):
                        one = pairs.sparkSession.range(1).select(F.lit(here).alias("x"), F.lit(here).alias("y"))
                        source = source.unionByName(one.withColumn("g", F.lit(graph)) if "g" in source.columns else one)
                source = source.distinct()
        else:
            # the filter comes before the distinct of the union of graphs
            source, places = self.quads, [("s", s), ("p", p), ("o", o)]
        if graph is not None and graph.startswith("?"):
            places = [*places, ("g", graph)]
        elif graph is not None and not isinstance(p, tuple):
            source = source.where(F.col("g") == graph)
        variables: dict[str, str] = {}
        for place, term in places:
            if not term.startswith("?"):
                source = source.where(F.col(place) == term)
            elif term in variables:
                source = source.where(F.col(place) == F.col(variables[term]))
            else:
                variables[term] = place
        columns = [F.col(place).alias(v[1:]) for v, place in variables.items()]
        df = source.select(*columns) if columns else source.select(F.lit(1).alias(self.fresh()))
        if graph is None and not self.disjoint and not isinstance(p, tuple):
            df = df.distinct()
        return Rows(df, list(variables))

    @staticmethod
    def seed(term: str, met: Rows | None) -> DataFrame | str | None:
        if not term.startswith("?"):
            return term
        if met is not None and term in met.variables and term not in met.maybe:
            return met.df.select(col(term).alias("node"))
        return None

    def on_bgp(self, node: tuple, graph: str | None) -> Rows:
        left = list(node[1])
        if not left:
            return Rows(self.quads.sparkSession.range(1).select(F.lit(1).alias(self.fresh())), [])

        def rank(t: tuple, seen: set) -> tuple:
            names = {x for x in (t[0], t[1], t[2]) if isinstance(x, str) and x.startswith("?")}
            return (bool(seen) and not names & seen, isinstance(t[1], tuple), len(names - seen))

        seen: set[str] = set()
        out = None
        while left:
            t = min(left, key=lambda x: rank(x, seen))
            left.remove(t)
            rows = self.pattern(t, graph, out)
            seen |= set(rows.variables)
            out = rows if out is None else self.joined(out, rows)
        return out

    def meet(self, left: DataFrame, right: DataFrame, keys: list[str], how: str, condition: Column | None = None) -> DataFrame:
        """A join on variables bound in both; those of ``right`` have the prefix ``_r``."""
        on = reduce(lambda x, y: x & y, (col(v) == F.col(f"`_r{v[1:]}`") for v in keys)) if keys else None
        if on is None and condition is None and how in ("left_semi", "left_anti"):
            # whether there is any row at all: one row decides it
            some = F.broadcast(right.limit(1).agg(F.count(F.lit(1)).alias("_some")))
            return left.crossJoin(some).where(F.col("_some") == (1 if how == "left_semi" else 0)).drop("_some")
        if on is None and how == "inner":
            met = all_pairs(left, right)
            return met if condition is None else met.where(condition)
        return left.join(right, on if condition is None else on & condition, how)

    def joined(self, a: Rows, b: Rows, how: str = "inner", condition=None) -> Rows:
        shared = [v for v in a.variables if v in b.variables]
        variables = [*a.variables, *(v for v in b.variables if v not in a.variables)]
        right_of = lambda v: F.col(f"`_r{v[1:]}`")
        scope = {v: F.coalesce(col(v), right_of(v)) if v in shared else col(v) for v in variables}
        wanted = self.value(condition, scope).bool() if condition is not None else None
        columns = [(scope[v] if v in a.maybe else col(v)).alias(v[1:]) for v in variables]
        alone = [(col(v) if v in a.variables else F.lit(None).cast("string")).alias(v[1:]) for v in variables]
        unsure = [v for v in shared if v in a.maybe | b.maybe]
        left_parts, right_parts = [(a.df, set(shared) - set(unsure))], [(renamed(b.df, shared, "_r"), set(shared) - set(unsure))]
        rest = F.lit(True)
        if len(unsure) <= PARTS:
            left_parts = split(a.df, shared, a.maybe)
            right_parts = [(renamed(df, shared, "_r"), bound) for df, bound in split(b.df, shared, b.maybe)]
        else:
            for v in unsure:
                rest = rest & ((col(v) == right_of(v)) | col(v).isNull() | right_of(v).isNull())
        if wanted is not None or len(unsure) > PARTS:
            rest = rest if wanted is None else rest & wanted
        else:
            rest = None
        out = []
        for left, bound in left_parts:
            keys = [(df, [v for v in shared if v in bound & other]) for df, other in right_parts]
            if how == "left" and len(keys) == 1 and keys[0][1]:
                met = self.meet(left, *keys[0], "left", rest)
                out.append(met.select(*columns) if columns else met)
                continue
            number = how == "left" and any(not k for _, k in keys)
            own = saved(left.withColumn("_row", F.monotonically_increasing_id()), "optional") if number else left
            found = [self.meet(own, df, k, "inner", rest) for df, k in keys]
            out += [met.select(*columns) if columns else met for met in found]
            if how == "left" and number:
                hit = reduce(DataFrame.unionByName, [met.select("_row") for met in found]).distinct()
                out.append(own.join(hit, "_row", "left_anti").select(*alone))
            elif how == "left":
                for df, k in keys:
                    own = self.meet(own, df, k, "left_anti", rest)
                out.append(own.select(*alone))
        df = reduce(DataFrame.unionByName, out)
        if how == "left":
            return Rows(df, variables, a.maybe | {v for v in b.variables if v not in a.variables})
        return Rows(df, variables, (a.maybe - set(shared)) | (b.maybe - set(shared)) | (a.maybe & b.maybe))

    def having(self, rows: Rows, inner: Rows, some: bool, disjoint: bool = False) -> DataFrame:
        """Rows with (or without) a compatible one in ``inner``; with ``disjoint`` (MINUS) one
        that shares no bound variable does not count."""
        shared = [v for v in rows.variables if v in inner.variables]
        right_parts = [(renamed(df.select(*[col(v) for v in shared]), shared, "_r") if shared else df, bound) for df, bound in split(inner.df, shared, inner.maybe)]
        out = []
        for left, bound in split(rows.df, shared, rows.maybe):
            parts = [(df, keys) for df, other in right_parts if (keys := [v for v in shared if v in bound & other]) or not disjoint]
            if some and len(parts) == 1:
                out.append(self.meet(left, *parts[0], "left_semi"))
                continue
            missing = left
            for k, (df, keys) in enumerate(parts):
                if some:  # what an earlier part did not give
                    out.append(self.meet(missing, df, keys, "left_semi"))
                if not some or k + 1 < len(parts):
                    missing = self.meet(missing, df, keys, "left_anti")
            if not some:
                out.append(missing)
        return reduce(DataFrame.unionByName, out)

    def with_exists(self, rows: Rows, e, graph: str | None):
        """The rows with a column for each EXISTS inside an expression, and the expression on those."""
        if not isinstance(e, tuple):
            if isinstance(e, list):
                out = []
                for x in e:
                    rows, y = self.with_exists(rows, x, graph)
                    out.append(y)
                return rows, out
            return rows, e
        if e and e[0] == "exists":
            inner, name = self.build(e[1], graph), self.fresh()
            found = [self.having(rows, inner, some).withColumn(name, F.lit(some == e[2])) for some in (True, False)]
            return replace(rows, df=found[0].unionByName(found[1])), ("column", "bool", name)
        out = []
        for x in e:
            rows, y = self.with_exists(rows, x, graph)
            out.append(y)
        return rows, tuple(out)

    def on_join(self, node: tuple, graph: str | None) -> Rows:
        return self.joined(self.build(node[1], graph), self.build(node[2], graph))

    def on_optional(self, node: tuple, graph: str | None) -> Rows:
        return self.joined(self.build(node[1], graph), self.build(node[2], graph), "left", node[3])

    def on_union(self, node: tuple, graph: str | None) -> Rows:
        a, b = self.build(node[1], graph), self.build(node[2], graph)
        df = a.df.select(*[col(v) for v in a.variables]).unionByName(b.df.select(*[col(v) for v in b.variables]), allowMissingColumns=True)
        both = [*a.variables, *(v for v in b.variables if v not in a.variables)]
        return Rows(df, both, a.maybe | b.maybe | (set(a.variables) ^ set(b.variables)))

    def on_minus(self, node: tuple, graph: str | None) -> Rows:
        a, b = self.build(node[1], graph), self.build(node[2], graph)
        if not set(a.variables) & set(b.variables):
            return a
        return replace(a, df=self.having(a, b, False, disjoint=True))

    def on_graph(self, node: tuple, graph: str | None) -> Rows:
        return self.build(node[2], node[1])

    def on_service(self, node: tuple, graph: str | None) -> Rows:
        """The pattern over another quad table; one solution without bindings if it is unknown and SILENT."""
        _, name, silent, inner = node
        if name not in self.services:
            if silent:
                return self.on_bgp(("bgp", []), None)
            raise SparqlError(f"unknown service {name}")
        other = Engine(self.services[name], self.prefixes, services=self.services)
        other.counter = self.counter + 1000  # names of its own
        rows = other.build(inner, None)
        self.counter = other.counter
        return rows

    def on_filter(self, node: tuple, graph: str | None) -> Rows:
        rows, e = self.build(node[1], graph), node[2]
        parts = []

        def cut(x) -> None:
            if x[0] == "and":
                cut(x[1])
                cut(x[2])
            else:
                parts.append(x)

        cut(e)
        for x in parts:
            if x[0] == "not" and x[1][0] == "exists":
                x = ("exists", x[1][1], not x[1][2])
            if x[0] == "exists":
                rows = replace(rows, df=self.having(rows, self.build(x[1], graph), x[2]))
            else:
                names = rows.df.columns
                more, x = self.with_exists(rows, x, graph)
                rows = replace(rows, df=more.df.where(self.value(x, {v: col(v) for v in rows.variables}).bool()).select(*[F.col(f"`{c}`") for c in names]))
        return rows

    def on_extend(self, node: tuple, graph: str | None) -> Rows:
        rows = self.build(node[1], graph)
        names = rows.df.columns
        more, e = self.with_exists(rows, node[3], graph)
        term = self.value(e, {v: col(v) for v in rows.variables}).term().alias(node[2][1:])
        sure = node[3][0] == "term" or (node[3][0] == "var" and node[3][1] in rows.variables and node[3][1] not in rows.maybe)
        return Rows(more.df.select(*[F.col(f"`{c}`") for c in names], term), [*rows.variables, node[2]], rows.maybe if sure else rows.maybe | {node[2]})

    def on_values(self, node: tuple, graph: str | None) -> Rows:
        names, rows = node[1], node[2]
        df = self.quads.sparkSession.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n[1:]}` string" for n in names))
        return Rows(df, list(names), frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows)))

    def on_select(self, node: tuple, graph: str | None) -> Rows:
        return self.query(node[1], graph)

    # -- property paths

    def path(self, p, graph: str | None, start: DataFrame | str | None = None, end: DataFrame | str | None = None) -> DataFrame:
        """Pairs ``x, y`` (and ``g`` where the graph is a variable); closures from ``start`` or to
        ``end`` only, where these are given."""
        if isinstance(p, str):
            return self.links(F.col("p") == p, graph)
        kind, inner = p
        g = ["g"] if graph is not None and graph.startswith("?") else []
        if kind == "inv":
            return self.path(inner, graph).select(F.col("y").alias("x"), F.col("x").alias("y"), *g)
        if kind == "seq":
            out = self.path(inner[0], graph)
            for q in inner[1:]:
                out = out.withColumnRenamed("y", "m").join(self.path(q, graph).withColumnRenamed("x", "m"), ["m", *g]).select("x", "y", *g)
            return out
        if kind == "alt":
            out = self.path(inner[0], graph)
            for q in inner[1:]:
                out = out.unionByName(self.path(q, graph))
            return out
        if kind == "not":
            forth = [x for x in inner if isinstance(x, str)]
            back = [x[1] for x in inner if not isinstance(x, str)]
            out = self.links(~F.col("p").isin(forth), graph) if forth or not back else None
            if back:
                other = self.links(~F.col("p").isin(back), graph).select(F.col("y").alias("x"), F.col("x").alias("y"), *g)
                out = other if out is None else out.unionByName(other)
            return out
        step = self.path(inner, graph).distinct()
        if kind == "maybe":
            closed = step
        else:
            # within a graph: a node is then its graph and itself
            node = (lambda c: F.struct("g", F.col(c).alias("n"))) if g else F.col
            edges = step.select(node("x").alias("src"), node("y").alias("dst"))
            if not g and (start is not None or end is not None):
                closed = self.closure_from(edges, start, end)
            else:
                closed = transitive_closure(edges)
            closed = closed.select(F.col("src.g").alias("g"), F.col("src.n").alias("x"), F.col("dst.n").alias("y")) if g else closed.select(F.col("src").alias("x"), F.col("dst").alias("y"))
        if kind == "plus":
            return closed
        triples = self.triples(graph)
        nodes = triples.select(*g, F.col("s").alias("x")).union(triples.select(*g, "o")).distinct()
        return closed.unionByName(nodes.select(*g, "x", F.col("x").alias("y"))).distinct()

    def closure_from(self, edges: DataFrame, start: DataFrame | str | None, end: DataFrame | str | None) -> DataFrame:
        """Pairs of a closure with one end among the nodes given; a term goes before a variable."""
        backwards = start is None or (isinstance(end, str) and not isinstance(start, str))
        seeds = end if backwards else start
        if isinstance(seeds, str):
            seeds = edges.sparkSession.range(1).select(F.lit(seeds).alias("node"))
        if backwards:
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reachable(edges, seeds)
        return found.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else found

    def links(self, which: Column, graph: str | None) -> DataFrame:
        df = self.quads.where(which)
        if graph is not None and graph.startswith("?"):
            return df.select(F.col("s").alias("x"), F.col("o").alias("y"), "g")
        if graph is not None:
            return df.where(F.col("g") == graph).select(F.col("s").alias("x"), F.col("o").alias("y"))
        df = df.select(F.col("s").alias("x"), F.col("o").alias("y"), "p")
        return (df if self.disjoint else df.distinct()).select("x", "y")

    # -- solution modifiers

    def query(self, q: Query, graph: str | None = None) -> Rows:
        return self.modified(q, self.build(q.where, graph))

    def modified(self, q: Query, rows: Rows) -> Rows:
        aggregates: list[Column] = []

        def lift(e):
            if not isinstance(e, tuple):
                return [lift(x) for x in e] if isinstance(e, list) else e
            if e and e[0] == "aggregate":
                name = self.fresh()
                value, kind = self.aggregate(e, {v: col(v) for v in rows.variables})
                aggregates.append(value.alias(name))
                return ("column", kind, name)
            return tuple(lift(x) for x in e)

        variables = [(v, lift(e) if e is not None else None) for v, e in q.variables]
        having = [lift(e) for e in q.having]
        order = [(up, lift(e)) for up, e in q.order]
        if q.group or aggregates:
            df, keys = rows.df, []
            for v, e in q.group:
                if e is not None:
                    df = df.withColumn(v[1:], self.value(e, {x: col(x) for x in rows.variables}).term())
                keys.append(v)
            grouped = df.groupBy(*[col(v) for v in keys])
            df = grouped.agg(*aggregates) if aggregates else df.select(*[col(v) for v in keys]).distinct()
            rows = Rows(df, keys, rows.maybe & set(keys))
        for e in having:
            rows = replace(rows, df=rows.df.where(self.value(e, {v: col(v) for v in rows.variables}).bool()))
        out = list(rows.variables) if not variables else []
        for v, e in variables:
            if e is not None:
                term = self.value(e, {x: col(x) for x in rows.variables}).term()
                rows = Rows(rows.df.withColumn(v[1:], term), [*rows.variables, v], rows.maybe | {v})
            elif v not in rows.variables:
                rows = Rows(rows.df.withColumn(v[1:], F.lit(None).cast("string")), [*rows.variables, v], rows.maybe | {v})
            out.append(v)
        names = [v for v in out if not v.startswith("?_")] if not variables else out
        df = rows.df
        if q.distinct and names:  # the order may then use selected variables only
            rows = Rows(df.select(*[col(v) for v in names]).distinct(), names, rows.maybe & set(names))
            df = rows.df
        if order:
            keys = []
            for up, e in order:
                value = self.value(e, {v: col(v) for v in rows.variables})
                number, text = value.num(), value.str()
                keys += [number.asc_nulls_first(), text.asc_nulls_first()] if up else [number.desc_nulls_last(), text.desc_nulls_last()]
            df = df.orderBy(*keys)
        df = df.select(*[col(v) for v in names]) if names else df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rows(df, names, rows.maybe & set(names))

    def aggregate(self, e: tuple, scope: dict) -> tuple[Column, str]:
        _, name, distinct, inner, separator = e
        if name == "COUNT":
            if inner is None:
                return (F.count_distinct(F.struct(*scope.values())) if distinct and scope else F.count(F.lit(1))).cast("double"), "num"
            term = self.value(inner, scope).term()
            return (F.count_distinct(term) if distinct else F.count(term)).cast("double"), "num"
        value = self.value(inner, scope)
        if name in ("SUM", "AVG"):
            number, whole = value.num(), value.whole() if name == "SUM" else None
            if whole is not None:  # whole numbers alone have a whole sum, whatever its size
                add = F.sum_distinct if distinct else F.sum
                exact = F.when(F.count(number) == F.count(whole), F.coalesce(add(whole), F.lit(0).cast("decimal(38,0)")))
                return F.when(exact.isNotNull(), literal(exact, "integer")).otherwise(Value("num", add(number)).term()), "term"
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg}.get((name, distinct))
            if f is None:
                return F.try_divide(F.sum_distinct(number), F.count_distinct(number)), "num"
            return F.coalesce(f(number), F.lit(0.0)) if name == "SUM" else f(number), "num"
        if name == "GROUP_CONCAT":
            found = F.array_sort((F.collect_set if distinct else F.collect_list)(value.str()))
            return F.array_join(found, separator), "str"
        if name == "SAMPLE":
            return F.min(value.term()), "term"
        pick = F.min if name == "MIN" else F.max
        return pick(F.struct(value.num().alias("n"), value.term().alias("t")))["t"], "term"

    # -- expressions

    def value(self, e, scope: dict[str, Column]) -> Value:
        kind = e[0]
        if kind == "var":
            return Value("term", scope.get(e[1], F.lit(None).cast("string")))
        if kind == "term":
            return Value("term", F.lit(e[1]))
        if kind == "column":
            return Value(e[1], F.col(e[2]))
        if kind in ("and", "or"):
            a, b = self.value(e[1], scope).bool(), self.value(e[2], scope).bool()
            return Value("bool", a & b if kind == "and" else a | b)
        if kind == "not":
            return Value("bool", ~self.value(e[1], scope).bool())
        if kind == "in":
            out = F.lit(False)
            for x in e[2]:
                out = out | self.compare("=", self.value(e[1], scope), self.value(x, scope))
            return Value("bool", out)
        if kind in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", self.compare(kind, self.value(e[1], scope), self.value(e[2], scope)))
        if kind in ("+", "-", "*", "/"):
            left, right = self.value(e[1], scope), self.value(e[2], scope)
            a, b, m, n = left.num(), right.num(), left.whole(), right.whole()
            apply = {"+": (lambda: a + b, F.try_add), "-": (lambda: a - b, F.try_subtract), "*": (lambda: a * b, F.try_multiply), "/": (lambda: F.try_divide(a, b), None)}[kind]
            exact = apply[1](m, n).try_cast("decimal(38,0)") if apply[1] and m is not None and n is not None else None
            return Value("num", apply[0](), exact)
        if kind == "call":
            return self.call(e[1], e[2], scope)
        raise SparqlError(f"{kind} cannot stand here")

    @staticmethod
    def compare(op: str, a: Value, b: Value) -> Column:
        apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if "bool" in (a.kind, b.kind):
            return apply(a.bool(), b.bool())
        if "num" in (a.kind, b.kind):
            return apply(a.num(), b.num())
        if a.kind == b.kind == "term":
            rest = apply(a.column, b.column) if op in ("=", "!=") else F.when(datatype_of(a.column) == datatype_of(b.column), apply(a.str(), b.str()))
            return F.coalesce(apply(a.num(), b.num()), rest)
        return apply(a.str(), b.str())

    def call(self, name: str, args: list, scope: dict) -> Value:
        v = [self.value(x, scope) for x in args] if name != "BOUND" else []
        n = len(args)
        if name == "BOUND":
            return Value("bool", scope[args[0][1]].isNotNull() if args[0][1] in scope else F.lit(False))
        if name == "IF":
            return Value("term", F.when(v[0].bool(), v[1].term()).otherwise(v[2].term()))
        if name == "COALESCE":
            return Value("term", F.coalesce(*(x.term() for x in v)))
        if name == "STR":
            return Value("str", v[0].str())
        if name == "LANG":
            return Value("str", lang_of(v[0].term()))
        if name == "DATATYPE":
            return Value("term", F.concat(F.lit("<"), datatype_of(v[0].term()), F.lit(">")))
        if name == "LANGMATCHES":
            have, want = F.lower(v[0].str()), F.lower(v[1].str())
            return Value("bool", F.when(want == "*", have != "").otherwise((have == want) | have.startswith(F.concat(want, F.lit("-")))))
        if name in ("IRI", "URI"):
            return Value("term", F.concat(F.lit("<"), v[0].str(), F.lit(">")))
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC"):
            t = v[0].term()
            return Value("bool", {"ISBLANK": is_blank(t), "ISLITERAL": is_literal(t), "ISNUMERIC": number_of(t).isNotNull()}.get(name, is_iri(t)))
        if name == "SAMETERM":
            return Value("bool", v[0].term() == v[1].term())
        if name == "STRLANG":
            return Value("term", F.concat(literal(v[0].str()), F.lit("@"), v[1].str()))
        if name == "STRDT":
            return Value("term", F.concat(literal(v[0].str()), F.lit("^^"), v[1].term()))
        if name == "REGEX":
            return Value("bool", v[0].str().rlike(self.pattern_of(args[1], args[2] if n > 2 else None)))
        if name == "REPLACE":
            return Value("str", F.regexp_replace(v[0].str(), F.lit(self.pattern_of(args[1], args[3] if n > 3 else None)), v[2].str()))
        strings = {
            "UCASE": F.upper, "LCASE": F.lower, "MD5": F.md5, "SHA1": lambda x: F.sha1(x.cast("binary")), "SHA256": lambda x: F.sha2(x, 256), "SHA512": lambda x: F.sha2(x, 512), "ENCODE_FOR_URI": lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")),
        }
        if name in strings:
            return Value("str", strings[name](v[0].str()))
        tests = {"CONTAINS": lambda a, b: a.contains(b), "STRSTARTS": lambda a, b: a.startswith(b), "STRENDS": lambda a, b: a.endswith(b)}
        if name in tests:
            return Value("bool", tests[name](v[0].str(), v[1].str()))
        if name == "CONCAT":
            return Value("str", F.concat(*(x.str() for x in v)))
        if name == "SUBSTR":
            return Value("str", F.substring(v[0].str(), v[1].num().cast("int"), v[2].num().cast("int") if n > 2 else F.lit(1 << 30)))
        if name in ("STRBEFORE", "STRAFTER"):
            a, b = v[0].str(), v[1].str()
            at = F.instr(a, b) if False else F.position(b, a)
            return Value("str", F.when(at == 0, "").otherwise(F.substring(a, F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(a, at + F.length(b), F.lit(1 << 30))))
        if name == "STRLEN":
            return Value("num", F.length(v[0].str()).cast("double"))
        numbers = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda x: F.floor(x + 0.5)}
        if name in numbers:
            return Value("num", numbers[name](v[0].num()).cast("double"))
        stamp = lambda i: F.try_to_timestamp(v[i].str())
        dates = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}
        if name in dates:
            return Value("num", dates[name](stamp(0)).cast("double"))
        if name == "NOW":
            return Value("term", literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "dateTime"))
        if name == "RAND":
            return Value("num", F.rand())
        if name in ("UUID", "STRUUID"):
            return Value("str", F.uuid()) if name == "STRUUID" else Value("term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
        if name == f"<{PERSONAL}durationInMillis>":
            return Value("num", duration_millis(stamp(0), stamp(1)).cast("double"))
        if name == f"<{PERSONAL}duration>":
            return Value("term", literal(duration_iso(stamp(0), stamp(1)), "duration"))
        casts = {f"<{XSD}{t}>" for t in ("integer", "decimal", "double", "float", "long", "int")}
        if name in casts:
            return Value("num", v[0].str().try_cast("double"))
        if name == f"<{XSD}string>":
            return Value("str", v[0].str())
        if name == f"<{XSD}boolean>":
            return Value("bool", v[0].str().try_cast("boolean"))
        if name in (f"<{XSD}dateTime>", f"<{XSD}date>"):
            return Value("term", F.when(stamp(0).isNotNull(), literal(v[0].str(), name.removesuffix(">").rpartition("#")[2])))
        raise SparqlError(f"unknown function {name}")

    @staticmethod
    def pattern_of(pattern, flags) -> str:
        if pattern[0] != "term":
            raise SparqlError("a pattern must be constant")
        import re

        text = re.sub(r'^"(.*)"$', r"\1", pattern[1], flags=re.S).replace("\\\\", "\\")
        return f"(?{flags[1].strip(chr(34))}){text}" if flags else text

    # -- templates

    def instantiated(self, rows: Rows, template: list) -> DataFrame:
        place = lambda t: F.lit(None).cast("string") if t is None else (col(t) if t in rows.variables else F.lit(None).cast("string")) if t.startswith("?") else F.lit(t)
        quads = [F.struct(*(place(x).alias(n) for n, x in zip(QUAD, t, strict=True))) for t in template]
        out = rows.df.select(F.explode(F.array(*quads)).alias("q")).select("q.*")
        return out.where("s is not null and p is not null and o is not null and s not like '\"%' and p like '<%'")


def select(quads: DataFrame, text: str, disjoint: bool | None = None, decode: bool = True, bind: dict[str, list[str]] | None = None, services: dict[str, DataFrame] | None = None) -> DataFrame:
    """Solutions of a SELECT; with ``decode`` as plain strings instead of terms."""
    df = Engine(quads, disjoint=disjoint, services=services).solutions(text, bind)
    return df.select(*[lexical(F.col(f"`{c}`")).alias(c) for c in df.columns]) if decode else df


def ask(quads: DataFrame, text: str) -> bool:
    return Engine(quads).ask(text)


def construct(quads: DataFrame, text: str, disjoint: bool | None = None) -> DataFrame:
    return Engine(quads, disjoint=disjoint).construct(text)


def describe(quads: DataFrame, text: str) -> DataFrame:
    return Engine(quads).describe(text)


def update(quads: DataFrame, text: str) -> DataFrame:
    return Engine(quads).update(text)
