"""RDF files: N-Triples and N-Quads by lines, Turtle, TriG, RDF/XML, TriX, RDF/JSON; result formats."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import QUADS_DDL, RDF, XSD, document_diff, is_blank, is_iri, is_literal, lang_of, lexical
from ..plans.sparql.parser import Parser

_TERM = r'(<[^>]*>|_:[A-Za-z0-9]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*(<[^>]*>|_:[A-Za-z0-9]+)\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>|_:[A-Za-z0-9]+)?\s*\.\s*(?:#.*)?$"


def read_nquads(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads files; triples get ``graph``.  Lines that are neither are left out."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", _LINE, i)
    g = F.when(part(4) != "", part(4)).otherwise(F.lit(graph))
    return lines.where(F.col("value").rlike(_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), g.alias("g"))


def write_nquads(quads: DataFrame, path: str) -> None:
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), F.col("g"))).otherwise("")
    quads.select(F.concat_ws(" ", "s", "p", "o").alias("t"), g.alias("g")).select(F.concat("t", "g", F.lit(" ."))).write.text(path)


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of a Turtle document: prefixes, ``a``, ``;``, ``,``, ``[]`` and literals."""
    text = re.sub(r"(?im)^\s*@(prefix|base)(\s+[^\n]*?)\s*\.\s*$", r"\1\2", text)
    p = Parser(text, {})
    out = []
    while p.peek()[0] != "end":
        p.prologue()
        if p.peek()[0] == "end":
            break
        out += p.triples()
        p.take(".")
    blank = lambda t: "_:" + t[2:] if isinstance(t, str) and t.startswith("?_") else t
    return [tuple(map(blank, t)) for t in out]


def read_turtle(spark: SparkSession, text: str, graph: str) -> DataFrame:
    """A small Turtle document, such as an ontology."""
    return spark.createDataFrame([(*t, graph) for t in parse_turtle(text)], QUADS_DDL)


def load_ontology(spark: SparkSession, text: str, graph: str, stored: DataFrame) -> DataFrame:
    """The diff that makes the stored graph of an ontology that of a Turtle text; empty if it is."""
    return document_diff(read_turtle(spark, text, graph), stored)


_SKIP = re.compile(r'''(?s)"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^<>\s]*>|\#[^\n]*|[{}]|.''')


def parse_trig(text: str, default: str | None = None) -> list[tuple[str, str, str, str | None]]:
    """Quads of a TriG document: Turtle, and blocks of it with a graph's name before them."""
    out, plain, depth, block, name = [], [], 0, [], None
    for m in _SKIP.finditer(text):
        token = m[0]
        if token == "{" and depth == 0:
            head = "".join(plain)
            named = re.search(r"(?s)(?:\b(?i:graph)\s+)?(<[^<>\s]*>|[\w-]*:[\w.-]*)?\s*$", head)
            name, plain, depth, block = named[1], [head[: named.start()]], 1, []
        elif token == "}" and depth == 1:
            depth = 0
            prologue = "\n".join(re.findall(r"(?im)^\s*@?(?:prefix|base)\b[^\n]*$", "".join(plain)))
            inner = "".join(block).strip()
            g = default if name is None else parse_turtle(f"{prologue}\n{name} <urn:p> <urn:o> .")[0][0]
            if inner:
                out += [(*t, g) for t in parse_turtle(f"{prologue}\n{inner}" + ("" if inner.endswith(".") else " ."))]
        elif not token.startswith("#"):
            (block if depth else plain).append(token)
    return [(*t, default) for t in parse_turtle("".join(plain))] + out


def _literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    body = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{body}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != f"{XSD}string" else "")


_XML = "{http://www.w3.org/XML/1998/namespace}"


def parse_trix(text: str, default: str | None = None) -> list[tuple[str, str, str, str | None]]:
    """Quads of a TriX document."""

    def term(e) -> str:
        kind, own = e.tag.rpartition("}")[2], e.text or ""
        if kind == "uri":
            return f"<{own.strip()}>"
        if kind == "id":
            return f"_:{own.strip()}"
        return _literal(own, e.get("datatype"), e.get(f"{_XML}lang"))

    out = []
    for graph in ElementTree.fromstring(text):
        parts = list(graph)
        named = [e for e in parts if e.tag.rpartition("}")[2] == "uri"]
        g = term(named[0]) if named else default
        out += [(*map(term, t), g) for t in parts if t.tag.rpartition("}")[2] == "triple"]
    return out


def parse_rdf_xml(text: str, base: str = "") -> list[tuple[str, str, str]]:
    """Triples of an RDF/XML document: typed nodes, property attributes, ``rdf:about``, ``ID``,
    ``nodeID``, ``resource``, ``datatype``, ``parseType`` (Resource, Collection, Literal), ``li``."""
    out: list[tuple[str, str, str]] = []
    r, count = f"{{{RDF}}}", 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def name(tag: str) -> str:
        return f"<{tag[1:].replace('}', '', 1)}>"

    def reference(value: str, at: str) -> str:
        return f"<{urljoin(at, value) if at else value}>"

    def node(e, at: str, lang: str | None) -> str:
        at, lang = e.get(f"{_XML}base", at), e.get(f"{_XML}lang", lang)
        if f"{r}about" in e.attrib:
            s = reference(e.get(f"{r}about"), at)
        elif f"{r}ID" in e.attrib:
            s = reference("#" + e.get(f"{r}ID"), at)
        else:
            s = f"_:{e.get(f'{r}nodeID')}" if f"{r}nodeID" in e.attrib else fresh()
        if e.tag != f"{r}Description":
            out.append((s, f"<{RDF}type>", name(e.tag)))
        attributes(e, s, at, lang)
        properties(e, s, at, lang)
        return s

    def attributes(e, s: str, at: str, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k == f"{r}type":
                out.append((s, f"<{RDF}type>", reference(v, at)))
            elif k.startswith("{") and not k.startswith((_XML, r)):
                out.append((s, name(k), _literal(v, None, lang)))

    def properties(e, s: str, at: str, lang: str | None) -> None:
        nth = 0
        for p in e:
            if p.tag == f"{r}li":
                nth += 1
                predicate = f"<{RDF}_{nth}>"
            else:
                predicate = name(p.tag)
            own_at, own_lang = p.get(f"{_XML}base", at), p.get(f"{_XML}lang", lang)
            kind = p.get(f"{r}parseType")
            if kind == "Resource":
                o = fresh()
                properties(p, o, own_at, own_lang)
            elif kind == "Collection":
                items = [node(x, own_at, own_lang) for x in p]
                cells = [fresh() for _ in items]
                for k, (cell, item) in enumerate(zip(cells, items, strict=True)):
                    out.append((cell, f"<{RDF}first>", item))
                    out.append((cell, f"<{RDF}rest>", cells[k + 1] if k + 1 < len(cells) else f"<{RDF}nil>"))
                o = cells[0] if cells else f"<{RDF}nil>"
            elif kind is not None:
                o = _literal((p.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in p), f"{RDF}XMLLiteral")
            elif f"{r}resource" in p.attrib or f"{r}nodeID" in p.attrib:
                o = reference(p.get(f"{r}resource"), own_at) if f"{r}resource" in p.attrib else f"_:{p.get(f'{r}nodeID')}"
                attributes(p, o, own_at, own_lang)
            elif len(p):
                o = node(p[0], own_at, own_lang)
            elif any(k.startswith("{") and not k.startswith((_XML, r)) for k in p.attrib):
                o = fresh()
                attributes(p, o, own_at, own_lang)
            else:
                datatype = p.get(f"{r}datatype")
                o = _literal(p.text or "", datatype, None if datatype else own_lang)
            out.append((s, predicate, o))
            if f"{r}ID" in p.attrib:
                statement = reference("#" + p.get(f"{r}ID"), own_at)
                out.extend((statement, f"<{RDF}{k}>", v) for k, v in (("subject", s), ("predicate", predicate), ("object", o)))
                out.append((statement, f"<{RDF}type>", f"<{RDF}Statement>"))

    root = ElementTree.fromstring(text)
    for e in root if root.tag == f"{r}RDF" else [root]:
        node(e, root.get(f"{_XML}base", base), root.get(f"{_XML}lang"))
    return out


def parsed(text: str, kind: str, graph: str | None = None) -> list[tuple[str, str, str, str | None]]:
    """Quads of a document of a kind: ttl, n3, trig, trix, rdf."""
    if kind == "trig":
        return parse_trig(text, graph)
    if kind == "trix":
        return parse_trix(text, graph)
    # N3 is read as far as it is Turtle
    triples = parse_rdf_xml(text, (graph or "").strip("<>")) if kind == "rdf" else parse_turtle(text)
    return [(*t, graph) for t in triples]


def read_rdf(spark: SparkSession, path: str, kind: str, graph: str | None = None) -> DataFrame:
    """Quads of all documents of a kind under a path; each is parsed by one task.  Blank nodes
    of different documents differ.  ``error`` tells why a document gave none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path_, text in zip(pdf["path"], pdf["content"], strict=True):
                own = lambda t, p=path_: f"_:d{abs(hash_of(p))}{t[2:]}" if isinstance(t, str) and t.startswith("_:") else t
                try:
                    rows += [(*map(own, q), None) for q in parsed(bytes(text).decode("utf-8", "replace").lstrip("\ufeff"), kind, graph)]
                except Exception as e:  # any fault of a document is that document's
                    rows.append((None, None, None, None, f"{path_}: {e}"))
            yield pd.DataFrame(rows, columns=["s", "p", "o", "g", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, QUADS_DDL + ", error string")


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def read_rdf_json(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """RDF/JSON documents, one to a file: subjects, predicates, lists of objects."""
    kind = "map<string, map<string, array<struct<value:string,type:string,lang:string,datatype:string>>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    subjects = docs.select(F.explode("d").alias("s", "ps")).select("s", F.explode("ps").alias("p", "os")).select("s", "p", F.explode("os").alias("o"))
    name = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o.lang").isNotNull(), F.concat(F.lit("@"), F.col("o.lang"))).when(F.col("o.datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o.datatype"), F.lit(">"))).otherwise("")
    o = F.when(F.col("o.type") == "literal", F.concat(F.lit('"'), F.replace(F.col("o.value"), F.lit('"'), F.lit('\\"')), F.lit('"'), tail)).otherwise(name(F.col("o.value")))
    return subjects.select(name(F.col("s")).alias("s"), F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), o.alias("o"), F.lit(graph).alias("g"))


# -- results


def results_json(terms: DataFrame) -> DataFrame:
    """One JSON binding per solution of terms, in the SPARQL results form."""

    def binding(c: str):
        t = F.col(f"`{c}`")
        kind = F.when(is_iri(t), "uri").when(is_blank(t), "bnode").when(is_literal(t), "literal")
        datatype = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
        lang = lang_of(t)
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), lexical(t).alias("value"), F.when(lang != "", lang).alias("xml:lang"), F.when(datatype != "", datatype).alias("datatype"))).alias(c)

    return terms.select(F.to_json(F.struct(*[binding(c) for c in terms.columns])).alias("binding"))


def _bindings(terms: DataFrame, limit: int | None) -> Iterator[str]:
    for n, row in enumerate(results_json(terms).toLocalIterator()):
        if limit is not None and n >= limit:
            raise ValueError(f"more than {limit} solutions")
        yield row[0]


def json_chunks(terms: DataFrame, limit: int | None = None) -> Iterator[str]:
    """A whole results document of any size, piece by piece: one partition at a time is held.

    More than ``limit`` solutions, where one is given, are an error; none is cut off.
    """
    yield '{"head": ' + json.dumps({"vars": terms.columns}) + ', "results": {"bindings": ['
    comma = ""
    for binding in _bindings(terms, limit):
        yield comma + binding
        comma = ","
    yield "]}}"


def xml_chunks(terms: DataFrame, limit: int | None = None) -> Iterator[str]:
    head = "".join(f'<variable name="{escape(c)}"/>' for c in terms.columns)
    yield f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>'
    for binding in _bindings(terms, limit):
        cells = []
        for name, b in json.loads(binding).items():
            attributes = "".join(f' {k}="{escape(b[k])}"' for k in ("xml:lang", "datatype") if b.get(k))
            cells.append(f'<binding name="{escape(name)}"><{b["type"]}{attributes}>{escape(b["value"])}</{b["type"]}></binding>')
        yield f"<result>{''.join(cells)}</result>"
    yield "</results></sparql>"


def results_document(terms: DataFrame, limit: int | None = None) -> str:
    """A whole results document as one text; ``json_chunks`` gives it piece by piece."""
    return "".join(json_chunks(terms, limit))


def results_xml(terms: DataFrame, limit: int | None = None) -> str:
    return "".join(xml_chunks(terms, limit))


def boolean_document(answer: bool, kind: str = "json") -> str:
    """The results document of an ASK: json, xml or text."""
    word = "true" if answer else "false"
    if kind == "json":
        return f'{{"head": {{}}, "boolean": {word}}}'
    if kind == "xml":
        return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>'
    return word


def write_results_json(terms: DataFrame, path: str) -> None:
    """All solutions as lines of JSON bindings, written by the executors."""
    results_json(terms).write.text(path)


def write_results_csv(terms: DataFrame, path: str, separator: str = ",") -> None:
    """SPARQL CSV (plain values), or TSV with a tabulator (terms)."""
    df = terms if separator == "\t" else terms.select(*[lexical(F.col(f"`{c}`")).alias(c) for c in terms.columns])
    df.write.option("header", True).option("sep", separator).csv(path)


def graphml(nodes: list[tuple[str, dict]], edges: list[tuple[str, str, dict]], directed: bool = True) -> str:
    """A GraphML document of a small graph."""
    keys = {("node", k) for _, a in nodes for k in a} | {("edge", k) for *_, a in edges for k in a}
    out = ['\ufeff<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id="{f}_{escape(k)}" for="{f}" attr.name="{escape(k)}" attr.type="string"/>' for f, k in sorted(keys)]
    out.append(f'<graph edgedefault="{"directed" if directed else "undirected"}">')
    data = lambda f, a: "".join(f'<data key="{f}_{escape(k)}">{escape(str(v))}</data>' for k, v in sorted(a.items()))
    out += [f'<node id="{escape(n)}">{data("node", a)}</node>' for n, a in nodes]
    out += [f'<edge source="{escape(s)}" target="{escape(t)}">{data("edge", a)}</edge>' for s, t, a in edges]
    return "\n".join([*out, "</graph>", "</graphml>"])
