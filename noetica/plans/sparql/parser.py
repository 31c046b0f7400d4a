"""Recursive-descent parser for SPARQL queries and updates.

It gives plain tuples: ``("bgp", [(s, p, o)])``, ``("join", a, b)``, ``("optional", a, b,
condition)``, ``("union", a, b)``, ``("minus", a, b)``, ``("graph", g, a)``, ``("filter",
a, expression)``, ``("extend", a, variable, expression)``, ``("values", variables, rows)``,
``("select", query)``.  Terms are strings as in the quad table; variables start with ``?``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ...model import PREFIXES, RDF, XSD

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<blank>_:\w+)|(?P<name>[A-Za-z][\w.-]*)?(?P<colon>:)(?P<local>[\w%-]*(?:\.[\w%-]+)*)
    |(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,=<>!*/+^|?-])""",
    re.X,
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class SparqlError(ValueError):
    pass


@dataclass
class Query:
    form: str = "SELECT"
    variables: list = field(default_factory=list)  # (name, expression or None); empty: all
    distinct: bool = False
    where: tuple = ("bgp", [])
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)
    resources: list = field(default_factory=list)


@dataclass
class Update:
    delete: list = field(default_factory=list)  # (s, p, o, graph or None)
    insert: list = field(default_factory=list)
    where: tuple | None = None


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, services: bool = False):
        self.services = services  # whether there is anything that SERVICE could name
        self.prefixes = dict(PREFIXES if prefixes is None else prefixes)
        self.base, self.blanks, self.tokens, at = "", 0, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            at = m.end()
            kind = m.lastgroup
            if kind == "local":
                self.tokens.append(("pname", (m["name"] or "", m["local"])))
            elif kind:
                self.tokens.append((kind, m[kind]))
        self.at = 0

    # -- tokens

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def is_(self, *words: str) -> bool:
        kind, value = self.peek()
        return (kind == "word" and value.upper() in words) or (kind == "op" and value in words)

    def take(self, *words: str) -> str | None:
        if self.is_(*words):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, *words: str) -> str:
        found = self.take(*words)
        if not found:
            raise SparqlError(f"expected {' or '.join(words)}, found {self.peek()[1]!r}")
        return found

    def next(self, kind: str):
        k, value = self.peek()
        if k != kind:
            raise SparqlError(f"expected {kind}, found {value!r}")
        self.at += 1
        return value

    # -- documents

    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                name, _ = self.next("pname")
                self.prefixes[name] = self.next("iri")[1:-1]
            elif self.take("BASE"):
                self.base = self.next("iri")[1:-1]
            else:
                return

    def query(self) -> Query:
        self.prologue()
        q = self.select() if self.is_("SELECT") else self.other()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return q

    def select(self) -> Query:
        q = Query()
        self.need("SELECT")
        q.distinct = self.take("DISTINCT", "REDUCED") is not None
        if not self.take("*"):
            while True:
                if self.peek()[0] == "var":
                    q.variables.append((self.var(), None))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    q.variables.append((self.var(), e))
                    self.need(")")
                else:
                    break
            if not q.variables:
                raise SparqlError("nothing is selected")
        return self.rest(q)

    def other(self) -> Query:
        q = Query(form=self.need("ASK", "CONSTRUCT", "DESCRIBE"))
        if q.form == "CONSTRUCT" and self.is_("{"):
            q.template = self.template()
        if q.form == "DESCRIBE":
            while self.peek()[0] in ("iri", "pname", "var"):
                q.resources.append(self.term())
            if not self.is_("WHERE", "{"):
                return q
        q = self.rest(q)
        if q.form == "CONSTRUCT" and not q.template and q.where[0] == "bgp":
            q.template = q.where[1]
        return q

    def rest(self, q: Query) -> Query:
        self.take("WHERE")
        q.where = self.group()
        if self.take("GROUP"):
            self.need("BY")
            while self.peek()[0] == "var" or self.is_("("):
                if self.take("("):
                    e = self.expression()
                    name = self.var() if self.take("AS") else f"?_g{len(q.group)}"
                    self.need(")")
                    q.group.append((name, e))
                else:
                    q.group.append((self.var(), None))
        if self.take("HAVING"):
            while self.is_("("):
                q.having.append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                way = self.take("ASC", "DESC")
                if way or self.is_("(") or self.peek()[0] in ("var",):
                    q.order.append((way != "DESC", self.primary()))
                else:
                    break
        while self.is_("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                q.limit = int(self.next("number"))
            else:
                self.need("OFFSET")
                q.offset = int(self.next("number"))
        return q

    # -- patterns

    def group(self) -> tuple:
        self.need("{")
        if self.is_("SELECT"):
            node = ("select", self.select())
            self.need("}")
            return node
        node, filters = None, []

        def join(other: tuple) -> tuple:
            if node is None:
                return other
            if node[0] == "bgp" and other[0] == "bgp":
                return ("bgp", node[1] + other[1])
            return ("join", node, other)

        empty = ("bgp", [])
        while not self.take("}"):
            if self.take("OPTIONAL"):
                inner = self.group()
                condition = None
                while inner[0] == "filter":
                    inner, condition = inner[1], inner[2] if condition is None else ("and", inner[2], condition)
                node = ("optional", node or empty, inner, condition)
            elif self.take("MINUS"):
                node = ("minus", node or empty, self.group())
            elif self.take("GRAPH"):
                g = self.term()
                node = join(("graph", g, self.group()))
            elif self.take("FILTER"):
                filters.append(self.primary())
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                node = ("extend", node or empty, self.var(), e)
                self.need(")")
            elif self.take("VALUES"):
                node = join(self.values())
            elif self.is_("SERVICE") and not self.services:
                raise SparqlError("there are no services here")
            elif self.take("SERVICE"):
                silent = self.take("SILENT") is not None
                name = self.term()
                node = join(("service", name, silent, self.group()))
            elif self.is_("{"):
                other = self.group()
                while self.take("UNION"):
                    other = ("union", other, self.group())
                node = join(other)
            else:
                node = join(("bgp", self.triples()))
            self.take(".")
        node = node or empty
        for e in filters:
            node = ("filter", node, e if node[0] != "filter" else e)
        return node

    def values(self) -> tuple:
        names, rows = [], []
        if self.peek()[0] == "var":
            names.append(self.var())
            self.need("{")
            while not self.take("}"):
                rows.append([None if self.take("UNDEF") else self.term()])
        else:
            self.need("(")
            while not self.take(")"):
                names.append(self.var())
            self.need("{")
            while not self.take("}"):
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(None if self.take("UNDEF") else self.term())
                rows.append(row)
        return ("values", names, rows)

    def triples(self) -> list:
        out: list = []
        subject = self.node(out)
        if self.is_(".", "}") and out:
            return out
        self.properties(subject, out)
        return out

    def properties(self, subject: str, out: list) -> None:
        while True:
            p = self.path()
            while True:
                o = self.node(out)
                out.append((subject, p, o))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.is_(".", "}", "]"):
                return

    def node(self, out: list) -> str:
        if self.take("["):
            self.blanks += 1
            name = f"?_b{self.blanks}"
            if not self.take("]"):
                self.properties(name, out)
                self.need("]")
            return name
        return self.term()

    def template(self) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            out += self.triples()
            self.take(".")
        return out

    def path(self):
        if self.peek()[0] == "var":
            return self.var()
        return self.alternative()

    def alternative(self):
        found = [self.sequence()]
        while self.take("|"):
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = [self.step()]
        while self.take("/"):
            found.append(self.step())
        return found[0] if len(found) == 1 else ("seq", found)

    def step(self):
        if self.take("^"):
            return ("inv", self.step())
        if self.take("!"):
            inner = self.alternative() if not self.take("(") else None
            if inner is None:
                inner = self.alternative()
                self.need(")")
            return ("not", inner[1] if isinstance(inner, tuple) and inner[0] == "alt" else [inner])
        if self.take("("):
            p = self.alternative()
            self.need(")")
        elif self.peek() == ("word", "a"):
            self.at += 1
            p = f"<{RDF}type>"
        else:
            p = self.term()
        way = self.take("*", "+", "?")
        return ({"*": "star", "+": "plus", "?": "maybe"}[way], p) if way else p

    # -- terms

    def var(self) -> str:
        return "?" + self.next("var")[1:]

    def term(self) -> str:
        kind, value = self.peek()
        self.at += 1
        if kind == "var":
            return "?" + value[1:]
        if kind == "iri":
            inner = value[1:-1]
            return value if re.match(r"[A-Za-z][\w+.-]*:", inner) else f"<{self.base}{inner}>"
        if kind == "pname":
            if value[0] not in self.prefixes:
                raise SparqlError(f"unknown prefix {value[0]!r}")
            return f"<{self.prefixes[value[0]]}{value[1]}>"
        if kind == "blank":
            return "?_" + value[2:]
        if kind == "string":
            return self.literal(value)
        if kind == "number":
            return self.number(value)
        if kind == "op" and value in "+-" and self.peek()[0] == "number":
            return self.number(("-" if value == "-" else "") + self.next("number"))
        if kind == "word" and value.lower() in ("true", "false"):
            return f'"{value.lower()}"^^<{XSD}boolean>'
        raise SparqlError(f"expected a term, found {value!r}")

    def literal(self, raw: str) -> str:
        inner = raw[3:-3] if raw[:3] in ('"""', "'''") else raw[1:-1]
        inner = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), inner)
        text = inner.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        if self.peek()[0] == "lang":
            return f'"{text}"{self.next("lang")}'
        if self.take("^^"):
            datatype = self.term()
            return f'"{text}"' if datatype == f"<{XSD}string>" else f'"{text}"^^{datatype}'
        return f'"{text}"'

    @staticmethod
    def number(value: str) -> str:
        kind = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
        return f'"{value}"^^<{XSD}{kind}>'

    # -- expressions

    def expression(self):
        left = self.conjunction()
        while self.take("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.relation()
        while self.take("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self):
        left = self.sum()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            return (op, left, self.sum())
        negative = self.is_("NOT") and self.tokens[self.at + 1][1].upper() == "IN"
        if negative:
            self.need("NOT")
        if self.take("IN"):
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            return ("not", ("in", left, items)) if negative else ("in", left, items)
        return left

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = (op, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while op := self.take("*", "/"):
            left = (op, left, self.unary())
        return left

    def unary(self):
        if self.take("!"):
            return ("not", self.unary())
        if self.is_("-") and self.tokens[self.at + 1][0] != "number":
            self.need("-")
            return ("-", ("term", self.number("0")), self.unary())
        return self.primary()

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        negative = self.is_("NOT") and self.tokens[self.at + 1][1].upper() == "EXISTS"
        if negative:
            self.need("NOT")
        if self.take("EXISTS"):
            return ("exists", self.group(), not negative)
        kind, value = self.peek()
        if kind == "word" and value.lower() not in ("true", "false"):
            name = value.upper()
            self.at += 1
            if name in AGGREGATES:
                return self.aggregate(name)
            return ("call", name, self.arguments())
        if kind in ("iri", "pname") and self.tokens[self.at + 1 : self.at + 2] == [("op", "(")]:
            return ("call", self.term(), self.arguments())
        t = self.term()
        return ("var", t) if t.startswith("?") else ("term", t)

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def aggregate(self, name: str):
        self.need("(")
        distinct = self.take("DISTINCT") is not None
        e = None if self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.next("string")[1:-1]
        self.need(")")
        return ("aggregate", name, distinct, e, separator)

    # -- updates

    def update(self) -> list[Update]:
        out = []
        while self.peek()[0] != "end":
            self.prologue()
            u, default = Update(), None
            if self.take("WITH"):
                default = self.term()
            if self.take("INSERT"):
                data = self.take("DATA")
                u.insert = self.quads(default)
            else:
                self.need("DELETE")
                if self.take("DATA"):
                    data = True
                    u.delete = self.quads(default)
                elif self.take("WHERE"):
                    start = self.at
                    u.delete = self.quads(default)
                    self.at = start
                    u.where, data = self.group(), True
                else:
                    data = None
                    u.delete = self.quads(default)
                    if self.take("INSERT"):
                        u.insert = self.quads(default)
            if not data:
                self.need("WHERE")
                u.where = self.group()
            if default and u.where:
                u.where = ("graph", default, u.where)
            out.append(u)
            if not self.take(";"):
                break
        if self.peek()[0] != "end" or not out:
            raise SparqlError("malformed update")
        return out

    def quads(self, default: str | None) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("GRAPH"):
                g = self.term()
                out += [(*t, g) for t in self.template()]
            else:
                out += [(*t, default) for t in self.triples()]
            self.take(".")
        return out
