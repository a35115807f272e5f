"""SELECT and ASK of SPARQL 1.1 over a triples table, compiled into DataFrame operations.

Patterns become filters and equi-joins on their shared variables, OPTIONAL a left join, MINUS and EXISTS anti and semi
joins; Catalyst orders and plans them. Terms are held as N-Triples write them, so an IRI is never equal to a text.

Refused, with an error: updates, CONSTRUCT and DESCRIBE, SERVICE and GRAPH, blank-node property lists, negated property
sets, and groups whose parts share no variable (they'd be a cross join). Errors in expressions are nulls, which no
FILTER keeps. A path with * starts from all nodes of the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.scratch import materialize
from graphloom.sources.guard import MOST_CHARS, MOST_ROWS, SECONDS, Answer, Refused, bounded

XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
NUMBERS = ["integer", "decimal", "double", "float", "long", "int", "short", "nonNegativeInteger", "positiveInteger"]
TOKEN = re.compile(
    r"\s+|#[^\n]*|(?P<iri><[^<>\"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<text>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<lang>@[A-Za-z-]+)|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z][\w-]*)?(?P<colon>:)(?P<local>[\w-]*(?:\.[\w-]+)*)"
    r"|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!+\-*/|^?])",
    re.S,
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


@dataclass
class Group:
    """Parts of a group in order, and its filters, which count for the whole of it."""

    parts: list[tuple] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str
    where: Group
    distinct: bool = False
    items: list[tuple[str, tuple | None]] | None = None  # none: all variables
    group: list[tuple[tuple, str | None]] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str):
        self.at, self.prefixes, self.tokens = 0, {}, []
        place = 0
        while place < len(text):
            m = TOKEN.match(text, place)
            if not m:
                raise Refused(f"can't read: {text[place : place + 20]!r}")
            place = m.end()
            kind = "pname" if m["colon"] else m.lastgroup
            if kind:
                self.tokens.append((kind, ((m["name"] or ""), m["local"]) if m["colon"] else m[0]))
        self.tokens.append(("end", ""))

    def peek(self, *words: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("word", "op") and (value.upper() if kind == "word" else value) in words

    def take(self, *words: str) -> bool:
        found = self.peek(*words)
        self.at += found
        return found

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Refused(f"expected {' or '.join(words)}, found {self.tokens[self.at][1]!r}")

    def kind(self, kind: str) -> str | tuple | None:
        found, value = self.tokens[self.at]
        if found == kind:
            self.at += 1
            return value
        return None

    def must(self, kind: str):
        value = self.kind(kind)
        if value is None:
            raise Refused(f"expected {kind}, found {self.tokens[self.at][1]!r}")
        return value

    def query(self) -> Query:
        while self.take("PREFIX"):
            name, _ = self.must("pname")
            self.prefixes[name] = self.must("iri")[1:-1]
        found = self.select()
        self.must("end")
        return found

    def select(self) -> Query:
        if self.take("ASK"):
            self.take("WHERE")
            return Query("ASK", self.group())
        if not self.take("SELECT"):
            raise Refused("only SELECT and ASK are run")
        distinct = self.take("DISTINCT", "REDUCED")
        items: list | None = []
        if self.take("*"):
            items = None
        while items is not None:
            if v := self.kind("var"):
                items.append((v[1:], None))
            elif self.take("("):
                e = self.expression()
                self.need("AS")
                items.append((self.must("var")[1:], e))
                self.need(")")
            else:
                break
        self.take("WHERE")
        q = Query("SELECT", self.group(), distinct, items)
        if self.take("GROUP"):
            self.need("BY")
            while not self.peek("HAVING", "ORDER", "LIMIT", "OFFSET", "}") and self.tokens[self.at][0] != "end":
                if self.take("("):
                    e, name = self.expression(), None
                    if self.take("AS"):
                        name = self.must("var")[1:]
                    self.need(")")
                else:
                    e, name = self.primary(), None
                q.group.append((e, name or (e[1] if e[0] == "var" else None)))
        if self.take("HAVING"):
            while self.peek("("):
                q.having.append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while not self.peek("LIMIT", "OFFSET", "}") and self.tokens[self.at][0] != "end":
                down = self.peek("DESC")
                self.take("ASC", "DESC")
                q.order.append((self.primary(), down))
        while self.peek("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                q.limit = int(self.must("num"))
            else:
                self.need("OFFSET")
                q.offset = int(self.must("num"))
        return q

    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.peek("SELECT"):
            g.parts.append(("select", self.select()))
            self.need("}")
            return g
        while not self.take("}"):
            if self.take("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.take("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.take("FILTER"):
                g.filters.append(self.primary())
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                g.parts.append(("bind", self.must("var")[1:], e))
                self.need(")")
            elif self.take("VALUES"):
                g.parts.append(self.values())
            elif self.peek("{"):
                arms = [self.group()]
                while self.take("UNION"):
                    arms.append(self.group())
                g.parts.append(("union", arms))
            elif self.peek("GRAPH", "SERVICE"):
                raise Refused("GRAPH and SERVICE aren't supported")
            else:
                self.triples(g)
            self.take(".")
        return g

    def values(self) -> tuple:
        many = self.take("(")
        names = []
        while v := self.kind("var"):
            names.append(v[1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
            rows.append([None if self.take("UNDEF") else self.term()[1] for _ in names])
            if many:
                self.need(")")
        return ("values", names, rows)

    def triples(self, g: Group) -> None:
        s = self.term()
        while True:
            p = ("var", v[1:]) if (v := self.kind("var")) else self.path()
            while True:
                g.parts.append(("triple", s, p, self.term()))
                if not self.take(","):
                    break
            if not self.take(";") or self.peek(".", "}"):
                break

    def path(self) -> tuple:
        arms = [self.steps()]
        while self.take("|"):
            arms.append(self.steps())
        return arms[0] if len(arms) == 1 else ("alt", arms)

    def steps(self) -> tuple:
        found = self.step()
        while self.take("/"):
            found = ("seq", found, self.step())
        return found

    def step(self) -> tuple:
        if self.take("^"):
            return ("inverse", self.step())
        if self.take("("):
            found = self.path()
            self.need(")")
        elif self.take("A"):
            found = ("iri", TYPE)
        else:
            found = self.term()
            if found[0] != "term" or not found[1].startswith("<"):
                raise Refused("a predicate is an IRI, a variable or a path")
            found = ("iri", found[1])
        for op, name in (("*", "star"), ("+", "plus"), ("?", "maybe")):
            if self.take(op):
                return (name, found)
        return found

    def term(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "var":
            return ("var", value[1:])
        if kind == "iri":
            return ("term", value)
        if kind == "pname":
            if value[0] not in self.prefixes:
                raise Refused(f"unknown prefix {value[0]}:")
            return ("term", f"<{self.prefixes[value[0]]}{value[1]}>")
        if kind == "text":
            cut = 3 if value.startswith('"""') else 1
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[cut:-cut], flags=re.S)
            tail = ""
            if lang := self.kind("lang"):
                tail = lang.lower()
            elif self.take("^^"):
                tail = "^^" + self.term()[1]
            return ("term", f'"{body}"{"" if tail == f"^^<{XSD}string>" else tail}')
        if kind == "num":
            return ("term", f'"{value}"^^<{XSD}{"integer" if value.isdigit() else "decimal"}>')
        if kind == "word" and value in ("true", "false"):
            return ("term", f'"{value}"^^<{XSD}boolean>')
        raise Refused(f"expected a term, found {value!r}")

    def expression(self, level: int = 0) -> tuple:
        ladder = [("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/")]
        if level == len(ladder):
            return self.primary()
        left = self.expression(level + 1)
        while True:
            if level == 2 and self.peek("IN", "NOT"):
                no = self.take("NOT")
                self.need("IN")
                found = ("in", left, self.arguments())
                left = ("!", found) if no else found
                continue
            op = next((x for x in ladder[level] if self.peek(x)), None)
            if op is None:
                return left
            self.take(op)
            left = ("op", op, left, self.expression(level + 1))

    def arguments(self) -> list[tuple]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("!"):
            return ("!", self.primary())
        if self.take("-"):
            return ("op", "-", ("term", f'"0"^^<{XSD}integer>'), self.primary())
        if self.take("NOT"):
            self.need("EXISTS")
            return ("exists", self.group(), True)
        if self.take("EXISTS"):
            return ("exists", self.group(), False)
        kind, value = self.tokens[self.at]
        if kind == "word" and value not in ("true", "false"):
            self.at += 1
            name = value.upper()
            if name in AGGREGATES:
                self.need("(")
                distinct = self.take("DISTINCT")
                e = None if self.take("*") else self.expression()
                separator = " "
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = self.term()[1][1:-1]
                self.need(")")
                return ("aggregate", name, distinct, e, separator)
            return ("call", name, self.arguments())
        return self.term()


# -- terms and expressions


def encoded(triples: DataFrame) -> DataFrame:
    """(s, p, o) with terms as N-Triples write them, from the columns of `read_ntriples`."""

    def node(c: str) -> Column:
        return F.when(F.startswith(c, F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    other = F.nullif(F.col("datatype"), F.lit(f"{XSD}string"))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.lower("lang"))).otherwise(
        F.concat(F.lit("^^<"), other, F.lit(">"))
    )
    literal = F.concat(F.lit('"'), "o", F.lit('"'), F.coalesce(tail, F.lit("")))
    kept = triples.where("o_kind <> 'malformed'")
    return kept.select(node("s").alias("s"), node("p").alias("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")).alias("o")).distinct()


def lexical(term: Column) -> Column:
    """The text of a term: an IRI without its brackets, a literal without quotes and type."""
    return (
        F.when(F.startswith(term, F.lit("<")), F.substring(term, F.lit(2), F.length(term) - 2))
        .when(F.startswith(term, F.lit('"')), F.regexp_extract(term, r'(?s)^"(.*)"', 1))
        .otherwise(term)
    )


def number(term: Column) -> Column:
    """The value of a numeric literal, else null."""
    kinds = "|".join(NUMBERS)
    return F.when(term.rlike(rf"(?s)\"\^\^<{re.escape(XSD)}(?:{kinds})>$"), lexical(term).try_cast("double"))


def term_of(value: Column, kind: str) -> Column:
    if kind == "term":
        return value
    if kind == "num":
        whole = value == F.floor(value)
        text = F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
        return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}'), F.when(whole, "integer").otherwise("decimal"), F.lit(">"))
    if kind == "bool":
        return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}boolean>'))
    return F.concat(F.lit('"'), value, F.lit('"'))


class Expressions:
    """Expressions over a set of named columns: each gives a column and its kind (term, num, str, bool)."""

    def __init__(self, env: dict[str, Column]):
        self.env = env

    def num(self, e: tuple) -> Column:
        c, kind = self.value(e)
        return c if kind == "num" else number(term_of(c, kind))

    def text(self, e: tuple) -> Column:
        c, kind = self.value(e)
        return c if kind == "str" else lexical(term_of(c, kind))

    def term(self, e: tuple) -> Column:
        return term_of(*self.value(e))

    def true(self, e: tuple) -> Column:
        """The effective boolean value."""
        c, kind = self.value(e)
        if kind == "bool":
            return c
        if kind == "num":
            return c != 0
        if kind == "str":
            return c != ""
        n = number(c)
        return F.when(F.endswith(c, F.lit("#boolean>")), lexical(c) == "true").when(n.isNotNull(), n != 0).when(
            F.startswith(c, F.lit('"')), lexical(c) != ""
        )

    def compare(self, op: str, a: tuple, b: tuple) -> Column:
        x, y = self.term(a), self.term(b)
        m, n = number(x), number(y)
        u, v = lexical(x), lexical(y)
        both = m.isNotNull() & n.isNotNull()
        if op in ("=", "!="):
            same = F.when(both, m == n).otherwise(x == y)
            return same if op == "=" else ~same
        pick = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        alike = F.regexp_extract(x, r'(?s)"([^"]*)$', 1) == F.regexp_extract(y, r'(?s)"([^"]*)$', 1)
        literals = F.startswith(x, F.lit('"')) & F.startswith(y, F.lit('"'))
        return F.when(both, pick(m, n)).when(literals & alike, pick(u, v))

    def value(self, e: tuple) -> tuple[Column, str]:
        head = e[0]
        if head == "var":
            return self.env.get(e[1], F.lit(None).cast("string")), "term"
        if head == "term":
            return F.lit(e[1]), "term"
        if head == "column":
            return F.col(e[1]), e[2]
        if head == "!":
            return ~self.true(e[1]), "bool"
        if head == "in":
            found = F.lit(False)
            for x in e[2]:
                found = found | self.compare("=", e[1], x)
            return found, "bool"
        if head == "op":
            _, op, a, b = e
            if op in ("||", "&&"):
                x, y = self.true(a), self.true(b)
                return (x | y if op == "||" else x & y), "bool"
            if op in "+-*/":
                x, y = self.num(a), self.num(b)
                return {"+": x + y, "-": x - y, "*": x * y, "/": x / F.nullif(y, F.lit(0.0))}[op], "num"
            return self.compare(op, a, b), "bool"
        if head == "call":
            return self.call(e[1], e[2])
        raise Refused(f"{head} can't stand here")

    def call(self, name: str, args: list[tuple]) -> tuple[Column, str]:
        t, s, n = self.term, self.text, self.num
        table = {
            "STR": lambda a: (s(a), "str"),
            "LCASE": lambda a: (F.lower(s(a)), "str"),
            "UCASE": lambda a: (F.upper(s(a)), "str"),
            "STRLEN": lambda a: (F.char_length(s(a)).cast("double"), "num"),
            "CONTAINS": lambda a, b: (F.contains(s(a), s(b)), "bool"),
            "STRSTARTS": lambda a, b: (F.startswith(s(a), s(b)), "bool"),
            "STRENDS": lambda a, b: (F.endswith(s(a), s(b)), "bool"),
            "STRBEFORE": lambda a, b: (F.when(F.contains(s(a), s(b)), F.split_part(s(a), s(b), F.lit(1))).otherwise(""), "str"),
            "STRAFTER": lambda a, b: (
                F.when(F.contains(s(a), s(b)), F.substring(s(a), F.position(s(b), s(a)) + F.length(s(b)), F.length(s(a)))).otherwise(""), "str"),
            "SUBSTR": lambda a, b, c=None: (F.substring(s(a), n(b).cast("int"), n(c).cast("int") if c else F.length(s(a))), "str"),
            "CONCAT": lambda *a: (F.concat(*map(s, a)), "str"),
            "REGEX": lambda a, b, c=None: (F.regexp_like(s(a), F.concat(F.concat(F.lit("(?"), s(c), F.lit(")")) if c else F.lit(""), s(b))), "bool"),
            "REPLACE": lambda a, b, c: (F.regexp_replace(s(a), s(b), s(c)), "str"),
            "BOUND": lambda a: (t(a).isNotNull(), "bool"),
            "ISIRI": lambda a: (F.startswith(t(a), F.lit("<")), "bool"),
            "ISURI": lambda a: (F.startswith(t(a), F.lit("<")), "bool"),
            "ISBLANK": lambda a: (F.startswith(t(a), F.lit("_:")), "bool"),
            "ISLITERAL": lambda a: (F.startswith(t(a), F.lit('"')), "bool"),
            "ISNUMERIC": lambda a: (number(t(a)).isNotNull(), "bool"),
            "LANG": lambda a: (F.regexp_extract(t(a), r'(?s)"@([\w-]+)$', 1), "str"),
            "DATATYPE": lambda a: (
                F.when(F.endswith(t(a), F.lit('"')), f"<{XSD}string>").otherwise(F.nullif(F.regexp_extract(t(a), r'(?s)"\^\^(<[^>]*>)$', 1), F.lit(""))),
                "term",
            ),
            "COALESCE": lambda *a: (F.coalesce(*map(t, a)), "term"),
            "IF": lambda a, b, c: (F.when(self.true(a), t(b)).when(~self.true(a), t(c)), "term"),
            "SAMETERM": lambda a, b: (t(a) == t(b), "bool"),
            "ABS": lambda a: (F.abs(n(a)), "num"),
            "CEIL": lambda a: (F.ceil(n(a)).cast("double"), "num"),
            "FLOOR": lambda a: (F.floor(n(a)).cast("double"), "num"),
            "ROUND": lambda a: (F.floor(n(a) + 0.5).cast("double"), "num"),
        }
        if name not in table:
            raise Refused(f"unknown function {name}")
        try:
            return table[name](*args)
        except TypeError:
            raise Refused(f"wrong number of arguments for {name}") from None


# -- groups


@dataclass
class Solutions:
    """Rows of bindings, a column for each variable; `sure` are those that are never null."""

    df: DataFrame
    sure: set[str]

    @property
    def names(self) -> set[str]:
        return set(self.df.columns)


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples, self.spark = triples, triples.sparkSession

    def join(self, a: Solutions | None, b: Solutions, how: str, filters: list[tuple] = ()) -> Solutions:
        if a is None:
            if how == "inner":
                return b
            raise Refused("OPTIONAL and MINUS need a pattern before them")
        shared = sorted(a.names & b.names)
        if not shared:
            raise Refused("patterns of a group must share a variable")
        right = b.df.withColumnsRenamed({v: f"_r_{v}" for v in shared})
        on = F.lit(True)
        for v in shared:
            same = F.col(v) == F.col(f"_r_{v}")
            on &= same if v in a.sure & b.sure else same | F.col(v).isNull() | F.col(f"_r_{v}").isNull()
        env = {v: F.coalesce(v, f"_r_{v}") if v in shared else F.col(v) for v in a.names | b.names}
        for f in filters:
            on &= F.coalesce(Expressions(env).true(f), F.lit(False))
        met = a.df.join(right, on, how)
        if how in ("left_semi", "left_anti"):
            return Solutions(met, a.sure)
        both = met.select(*(c.alias(v) for v, c in env.items()))
        return Solutions(both, a.sure | b.sure if how == "inner" else a.sure)

    def edges(self, p: tuple) -> DataFrame:
        """(s, o) of a property path."""
        head = p[0]
        if head == "iri":
            return self.triples.where(F.col("p") == p[1]).select("s", "o")
        if head == "inverse":
            return self.edges(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if head == "alt":
            first, *rest = map(self.edges, p[1])
            for r in rest:
                first = first.unionAll(r)
            return first
        if head == "seq":
            left = self.edges(p[1]).select("s", F.col("o").alias("m"))
            return left.join(self.edges(p[2]).select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        one = self.edges(p[1]).distinct()
        if head != "maybe":
            one = self.closure(materialize(one))
        if head == "plus":
            return one
        nodes = self.triples.select(F.explode(F.array("s", "o")).alias("s"))
        return one.unionAll(nodes.select("s", F.col("s").alias("o"))).distinct()

    @staticmethod
    def closure(one: DataFrame) -> DataFrame:
        """Paths of any length: each round joins the new pairs with the edges, until none is new."""
        found = fresh = one
        step = one.select(F.col("s").alias("o"), F.col("o").alias("n"))
        while not fresh.isEmpty():
            more = fresh.join(step, "o").select("s", F.col("n").alias("o")).distinct()
            fresh = materialize(more.join(found, ["s", "o"], "left_anti"))
            found = found.unionAll(fresh)
        return found

    def walk(self, p: tuple, start: str, forward: bool) -> DataFrame:
        """(s, o) of a path of any length from a known end: each round steps from the nodes that are new."""
        one = self.edges(p[1])
        step = one if forward else one.select(F.col("o").alias("s"), F.col("s").alias("o"))
        step = materialize(step.distinct())
        found = fresh = materialize(step.where(F.col("s") == start).select(F.col("o").alias("n")))
        while not fresh.isEmpty():
            more = fresh.join(step.withColumnRenamed("s", "n"), "n").select(F.col("o").alias("n")).distinct()
            fresh = materialize(more.join(found, "n", "left_anti"))
            found = found.unionAll(fresh)
        if p[0] == "star":
            own = self.triples.where((F.col("s") == start) | (F.col("o") == start)).limit(1).select(F.lit(start).alias("n"))
            found = found.unionAll(own).distinct()
        return found.select(F.lit(start).alias("s"), F.col("n").alias("o")) if forward else found.select(F.col("n").alias("s"), F.lit(start).alias("o"))

    def triple(self, s: tuple, p: tuple, o: tuple) -> Solutions:
        if p[0] == "var":
            rows, places = self.triples, [("s", s), ("p", p), ("o", o)]
        elif p[0] in ("plus", "star") and "term" in (s[0], o[0]):
            rows, places = self.walk(p, s[1] if s[0] == "term" else o[1], s[0] == "term"), [("s", s), ("o", o)]
        else:
            rows, places = self.edges(p), [("s", s), ("o", o)]
        out: dict[str, str] = {}
        for column, t in places:
            if t[0] == "term":
                rows = rows.where(F.col(column) == t[1])
            elif t[1] in out:
                rows = rows.where(F.col(column) == F.col(out[t[1]]))
            else:
                out[t[1]] = column
        return Solutions(rows.select(*(F.col(c).alias(v) for v, c in out.items())), set(out))

    def group(self, g: Group, filtered: bool = True) -> Solutions | None:
        now: Solutions | None = None
        waiting: list[Solutions] = []  # patterns that have no variable in common with what is there yet

        def settle() -> None:
            nonlocal now
            while waiting:
                at = next((i for i, w in enumerate(waiting) if now is None or not w.names or now.names & w.names), None)
                if at is None:
                    raise Refused("patterns of a group must share a variable")
                w = waiting.pop(at)
                if w.names or now is None:
                    now = self.join(now, w, "inner")
                elif w.df.isEmpty():  # a pattern of constants alone is true or false
                    now = Solutions(now.df.where(F.lit(False)), now.sure)

        for part in g.parts:
            if part[0] == "triple":
                waiting.append(self.triple(*part[1:]))
                continue
            if part[0] == "values":
                _, names, rows = part
                df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
                waiting.append(Solutions(df, {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)}))
                continue
            if part[0] in ("select", "union"):
                waiting.append(self.select(part[1]) if part[0] == "select" else self.union(part[1]))
                continue
            settle()
            if part[0] == "bind":
                base = now or Solutions(self.spark.range(1).select(), set())
                env = {v: F.col(v) for v in base.names}
                now = Solutions(base.df.withColumn(part[1], Expressions(env).term(part[2])), base.sure)
            elif part[0] == "optional":
                inner = self.group(part[1], filtered=False)
                if inner is not None:
                    now = self.join(now, inner, "left", part[1].filters)
            else:
                inner = self.group(part[1])
                if inner is not None and now is not None and now.names & inner.names:
                    now = self.join(now, inner, "left_anti")
        settle()
        return self.filter(now, g.filters) if filtered else now

    def union(self, arms: list[Group]) -> Solutions:
        found = [x for x in map(self.group, arms) if x is not None]
        df = found[0].df
        for x in found[1:]:
            df = df.unionByName(x.df, allowMissingColumns=True)
        return Solutions(df, set.intersection(*(x.sure for x in found)))

    def filter(self, now: Solutions | None, filters: list[tuple]) -> Solutions | None:
        for f in filters:
            no = f[0] == "!" and f[1][0] == "exists"
            e = f[1] if no else f
            if e[0] == "exists":
                inner = self.group(e[1], filtered=False)
                now = self.join(now, inner, "left_anti" if e[2] != no else "left_semi", e[1].filters)
            elif f[0] == "op" and f[1] == "&&":
                now = self.filter(now, [f[2], f[3]])
            elif now is not None:
                env = {v: F.col(v) for v in now.names}
                now = Solutions(now.df.where(F.coalesce(Expressions(env).true(f), F.lit(False))), now.sure)
        return now

    def aggregates(self, e: tuple, found: list[tuple]) -> tuple:
        """The expression with its aggregates as columns, which are added to `found`."""
        if e[0] == "aggregate":
            if e not in found:
                found.append(e)
            return ("column", f"_a{found.index(e)}", "num" if e[1] in ("COUNT", "SUM", "AVG") else "str" if e[1] == "GROUP_CONCAT" else "term")
        return tuple(
            self.aggregates(x, found) if isinstance(x, tuple) and x and isinstance(x[0], str) else [self.aggregates(y, found) for y in x] if isinstance(x, list) else x
            for x in e
        )

    def thinned(self, q: Query) -> Solutions | None:
        """Solutions of a SELECT DISTINCT of plain variables over triple patterns alone; None for any other query.

        A sequence of paths is two patterns with a hidden variable. Those that add the fewest variables come first, and a variable that
        nothing later asks for goes before the next join, so what leads to the same answers meets once.
        """
        if not q.distinct or q.group or q.having or q.order or q.where.filters or not q.items or any(e for _, e in q.items):
            return None
        if any(part[0] != "triple" for part in q.where.parts):
            return None
        left: list[tuple] = []

        def add(s: tuple, p: tuple, o: tuple) -> None:
            if p[0] == "seq":
                hidden = ("var", f"_path {len(left)}")  # no variable has a blank
                add(s, p[1], hidden)
                add(hidden, p[2], o)
            elif p[0] == "inverse":
                add(o, p[1], s)
            else:
                left.append((s, p, o))

        for part in q.where.parts:
            add(*part[1:])
        asks = [{t[1] for t in pattern if t[0] == "var"} for pattern in left]
        kept = {n for n, _ in q.items}
        if not all(asks) or not kept <= set().union(*asks):
            return None
        now: Solutions | None = None
        todo = list(zip(left, asks))
        while todo:
            fits = [x for x in todo if now is None or now.names & x[1]]
            if not fits:
                raise Refused("patterns of a group must share a variable")
            had = now.names if now else set()
            best = min(fits, key=lambda x: len(x[1] - had))
            todo.remove(best)
            now = self.join(now, self.triple(*best[0]), "inner")
            wanted = now.names & kept.union(*(names for _, names in todo))
            if wanted != now.names and wanted:
                now = Solutions(now.df.select(*sorted(wanted)).distinct(), now.sure & wanted)
        return now

    def select(self, q: Query) -> Solutions:
        now = self.thinned(q) or self.group(q.where)
        if now is None:
            now = Solutions(self.spark.range(1).select(), set())
        df, items = now.df, q.items
        env = {v: F.col(v) for v in now.names}
        order, having = [e for e, _ in q.order], q.having
        found: list[tuple] = []
        if items is not None:
            items = [(n, e and self.aggregates(e, found)) for n, e in items]
        having = [self.aggregates(e, found) for e in having]
        order = [self.aggregates(e, found) for e in order]
        sure = now.sure
        if q.group or found:
            ex = Expressions(env)
            keys = [ex.term(e).alias(n or f"_g{i}") for i, (e, n) in enumerate(q.group)]
            df = df.groupBy(*keys).agg(*(self.aggregate(ex, a).alias(f"_a{i}") for i, a in enumerate(found))) if found else df.select(*keys).distinct()
            env = {n: F.col(n) for _, n in q.group if n}
            sure = sure & set(env)
        if items is not None:
            for n, e in items:
                if e:
                    df = df.withColumn(n, Expressions(env).term(e))
                    env[n] = F.col(n)
        for e in having:
            df = df.where(F.coalesce(Expressions(env).true(e), F.lit(False)))
        names = [n for n, _ in items] if items is not None else [c for c in df.columns if not c.startswith("_")]
        ex = Expressions(env)
        keys = []
        for e, (_, down) in zip(order, q.order):
            t = ex.term(e)
            keys += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in (t.isNotNull(), number(t), lexical(t))]
        chosen = [env.get(n, F.lit(None).cast("string")).alias(n) for n in names]
        if q.distinct:
            df = df.select(*chosen).distinct()
            if keys and any(e[0] != "var" or e[1] not in names for e in order):
                raise Refused("with DISTINCT, order by selected variables")
            chosen = [F.col(n) for n in names]
        if keys:
            df = df.orderBy(*keys)
        df = df.select(*chosen)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, sure & set(names))

    @staticmethod
    def aggregate(ex: Expressions, a: tuple) -> Column:
        _, name, distinct, e, separator = a
        if name == "COUNT":
            c = F.lit(1) if e is None else ex.term(e)
            return (F.count_distinct(c) if distinct else F.count(c)).cast("double")
        if name in ("SUM", "AVG"):
            n = ex.num(e)
            if distinct:
                return F.sum_distinct(n) if name == "SUM" else F.sum_distinct(n) / F.count_distinct(n)
            return F.coalesce(F.sum(n), F.lit(0.0)) if name == "SUM" else F.avg(n)
        if name == "GROUP_CONCAT":
            text = ex.text(e)
            bag = F.collect_set(text) if distinct else F.collect_list(text)
            return F.array_join(F.array_sort(bag), separator)
        t = ex.term(e)
        if name == "SAMPLE":
            return F.min(t)
        key = F.struct(number(t).isNotNull(), number(t), lexical(t))
        best = F.min_by if name == "MIN" else F.max_by
        return best(t, F.when(t.isNotNull(), key))


def parse(query: str) -> Query:
    if len(query) > MOST_CHARS:
        raise Refused("too long")
    return Parser(query).query()


def select(triples: DataFrame, query: str) -> DataFrame:
    """The solutions of a SELECT, a column of texts for each variable; `triples` is as `read_ntriples` gives it."""
    q = parse(query)
    if q.form != "SELECT":
        raise Refused("not a SELECT")
    df = Compiler(encoded(triples)).select(q).df
    return df.select(*(lexical(F.col(c)).alias(c) for c in df.columns))


def ask(triples: DataFrame, query: str) -> bool:
    q = parse(query)
    if q.form != "ASK":
        raise Refused("not an ASK")
    found = Compiler(encoded(triples)).group(q.where)
    return found is None or not found.df.isEmpty()


def run(spark: SparkSession, triples: DataFrame, query: str, limit: int = MOST_ROWS, seconds: float = SECONDS) -> Answer | bool:
    """A SELECT's rows, `limit` at most, or an ASK's answer, within the time given."""
    if parse(query).form == "ASK":
        return bounded(spark, lambda: ask(triples, query), seconds)
    df = select(triples, query)
    rows = bounded(spark, lambda: df.limit(limit + 1).collect(), seconds)
    return Answer(df.columns, [tuple(r) for r in rows[:limit]], len(rows) > limit)
