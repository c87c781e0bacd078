"""SPARQL SELECT text to DataFrame plans, query files, and coverage of queries over graphs.

A query runs over all graphs of a triple table at once: ``g`` is part of every join and group, so each graph answers
for itself; a variable ?g is called ``g_``. Supported: basic patterns with ``;`` and ``,``, property paths (/ ^ | + * ?), FILTER, OPTIONAL, UNION,
MINUS, [NOT] EXISTS, BIND, VALUES, sub-groups, sub-queries, DISTINCT, GROUP BY variables and expressions, HAVING,
aggregates, ORDER BY, LIMIT and OFFSET, LANG, DATATYPE and tests of kinds of terms (null for ends of repeated paths).
A literal with datatype or language matches only such literals, one without matches by its text. Federation and other query forms raise SparqlError.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.operators import patterns as algebra
from tripleforge.operators.patterns import GRAPH, is_variable, numeric
from tripleforge.operators.store import PREFIXES, RDF_TYPE, expand

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>\d+(?:\.\d+)?)|(?P<name>(?:[A-Za-z][\w-]*)?:[\w-]*(?:\.[\w-]+)*)|(?P<word>[A-Za-z_]\w*)|(?P<sign>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/|^?-])""",
    re.VERBOSE,
)
_TERM_TESTS = {"lang", "datatype", "isiri", "isuri", "isliteral", "isblank"}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "sample", "group_concat"}


class SparqlError(ValueError):
    """The text is not a query of the supported kind."""


@dataclass
class Query:
    """A parsed query; ``where`` is a list of group elements, expressions are nested tuples."""

    columns: list = field(default_factory=list)
    distinct: bool = False
    where: list = field(default_factory=list)
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    prefixes: dict = field(default_factory=dict)


@dataclass
class _State:
    """Variables made up so far, and whether the triples are a set."""

    count: int = 0
    unique: bool = False
    kinds: frozenset = frozenset()


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected text: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                # the column g is the graph
                self.tokens.append((m.lastgroup, "?g_" if m.lastgroup == "var" and m[0][1:] == "g" else m[0]))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        if self.peek()[0] == "word" and self.peek()[1].lower() == words[0] and all(self.peek(i)[1].lower() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def take(self, sign: str) -> bool:
        if self.peek() == ("sign", sign):
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise SparqlError(f"{sign!r} expected, not {self.peek()[1]!r}")

    def query(self, prefixes: dict | None = None) -> Query:
        q = Query(prefixes=dict(prefixes or PREFIXES))
        while self.word("prefix"):
            name, iri = self.next()[1], self.next()[1]
            q.prefixes[name[:-1]] = iri[1:-1]
        if not self.word("select"):
            raise SparqlError("only SELECT queries are supported")
        q.distinct = self.word("distinct") or self.word("reduced")
        while not (self.peek()[1].lower() == "where" or self.peek()[1] == "{"):
            if self.take("*"):
                q.columns.append("*")
            elif self.peek()[0] == "var":
                q.columns.append(("?" + self.next()[1][1:], None))
            else:
                self.need("(")
                e = self.expression()
                if not self.word("as"):
                    raise SparqlError("AS expected")
                q.columns.append(("?" + self.next()[1][1:], e))
                self.need(")")
        self.word("where")
        q.where = self.group(q.prefixes)
        while self.peek()[0] != "end" and not (prefixes and self.peek() == ("sign", "}")):
            if self.word("group", "by"):
                while self.peek()[0] == "var" or self.peek() == ("sign", "(") or self.peek()[0] in ("word", "name") and self.peek()[1].lower() != "having" and self.peek(1) == ("sign", "("):
                    q.group.append(self.grouping(len(q.group)))
            elif self.word("having"):
                q.having.append(self.primary())
            elif self.word("order", "by"):
                while self.peek()[0] == "var" or self.peek()[1].lower() in ("asc", "desc", "("):
                    down = self.word("desc")
                    self.word("asc")
                    q.order.append((self.primary(), down))
            elif self.word("limit"):
                q.limit = int(self.next()[1])
            elif self.word("offset"):
                q.offset = int(self.next()[1])
            else:
                raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return q

    def grouping(self, place: int) -> tuple[str, tuple | None]:
        """A variable, or an expression with the name it gets."""
        if self.peek()[0] == "var":
            return ("?" + self.next()[1][1:], None)
        if not self.take("("):
            return (f"?_g{place}", self.primary())
        e = self.expression()
        name = "?" + self.next()[1][1:] if self.word("as") else f"?_g{place}"
        self.need(")")
        return (name, e)

    def group(self, prefixes: dict) -> list:
        self.need("{")
        out: list = []
        if self.peek()[0] == "word" and self.peek()[1].lower() == "select":
            out.append(("select", self.query(prefixes)))
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("."):
                continue
            if self.word("filter"):
                if self.word("not", "exists"):
                    out.append(("exists", self.group(prefixes), True))
                elif self.word("exists"):
                    out.append(("exists", self.group(prefixes), False))
                else:
                    out.append(("filter", self.primary()))
            elif self.word("optional"):
                out.append(("optional", self.group(prefixes)))
            elif self.word("minus"):
                out.append(("minus", self.group(prefixes)))
            elif self.word("bind"):
                self.need("(")
                e = self.expression()
                if not self.word("as"):
                    raise SparqlError("AS expected")
                out.append(("bind", e, self.next()[1][1:]))
                self.need(")")
            elif self.word("values"):
                out.append(self.values())
            elif self.word("service") or self.word("graph"):
                raise SparqlError("SERVICE and GRAPH are not supported")
            elif self.peek() == ("sign", "{"):
                branches = [self.group(prefixes)]
                while self.word("union"):
                    branches.append(self.group(prefixes))
                out.append(("union", branches))
            elif self.peek()[0] == "end":
                raise SparqlError("'}' expected")
            else:
                self.triples(out)
        return out

    def values(self) -> tuple:
        names = []
        many = self.take("(")
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(None if self.word("undef") else self.term())
                rows.append(row)
            else:
                rows.append([None if self.word("undef") else self.term()])
        return ("values", names, rows)

    def term(self) -> str:
        kind, value = self.next()
        if kind == "var":
            return "?" + value[1:]
        if kind in ("iri", "name", "number"):
            return f'"{value}"' if kind == "number" else value
        if kind == "text":
            tail = "^^" + self.next()[1] if self.take("^^") else self.next()[1] if self.peek()[0] == "lang" else ""
            return '"' + re.sub(r"\\(.)", r"\1", value[1:-1]) + '"' + tail
        if kind == "word" and value == "a":
            return f"<{RDF_TYPE}>"
        if kind == "word" and value in ("true", "false"):
            return f'"{value}"'
        raise SparqlError(f"term expected, not {value!r}")

    def triples(self, out: list) -> None:
        subject = self.term()
        while True:
            path = self.path()
            while True:
                out.append(("triple", subject, path, self.term()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "}"):
                return

    def path(self) -> tuple:
        left = self.path_sequence()
        while self.take("|"):
            left = ("|", left, self.path_sequence())
        return left

    def path_sequence(self) -> tuple:
        left = self.path_step()
        while self.take("/"):
            left = ("/", left, self.path_step())
        return left

    def path_step(self) -> tuple:
        if self.take("^"):
            return ("^", self.path_step())
        if self.take("("):
            inner = self.path()
            self.need(")")
        else:
            inner = ("term", self.term())
        for sign in "+*?":
            if self.peek() == ("sign", sign):
                self.at += 1
                return (sign, inner)
        return inner

    def expression(self) -> tuple:
        return self.binary(0)

    _LEVELS = [("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/")]

    def binary(self, level: int) -> tuple:
        if level == len(self._LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            negated = level == 2 and self.word("not", "in")
            if negated or level == 2 and self.word("in"):
                self.need("(")
                left = ("in", left, self.arguments(), negated)
            elif self.peek()[0] == "sign" and self.peek()[1] in self._LEVELS[level]:
                left = (self.next()[1], left, self.binary(level + 1))
            else:
                return left

    def unary(self) -> tuple:
        if self.take("!"):
            return ("!", self.unary())
        if self.take("-"):
            return ("-", ("number", "0"), self.unary())
        return self.primary()

    def arguments(self) -> tuple:
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return tuple(out)

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, value = self.peek()
        if kind == "number":
            self.next()
            return ("number", value)
        if kind == "word" and self.peek(1) == ("sign", "("):
            name = value.lower()
            self.at += 2
            if name in _AGGREGATES:
                distinct = self.word("distinct")
                if self.take("*"):
                    self.need(")")
                    return ("aggregate", name, None, distinct, " ")
                e, separator = self.expression(), " "
                if self.take(";"):
                    self.word("separator")
                    self.need("=")
                    separator = self.next()[1][1:-1]
                self.need(")")
                return ("aggregate", name, e, distinct, separator)
            return ("call", name, self.arguments())
        if kind == "name" and self.peek(1) == ("sign", "("):
            self.at += 2
            return ("call", value, self.arguments())
        return ("term", self.term())


def parse(text: str) -> Query:
    """The query in ``text``."""
    return _Parser(text).query()


def _text(term: str, prefixes: dict) -> str:
    return algebra.term_parts(term, prefixes)[0]


def _compile(e: tuple, have: set[str], prefixes: dict, aggregates: dict | None = None) -> tuple[Column, str]:
    """An expression as (column, kind): kind is 'number', 'text', 'term' (text that may be a number) or 'truth'."""
    sub = lambda x: _compile(x, have, prefixes, aggregates)
    as_number = lambda x: (lambda c, k: c if k == "number" else numeric(c.cast("string")))(*sub(x))
    as_text = lambda x: sub(x)[0].cast("string")
    as_truth = lambda x: (lambda c, k: c if k == "truth" else (c != 0) if k == "number" else (c != "") & (c != "false"))(*sub(x))
    op = e[0]
    if op == "number":
        return F.lit(float(e[1])), "number"
    if op == "term":
        if is_variable(e[1]):
            return (F.col(e[1][1:]), "term") if e[1][1:] in have else (F.lit(None).cast("string"), "term")
        return F.lit(_text(e[1], prefixes)), "text"
    if op == "aggregate":
        if aggregates is None:
            raise SparqlError("aggregate outside SELECT, HAVING or ORDER BY")
        name = f"_a{len(aggregates)}" if e not in aggregates else aggregates[e]
        aggregates[e] = name
        return F.col(name), "number" if e[1] in ("count", "sum", "avg") else "term"
    if op == "||":
        return as_truth(e[1]) | as_truth(e[2]), "truth"
    if op == "&&":
        return as_truth(e[1]) & as_truth(e[2]), "truth"
    if op == "!":
        return ~as_truth(e[1]), "truth"
    if op in ("+", "-", "*", "/"):
        a, b = as_number(e[1]), as_number(e[2])
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op], "number"
    if op in ("=", "!=", "<", ">", "<=", ">="):
        (a, ka), (b, kb) = sub(e[1]), sub(e[2])
        compare = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if "number" in (ka, kb):
            return compare(as_number(e[1]), as_number(e[2])), "truth"
        if "truth" in (ka, kb) or "text" in (ka, kb):
            return compare(a.cast("string"), b.cast("string")), "truth"
        na, nb = numeric(a), numeric(b)
        return F.when(na.isNotNull() & nb.isNotNull(), compare(na, nb)).otherwise(compare(a, b)), "truth"
    if op == "in":
        found = None
        for x in e[2]:
            one = _compile(("=", e[1], x), have, prefixes, aggregates)[0]
            found = one if found is None else found | one
        found = F.lit(False) if found is None else found
        return (~found if e[3] else found), "truth"
    name, args = e[1].lower(), e[2]
    if name == "bound":
        return sub(args[0])[0].isNotNull(), "truth"
    if name in _TERM_TESTS:
        if args[0][0] != "term" or not is_variable(args[0][1]):
            raise SparqlError(f"{e[1]} needs a variable")
        column = f"_k_{args[0][1][1:]}"
        part = [F.get(F.split(F.col(column) if column in have else F.lit(None).cast("string"), r"\|"), F.lit(i)) for i in range(3)]
        if name == "lang":
            return F.when(part[0] == "L", part[2]), "text"
        if name == "datatype":
            return F.when(part[0] == "L", F.when(part[2] != "", F.lit(PREFIXES["rdf"] + "langString")).when(part[1] == "", F.lit(PREFIXES["xsd"] + "string")).otherwise(part[1])), "text"
        return part[0] == {"isiri": "I", "isuri": "I", "isliteral": "L", "isblank": "B"}[name], "truth"
    if name == "langmatches":
        tag, wanted = F.lower(as_text(args[0])), _literal(args[1]).lower()
        return (tag != "") if wanted == "*" else (tag == wanted) | tag.startswith(wanted + "-"), "truth"
    if name == "str":
        return as_text(args[0]), "text"
    if name in ("lcase", "ucase"):
        return (F.lower if name == "lcase" else F.upper)(as_text(args[0])), "text"
    if name == "strlen":
        return F.length(as_text(args[0])).cast("double"), "number"
    if name in ("contains", "strstarts", "strends"):
        return {"contains": F.contains, "strstarts": F.startswith, "strends": F.endswith}[name](as_text(args[0]), as_text(args[1])), "truth"
    if name == "regex":
        pattern, flags = _literal(args[1]), _literal(args[2]) if len(args) > 2 else ""
        return as_text(args[0]).rlike(f"(?{flags}){pattern}" if flags else pattern), "truth"
    if name == "replace":
        return F.regexp_replace(as_text(args[0]), _literal(args[1]), _literal(args[2])), "text"
    if name == "concat":
        return F.concat(*[as_text(a) for a in args]), "text"
    if name == "strafter":
        a, b = as_text(args[0]), as_text(args[1])
        return F.when(F.contains(a, b), F.substring(a, F.instr(a, _literal(args[1])) + len(_literal(args[1])), F.length(a))).otherwise(F.lit("")), "text"
    if name == "strbefore":
        a, b = as_text(args[0]), as_text(args[1])
        return F.when(F.contains(a, b), F.substring(a, 1, F.instr(a, _literal(args[1])) - 1)).otherwise(F.lit("")), "text"
    if name == "substr":
        a, start = as_text(args[0]), as_number(args[1]).cast("int")
        return F.substring(a, start, as_number(args[2]).cast("int") if len(args) > 2 else F.length(a)), "text"
    if name in ("month", "day"):
        return F.regexp_extract(as_text(args[0]), r"^-?\d{4,}-(\d{2})-(\d{2})", 1 if name == "month" else 2).try_cast("double"), "number"
    if name == "coalesce":
        return F.coalesce(*[as_text(a) for a in args]), "term"
    if name == "if":
        return F.when(as_truth(args[0]), as_text(args[1])).otherwise(as_text(args[2])), "term"
    if name in ("abs", "round", "ceil", "floor"):
        return {"abs": F.abs, "round": F.round, "ceil": F.ceil, "floor": F.floor}[name](as_number(args[0])).cast("double"), "number"
    if name == "year":
        return F.regexp_extract(as_text(args[0]), r"^(-?\d{4,})", 1).try_cast("double"), "number"
    if name.endswith((":integer", ":decimal", ":double", ":float")):
        return as_number(args[0]), "number"
    if name.endswith(":string"):
        return as_text(args[0]), "text"
    raise SparqlError(f"function {e[1]!r} is not supported")


def _literal(e: tuple) -> str:
    if e[0] != "term" or e[1][0] != '"':
        raise SparqlError("a constant text is expected")
    return algebra.term_parts(e[1])[0]


def _bound(edges: DataFrame, term: str, prefixes: dict) -> DataFrame:
    """The one start of a path, in every graph."""
    return edges.select(GRAPH).distinct().withColumn("a", F.lit(_text(term, prefixes)))


def _path(triples: DataFrame, s: str, path: tuple, o: str, prefixes: dict, fresh: _State) -> DataFrame:
    op = path[0]
    if op == "term":
        return algebra.scan(triples, s, path[1], o, prefixes, fresh.unique, fresh.kinds)
    if op == "^":
        return _path(triples, o, path[1], s, prefixes, fresh)
    if op == "/":
        fresh.count += 1
        middle = f"?_m{fresh.count}"
        both = algebra.join(_path(triples, s, path[1], middle, prefixes, fresh), _path(triples, middle, path[2], o, prefixes, fresh))
        return both.drop(middle[1:])
    if op == "|":
        return algebra.union(_path(triples, s, path[1], o, prefixes, fresh), _path(triples, s, path[2], o, prefixes, fresh))
    edges = _path(triples, "?a", path[1], "?b", prefixes, fresh)
    if op == "?":
        nodes = triples.select(GRAPH, F.col("s").alias("a")).union(triples.select(GRAPH, "o")).distinct()
        pairs = edges.union(nodes.withColumn("b", F.col("a"))).distinct()
    elif not is_variable(s):
        pairs = algebra.closure(edges, op == "*", _bound(edges, s, prefixes))
    elif not is_variable(o):
        # from the bound end against the direction of the edges
        back = edges.select(GRAPH, F.col("b").alias("a"), F.col("a").alias("b"))
        pairs = algebra.closure(back, op == "*", _bound(edges, o, prefixes)).select(GRAPH, F.col("b").alias("a"), F.col("a").alias("b"))
    else:
        pairs = algebra.closure(edges, op == "*")
    out, names = pairs, {}
    for place, term in (("a", s), ("b", o)):
        if is_variable(term):
            if term in names:
                out = out.where("a = b")
            else:
                names[term] = place
        else:
            out = out.where(F.col(place) == _text(term, prefixes))
    return out.select(GRAPH, *[F.col(c).alias(v[1:]) for v, c in names.items()])


def _names(triple: tuple) -> set[str]:
    """The variables of a triple pattern."""
    terms = lambda path: {path[1]} if path[0] == "term" else set().union(*[terms(x) for x in path[1:] if isinstance(x, tuple)])
    return {t[1:] for t in {triple[1], triple[3]} | terms(triple[2]) if is_variable(t)}


def _linked(run: list, known: set[str]) -> list[list]:
    """Triple patterns that follow each other, in groups that share no variable but ``known`` ones; each pattern of a
    group shares one with those before it."""
    groups = []
    while run:
        group, run = run[:1], run[1:]
        while more := next((t for t in run if any(_names(t) & _names(u) - known for u in group)), None):
            group.append(more)
            run = [t for t in run if t is not more]
        groups.append(group)
    return groups


def _counted(block: DataFrame, wanted: set[str], fresh: _State) -> DataFrame:
    """Solutions cut to the ``wanted`` variables, each once with the number of its repetitions in a column ``_w…``."""
    keys = [c for c in block.columns if c == GRAPH or c.removeprefix("_k_") in wanted]
    if len(keys) == len(block.columns):
        return block
    fresh.count += 1
    return block.groupBy(*keys).agg(F.count("*").alias(f"_w{fresh.count}"))


def _evaluate(triples: DataFrame, elements: list, prefixes: dict, fresh: _State, spare: set[str] = frozenset()) -> tuple[DataFrame, set[str]]:
    """Solutions of a group and its variables that may be unbound.

    Patterns after a variable that may be unbound are joined with each other first: one by one, each solution without
    that variable would meet all that the first of them finds. Where only the number of solutions counts, those that differ
    in ``spare`` variables alone become one with a number.
    """
    out: DataFrame | None = None
    loose: set[str] = set()
    filters = []
    triples_of = [e for e in elements if e[0] == "triple"]
    done: list = []

    def both(a: DataFrame | None, b: DataFrame, unbound: set[str]) -> DataFrame:
        return b if a is None else algebra.join(a, b, unbound)

    for i, e in enumerate(elements):
        if e[0] == "triple":
            if any(e is t for t in done):
                continue
            rest = [x for x in elements[i:] if x[0] != "filter"]
            run = list(itertools.takewhile(lambda x: x[0] == "triple", rest))
            known = set(algebra.variables(out)) if out is not None else set()
            for group in _linked(run, known):
                done += group
                names = set().union(*map(_names, group))
                found = [_path(triples, t[1], t[2], t[3], prefixes, fresh) for t in group]
                if names & known & loose:
                    block = reduce(algebra.join, found)
                    others = set().union(*[_names(t) for t in triples_of if not any(t is u for u in group)])
                    found = [_counted(block, names - (spare - known - others), fresh) if spare else block]
                for x in found:
                    out = x if out is None else algebra.join(out, x, loose, names)
                loose -= names
        elif e[0] == "filter":
            filters.append(e[1])
        elif e[0] == "select":
            inner = _select(triples, e[1], fresh)
            loose_ = set(algebra.variables(inner))
            out = both(out, inner, loose | loose_)
            loose |= loose_
        elif e[0] == "union":
            parts = [_evaluate(triples, b, prefixes, fresh) for b in e[1]]
            names = [set(algebra.variables(p)) for p, _ in parts]
            merged = parts[0][0]
            for p, _ in parts[1:]:
                merged = algebra.union(merged, p)
            unbound = set().union(*[u for _, u in parts]) | (set().union(*names) - set.intersection(*names))
            out = both(out, merged, loose | unbound)
            loose |= unbound
        elif e[0] == "values":
            rows = [tuple(_text(t, prefixes) if t is not None else None for t in row) for row in e[2]]
            table = triples.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` string" for n in e[1]))
            unbound = {n for i, n in enumerate(e[1]) if any(r[i] is None for r in rows)}
            graphs = triples.select(GRAPH).distinct() if out is None else None
            table = graphs.join(F.broadcast(table)) if graphs is not None else out.select(GRAPH).distinct().join(F.broadcast(table))
            out = both(out, table, loose | unbound)
            loose |= unbound
        else:
            if out is None:
                out = triples.select(GRAPH).distinct()
            if e[0] == "bind":
                out = out.withColumn(e[2], _compile(e[1], set(algebra.variables(out)), prefixes)[0].cast("string"))
                loose.add(e[2])
            else:
                inner, unbound = _evaluate(triples, e[1], prefixes, fresh)
                if e[0] == "optional":
                    new = set(algebra.variables(inner)) - set(algebra.variables(out))
                    out = algebra.optional(out, inner, loose | unbound)
                    loose |= new | unbound
                elif e[0] == "minus":
                    out = algebra.minus(out, inner)
                else:
                    out = algebra.exists(out, inner, e[2])
    if out is None:
        out = triples.select(GRAPH).distinct()
    for f in filters:
        out = out.where(F.coalesce(_compile(f, set(algebra.variables(out)), prefixes)[0].cast("boolean"), F.lit(False)))
    return out, loose


def select(triples: DataFrame, text: str | Query, unique: bool = False) -> DataFrame:
    """Solutions of a query for every graph: columns ``g`` and the selected variables.

    ``unique`` says that no triple is there twice, which saves a shuffle per pattern.

    Numbers that the query computes are doubles, all other values text; ORDER BY, LIMIT and OFFSET hold per graph.
    """
    return _select(triples, parse(text) if isinstance(text, str) else text, _State(unique=unique))


def _asked_kinds(e) -> set[str]:
    """Variables whose kind, datatype or language an expression or query asks for."""
    if isinstance(e, Query):
        return set().union(*map(_asked_kinds, (e.columns, e.where, e.group, e.having, e.order)))
    if isinstance(e, tuple) and len(e) == 3 and e[0] == "call" and e[1].lower() in _TERM_TESTS:
        return {a[1][1:] for a in e[2] if a[0] == "term" and is_variable(a[1])}
    return set().union(*map(_asked_kinds, e)) if isinstance(e, (tuple, list)) else set()


def _aggregates(e) -> list[tuple]:
    """The aggregates within an expression or list."""
    if isinstance(e, tuple) and e[:1] == ("aggregate",):
        return [e]
    return [a for x in e for a in _aggregates(x)] if isinstance(e, (tuple, list)) else []


def _mentioned(e) -> set[str]:
    """Variables that expressions, patterns or queries mention, but for those of which they only count the solutions."""
    if isinstance(e, Query):
        return set().union(*map(_mentioned, (e.columns, e.where, e.group, e.having, e.order)))
    if isinstance(e, tuple) and e[:2] == ("aggregate", "count") and not e[3] and e[2] and e[2][0] == "term":
        return set()
    if isinstance(e, str):
        return {e.removeprefix("?")}
    return set().union(*map(_mentioned, e)) if isinstance(e, (tuple, list)) else set()


def _spare(q: Query) -> set[str]:
    """Variables of triple patterns that nothing else in a grouped query needs. There are none if an aggregate depends on
    repeated solutions and is no number of them."""
    asked = (q.columns, q.group, q.having, q.order)
    several = [a for a in _aggregates(list(asked)) if not (a[1] in ("count", "min", "max", "sample") or a[3] and a[1] in ("sum", "group_concat"))]
    if "*" in q.columns or several or not (q.group or _aggregates(list(asked))):
        return set()
    own = set().union(*[_names(e) for e in q.where if e[0] == "triple"])
    return own - _mentioned([*asked, *[e for e in q.where if e[0] != "triple"]])


def _select(triples: DataFrame, q: Query, fresh: _State) -> DataFrame:
    fresh.kinds |= _asked_kinds(q)
    spare = _spare(q)
    solutions, _ = _evaluate(triples, q.where, q.prefixes, fresh, spare)
    for name, e in q.group:
        if e is not None:
            solutions = solutions.withColumn(name[1:], _compile(e, set(algebra.variables(solutions)), q.prefixes)[0].cast("string"))
    have = set(algebra.variables(solutions))
    names = sorted(v for v in have if not v.startswith("_")) if "*" in q.columns else []
    columns = [(f"?{n}", None) for n in names] if "*" in q.columns else q.columns
    aggregates: dict = {}
    grouped = bool(q.group) or any(_has_aggregate(e) for _, e in columns if e) or bool(q.having)
    made = {v[1:]: _compile(e, have, q.prefixes, aggregates)[0] for v, e in columns if e is not None}
    having = [_compile(e, have, q.prefixes, aggregates)[0] for e in q.having]
    known = have | set(made)
    order = [(_compile(e, known, q.prefixes, aggregates), down) for e, down in q.order]
    if grouped:
        weights = [F.col(v) for v in have if re.fullmatch(r"_w\d+", v)]
        times = reduce(lambda a, b: a * b, weights) if weights else None
        measures = [_measure(e, have, q.prefixes, times, spare - have).alias(name) for e, name in aggregates.items()]
        keys = [GRAPH, *(v[1:] for v, _ in q.group)]
        solutions = solutions.groupBy(*keys).agg(*measures) if measures else solutions.select(*keys).distinct()
        for h in having:
            solutions = solutions.where(F.coalesce(h.cast("boolean"), F.lit(False)))
    for name, column in made.items():
        solutions = solutions.withColumn(name, column)
    wanted = [GRAPH, *(v[1:] for v, _ in columns)]
    missing = [c for c in wanted if c not in solutions.columns]
    for c in missing:
        solutions = solutions.withColumn(c, F.lit(None).cast("string"))
    if q.distinct and not order:
        solutions = solutions.select(*wanted).distinct()
    if q.limit is not None or q.offset:
        keys = [k for (c, kind), down in order for k in _sort_keys(c, kind, down)]
        place = F.row_number().over(Window.partitionBy(GRAPH).orderBy(*keys, *[F.col(c) for c in wanted[1:]]))
        solutions = solutions.withColumn("_place", place).where(F.col("_place") > q.offset)
        if q.limit is not None:
            solutions = solutions.where(F.col("_place") <= q.offset + q.limit)
    if order:
        solutions = solutions.orderBy(GRAPH, *[k for (c, kind), down in order for k in _sort_keys(c, kind, down)])
    out = solutions.select(*wanted)
    return out.dropDuplicates() if q.distinct and order else out


def _sort_keys(column: Column, kind: str, down: bool) -> list[Column]:
    """Numbers in order of size before texts in order of code points."""
    keys = [column] if kind == "number" else [numeric(column.cast("string")), column]
    return [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "aggregate" or any(_has_aggregate(x) for x in e)) or isinstance(e, list) and any(_has_aggregate(x) for x in e)


def _measure(e: tuple, have: set[str], prefixes: dict, times: Column | None = None, gone: set[str] = frozenset()) -> Column:
    """An aggregate as a column. ``times`` is the number of solutions that a row stands for, ``gone`` are variables that
    were bound in all of them but have no column any more."""
    _, name, argument, distinct, separator = e
    if argument is None or argument[0] == "term" and argument[1][1:] in gone:
        return (F.count(F.lit(1)) if times is None else F.sum(times)).cast("double")
    if times is not None and name == "count" and not distinct:
        return F.coalesce(F.sum(F.when(_compile(argument, have, prefixes)[0].isNotNull(), times)), F.lit(0)).cast("double")
    column, kind = _compile(argument, have, prefixes)
    number = column if kind == "number" else numeric(column.cast("string"))
    if name == "count":
        return (F.count_distinct(column) if distinct else F.count(column)).cast("double")
    if name in ("sum", "avg"):
        return (F.sum_distinct(number) if distinct and name == "sum" else getattr(F, name)(number)).cast("double")
    if name == "group_concat":
        values = F.collect_set(column) if distinct else F.collect_list(column)
        return F.concat_ws(separator, F.sort_array(values.cast("array<string>")))
    if name == "sample":
        return F.min(column)
    extreme = getattr(F, name)
    return F.coalesce(F.regexp_replace(extreme(number).cast("string"), r"\.0$", ""), extreme(column.cast("string")))


def load_queries(text: str) -> dict[str, str]:
    """Queries of a file by name: prefixes first, then ``# Qn: …`` headers, each followed by its query.

    A query ends where the next header begins, so that closing clauses such as LIMIT belong to it.
    """
    parts = re.split(r"(?m)^#\s*(Q\d+)\b[^\n]*$", text)
    prologue = "\n".join(re.findall(r"(?im)^\s*PREFIX\s+\S+\s+<[^>]*>", parts[0]))
    return {name: f"{prologue}\n{body.strip()}" for name, body in zip(parts[1::2], parts[2::2], strict=True) if body.strip()}


def coverage(triples: DataFrame, queries: dict[str, str], graphs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per query the graphs with and without solutions and those that cannot be read, and the share with solutions.

    ``graphs`` has column g of all graphs; ``errors`` those that could not be loaded, which count as errors for every
    query. Sorted by share, then by the number in the query's name.
    """
    spark = triples.sparkSession
    names = F.broadcast(spark.createDataFrame([(n,) for n in queries], "query string"))
    failed = errors.select(GRAPH).distinct().withColumn("failed", F.lit(True)) if errors is not None else graphs.limit(0).select(GRAPH).withColumn("failed", F.lit(True))
    cells = graphs.select(GRAPH).distinct().join(failed, GRAPH, "left").join(names)
    answered = None
    for name, text in queries.items():
        one = select(triples, text).select(GRAPH).distinct().withColumn("query", F.lit(name)).withColumn("answered", F.lit(True))
        answered = one if answered is None else answered.union(one)
    rows = cells.join(answered, [GRAPH, "query"], "left") if answered is not None else cells.withColumn("answered", F.lit(None).cast("boolean"))
    bad = F.coalesce("failed", F.lit(False))
    hit = F.coalesce("answered", F.lit(False)) & ~bad
    out = rows.groupBy("query").agg(F.count_if(hit).alias("n_success"), F.count_if(~hit & ~bad).alias("n_empty"), F.count_if(bad).alias("n_error"))
    total = F.col("n_success") + F.col("n_empty") + F.col("n_error")
    return out.withColumn("pct", F.round(100 * F.col("n_success") / F.nullif(total, F.lit(0)), 4)).orderBy(F.desc("pct"), F.regexp_extract("query", r"(\d+)", 1).try_cast("int"))
