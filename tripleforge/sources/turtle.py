"""Turtle text to triples: a one-pass reader, canonical triple lines, and Spark scans over files or text columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: The tokens of Turtle, tried in this order at each place.
_TOKEN = re.compile(
    r"""(?P<skip>[\s\ufeff]+|\#[^\r\n]*)
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:%-]))
    |(?P<bnode>_:[\w\u00b7](?:[\w.\u00b7-]*[\w\u00b7-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.\u00b7-]*[\w\u00b7-])?)?:(?:(?:[\w:\u00b7-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]|\.(?=[\w:.%\\-]))+)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    """The text is not Turtle."""


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


class _Reader:
    """Recursive descent over the tokens of one document. A node is (kind, text, datatype, language)."""

    def __init__(self, text: str, base: str = "", permissive: bool = False):
        self.text, self.base, self.permissive = text, base, permissive
        self.prefixes: dict[str, str] = {}
        self.triples: list[tuple] = []
        self.blanks = 0
        self.labels: dict[str, tuple] = {}
        self.at = 0
        self._next()

    def _next(self) -> None:
        at, text = self.at, self.text
        while True:
            if at >= len(text):
                self.kind, self.value, self.at = "end", "", at
                return
            m = _TOKEN.match(text, at)
            if not m:
                if self.permissive and text[at] == "<" and (end := text.find(">", at)) > 0 and "\n" not in text[at:end]:
                    self.kind, self.value, self.at = "iri", text[at : end + 1], end + 1
                    return
                raise TurtleError(f"unexpected text at {at}: {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value, self.at = m.lastgroup, m[0], at
                return

    def _take(self, value: str) -> bool:
        if self.kind == "sign" and self.value == value:
            self._next()
            return True
        return False

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise TurtleError(f"{value!r} expected before {self.at}, not {self.value!r}")

    def _resolve(self, iri: str) -> str:
        if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            from urllib.parse import urljoin

            return urljoin(self.base, iri)
        return iri

    def _iri(self) -> str:
        kind, value = self.kind, self.value
        if kind == "iri":
            self._next()
            return self._resolve(_unescape(value[1:-1]))
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"prefix {prefix!r} is not declared")
            self._next()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"IRI expected before {self.at}, not {value!r}")

    def document(self) -> list[tuple]:
        while self.kind != "end":
            word = self.value.lower()
            if self.kind == "lang" and word in ("@prefix", "@base") or self.kind == "word" and word in ("prefix", "base"):
                dotted = self.kind == "lang"
                self._next()
                if word.endswith("prefix"):
                    if self.kind != "name" or not self.value.endswith(":"):
                        raise TurtleError(f"prefix name expected before {self.at}")
                    name = self.value[:-1]
                    self._next()
                    self.prefixes[name] = self._iri()
                else:
                    self.base = self._iri()
                if dotted:
                    self._need(".")
            else:
                bracketed = self.kind == "sign" and self.value == "["
                subject = self._node(subject=True)
                if not (bracketed and self.kind == "sign" and self.value == "."):
                    self._predicates(subject)
                self._need(".")
        return self.triples

    def _predicates(self, subject: tuple) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                predicate = RDF + "type"
                self._next()
            else:
                predicate = self._iri()
            while True:
                self.triples.append((subject, predicate, self._node()))
                if not self._take(","):
                    break
            if not self._take(";"):
                return
            while self._take(";"):
                pass
            if self.kind == "end" or self.kind == "sign" and self.value in ".]":
                return

    def _blank(self) -> tuple:
        self.blanks += 1
        return ("B", f"b{self.blanks}", None, None)

    def _node(self, subject: bool = False) -> tuple:
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return ("I", self._iri(), None, None)
        if kind == "bnode":
            self._next()
            if value not in self.labels:
                self.labels[value] = self._blank()
            return self.labels[value]
        if self._take("["):
            node = self._blank()
            if not self._take("]"):
                self._predicates(node)
                self._need("]")
            return node
        if self._take("("):
            items = []
            while not self._take(")"):
                items.append(self._node())
            rest: tuple = ("I", RDF + "nil", None, None)
            for item in reversed(items):
                cell = self._blank()
                self.triples += [(cell, RDF + "first", item), (cell, RDF + "rest", rest)]
                rest = cell
            return rest
        if subject:
            raise TurtleError(f"subject expected before {self.at}, not {value!r}")
        if kind == "text":
            self._next()
            width = 3 if value[:3] in ('"""', "'''") and len(value) >= 6 else 1
            text = _unescape(value[width:-width])
            if self.kind == "lang":
                language = self.value[1:].lower()
                self._next()
                return ("L", text, RDF + "langString", language)
            if self.kind == "type":
                self._next()
                return ("L", text, self._iri(), None)
            return ("L", text, XSD + "string", None)
        if kind == "number":
            self._next()
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return ("L", value, XSD + name, None)
        if kind == "word" and value in ("true", "false"):
            self._next()
            return ("L", value, XSD + "boolean", None)
        raise TurtleError(f"object expected before {self.at}, not {value!r}")


def parse_turtle(text: str | None, base: str = "", permissive: bool = False) -> list[tuple]:
    """Triples (subject node, predicate IRI, object node) in order of the text, repetitions included.

    A node is (kind 'I', 'B' or 'L', text, datatype, language). ``permissive`` also accepts IRIs with spaces.
    """
    return _Reader(text or "", base, permissive).document()


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def _term(node: tuple) -> str:
    kind, text, datatype, language = node
    if kind == "I":
        return f"<{text}>"
    if kind == "B":
        return f"_:{text}"
    if language:
        return f'"{_escape(text)}"@{language}'
    return f'"{_escape(text)}"' if datatype == XSD + "string" else f'"{_escape(text)}"^^<{datatype}>'


def triple_line(triple: tuple) -> str:
    """The triple in N-Triples, without line end. Equal triples have equal lines."""
    s, p, o = triple
    return f"{_term(s)} <{p}> {_term(o)} ."


def triple_set(text: str | None) -> tuple[list[str], str | None]:
    """Sorted distinct lines of a document and their digest; the digest is null if there are none."""
    lines = sorted({triple_line(t) for t in parse_turtle(text)})
    return lines, hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if lines else None


TRIPLES = "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, error string"


def turtle_triples(documents: DataFrame, g: str, text: str, permissive: bool = False) -> DataFrame:
    """Distinct triples of each document, with columns g, s, s_kind, p, o, o_kind, o_dt, o_lang, error.

    ``g`` names the graph column and is prefixed to blank nodes, so that they cannot meet those of other graphs. A
    document that is not Turtle yields one row with ``error`` (200 characters at most) and nulls. Null or blank
    documents yield nothing.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for graph, content in zip(frame["g"], frame["text"], strict=True):
                name = lambda n: f"{graph}#{n[1]}" if n[0] == "B" else n[1]  # noqa: B023, E731
                try:
                    found = dict.fromkeys(parse_turtle(content, permissive=permissive))
                except (TurtleError, ValueError, RecursionError) as e:
                    rows.append((graph, *[None] * 7, str(e)[:200]))
                    continue
                rows += [(graph, name(s), s[0], p, name(o), o[0], o[2] if o[0] == "L" else None, o[3], None) for s, p, o in found]
            yield pd.DataFrame(rows, columns=["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "error"])

    return documents.select(documents[g].cast("string").alias("g"), documents[text].alias("text")).mapInPandas(read, TRIPLES)


def read_turtle(spark: SparkSession, path: str, pattern: str = "*.ttl", permissive: bool = False) -> DataFrame:
    """Turtle files below ``path`` as triples; the graph is the file's name without its ending."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    named = files.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("g"), F.col("value"))
    return turtle_triples(named, "g", "value", permissive)
