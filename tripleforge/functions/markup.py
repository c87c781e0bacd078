"""HTML pages and the JSON inside them: selectors by tag, class and attribute, JSON-LD, and paths into documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that never have content.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    """Flat list of elements: (tag, attributes, parent, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else -1, []])
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for i in reversed(range(len(self.open))):
            if self.nodes[self.open[i]][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for i in self.open:
            self.nodes[i][3].append(data)


def select(html: str | None, tag: str | None = None, css_class: str | None = None, attributes: dict[str, str] | None = None) -> list[dict]:
    """Elements of a page by tag, class and attributes (a value that ends with ``*`` is a substring to look for).

    Each is a dictionary of its attributes and, under '', its text without surrounding white space.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out = []
    for name, own, _, text in tree.nodes:
        if tag and name != tag or css_class and css_class not in own.get("class", "").split():
            continue
        if all((v[:-1] in own.get(k, "")) if v.endswith("*") else own.get(k) == v for k, v in (attributes or {}).items()):
            out.append(own | {"": " ".join("".join(text).split())})
    return out


def headings(html: str | None, text: str, ways: tuple[tuple[str | None, str | None, bool], ...] = (("h3", "title", False), ("h3", None, False), (None, "title", True))) -> list[int]:
    """Places of the elements that head a section called ``text``, by the first way that finds any.

    A way is a tag or none, a part of the class or none, and whether the text need only contain ``text``.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for tag, part, contained in ways:
        found = []
        for i, (name, own, _, texts) in enumerate(tree.nodes):
            said = " ".join("".join(texts).split())
            if (not tag or name == tag) and (not part or part in own.get("class", "")) and (text in said if contained else said == text):
                found.append(i)
        if found:
            return found
    return []


def linked_ids(html: str | None, section: str, pattern: str, climb: int = 10) -> list[str]:
    """Ids (first group of ``pattern``) in the links below the nearest ancestor, at most ``climb`` levels up, of an
    element with text or id ``section`` that has such links at all."""
    import re

    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    links = [(i, m[1]) for i, (name, own, _, _) in enumerate(tree.nodes) if name == "a" and (m := re.search(pattern, own.get("href", "")))]

    def below(i: int, root: int) -> bool:
        while i >= 0 and i != root:
            i = tree.nodes[i][2]
        return i == root

    for k, (_, own, _, text) in enumerate(tree.nodes):
        if own.get("id") == section or own.get("data-testid") == section or " ".join("".join(text).split()) == section:
            node = k
            for _ in range(climb + 1):
                found = [x for i, x in links if below(i, node)]
                if found or tree.nodes[node][2] < 0:
                    break
                node = tree.nodes[node][2]
            if found:
                return found
    return []


def extract(pages: DataFrame, key: str, html: str, tag: str | None = None, css_class: str | None = None, attributes: dict[str, str] | None = None, attribute: str = "") -> DataFrame:
    """(key, pos, value): text (or an attribute) of the selected elements of every page, in order."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, e.get(attribute)) for k, page in zip(frame["key"], frame["html"], strict=True) for i, e in enumerate(select(page, tag, css_class, attributes))]
            yield pd.DataFrame(rows, columns=["key", "pos", "value"])

    held = pages.select(pages[key].cast("string").alias("key"), pages[html].alias("html"))
    return held.mapInPandas(read, "key string, pos int, value string").withColumnRenamed("key", key)


def script_json(html: Column, kind: str = "application/ld+json") -> Column:
    """The JSON of the first script element of a type or id as variant; null if there is none or it is not JSON."""
    body = F.regexp_extract(html, rf"(?is)<script[^>]*(?:type|id)=[\"']{kind.replace('+', '[+]')}[\"'][^>]*>(.*?)</script>", 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def at_path(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of a variant, null if anything on the way is missing."""
    return F.try_variant_get(document, path, kind)


def of_type(document: Column, path: str, kind: str) -> Column:
    """The entries at a path, a list or a single one, whose @type is ``kind`` or a list that has it."""
    has = lambda x: F.coalesce(F.array_contains(F.transform(as_list(x, "$['@type']"), lambda t: t.cast("string")), kind), F.lit(False))
    return F.filter(as_list(document, path), has)


def as_list(document: Column, path: str) -> Column:
    """A value that is a list or a single item, as array of variants; null if missing."""
    value = F.try_variant_get(document, path, "variant")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(document, path, "array<variant>")).when(value.isNotNull(), F.array(value))
