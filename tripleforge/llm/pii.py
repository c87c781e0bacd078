"""Personal information in free text: a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.llm.names import NICKNAMES, fold, given_names, parse_name
from tripleforge.runtime import materialize, spread

TYPES = ("email", "phone", "identity_number", "street_address", "person_name")

#: Given names in common use, besides those with short forms in names.py.
GIVEN = frozenset(
    """adam agnes aisha alice amelia amy ana andrea andrew anna anne antonio aoife arthur astrid beatrice birgitta bjorn brian bridget camille carl carlos
    caroline catherine charlotte chiara christine christopher claire clara david diana diego edith ella elena elias emil emily emma eric erik esther ewa
    fatima felix fernando fiona florence francesca francis frank freya friedrich george georgia gerhard giovanni giulia grace greta hanna hannah hans
    heinrich helen helena henri henrik henry hugo ida ines irene isabel ivan jack jacob jakub james jan jane javier jean jennifer jessica joanna john jonas
    jorge jose joseph juan judith julia julian juliette jurgen karen karl katarzyna klaus krzysztof lars laura lena leon linda louis louise lucas lucia
    lucy ludovic luis luisa magdalena manuel marek maria marie mario marit martha martin martina mary mathilde matthew max mia miguel mohammed monica
    natalia nicolas niklas nina nora olga olivia oskar pablo paloma patricia patrick paul paula pedro peter philip pierre piotr rachel ralph raphael
    renaud roberto roger rosa rose ruth sara sarah sebastian sofia solveig sophie soren stefan stephen susan sven sylvia teresa timothy tomasz valentina
    vera veronica victor walter wolfgang ximena yves zoe""".split()
) | frozenset(NICKNAMES)

#: Last labels of domain names that make an address plausible.
TOP_LEVEL = frozenset("com org net edu gov info biz example test invalid localhost io co uk de fr es it nl pl eu us ca au ch at be se no dk fi ie pt".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_AT = re.compile(r"\s?(?:@|[(\[]at[)\]])\s?|\sat\s", re.IGNORECASE)
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[\w-]+)+", re.IGNORECASE)
_LABEL = re.compile(r"\.|[\s(\[]+dot[\s)\]]+", re.IGNORECASE)
_DIGITS = re.compile(r"(?<![\w.,:/-])(?<![\w.,:/-][(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d{1,12}(?:[ .-]\d{1,8})*(?![\w])(?!,\d)")
_GROUPS = re.compile(r"\+?\(?\d+\)?")
_CODE = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{6,8}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}[- ]\d{2}[- ]\d{4})(?![\w-])", re.IGNORECASE)
_NUMBER = re.compile(r"(?<![\w.,:/#-])\d{1,4}(?![\d.:/%])")
_WORDS = r"[^\W\d_][\w'’.-]*"
#: Kinds of streets in four languages.
_EN = re.compile(rf"\s?[a-z]?\s(?:{_WORDS}\s){{1,3}}(?:street|st|road|rd|lane|ln|avenue|ave|close|terrace|ter|drive|dr|court|ct|place|square|sq|crescent|grove|gardens|mews|boulevard|blvd|parade|row|walk)\b\.?", re.IGNORECASE)
_FR = re.compile(rf"\s?(?:bis|ter|[a-z])?,?\s(?:rue|avenue|av\.|boulevard|bd|impasse|chemin|place|allée|quai|cours|route|passage)\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’])?{_WORDS}", re.IGNORECASE)
_DE = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm")
_ES = re.compile(
    rf"(?<!\w)(?:calle|c/|plaza|avenida|avda\.|paseo|camino|via|piazza|praça|rua)\s?(?:de\slas?\s|de\slos\s|del\s|de\s|da\s|do\s)?{_WORDS}(?:\s{_WORDS})?,?\s(?:n[º°]\s?)?(?=\d)",
    re.IGNORECASE,
)
#: Flat, postal code and town after a street; the town has to begin with a capital letter.
_TAIL = re.compile(r"(?:,?\s(?:[Aa]pt|[Ff]lat|[Uu]nit|APT|FLAT)\.?\s\w+)?(?:,\s\d{4,5})?(?:,?\s(?-i:[A-ZÀ-Þ])[^\W\d_]+(?!\s[a-z]+\s[a-z]))?")
_INITIAL = (
    re.compile(r"(?<!\w)[^\W\d_]\.\s?(?:[^\W\d_]\.\s?)?(?:[^\W\d_]{4,}|(?-i:[A-ZÀ-Þ])[^\W\d_]{1,2}(?!\w))(?:-[^\W\d_]+)*"),
    re.compile(r"(?<!\w)[^\W\d_]{4,}(?:-[^\W\d_]+)*,\s[^\W\d_]\."),
)
#: Two words that both begin with a capital letter, or with an initial between them.
_CAPITALS = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞŁŠŽĐ][^\W\d_]+(?:['’-][^\W\d_]+)* {1,2}(?:[A-Z]\.? )?[A-ZÀ-ÖØ-ÞŁŠŽĐ][^\W\d_]")
#: Words after which people give a name, written in whatever case.
_LED = re.compile(
    r"(?<!\w)(?:name(?:'s| is)|called|named|i am|i'm|signed|regards|greetings from|sincerely|cheers|yours|contact|ask for|thanks to|ms|mrs|mr|dr|prof)[\s,.:;–—-]+(?=[^\W\d_]{2})",
    re.IGNORECASE,
)
_FUNCTION = frozenset("a an the of in on at to and or for from with my your his her our their is was i you it this that who me by as but so no not out off over up see all".split())


def _context(text: str, start: int, end: int) -> list[str]:
    left = _WORD.findall(text[max(0, start - 32) : start].lower())[-2:]
    right = _WORD.findall(text[end : end + 24].lower())[:1]
    sign = text[max(0, start - 2) : start].strip()[-1:]
    return [f"l1 {left[-1] if left else '^'}", f"l2 {' '.join(left)}", f"r1 {right[0] if right else '$'}", f"ls {sign if sign and not sign.isalnum() else ''}"]


def _emails(text: str, out: list) -> None:
    for m in _AT.finditer(text):
        domain = _DOMAIN.match(text, m.end())
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        name = text[start : m.start()].lstrip(".-+")
        if not domain or not name:
            continue
        start = m.start() - len(name)
        labels = [x.lower() for x in _LABEL.split(domain[0]) if x]
        while len(labels) > 2 and labels[-1] not in TOP_LEVEL and any(x in TOP_LEVEL for x in labels[1:-1]):
            labels.pop()
        signs = "plain" if m[0] == "@" else "words"
        features = ["email", f"sign {signs}", f"top {signs} {labels[-1] in TOP_LEVEL}", f"first {name.lower() in _FUNCTION}", f"inner {any(not c.isalpha() for c in name)}"]
        out.append((start, domain.end(), "email", features))


def _numbers(text: str, out: list) -> None:
    for m in _CODE.finditer(text):
        value = m[0]
        shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "A", value))
        out.append((m.start(), m.end(), "identity_number", ["identity", f"id {shape.replace(' ', '')}", f"id {shape}", *_context(text, m.start(), m.end())]))
    for m in _DIGITS.finditer(text):
        if sum(c.isdigit() for c in m[0]) < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUPS.finditer(m[0])]
        for i, (start, _) in enumerate(groups):
            for _, end in groups[i:]:
                value = text[start:end]
                n = sum(c.isdigit() for c in value)
                if not 7 <= n <= 15:
                    continue
                shape = re.sub(r"\d+", lambda g: str(len(g[0])), value)
                features = ["phone", f"n {n}", f"ph {shape}", f"head {value[0] if not value[0].isdigit() else value[:1] == '0'}", f"groups {shape.count(' ') + shape.count('.') + shape.count('-')}", f"rest {i > 0 or end < m.end()}"]
                out.append((start, end, "phone", features + _context(text, start, end)))


def _addresses(text: str, out: list) -> None:
    spanish = {m.end(): m.start() for m in _ES.finditer(text)}
    for m in _NUMBER.finditer(text):
        i, j = m.span()
        right = _EN.match(text, j) or _FR.match(text, j)
        if right:
            inner = _WORD.findall(right[0].lower())
            kind = "fr" if inner and right.re is _FR else "en"
            features = ["address", f"form {kind}", f"plain {any(w in _FUNCTION for w in inner[:-1]) and kind == 'en'}", f"words {len(inner)}"]
            end = _TAIL.match(text, right.end()).end()
            out.append((i, end, "street_address", features + _context(text, i, end)))
            continue
        end = i
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and not text[start - 1].isspace():
            start -= 1
        word = text[start:end].lower()
        if end < i and word.endswith(_DE):
            j = _TAIL.match(text, j).end()
            out.append((start, j, "street_address", ["address", "form de", f"bare {word in _DE}", *_context(text, start, j)]))
        elif i in spanish:
            start, j = spanish[i], _TAIL.match(text, j).end()
            out.append((start, j, "street_address", ["address", "form es", *_context(text, start, j)]))


def _case(text: str) -> str:
    return "title" if text.istitle() else "upper" if text.isupper() else "lower" if text.islower() else "mixed"


@functools.lru_cache(100_000)
def _is_given(word: str) -> bool:
    return fold(word) in GIVEN


def _name_features(text: str, start: int, end: int, form: str, given: str, family: str, field: str, led: bool = False) -> list[str]:
    name = text[start:end]
    own = family.split("-")[-1].lower()
    whole = not _WORD.search(text[:start]) and not _WORD.search(text[end:]) if field == "author" else False
    known = _is_given(given)
    context = _context(text, start, end)
    before, after = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
    run = f"{_case(before[-1]) if before else '-'} {_case(after[0]) if after else '-'}"
    features = ["name", f"{field} {form} {known}", f"case {_case(name)} {known}", f"whole {whole} {known}", f"function {own in _FUNCTION or given.lower() in _FUNCTION}", f"size {min(len(own), 8)}", f"form {form}", f"led {led} {_case(name)} {known}"]
    return features + [f"{field} {c}" for c in context] + [f"{known} {c}" for c in context[:2]] + [f"run {run} {known}"]


def _names(text: str, words: list, field: str, out: list) -> None:
    """Runs of two words that may be a name: capitalised, after a lead-in, with a known given name, or in an author.

    A known given name is a feature like others, not a condition.
    """
    led = {m.end() for m in _LED.finditer(text)}
    for k, (w, i, j) in enumerate(words):
        known, capital = _is_given(w), w[0].isupper()
        free = known or field == "author" or i in led and k + 1 < len(words) and words[k + 1][0][0].isupper() == capital
        if k + 1 < len(words) and (free or capital):
            v, a, b = words[k + 1]
            gap = text[j:a]
            if gap in (" ", "  ") and (len(v) > 2 or len(v) > 1 and v[0].isupper()):
                if free or len(w) > 1 and v[0].isupper():
                    out.append((i, b, "person_name", _name_features(text, i, b, "given family", w, v, field, i in led)))
            elif k + 2 < len(words) and len(v) == 1 and gap == " " and text[b : words[k + 2][1]] in (". ", " "):
                u, _, e = words[k + 2]
                if known or len(w) > 1 and text[b] == "." and v.isupper() and u[0].isupper():
                    out.append((i, e, "person_name", _name_features(text, i, e, "given m family", w, u, field, i in led)))
            elif gap == ", " and len(w) > 3 and not _is_given(v) and (i in led or field == "author") and capital and v[0].isupper():
                out.append((i, b, "person_name", _name_features(text, i, b, "family, given", v, w, field, i in led)))
        if known and k and len(words[k - 1][0]) > 3:
            v, a, b = words[k - 1]
            if text[b:i] == ", ":
                out.append((a, j, "person_name", _name_features(text, a, j, "family, given", w, v, field)))
            elif text[b:i] == " " and not _is_given(v):
                out.append((a, j, "person_name", _name_features(text, a, j, "family given", w, v, field)))
    if "." in text:
        for form, pattern in zip(("i family", "family, i"), _INITIAL, strict=True):
            for m in pattern.finditer(text):
                parts = [w for w in _WORD.findall(m[0]) if len(w) > 1]
                out.append((m.start(), m.end(), "person_name", _name_features(text, m.start(), m.end(), form, m[0][0] if form[0] == "i" else m[0][-2], parts[0], field)))


def candidates(text: str, field: str) -> list[tuple[int, int, str, list[str]]]:
    """Segments of a text that may be personal information: (start, end, type, features of the whole segment)."""
    out: list = []
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        _emails(text, out)
    if not text.isalpha() and any(map(str.isdigit, text)):
        _numbers(text, out)
        _addresses(text, out)
    words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
    if field == "author" or "." in text or _CAPITALS.search(text) or any(_is_given(w) for w, _, _ in words) or _LED.search(text):
        _names(text, words, field, out)
    return out


class Field:
    """The random field: a weight per feature and type; text outside segments scores nothing."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, kind: str, features: list[str]) -> float:
        """Score of a segment."""
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def best(self, spans: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
        """The segmentation of greatest score: dynamic programming over where segments end."""
        scored = sorted((e, s, k, v) for s, e, k, f in spans if (v := self.score(k, f)) > 0)
        if len(scored) == 1:
            return [(scored[0][1], scored[0][0], scored[0][2])]
        ends, totals, chosen = [-1], [0.0], [()]
        for e, s, k, v in scored:
            i = len(ends) - 1
            while ends[i] > s:
                i -= 1
            if totals[i] + v > totals[-1]:
                ends.append(e)
                chosen.append((i, (s, e, k)))
                totals.append(totals[i] + v)
        out, i = [], len(ends) - 1
        while i:
            back, span = chosen[i]
            out.append(span)
            i = back
        return out[::-1]

    def fit(self, examples: list[tuple[list, set]], rounds: int = 12, rate: float = 0.4, l2: float = 1e-4) -> None:
        """Maximises the conditional likelihood of the true segmentations by adaptive gradient steps.

        ``examples``: candidates of a text and the set of true (start, end, type). Marginals come from the forward
        and backward sums over all segmentations.
        """
        squares: dict[tuple[str, str], float] = {}
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if b > -1e300 else a
        for _ in range(rounds):
            for spans, truth in examples:
                points = sorted({p for s in spans for p in s[:2]})
                at = {p: i for i, p in enumerate(points)}
                scores = [self.score(k, f) for _, _, k, f in spans]
                into, outof = [[] for _ in points], [[] for _ in points]
                for n, (s, e, _, _) in enumerate(spans):
                    into[at[e]].append(n)
                    outof[at[s]].append(n)
                ahead, behind = [0.0] * len(points), [0.0] * len(points)
                for i in range(len(points)):
                    total = ahead[i - 1] if i else 0.0
                    for n in into[i]:
                        total = add(total, ahead[at[spans[n][0]]] + scores[n])
                    ahead[i] = total
                for i in reversed(range(len(points))):
                    total = behind[i + 1] if i + 1 < len(points) else 0.0
                    for n in outof[i]:
                        total = add(total, behind[at[spans[n][1]]] + scores[n])
                    behind[i] = total
                for n, (s, e, k, features) in enumerate(spans):
                    marginal = math.exp(min(0.0, ahead[at[s]] + scores[n] + behind[at[e]] - ahead[-1]))
                    slope = ((s, e, k) in truth) - marginal
                    if abs(slope) < 1e-3:
                        continue
                    for f in features:
                        w = self.weights.get((k, f), 0.0)
                        g = slope - l2 * w
                        q = squares[k, f] = squares.get((k, f), 0.0) + g * g
                        self.weights[k, f] = w + rate * g / math.sqrt(q + 1e-6)


_TRAINED: list[Field] = []


def _labels(spans: list, truth: set) -> set:
    """The candidates that stand for the true segments: same start and type, nearest end."""
    out = set()
    for start, end, kind in truth:
        own = [s[:3] for s in spans if s[0] == start and s[2] == kind]
        if own:
            out.add(min(own, key=lambda x: (abs(x[1] - end), x[1])))
    return out


def trained_field() -> Field:
    """The field fitted to generated labelled texts (see pii_training.py); fitted once per driver process."""
    if not _TRAINED:
        from tripleforge.llm.pii_training import labelled_texts

        field = Field()
        field.fit([(spans, _labels(spans, truth)) for text, where, truth in labelled_texts() if (spans := candidates(text, where))])
        _TRAINED.append(field)
    return _TRAINED[0]


def find_pii(records: DataFrame, key: str, fields: list[str], author: str | None = None) -> DataFrame:
    """Segments of personal information: (key, field, pii_type, start_pos, end_pos, value), whole texts, code points.

    ``author`` names the field that holds a writer's name rather than prose. Null and empty texts have none; a
    repeated record gives its segments as often as it comes; segments of one text never overlap, and of equally good
    segmentations the one met first from the left is taken. Other columns are ignored. The segments found, a small part of
    the texts, are written once, as their users read them several times.
    """
    shared = records.sparkSession.sparkContext.broadcast(trained_field())

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            rows = []
            for field in fields:
                where = "author" if field == author else "text"
                for k, text in zip(frame[key], frame[field], strict=True):
                    if text and (spans := candidates(text, where)):
                        rows += [(k, field, kind, s, e, text[s:e]) for s, e, kind in model.best(spans)]
            yield pd.DataFrame(rows, columns=["key", "field", "pii_type", "start_pos", "end_pos", "value"])

    held = spread(records.select(key, *fields))
    found = held.mapInPandas(search, "key long, field string, pii_type string, start_pos int, end_pos int, value string")
    return materialize(found, "pii").withColumnRenamed("key", key)


def _person_keys(names: DataFrame, column: str, found: bool) -> DataFrame:
    """Each name in a column with keys that two names of one person share, one being ``found`` and one not.

    Two full names share family name and given name or its full form; a full name and an initial share the family name
    and the initial of the given name, as do two initials.
    """
    full, initial = ("full", "initial") if not found else ("initial", "full")

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["value"]:
                p = parse_name(name)
                if not p:
                    continue
                kind, family, given = p
                if kind == "full":
                    forms = {*given_names(given), given}
                    rows += [(name, f"name|{family}|{g}") for g in forms] + [(name, f"{full}|{family}|{g[0]}") for g in forms]
                elif kind == "initial":
                    rows += [(name, f"{initial}|{family}|{given[0]}"), (name, f"both|{family}|{given[0]}")]
            yield pd.DataFrame(rows, columns=["value", "person"]).drop_duplicates()

    return names.select(names[column].alias("value")).where("value is not null").distinct().mapInPandas(keys, "value string, person string")


def private_pii(found: DataFrame, public_names: DataFrame, column: str) -> DataFrame:
    """``found`` without the names of people in ``public_names``: same family name and same given name or short form of
    it, or its initial where one of the two names has just that."""
    public = _person_keys(public_names, column, False).select("person").distinct()
    named = _person_keys(found.where("pii_type = 'person_name'"), "value", True).join(public, "person", "left_semi").select("value").distinct()
    known = named.withColumn("pii_type", F.lit("person_name"))
    return found.join(known, ["value", "pii_type"], "left_anti")


def redact(records: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``records`` with each segment replaced by its type in square brackets; the rest of every text stays as it was.

    Columns of ``records`` are kept. Repeated records are all redacted; records without segments come out unchanged.
    """
    spans = found.select(key, "field", "pii_type", "start_pos", "end_pos").distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.struct("field", "start_pos", "end_pos", "pii_type"))).alias("_spans"))
    joined = records.join(spans, key, "left")
    for field in fields:
        own = F.filter(F.col("_spans"), lambda s: s.field == field)  # noqa: B023
        text = F.col(field)
        start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
        merged = F.aggregate(own, start, lambda a, s: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start_pos"] - a["at"]), F.lit("["), F.upper(s["pii_type"]), F.lit("]")).alias("done"), s["end_pos"].alias("at")), lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))  # noqa: B023
        joined = joined.withColumn(field, F.when(text.isNull() | own.isNull(), text).otherwise(merged))
    return joined.drop("_spans")
