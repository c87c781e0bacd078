"""Names of persons and groups as people type them: parts, nicknames, spellings."""

from __future__ import annotations

import re
import unicodedata

#: Given names and their usual short forms.
NICKNAMES = {
    "abigail": "abby abbie gail",
    "alexander": "alex alec sandy sasha xander lex",
    "anthony": "tony ant",
    "benjamin": "ben benny benji",
    "charles": "charlie chuck chas chaz",
    "cordelia": "delia cordy",
    "daniel": "dan danny",
    "dorothy": "dot dolly dottie dory",
    "edward": "ed eddie ned ted teddy",
    "eleanor": "nell ellie nora lenore ella",
    "elizabeth": "betty liz lizzie beth eliza betsy libby",
    "frederick": "fred freddie freddy fritz",
    "gabriel": "gabe",
    "harold": "hal harry",
    "isabella": "bella izzy isa",
    "josephine": "jo josie",
    "katherine": "kathy kate kitty kat katie kay",
    "leonard": "len lenny leo",
    "margaret": "maggie meg peggy greta madge rita",
    "matilda": "tilly mattie tilda",
    "michael": "mike mick mickey",
    "nathaniel": "nat nate nathan",
    "oliver": "ollie noll",
    "penelope": "penny nell",
    "quentin": "quent quinn",
    "rebecca": "becky becca",
    "richard": "dick rick rich ricky richie",
    "robert": "bob rob bobby robbie bert",
    "samuel": "sam sammy",
    "susanna": "sue susie susan suzy",
    "theodore": "ted theo teddy",
    "thomas": "tom tommy",
    "ursula": "ursie",
    "victoria": "vicky tori vic",
    "vincent": "vince vinny",
    "william": "will bill billy willie liam",
    "xavier": "xav",
    "yvonne": "evie vonnie",
    "zachary": "zach zack",
    "ingrid": "inga",
}
#: What groups call themselves.
GROUPS = "brass band|band|big band|choir|chorus|ensemble|orchestra|philharmonic|players|quartet|quintet|sextet|singers|symphony|trio|duo|collective|consort"
#: Their abbreviations.
SHORT_GROUPS = {"bd": "band", "chr": "choir", "ch": "choir", "ens": "ensemble", "orch": "orchestra", "phil": "philharmonic", "qrt": "quartet", "qt": "quartet", "tr": "trio", "symph": "symphony", "sngrs": "singers", "plrs": "players"}
_SHORT = re.compile(rf"\b(?:({'|'.join(SHORT_GROUPS)})\.(?=\W|$)|({'|'.join(k for k in SHORT_GROUPS if len(k) > 3 and k != 'phil')})\b)")
_GROUP = re.compile(rf"\b({GROUPS})\b")
_LEAD = re.compile(r"^(?:(?:written|performed|composed|lyrics|music|produced|sung)\s+)?by\s+")
_QUOTED = re.compile(r"[\"“”(][^\"“”)]*[\"“”)]")
_PLACE = re.compile(r"\s+(?:of|from)\s+\S.*$")

CANONICAL = {short: frozenset(k for k, v in NICKNAMES.items() if short in v.split() or short == k) for line in [*NICKNAMES.values(), *NICKNAMES] for short in line.split()}


#: Letters that have no decomposition, and what they are commonly written as.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold().translate(_LETTERS)


def given_names(name: str) -> frozenset[str]:
    """The full given names a form may stand for; itself if it is no known short form."""
    return CANONICAL.get(name, frozenset([name]))


def parse_name(name: str | None) -> tuple[str, str, str] | None:
    """(kind, family, given) of a person, or of a group with its own name as family and its type as given.

    kind is 'group', 'full' (a given name in letters), 'initial' (its first letter only) or 'family' (none). Middle
    initials and quoted nicknames are left out, "Family, Given" and "Family Given" are turned round if the given name
    is a known one, and lead-ins such as "by" are removed. A name of three words or more that begins with "the" is a group
    of whatever type. Null for names without letters and for 'traditional'.
    """
    text = _LEAD.sub("", " ".join(fold(name or "").split()))
    text = " ".join(_QUOTED.sub(" ", text).split())
    text = _SHORT.sub(lambda m: SHORT_GROUPS[m[1] or m[2]], text)
    if not text or text.strip(" .") in ("traditional", "trad"):
        return None
    if m := _GROUP.search(text):
        own = _PLACE.sub("", (text[: m.start()] + " " + text[m.end() :]).strip())
        words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", own) if w != "the"]
        return ("group", " ".join(words), m[1]) if words else None
    last, comma, first = text.partition(",")
    spaced = re.sub(r"\.(?=\S)", ". ", first.strip() if comma else text)
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", spaced)
    if comma:
        family = " ".join(re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", last))
    else:
        if not words:
            return None
        if words[0] == "the" and len(words) > 2:
            return ("group", " ".join(words[1:-1]), words[-1])
        if len(words) > 1 and words[-1].rstrip(".") in CANONICAL and words[0] not in CANONICAL and not words[0].endswith("."):
            words = [words[-1], words[0]]
        family = words.pop().rstrip(".")
    if not family:
        return None
    if not words:
        return ("family", family, "")
    given = words[0].rstrip(".")
    return ("initial", family, given[0]) if len(given) == 1 else ("full", family, given)


def typo_distance(a: str, b: str, limit: int = 1) -> int:
    """Edits (insertion, deletion, substitution, swap of neighbours) from a to b within the band; limit + 1 if more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    if limit == 1:
        # what follows the first difference decides
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]:
            return 1
        return 1 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2
    far = limit + 1
    before, row = None, {j: j for j in range(min(len(b), limit) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            if j == 0:
                now[j] = i
                continue
            d = min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            now[j] = d
        before, row = row, now
    return min(row.get(len(b), far), far)


def same_given(a: str, b: str) -> int:
    """Typos between two given names, short forms counting as the name itself; 2 if they differ."""
    if a == b or given_names(a) & given_names(b):
        return 0
    if min(len(a), len(b)) < 4:
        return 2
    if typo_distance(a, b) <= 1:
        return 1
    known = [x for x in (*given_names(a), *given_names(b))]
    return 1 if any(typo_distance(x, y) <= 1 for x in known for y in (a, b) if x != y and len(y) >= 4 and x not in (a, b)) else 2
