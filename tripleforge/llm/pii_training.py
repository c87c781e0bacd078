"""Labelled texts for the field in pii.py, generated from wording in common use; no text of a user is needed."""

from __future__ import annotations

import random

from tripleforge.llm.pii import GIVEN

#: How people introduce each kind of data, and what stands around it.
LEADS = {
    "email": ["write me at", "e-mail me", "email:", "contact:", "my address is", "mail", "send it to", "pls send the tabs to", "reach me at", "sheet music? mail", "or"],
    "phone": ["call me", "tel.", "text", "ring", "my number:", "whatsapp me on", "phone:", "mobile", "fax", "reach me on", "sms", "or"],
    "identity_number": ["my SSN is", "SSN:", "soc sec", "social security no.", "passport no.", "passport:", "my national insurance is", "NI number", "NINO:", "DNI", "my id card number is", "id:", "Ausweis", "carte d'identité", ""],
    "street_address": ["I live at", "come by,", "we meet at", "ship it to", "pick up at", "my place is", "send it to", "kid from", "moved to", "or"],
    "person_name": ["my name is", "greetings from", "regards,", "—", "—", "—", "ask for", "my teacher", "by my neighbour", "cheers,", "my aunt", "I am", "yours,", "danced by my neighbour", "contact", "or my teacher"],
}
TAILS = ["", ".", "!", " please", " thanks", ", anytime", "; see you", " or so", "?"]
AUTHOR_LEADS = ["", "", "", "", "★", "🎬 ", "DJ-free ", "the real ", "it's "]
AUTHOR_TAILS = ["", "", "", " 🎻", " ♥", " official"]
#: Numbers and names that are nobody's personal data. # stands for a digit, N for a name, W for a title.
PLAIN = [
    "barcode # ##### ##### # if you hunt for it", "#,###,### views and counting", "opus ##, no. #, page ### of the score", "matrix number ###-####-A, first pressing", "Cat. no. TRN-###, pressed in W",
    "recorded in ####? sounds like #### to me", "look at #:## and again at #:## @ full volume, that hum", "bars ###-### and ###-### are pure joy, tuned to ###.## Hz", "I have ### versions of W and this one is best",
    "stood in line from # to ## for a ticket, seat ###, row ##", "N deserves more than ### likes, seriously", "N never sounded this good", "the N Quartet never sounded this good", "who is here after watching W?", "the part at #:## is pure gold",
    "volume at ## percent", "W was played at my wedding, everybody sang along", "the actor in W hums W while fear takes over, chills", "@some_body## you are right about W, the light is great", "ISBN ### # #### #### #", "order #########",
    "N wrote this, N sang it", "the best of N since ####", "after ## plays I still cry", "this scene lasts ### minutes on the road to W", "the ## lanterns of the square", "my grandfather whistled this in W in ####", "## comments and not one about W",
    "I love N in this film", "W > everything else in W", "came for the lane, stayed for the ending", "you look like a fool at that place", "the story of W and W", "N, W and N in one film", "version #.#.# is out", "he won ## - ## in ####", "a ## minute walk", "music by N", "sung by N, live",
]
AUTHORS = ["hidden.river##", "@green_meadow", "TheSilentBaker##", "broken-signal", "quiet tunnel", "hire me", "the official channel", "music lover", "film club W", "band: ", "W fan"]
STREETS = ["Oak", "Mill", "Church", "Station", "Rose", "Wren", "Heron", "Larch", "Cooper", "Saltmarsh", "King", "Foundry"]
_SYLLABLES = ["ba", "del", "mor", "quin", "ser", "tho", "lum", "gri", "wes", "har", "pen", "ol", "ve", "rik", "san", "dor", "ney", "cob", "mel", "fen", "yar", "zib", "net", "rask"]
_SOUNDS = ["xi", "ao", "lu", "wa", "se", "un", "pri", "ya", "kho", "dmi", "tri", "nge", "aki", "yo", "hu", "jin", "fa", "ri", "za", "ta", "mi", "ko", "ade", "chi"]
_ENDINGS = ["son", "ton", "ley", "field", "berg", "mann", "wood", "shaw", "worth", "well", "ski", "ez", "hurst", "thorpe", "gate", "bottom", "by", "mire", "lund", "strand", "beck", "in", "ard"]


#: Words around names and titles that are nobody's personal data, and what relatives and strangers do.
_AROUND = "in of and while with for into after before like about on under plus than from hums plays meets watching reading the this that pressing scenes bars theme ending version colour staging narration sound regret longing".split()
_ADJECTIVES = "Hollow Golden Pure Silent Broken Northern Velvet Frozen Crooked Paper Distant Old Green Wooden Pathetic Restless Tidal Scarlet".split()
_NOUNS = "Meadow Lantern Orchard Beekeeper Harbour River Lighthouse Clockmaker Teacher Shoreline Suspicion Rubbish Bridge Glacier Ferry Violinist Archive Mirror".split()
_LEADING = "my teacher;my neighbour;my aunt;my uncle;my grandfather;I am;contact;ask for;cheers;regards from".split(";")
_POINTING = "this is;what is;regards from;contact the;I am in;watching;back to".split(";")
_DOES = "whistled this;hums it;grandfather sang this;loves this film;cried here;is so happy;played it twice;and brother laughed;who left early;still plays it;was right about this;never liked it".split(";")


def _word(r: random.Random) -> str:
    return "".join(r.choices(_SYLLABLES + _SOUNDS, k=r.choice([1, 2, 2]))).capitalize()


def _title(r: random.Random) -> str:
    """A title or other capitalised words in the manner of titles."""
    adjective, noun = (r.choice(x) if r.random() < 0.6 else _word(r) for x in (_ADJECTIVES, _NOUNS))
    kinds = [f"{adjective} {noun}", f"The {noun}", f"My {noun}", f"{_word(r)}, My {noun}", f"{adjective} {noun}: The {_word(r)} Years", f"A {noun} for {_word(r)}", f"{noun} of {_word(r)}", f"{adjective} {_word(r)} {noun}", f"{adjective} {noun} > everything else"]
    return r.choice(kinds)


def _untitled(r: random.Random) -> str:
    """Ordinary wording with titles, and lead-ins that no name follows."""
    if r.random() < 0.25:
        lead, what = r.choice([(_LEADING, _DOES), (_LEADING, _DOES), (_POINTING, [_title(r)])])
        return f"{r.choice(lead)} {r.choice(what)} {r.choice(_AROUND)} {_title(r)}"
    around = lambda: " ".join(r.choice(_AROUND) if r.random() < 0.7 else _word(r).lower() for _ in range(r.randint(0, 3)))
    return " ".join(x for x in (around(), _title(r), around(), _title(r) if r.random() < 0.3 else "") if x)


def _digits(r: random.Random, pattern: str) -> str:
    return "".join(str(r.randint(1 if i == 0 else 0, 9)) if c == "#" else c for i, c in enumerate(pattern))


def _family(r: random.Random) -> str:
    own = lambda: "".join(r.choices(_SYLLABLES, k=r.randint(1, 2))).capitalize() + r.choice(_ENDINGS)
    return own() if r.random() < 0.88 else f"{own()}-{own()}"


def _cased(r: random.Random, text: str) -> str:
    x = r.random()
    return text.lower() if x < 0.08 else text.upper() if x < 0.16 else text


def _name(r: random.Random) -> str:
    # a third of the given names is made up, so that the field learns to do without a known one
    given = r.choice(_GIVEN).title() if r.random() < 0.67 else "".join(r.choices(_SYLLABLES + _SOUNDS, k=r.choice([2, 2, 3]))).capitalize()
    family, x = _family(r), r.random()
    text = f"{given} {family}" if x < 0.72 else f"{family}, {given}" if x < 0.84 else f"{given[0]}. {family}" if x < 0.95 else f"{family}, {given[0]}." if x < 0.96 else f"{given} {r.choice('ABCDEFGH')}. {family}"
    return _cased(r, text)


_GIVEN = sorted(GIVEN)


def _value(r: random.Random, kind: str) -> str:
    if kind == "person_name":
        return _name(r)
    if kind == "email":
        given, family = r.choice(_GIVEN), _family(r).lower()
        local = r.choice([f"{given}.{family}", f"{given}_{family[:4]}", f"{given[0]}{family}", f"{family}{r.randint(0, 99):02d}", f"{given}+{r.choice(['clips', 'list'])}", f"{r.choice(['green', 'silent'])}.{r.choice(['river', 'baker'])}"])
        domain = [*r.sample(["mail", "post", "harbour", "fjordweb", "in", "quillmail"], r.choice([1, 1, 2])), r.choice(["example", "test", "invalid", "com", "org", "de"])]
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", ".")])
        return _cased(r, local + at + dot.join(domain))
    if kind == "phone":
        return _digits(r, r.choice(["+44 7700 ######", "07700######", "020 7946 0###", "(0##) ##### ###", "+1 ### 555 01##", "(###) 555-01##", "###-555-01##", "###.555.01##", "+33 1 ## ## ## ##", "01.##.##.##.##", "+49 30 ########", "0# ## ## ## ##", "+34 6## ### ###"]))
    if kind == "identity_number":
        letter = r.choice("ABCD")
        return _digits(r, r.choice([f"QQ ## ## ## {letter}", f"AB######{letter}", "###-##-####", "### ## ####", "ZX#######", "X########"[:9], f"0#######{r.choice('TRWAGMYFPDXBNJZSQVHLCKE')}", f"########{r.choice('TRWAGMYFPDXBNJZ')}"]))
    number, street, town = r.randint(1, 199), r.choice(STREETS), r.choice(["", "", f", {_family(r)}", f" {_family(r)}"])
    kinds = [f"{number}{r.choice(['', '', 'a', 'b'])} {street} {r.choice(['Street', 'St.', 'Road', 'Rd', 'Lane', 'Avenue', 'Close', 'Terrace'])}{r.choice(['', '', f', Apt {r.randint(1, 9)}'])}{town}"]
    kinds.append(f"{number} {r.choice(['rue', 'avenue', 'bd', 'impasse', 'chemin'])} {r.choice(['des', 'du', 'de la'])} {_family(r)}{town}")
    kinds.append(f"{street}{r.choice(['straße', 'str.', 'gasse', 'weg'])} {number}, {r.randint(10000, 99999)}{town}")
    kinds.append(f"{r.choice(['Calle', 'Plaza', 'Avenida', 'C/'])} {r.choice(['del', 'de la', 'de los', ''])} {_family(r)}, {number}, {r.randint(10000, 99999)}{town}".replace("  ", " "))
    return _cased(r, r.choices(kinds, [3, 1, 1, 1])[0])


def _plain(r: random.Random) -> str:
    if r.random() < 0.4:
        text = _untitled(r)
        return text.upper() if r.random() < 0.15 else _cased(r, text)
    text = _digits(r, r.choice(PLAIN))
    while "N" in text.replace("NI", "").replace("No", "").replace("TRN", "") and " N" in f" {text}":
        text = f" {text}".replace(" N", f" {_name(r)}", 1)[1:]
        if r.random() < 0.5:
            break
    return _cased(r, text.replace("W", f"{r.choice(['The Salt', 'Old', 'Green', 'A'])} {r.choice(STREETS)}"))


def labelled_texts(n: int = 4_000, seed: int = 5) -> list[tuple[str, str, set[tuple[int, int, str]]]]:
    """(text, field kind, true segments) of ``n`` comments and half as many author names."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, truth = "", set()
        for _ in range(r.choice([1, 2, 2, 3])):
            text += r.choice(["", "", " ", ". ", "\n", " - ", " / ", ", ", "... "]) if text else ""
            if r.random() < 0.5:
                kind = r.choice(list(LEADS))
                lead, value = r.choice(LEADS[kind]), _value(r, kind)
                text += f"{lead} " if lead else ""
                truth.add((len(text), len(text) + len(value), kind))
                text += value + r.choice(TAILS)
            else:
                text += _plain(r) + r.choice(["", ".", "!", "..."])
        out.append((text, "text", truth))
    for _ in range(n // 2):
        lead, tail, x = r.choice(AUTHOR_LEADS), r.choice(AUTHOR_TAILS), r.random()
        if x < 0.45:
            out.append((_digits(r, r.choice(AUTHORS)).replace("W", "Salt"), "author", set()))
            continue
        kind = "person_name" if x < 0.85 else "phone" if x < 0.93 else "email"
        lead = r.choice(["band: ", "hire me ", "", "booking "]) if kind != "person_name" else lead
        value = _value(r, kind)
        out.append((lead + value + tail, "author", {(len(lead), len(lead) + len(value), kind)}))
    return out
