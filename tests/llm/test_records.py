import itertools
import random
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleforge.llm import content, linkage, names, pii, pii_training, spellings


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(1, 3))
def test_typo_distance(a, b, limit):
    assert names.typo_distance(a, b, limit) == min(osa(a, b), limit + 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ann Bell", ("full", "bell", "ann")), ("Bell, Ann", ("full", "bell", "ann")), ("Dorothy BELL", ("full", "bell", "dorothy")), ("Bell Dorothy", ("full", "bell", "dorothy")),
        ("A. Bell", ("initial", "bell", "a")), ("A.B. Bell", ("initial", "bell", "a")), ("Bell, A.", ("initial", "bell", "a")), ("Bell", ("family", "bell", "")), ("by  Ann K. Béll", ("full", "bell", "ann")),
        ('Ann "Dot" Bell', ("full", "bell", "ann")), ("The Bell Quartet", ("group", "bell", "quartet")), ("Bell Brass Band, The", ("group", "bell", "brass band")), ("Quartet Bell", ("group", "bell", "quartet")), ("the Bell Qrt.", ("group", "bell", "quartet")),
        ("Bell Trio of Rome", ("group", "bell", "trio")), ("The Bell Sngrs", ("group", "bell", "singers")), ("The Bell Gamelan", ("group", "bell", "gamelan")), ("Traditional", None), ("trad.", None), ("", None), (None, None), ("...", None), ("42", None), ("Søren Bell", ("full", "bell", "soren")),
    ],
)
def test_parse_name(text, want):
    assert names.parse_name(text) == want


def test_segment_join_against_brute_force(spark):
    r = random.Random(2)
    base = ["".join(r.choices("abcde", k=r.randrange(3, 10))) for _ in range(120)]
    for b in base[:80]:
        i = r.randrange(len(b))
        base.append(r.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "y" + b[i + 1 :], b[: i - 1] + b[i : i + 1] + b[i - 1 : i] + b[i + 1 :] if i else b]))
    words = sorted({w for w in base if len(w) >= spellings.LEAST})
    df = spark.createDataFrame([(w, 1) for w in [*base, *base, None, ""]], "name string, a int")
    got = {frozenset((x["a"], x["b"])) for x in spellings.segment_join(df).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and osa(a, b) <= 1}


def entities(spark, spelled):
    out = {}
    for r in spellings.name_entities(spark.createDataFrame([(n, "c") for n in spelled], "who string, component string"), "who").collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_entities(spark):
    one = ["Dorothy Lebatetralt", "Lebatetralt, Dorothy", "DOROTHY LEBATETRALT", "Dolly Lebatetralt", "D. Lebatetralt", "Lebatetralt Dorothy", "Dorothy Lebatetrlat", "Doroty Lebatetralt", "by Dorothy Lebátetralt", "Lebatetralt"]
    other = ["Samuel Nunisupesk", "S. Nunisupesk"]
    third = ["Richard Nunisupesk", "Dick Nunisupesk"]
    group = ["The Nunisupesk Trio", "Nunisupesk Trio, The", "the nunisupeks trio"]
    got = entities(spark, [*one, *other, *third, *group, "Nunisupesk", "Traditional", "", None, "Dorothy Lebatetralt"])
    assert got == sorted(map(sorted, [one, other, third, group, ["Nunisupesk"]]))


def test_given_keys():
    """Whatever given names are accepted as one share a key."""
    r = random.Random(9)
    known = [*names.NICKNAMES, *[x for v in names.NICKNAMES.values() for x in v.split()]]
    slip = lambda w: r.choice([w, w[: (i := r.randrange(len(w)))] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[: max(0, i - 1)] + w[i : i + 1] + w[max(0, i - 1) : i] + w[i + 1 :]])
    for _ in range(3_000):
        a = r.choice(known)
        b = slip(r.choice([a, r.choice([*names.given_names(a)]), r.choice(known)]))
        if b and names.same_given(a, b) <= 1:
            assert spellings.given_keys("full", a) & spellings.given_keys("full", b)


def test_many_given_names_of_one_family(spark):
    """Work grows with the number of names, not with its square: the pairs compared are those that share a key."""
    r = random.Random(14)
    spelled = sorted({"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(50_000)})
    lists = Counter(k for g in spelled for k in spellings.given_keys("full", g))
    assert sum(n * (n - 1) // 2 for n in lists.values()) < len(spelled)
    some = spelled[:5_000]
    df = spark.createDataFrame([(f"{g.title()} Smithson",) for g in some], "who string")
    assert spellings.name_entities(df, "who").select("entity").distinct().count() == len(some)


def test_entities_of_nothing(spark):
    assert entities(spark, []) == [] and entities(spark, [None, "traditional"]) == []
    assert entities(spark, ["X. Only", "Only, X."]) == [["Only, X.", "X. Only"]]


def test_variant_pairs(spark):
    df = spark.createDataFrame([("b", "e"), ("a", "e"), ("c", "f")], "name string, entity string")
    assert [tuple(r) for r in spellings.variant_pairs(df).collect()] == [("a", "b")]


@pytest.mark.parametrize(
    ("title", "channel", "description", "want"),
    [
        ("Ann Bell - Red River (Official Audio)", "Tunes", None, ("Red River", "Ann Bell")), ('Red River (from "Film") [HD]', "AnnBellTV", None, ("Red River", "Ann Bell")), ("Red River | Film OST | HQ", "x", "Performed by Ann Bell.", ("Red River", "Ann Bell")),
        ("RED RIVER // Bell, A. - Live in Rome", "x", None, ("RED RIVER", "Bell, A.")), ("Red River by Ann Bell", "x", None, ("Red River", "Ann Bell")), ("Red River", "Ann Bell - Topic", None, ("Red River", "Ann Bell")),
    ],
)
def test_readings(title, channel, description, want):
    assert want in [r[:2] for r in linkage.readings(title, channel, description)]


@pytest.mark.parametrize("order", list(itertools.permutations(["Ann Bell", "Red River", "Salt Road OST"])))
@pytest.mark.parametrize("remark", ["", " | HQ", " (Official Video)", " - Live in Rome"])
def test_readings_in_any_order(order, remark):
    for sign in (" - ", " – ", " | "):
        assert ("Red River", "Ann Bell", "Salt Road") in linkage.readings(sign.join(order) + remark, "x", None)
    assert ("Red River", "Ann Bell", "Salt Road") in linkage.readings("Ann Bell - Red River [Salt Road] - Live in Rome", "x", None)
    assert ("Live Forever", "Ann Bell", "") in linkage.readings("Ann Bell - Live Forever", "x", None)
    assert linkage.readings("Salt Road Soundtrack", "Ann Bell", None)[0][:2] == ("Salt Road Soundtrack", "Ann Bell")


def test_assignment_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(1, 5)
        weights = np.array([[r.choice([0, 0, r.random()]) for _ in range(m)] for _ in range(n)])
        pairs = linkage.assignment(weights)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        small, large = sorted((n, m))
        w = weights if n <= m else weights.T
        best = max(sum(w[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(sum(weights[p] for p in pairs) - best) < 1e-9


@pytest.mark.parametrize("title", ["Ann - Song (cover by Bo)", "Song KARAOKE version", "How to play Song guitar lesson", "Film - Official Trailer", "Reacting to Song", None, ""])
def test_no_readings(title):
    assert linkage.readings(title, "c", None) == []


TRACKS = "track_id long, title string, artist string, film string, side int"
VIDEOS = "video_id string, title string, channel_title string, description string, key string"


def links(spark, tracks, videos, width=40):
    t = spark.createDataFrame([(*x, 1) for x in tracks], TRACKS)
    v = spark.createDataFrame([(*x, "k") for x in videos], VIDEOS)
    return {(r["track_id"], r["video_id"]) for r in linkage.link_tracks(t, v, width).collect()}


def test_linking(spark):
    tracks = [(1, "Red River", "Ann Bellhouse", "F"), (2, "Red River", "Bo Carpenter", None), (3, " RED RIDER ", "Ann Bellhouse", None), (4, None, "x", None), (5, "Solo", None, None), (6, "Red River", "Ann Bellhouse", "F")]
    videos = [("a", "Ann Bellhouse - Red River", "c", None), ("a", "Ann Bellhouse - Red River", "c", None), ("b", "Rde River (HD)", "A. Bellhouse - Topic", None), ("c", "Red River by Bo Carpentre", "c", None), ("d", "Red Rider - Bellhouse, Ann", "c", None), ("e", "Ann Bellhouse - Red River (cover by X)", "c", None), ("f", None, None, None), ("g", "Red River - Someone Else", "c", None), ("h", "R" * 50_000, "c", "z" * 50_000)]
    assert links(spark, tracks, videos) == {(1, "a"), (6, "a"), (1, "b"), (6, "b"), (2, "c"), (3, "d")}
    assert links(spark, [], videos) == set() and links(spark, tracks, []) == set()


def test_no_pair_is_lost_at_the_borders_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BUCKET", 64)
    r = random.Random(7)
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randrange(6, 10)))
    songs = [(i, f"{word()} {word()}".title(), f"{word()} {word()}".title(), None) for i in range(400)]
    videos = [(f"v{i}", f"{a} - {t}", "c", None) for i, t, a, _ in songs]
    assert links(spark, songs, videos, 20) == {(i, f"v{i}") for i in range(400)}


def training_texts(n=900, seed=4):
    r = random.Random(seed)
    nouns = ["harbour", "garden", "mirror", "train", "letter", "river", "bridge", "lamp"]
    bad, out = ["you are a filthy vermin", "shut your mouth you pathetic idiot", "go and die you worthless scum"], []
    for _ in range(n):
        lines = [f"the {r.choice(nouns)} in the {r.choice(nouns)} scene is {r.choice(['dull', 'fine', 'a stupid mess', 'filthy with rain'])}" for _ in range(r.randrange(1, 6))]
        y = r.random() < 0.15
        if y:
            text = r.choice(bad)
            text = r.choice([text, text.upper(), text.replace("e", "3"), text.replace("i", "iii"), " ".join(text[:5]) + text[5:]])
            lines.insert(r.randrange(len(lines) + 1), text)
        out.append((". ".join(lines), int(y)))
    return out


def test_content_model_on_held_out_texts():
    rows = training_texts()
    model = content.train_content_model([t for t, _ in rows[:600]], [y for _, y in rows[:600]])
    wrong = sum((s > 0) != (y == 1) for s, (_, y) in zip(model.scores([t for t, _ in rows[600:]]), rows[600:], strict=True))
    assert wrong <= 9
    one = [model.scores([t])[0] for t, _ in rows[600:640]]
    assert one == pytest.approx(model.scores([t for t, _ in rows[600:640]]).tolist(), abs=1e-4)


def test_content_of_odd_texts():
    model = content.train_content_model(["good"] * 5 + ["bad idiot"] * 5, [0] * 5 + [1] * 5)
    got = model.scores([None, "", "\0", "bad idiot", "x" * 300_000, "." * 1000])
    assert len(got) == 6 and got[3] > 0 and got[0] == got[1]
    assert len(model.scores([])) == 0
    assert content.train_content_model(["a", "b"], [0, 0]).scores(["c"])[0] < 0 < content.train_content_model(["a"], [1]).scores(["c"])[0]
    assert content.train_content_model([], []).scores(["c"])[0] < 0


def test_content_scores_and_rates(spark):
    rows = [("t", i, None if i % 5 == 0 else f"s{i % 2}", x) for i, (x, _) in enumerate(training_texts(300))] + [("t", 900, "s0", None), ("t", 901, "s0", ""), ("t", 1, "s1", training_texts(300)[1][0])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "source_table string, record_id long, source string, text string, score int")
    labels = spark.createDataFrame([("t", i, y) for i, (_, y) in enumerate(training_texts(300))] + [("t", 5_000, 1), ("t", 1, None)], "source_table string, record_id long, is_abusive int")
    scores = content.content_scores(df, labels)
    assert scores.count() == len(rows)
    rates = {r["source"]: r for r in content.content_rates(scores).collect()}
    assert rates["s0"]["n_records"] + rates["s1"]["n_records"] + rates[None]["n_records"] == 302
    assert content.content_scores(df.limit(0), labels).count() == 0


def test_field_is_exact():
    """Best segmentation and marginals against all segmentations of a small example."""
    spans = [(0, 3, "email", ["a"]), (2, 5, "phone", ["b"]), (3, 6, "phone", ["c"]), (5, 8, "email", ["d"]), (0, 8, "person_name", ["e"])]
    field = pii.Field()
    field.weights = {("email", "a"): 1.0, ("phone", "b"): 2.2, ("phone", "c"): 0.4, ("email", "d"): 0.9, ("person_name", "e"): 2.5}
    subsets = [s for k in range(32) if all(a[1] <= b[0] for s in [[x for i, x in enumerate(spans) if k >> i & 1]] for a, b in zip(sorted(s), sorted(s)[1:])) for s in [[x for i, x in enumerate(spans) if k >> i & 1]]]
    best = max(subsets, key=lambda s: sum(field.score(x[2], x[3]) for x in s))
    assert field.best(spans) == sorted(x[:3] for x in best)
    assert field.best([]) == []


def test_field_on_held_out_texts():
    field = pii.trained_field()
    hit = false = missed = 0
    for text, where, truth in pii_training.labelled_texts(600, seed=99):
        got = {(s, k) for s, _, k in field.best(pii.candidates(text, where))}
        want = {(s, k) for s, _, k in truth}
        hit, false, missed = hit + len(got & want), false + len(got - want), missed + len(want - got)
    assert hit / (hit + false) > 0.97 and hit / (hit + missed) > 0.93


UNLISTED = "Xiaoming Oluwaseun Priya Yuki Siobhan Dmitri Thandiwe Nguyen Aoki Folasade Rajesh Haruto Chukwuemeka Anahera Leilani Kwabena Zoltan Milica Ragnheidur Itziar".split()
FAMILIES = "Li Adeyemi Raghavan Tanaka O'Leary Volkov Mokoena Tran Kiplagat Okonkwo Bose Szabo Petrovic Aguirre Castellanos Winterbourne Vandermeer Osei Jonsdottir Kapoor".split()


def test_names_that_no_list_has():
    """Given names outside every list of the library, in comments and as authors, beside capitalised words that are no names."""
    field = pii.trained_field()
    assert not any(pii._is_given(n) for n in UNLISTED)
    r = random.Random(11)
    leads = ["my name is {}", "regards, {}", "ask for {} at the desk", "greetings from {}!", "my teacher {} played this", "cheers, {}", "great film. yours, {}", "contact {} please", "so said my neighbour {}.", "hello, I am {} and I sing"]
    plain = ["The Salt Orchard is a masterpiece", "I watched Green River twice", "Thank You So Much for this", "Golden Lantern by the sea", "what a scene in New York", "Best Soundtrack Ever", "regards from the cinema", "this is Pure Gold", "I am so Happy Today", "contact the Film Office", "Old Harbour and Grand Hotel"]
    hit = false = missed = 0
    for _ in range(600):
        name = f"{r.choice(UNLISTED)} {r.choice(FAMILIES)}"
        where, text, want = r.choice([("author", name, True), ("text", r.choice(leads), True), ("text", r.choice(leads), True), ("text", r.choice(plain), False), ("text", r.choice(plain), False)])
        start = 0 if where == "author" else text.find("{}")
        text = text.format(name.lower() if r.random() < 0.1 else name)
        if r.random() < 0.3 and where == "text":
            before = r.choice(plain) + ". "
            text, start = before + text, start + len(before)
        got = {s for s, _, k in field.best(pii.candidates(text, where)) if k == "person_name"}
        true = {start} if want else set()
        hit, false, missed = hit + len(got & true), false + len(got - true), missed + len(true - got)
    assert hit / (hit + false) >= 0.95 and hit / (hit + missed) >= 0.95, (hit, false, missed)


def test_long_local_parts_and_street_names():
    field = pii.trained_field()
    local = "a" * 100 + ".bell"
    assert [(k, s) for s, _, k in field.best(pii.candidates(f"write me at {local}@mail.example, thanks", "text"))] == [("email", 12)]
    street = "Donau" * 20 + "straße"
    assert [(k, s) for s, _, k in field.best(pii.candidates(f"I live at {street} 131, 36266 Lund", "text"))] == [("street_address", 10)]
    street = f"Calle de los {'Faroles' * 12}, 109"
    assert [(k, s) for s, _, k in field.best(pii.candidates(f"I live at {street}, 95996 Lund", "text"))] == [("street_address", 10)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write me at ann.bell at mail dot example, thanks", [("email", 12)]), ("tel. (030) 23125 621; see you", [("phone", 5)]), ("call me +1 617 555 0191!", [("phone", 8)]), ("my SSN is 666-07-4264.", [("identity_number", 10)]),
        ("I live at 12b Mill Road, Lund please", [("street_address", 10)]), ("I live at Calle del Farol, 109, 95996 Lund", [("street_address", 10)]), ("I live at Amselstr. 131, 36266 Lund", [("street_address", 10)]), ("12 rue des Lampions", [("street_address", 0)]),
        ("greetings from søren cobblerhurst thanks", [("person_name", 15)]), ("regards, A. Kettlethorpe.", [("person_name", 9)]), ("barcode 9 01233 47120 4 if you hunt", []), ("1,243,436 views and opus 238, no. 3", []), ("look at 1:24 and again at 3:40 @ full volume", []), ("", []), ("a" * 100_000, []),
    ],
)
def test_single_texts(text, want):
    assert [(k, s) for s, _, k in pii.trained_field().best(pii.candidates(text, "text"))] == want


def test_find_and_redact(spark):
    rows = [(1, "DJ-free Robert Orrinhurst", "call me 07700900123 or write me at a.b@mail.example"), (2, "golden.river9", None), (3, None, ""), (4, "Dorothy Lebatetralt", "Dorothy Lebatetralt never sounded this good"), (1, "DJ-free Robert Orrinhurst", "call me 07700900123 or write me at a.b@mail.example")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "comment_id long, author string, text string, value string, start_pos int")
    found = pii.find_pii(df, "comment_id", ["text", "author"], author="author")
    public = spark.createDataFrame([("Lebatetralt, D.",), (None,), ("",)], "name string")
    private = pii.private_pii(found, public, "name")
    assert {(r["comment_id"], r["field"], r["pii_type"], r["start_pos"]) for r in private.collect()} == {(1, "text", "phone", 8), (1, "text", "email", 35), (1, "author", "person_name", 8)}
    out = {r["comment_id"]: r for r in pii.redact(df, private, "comment_id", ["text", "author"]).collect()}
    assert out[1]["text"] == "call me [PHONE] or write me at [EMAIL]" and out[1]["author"] == "DJ-free [PERSON_NAME]" and out[1]["value"] == "x"
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["author"] == "Dorothy Lebatetralt"
    assert pii.redact(df, private, "comment_id", ["text", "author"]).count() == 5
    assert pii.find_pii(df.limit(0), "comment_id", ["text"]).count() == 0


def test_pairs_farther_apart_than_the_window(spark):
    """Many artists of one title whose names end alike, with a typo at the front of each name, and like titles."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("bcdfgklmnprst", k=7))
    songs = [(i, "Midnight River", f"{word()} {word()}tist".title(), None) for i in range(150)]
    slip = lambda a: f"{a.split()[0]} X{a.split()[1][1:]}"
    videos = [(f"v{i}", f"{slip(a)} - Midnight River", "c", None) for i, _, a, _ in songs] + [(f"w{i}", f"{a} - Midnight Rivre", "c", None) for i, _, a, _ in songs]
    want = {(i, f"{v}{i}") for i in range(150) for v in "vw"}
    assert links(spark, songs, videos, 3) == want


def test_spellings_of_one_artist_are_one_song(spark):
    names_ = ["Robert Cobbler", "Bob Cobbler", "R. Cobbler", "Robert Cobblre", "Rachel Carpenter", "Richard Carpenter", "R. Carpenter"]
    tracks = [(i, "Red River", a, None) for i, a in enumerate(names_)] + [(9, "Blue River", "Bob Cobbler", None)]
    videos = [("a", "Robert Cobbler - Red River", "c", None), ("b", "Richard Carpenter - Red River", "c", None), ("c", "Red River", "x", " ".join(f"Music: Person Number{x}." for x in "abcdef") + " Sung by Rachel Carpenter.")]
    assert links(spark, tracks, videos) == {(0, "a"), (1, "a"), (2, "a"), (3, "a"), (5, "b"), (4, "c")}


def test_songs_compete_for_recordings(spark):
    """Uploads that name only "Cobbler" fit both songs; one song has its own recording already, so the other gets them."""
    tracks = [(1, "Red River", "Robert Cobbler", "F"), (2, "Red River", "Ann Cobbler", "F")]
    videos = [("a", "Robert Cobbler - Red River", "c", None), ("b", "Red River", "Cobbler", None), ("d", "Red River", "Cobbler - Topic", None), ("e", "Robert Cobbler - Red River - Live in Rome", "c", None)]
    assert links(spark, tracks, videos) == {(1, "a"), (1, "e"), (2, "b"), (2, "d")}


def test_private_people_with_the_initial_of_a_public_one(spark):
    found = [(1, "Peter Smith"), (2, "Paul Smith"), (3, "P. Smith"), (4, "Bob Jones"), (5, "Rachel Jones"), (6, "Carl Bell"), (7, "Dora Bell"), (8, "C. Bell")]
    f = spark.createDataFrame([(i, "text", "person_name", v) for i, v in found], "comment_id long, field string, pii_type string, value string")
    public = spark.createDataFrame([("Paul Smith",), ("Robert Jones",), ("C. Bell",), (None,)], "name string")
    assert sorted(r["value"] for r in pii.private_pii(f, public, "name").collect()) == ["Dora Bell", "Peter Smith", "Rachel Jones"]
