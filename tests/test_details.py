import itertools
import random

import pytest
from pyspark.sql import functions as F

from tripleforge.functions import markup, text
from tripleforge.operators import comparison, patterns, profile, statistics
from tripleforge.operators.credits import parse_credit_lines
from tripleforge.operators.store import COLUMNS, lift, read_store, write_store
from tripleforge.plans import sparql
from tripleforge.sources import files


def one(spark, function, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(function(df.v)).collect()]


def test_strict_credit_lines(spark):
    block = "Music by Too Early\nSong One\nby A\nWritten by B (as Bee)\nby C\nMusic by D and E\nPerformed by F & G\nPerformed by H\nincludes 'x' (uncredited) Traditional\nCeline Dion sings\nTraditional\nArranged by Traditional band\n\nPerformed & Produced by I"
    df = spark.createDataFrame([("m", block), ("n", None), ("o", ""), ("p", "Music by only")], "id string, t string")
    rows = {r["title"]: r for r in parse_credit_lines(df, "id", "t").collect()}
    assert set(rows) == {"Song One", "Traditional", "Performed & Produced by I"}
    first = rows["Song One"]
    assert (first["composer"], first["performer"], first["lyrics_by"]) == ("D", "by H", None)
    assert first["additional_info"] == "by C includes 'x' (uncredited) Traditional Celine Dion sings" and first["is_uncredited"] and not first["is_traditional"]
    assert rows["Traditional"]["is_traditional"] and rows["Traditional"]["additional_info"] == "Arranged by Traditional band"
    assert rows["Performed & Produced by I"]["additional_info"] is None


def test_phrases_and_labels(spark):
    assert one(spark, text.credit_phrases, "Music by A; additional vocals by B", None, "") == [["Music by", "vocals by", "additional vocals by", "Music by", " additional vocals by"], None, []]
    assert one(spark, text.label_roles, "Written and Produced by", "Music / Lyrics: x", "By", None) == [["written", "produced"], ["music", "lyrics"], ["by"], None]
    assert one(spark, text.digits, "a1b2", None) == ["12", None] and one(spark, text.unescape, r"\"a\\") == ['"a\\']
    assert one(spark, text.one_line, " a\nb  c ") == ["a b c"]
    labels = spark.createDataFrame([("Rhythm and Blues by",), ("Written and Produced by",), (None,)], "label string")
    known = spark.createDataFrame([("rhythm and blues", "style"), ("written", "composer")], "role string, category string")
    got = {(r["role"], r["category"], r["matched"], r["is_compound"]) for r in profile.label_categories(labels, "label", known).collect()}
    assert got == {("rhythm and blues", "style", True, False), ("written", "composer", True, True), ("produced", None, False, True)}


def test_audio_counts_of_odd_json(spark):
    texts = ['[{"best_match": {"url": "u"}}, {"best_match": {"video_id": "v"}}, {"best_match": {"url": ""}}, {"best_match": null}, 5]', "[]", "{}", "not json", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r[1:] for r in profile.audio_counts(df, "k", "t").orderBy("k").collect()] == [(2, 5), (0, 0), (0, 0), (0, 0), (0, 0), (0, 0)]


def test_headings_and_types(spark):
    page = "<div class='t-title'>The Actor list</div><h3>Actor</h3><h3 class='x title__text'>Actor</h3>"
    assert markup.headings(page, "Actor") == [2] and markup.headings(page.replace("x title__text", "y"), "Actor") == [1, 2]
    assert markup.headings("<div class='t-title'>The Actor list</div>", "Actor") == [0] and markup.headings(None, "Actor") == []
    df = spark.createDataFrame([('{"a": [{"@type": "P"}, {"@type": ["Q", "P"]}, {"@type": "Q"}, 3]}',), ('{"a": {"@type": "P"}}',), ("{}",)], "t string")
    assert [r[0] for r in df.select(F.size(markup.of_type(F.try_parse_json("t"), "$.a", "P"))).collect()] in ([2, 1, -1], [2, 1, None])


def test_joins_with_unbound_variables_against_brute_force(spark):
    r = random.Random(3)
    value = lambda: r.choice([None, "x", "y"])
    a = [("g", value(), r.choice("pq"), i) for i in range(12)]
    b = [("g", value(), r.choice("pq"), i) for i in range(12)]
    left = spark.createDataFrame(a, "g string, v string, k string, i int")
    right = spark.createDataFrame(b, "g string, v string, k string, j int")
    fits = lambda x, y: x[2] == y[2] and (x[1] == y[1] or x[1] is None or y[1] is None)
    pairs = [(x[1] or y[1], x[2], x[3], y[3]) for x, y in itertools.product(a, b) if fits(x, y)]
    got = patterns.join(left, right, {"v"})
    assert sorted((x["v"], x["k"], x["i"], x["j"]) for x in got.collect() if x["v"]) == sorted(p for p in pairs if p[0]) and got.count() == len(pairs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    outer = patterns.optional(left, right, {"v"}).collect()
    assert len(outer) == len(pairs) + sum(not any(fits(x, y) for y in b) for x in a)


@pytest.mark.parametrize("limit", ["TASK_EDGES", "COPIED_EDGES"])
def test_both_ways_of_closure_agree(spark, monkeypatch, limit):
    r = random.Random(1)
    edges = spark.createDataFrame([(g, str(r.randrange(15)), str(r.randrange(15))) for g in "ab" for _ in range(20)], "g string, a string, b string")
    starts = edges.select("g", "a").limit(3)
    small = [{tuple(x) for x in patterns.closure(edges, reflexive, s).collect()} for reflexive in (False, True) for s in (None, starts)]
    monkeypatch.setattr(patterns, limit, 0)
    assert [{tuple(x) for x in patterns.closure(edges, reflexive, s).collect()} for reflexive in (False, True) for s in (None, starts)] == small


def test_lift_reads_only_what_a_pattern_needs(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b", ["x", None]), (2, None, "c", None)], "k int, n string, m string, l array<string>").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    t = lift(df, F.lit("all"), F.col("k"), {"e:n": "n", "e:m": "m", "e:l": "l"}, "e:T")
    assert sorted((x["s"], x["p"], x["o"]) for x in t.where("p <> 'x'").collect() if x["p"].startswith("e:")) == [("1", "e:l", "x"), ("1", "e:m", "b"), ("1", "e:n", "a"), ("2", "e:m", "c")]
    plan = patterns.scan(t, "?s", "e:n", "?o", unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:int,n:string>" in plan and "Union" not in plan and "Exchange" not in plan
    grouped = lift(df.groupBy("k").agg(F.max("n").alias("n")), F.lit("all"), F.col("k"), {"e:n": "n"})
    assert [(x["s"], x["o"]) for x in grouped.collect()] == [("1", "a")]
    write_store(t, str(tmp_path / "store"))
    assert read_store(spark, str(tmp_path / "store")).count() == t.count() and read_store(spark, str(tmp_path / "store")).columns == COLUMNS


def test_queries_in_queries(spark):
    t = lift(spark.createDataFrame([("1", "a-x", 3), ("2", "a-y", 5), ("3", "b-z", 7)], "k string, n string, v int"), F.lit("all"), F.col("k"), {"e:n": "n", "e:v": "v"})
    text_ = "SELECT ?g ?m WHERE { { SELECT ?g (MAX(?v) AS ?m) WHERE { ?s <e:n> ?n ; <e:v> ?v } GROUP BY (STRBEFORE(?n, '-') AS ?g) } FILTER(?m > 5) }"
    assert [(r["g_"], float(r["m"])) for r in sparql.select(t, text_).collect()] == [("b", 7.0)]
    assert {r["c"] for r in sparql.select(t, "SELECT (SUBSTR(?n, 3) AS ?c) WHERE { ?s <e:n> ?n }").collect()} == {"x", "y", "z"}


def test_originals_and_firsts(spark):
    t = lift(spark.createDataFrame([("1", "1.50"), ("1", "1.5")], "k string, v string"), F.lit("all"), F.col("k"), {"e:v": F.col("v").cast("decimal(9,2)")}).union(lift(spark.createDataFrame([("1", 1.5)], "k string, v double"), F.lit("all"), F.col("k"), {"e:w": "v"}))
    got = {r["p"]: r["original_o"] for r in comparison.originals(t).collect()}
    assert got == {"e:v": "1.50", "e:w": "1.5"}
    assert comparison.normalised(t).count() == 2 and comparison.grouped_by_subject(comparison.normalised(t)).first()["n"] == 2
    assert statistics.first_object(t, "e:v", True).first()["value"] == "1.50" and statistics.first_object(t, "e:v", False).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# c\n\n a \n")
    assert files.setting_lines(spark, str(tmp_path / "s.txt")) == ["a"]
    with pytest.raises(ValueError, match="no settings"):
        files.setting_lines(spark, str(tmp_path / "none.txt"))


def test_kinds_datatypes_and_languages(spark):
    rows = [("all", "a", "I", "e:l", "Haus", "L", None, "de"), ("all", "a", "I", "e:l", "house", "L", None, "en-GB"), ("all", "a", "I", "e:v", "5", "L", "http://www.w3.org/2001/XMLSchema#integer", None), ("all", "a", "I", "e:v", "5", "L", "http://www.w3.org/2001/XMLSchema#string", None), ("all", "a", "I", "e:o", "b", "I", None, None), ("all", "a", "I", "e:o", "n", "B", None, None)]
    t = spark.createDataFrame(rows, "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")
    ask = lambda q: sorted(tuple(r)[1:] for r in sparql.select(t, q).collect())
    assert ask('SELECT ?x WHERE { ?s <e:l> ?x FILTER(LANG(?x) = "de") }') == [("Haus",)]
    assert ask('SELECT ?x WHERE { ?s <e:l> ?x FILTER(LANGMATCHES(LANG(?x), "en")) }') == [("house",)]
    assert ask("SELECT ?p ?x WHERE { ?s ?p ?x FILTER(isIRI(?x)) }") == [("e:o", "b")]
    assert ask("SELECT (DATATYPE(?x) AS ?d) WHERE { ?s <e:v> ?x }") == [("http://www.w3.org/2001/XMLSchema#integer",), ("http://www.w3.org/2001/XMLSchema#string",)]
    assert len(ask('SELECT ?s WHERE { ?s <e:v> "5"^^xsd:integer }')) == 1 and len(ask('SELECT ?s WHERE { ?s <e:l> "Haus"@de }')) == 1 and ask('SELECT ?s WHERE { ?s <e:l> "Haus"@en }') == []
    assert ask("SELECT ?s WHERE { ?s <e:o> ?x OPTIONAL { ?s <e:none> ?y } FILTER(isBlank(?x) && !BOUND(?y)) }") == [("a",)]
