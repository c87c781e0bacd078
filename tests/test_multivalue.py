from pyspark.sql import functions as F

from tripleforge.operators.multivalue import delimiter_scores, infer_delimiters, split_values

PLAIN = [f"red {i}; blue sky; green-ish" for i in range(20)]


def values(spark, packed, source=None):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(packed)], "id long, packed string")
    out = {}
    for r in split_values(df, "packed", source).orderBy("id", "pos").collect():
        out.setdefault(r["id"], []).append((r["pos"], r["value"]))
    return out


def test_positions_and_cleaning(spark):
    got = values(spark, [*PLAIN, ' "a; b" ;c;;\t d ;', 'x\\; y; "say ""hi"""', "“p; q”; r"])
    assert got[20] == [(1, "a; b"), (2, "c"), (3, "d")]
    assert got[21] == [(1, "x; y"), (2, 'say "hi"')]
    assert got[22] == [(1, "p; q"), (2, "r")]


def test_blank_null_lonely_quote_and_repeats(spark):
    got = values(spark, [*PLAIN, None, "", "  ", ";;", 'a "b; c', "same; same"])
    assert not {20, 21, 22, 23} & set(got)
    assert got[24] == [(1, 'a "b'), (2, "c")]
    assert got[25] == [(1, "same"), (2, "same")]


def test_never_separators(spark):
    got = values(spark, [*PLAIN, "rock'n'roll; R&B; double-cross; U.S."])
    assert [v for _, v in got[20]] == ["rock'n'roll", "R&B", "double-cross", "U.S."]


def test_very_long(spark):
    got = values(spark, [*PLAIN, "; ".join(["word"] * 50_000), "x" * 300_000, '"' + "y" * 200_000 + '"; z'])
    assert len(got[20]) == 50_000 and len(got[21]) == 1 and len(got[22]) == 2


def test_sources_have_their_own_delimiters(spark):
    rows = [("a", f"one{i}|two{i}|x,y") for i in range(30)] + [("b", f"one{i},two{i},x") for i in range(30)]
    df = spark.createDataFrame(rows, "src string, packed string")
    found = {r["src"]: r["delimiters"] for r in infer_delimiters(df, "packed", ["src"]).collect()}
    assert "|" in found["a"] and "|" not in found["b"] and "," in found["b"]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id long, packed string")
    assert split_values(empty, "packed").count() == 0
    clash = spark.createDataFrame([(1, "a;b", "old", 9, "k", "d")], "id long, packed string, value string, pos int, delimiters string, _at string")
    rows = split_values(clash, "packed").orderBy("pos").collect()
    assert [(r["pos"], r["value"], r["delimiters"]) for r in rows] == [(1, "a", "k"), (2, "b", "k")]


def test_null_source(spark):
    rows = [(None, "a;b"), (None, "c;d"), ("s", "e;f")]
    df = spark.createDataFrame(rows, "src string, packed string")
    assert split_values(df, "packed", ["src"]).count() == 6


def test_scores_are_bounded(spark):
    df = spark.createDataFrame([(p,) for p in PLAIN], "packed string").withColumn("s", F.lit(1))
    for r in delimiter_scores(df, "packed", ["s"]).collect():
        assert 0 <= r["score"] <= 1


def test_rare_delimiters_separate_where_no_other_does(spark):
    rows = [*PLAIN * 60, "one * two * three", "red *star*; blue"]
    got = values(spark, rows)
    assert [v for _, v in got[1200]] == ["one", "two", "three"] and [v for _, v in got[1201]] == ["red *star*", "blue"]
