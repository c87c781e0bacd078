import pytest

from tripleforge.operators import comparison, patterns, statistics
from tripleforge.operators.store import COLUMNS, canonical_id
from tripleforge.plans import sparql
from tripleforge.sources.turtle import turtle_triples

DATA = """@prefix e: <http://e/> . @prefix schema: <http://schema.org/> .
e:a e:knows e:b, e:c ; e:age 30 ; e:name "Ann" . e:b e:knows e:c ; e:name "Bob" ; e:age 9 . e:c e:knows e:a ; e:name "Cy" . e:d e:name "Dee" ; e:mail "d@e" ."""


@pytest.fixture(scope="module")
def graph(spark):
    return turtle_triples(spark.createDataFrame([("g", DATA)], "id string, t string"), "id", "t").select(*COLUMNS)


def run(graph, text, *columns):
    out = sparql.select(graph, "PREFIX e: <http://e/>\n" + text)
    return sorted(tuple(str(r[c]).replace("http://e/", "") if r[c] is not None else None for c in columns or out.columns[1:]) for r in out.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?n WHERE { ?x e:knows e:c ; e:name ?n }", [("Ann",), ("Bob",)]),
        ("SELECT ?n ?a WHERE { ?x e:name ?n OPTIONAL { ?x e:age ?a } FILTER(!BOUND(?a) || ?a > 10) }", [("Ann", "30"), ("Cy", None), ("Dee", None)]),
        ("SELECT ?n WHERE { ?x e:name ?n MINUS { ?x e:knows ?y } }", [("Dee",)]),
        ("SELECT ?n WHERE { ?x e:name ?n MINUS { ?u e:mail ?v } }", [("Ann",), ("Bob",), ("Cy",), ("Dee",)]),
        ("SELECT ?n WHERE { { ?x e:age ?a } UNION { ?x e:mail ?m } ?x e:name ?n }", [("Ann",), ("Bob",), ("Dee",)]),
        ("SELECT ?y WHERE { e:a e:knows+ ?y }", [("a",), ("b",), ("c",)]),
        ("SELECT ?y WHERE { e:d e:knows* ?y }", []),
        ("SELECT ?y WHERE { e:a e:knows/e:knows ?y }", [("a",), ("c",)]),
        ("SELECT ?y WHERE { e:a (e:age|e:name) ?y }", [("30",), ("Ann",)]),
        ("SELECT ?y WHERE { e:c ^e:knows ?y }", [("a",), ("b",)]),
        ("SELECT ?y WHERE { e:b e:knows? ?y }", [("b",), ("c",)]),
        ("SELECT (COUNT(*) AS ?k) (AVG(?a) AS ?m) WHERE { ?x e:age ?a }", [("2.0", "19.5")]),
        ("SELECT ?x (COUNT(?y) AS ?k) WHERE { ?x e:knows ?y } GROUP BY ?x HAVING(COUNT(?y) > 1)", [("a", "2.0")]),
        ("SELECT ?n WHERE { ?x e:name ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1", [("Bob",), ("Cy",)]),
        ("SELECT ?a WHERE { ?x e:age ?a } ORDER BY ?a LIMIT 1", [("9",)]),
        ('SELECT ?n WHERE { VALUES ?n { "Ann" "Zed" } ?x e:name ?n }', [("Ann",)]),
        ("SELECT ?d WHERE { ?x e:age ?a BIND(?a * 2 + 1 AS ?d) }", [("19.0",), ("61.0",)]),
        ('SELECT ?n WHERE { ?x e:name ?n FILTER(REGEX(?n, "^[ab]", "i") && STRLEN(?n) = 3) }', [("Ann",), ("Bob",)]),
        ("SELECT ?n WHERE { ?x e:name ?n FILTER NOT EXISTS { ?x e:age ?a } }", [("Cy",), ("Dee",)]),
        ('SELECT (GROUP_CONCAT(?n; SEPARATOR = "+") AS ?all) WHERE { ?x e:name ?n ; e:age ?a }', [("Ann+Bob",)]),
        ("SELECT DISTINCT ?p WHERE { ?s ?p ?o FILTER(?p IN (e:age, e:mail)) }", [("age",), ("mail",)]),
        ("SELECT ?n WHERE { ?x e:name ?n ; e:age ?a FILTER(?n > 5) }", []),
    ],
)
def test_sparql(graph, text, want):
    assert run(graph, text) == want


@pytest.mark.parametrize("text", ["ASK { ?s ?p ?o }", "SELECT ?x WHERE { SERVICE <http://x> { ?x ?p ?o } }", "SELECT ?x WHERE { ?x ?p ?o", "SELECT (FROB(?x) AS ?y) WHERE { ?x ?p ?o }"])
def test_unsupported(graph, text):
    with pytest.raises(sparql.SparqlError):
        sparql.select(graph, text)


def test_chained_optionals_are_compatible_when_unbound(graph):
    text = "SELECT ?x ?v WHERE { ?x e:name ?n OPTIONAL { ?x e:mail ?v } OPTIONAL { ?x e:age ?v } }"
    assert run(graph, text) == [("a", "30"), ("b", "9"), ("c", None), ("d", "d@e")]


def test_query_file_keeps_closing_clauses():
    found = sparql.load_queries("PREFIX e: <http://e/>\n# Q1: one\nSELECT ?x WHERE { ?x ?p ?o } LIMIT 3\n# Q2: two\nSELECT ?y WHERE { ?y ?p ?o }\n")
    assert list(found) == ["Q1", "Q2"] and "LIMIT 3" in found["Q1"] and "PREFIX" in found["Q2"]


def test_coverage_counts_unreadable_graphs(spark, graph):
    graphs = spark.createDataFrame([("g",), ("h",), ("bad",)], "g string")
    out = sparql.coverage(graph, {"Q2": "SELECT ?x WHERE { ?x ?p ?o }", "Q1": 'SELECT ?x WHERE { ?x ?p "zz" }'}, graphs, spark.createDataFrame([("bad",)], "g string"))
    assert [tuple(r)[:4] for r in out.collect()] == [("Q2", 1, 1, 1), ("Q1", 0, 2, 1)]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("h", "b", "c")], "g string, a string, b string")
    assert sorted(map(tuple, patterns.closure(edges).collect())) == [("g", "a", "a"), ("g", "a", "b"), ("g", "b", "a"), ("g", "b", "b"), ("h", "b", "c")]


def test_comparison(spark):
    one, two = DATA + ' e:a e:p [ e:q "1"^^<http://www.w3.org/2001/XMLSchema#decimal> ] .', DATA.replace("e:", "f:").replace("@prefix f:", "@prefix f:") + ' f:a f:p [ f:q "1.0"^^<http://www.w3.org/2001/XMLSchema#decimal> ] .'
    read = lambda t: comparison.normalised(turtle_triples(spark.createDataFrame([("g", t)], "id string, t string"), "id", "t"))
    assert comparison.difference(read(one), read(two)).count() == 0
    row = comparison.agreement(read(one), read("")).first()
    assert (row["n_tested"], row["precision"], row["recall"], row["f1"]) == (0, 0.0, 0.0, 0.0)


def test_canonical_ids(spark):
    iris = ["https://x/title/tt1", "https://x/title/tt1/", "https://x/name/nm2?q#f", "https://x/other/9", None]
    df = spark.createDataFrame([(i,) for i in iris], "i string")
    assert [r[0] for r in df.select(canonical_id(df.i)).collect()] == ["tt1", "tt1", "nm2", "https://x/other/9", None]


def test_first_names(spark):
    df = spark.createDataFrame([("k", f"n{i:02d}") for i in range(12)] + [("j", "x"), ("j", None)], "k string, n string")
    out = {r["k"]: r["names"] for r in statistics.first_names(df, ["k"], "n").collect()}
    assert out["j"] == "x" and out["k"].endswith("n09...")


def test_main_entities_and_injection(spark):
    from tripleforge.operators import media

    text = """@prefix schema: <http://schema.org/> .
<http://m> schema:actor <http://p/nm1>, <http://p/nm2> ; schema:audio [ a schema:MusicRecording ; schema:name " Red \\"River\\"" ; schema:recordingOf [ schema:author <http://p/nm2> ] ] , <http://r2> .
<http://r2> a schema:MusicRecording ; schema:name "Blue" ; schema:url "old" ; schema:byArtist <http://p/nm1> .
<http://p/nm1> schema:name "Ann Bell" . <http://i> schema:caption "Ann Bell and others" ."""
    triples = turtle_triples(spark.createDataFrame([("g", text)], "id string, t string"), "id", "t").select(*COLUMNS)
    assert [tuple(r) for r in media.main_entities(triples).select("image", "person").collect()] == [("http://i", "http://p/nm1")]
    links = spark.createDataFrame([("g", 'red "river"', "u1", 1), ("g", 'RED "RIVER" ', "u2", 2), ("g", "blue", "u3", 1), ("g", "none", "u4", 1), ("h", "blue", "u5", 1)], "g string, title string, url string, pos int")
    done, lost = media.inject_urls(triples, links)
    assert sorted(r["o"] for r in done.where("p = 'http://schema.org/url'").collect()) == ["old", "u2"]
    assert sorted(r["url"] for r in lost.collect()) == ["u4", "u5"]
    records = {r["title"]: r for r in media.soundtrack_records(triples).collect()}
    assert records["Blue"]["performer"] == "Ann Bell" and records[' Red "River"']["composer"] == "nm2"


_AFTER = "WHERE { ?x e:name ?n OPTIONAL { ?x e:age ?a . ?x e:knows ?y } ?s e:knows ?y . ?s e:name ?m } GROUP BY ?x"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"SELECT ?x (COUNT(?s) AS ?k) (COUNT(*) AS ?all) {_AFTER}", [("a", "3.0", "3.0"), ("b", "2.0", "2.0"), ("c", "4.0", "4.0"), ("d", "4.0", "4.0")]),
        (f"SELECT ?x (COUNT(?a) AS ?k) (MAX(?y) AS ?most) {_AFTER}", [("a", "3.0", "c"), ("b", "2.0", "c"), ("c", "0.0", "c"), ("d", "0.0", "c")]),
        (f"SELECT ?x (COUNT(DISTINCT ?s) AS ?k) {_AFTER} HAVING(COUNT(?m) > 2)", [("a", "2.0"), ("c", "3.0"), ("d", "3.0")]),
        (f"SELECT ?x (GROUP_CONCAT(?m; SEPARATOR = '+') AS ?k) {_AFTER}", [("a", "Ann+Ann+Bob"), ("b", "Ann+Bob"), ("c", "Ann+Ann+Bob+Cy"), ("d", "Ann+Ann+Bob+Cy")]),
        ("SELECT ?x ?m WHERE { ?x e:name ?n OPTIONAL { ?x e:mail ?v } ?s e:name ?m . ?s e:mail ?v }", [("a", "Dee"), ("b", "Dee"), ("c", "Dee"), ("d", "Dee")]),
    ],
)
def test_patterns_after_unbound_variables(graph, text, want):
    assert run(graph, text) == want


def test_counting_joins_no_more_rows_than_groups(spark, tmp_path, monkeypatch):
    from tripleforge.operators import patterns as algebra
    from tripleforge.plans import graph_queries

    customers = [(i, f"c{i}", i % 3, 9995.0 if i % 20 == 0 else 5.0, "BUILDING" if i % 2 == 0 else "OTHER") for i in range(80)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"s{i}", i % 3, 1.0) for i in range(60)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    made, join = [], algebra.join
    monkeypatch.setattr(algebra, "join", lambda *args, **more: made.append(join(*args, **more)) or made[-1])
    got = sorted(map(tuple, graph_queries.bgp_optional_then_join(spark, str(tmp_path)).collect()))
    assert got == sorted((i, n, 20) for i in range(0, 80, 2) for n in range(3) if i % 20 or n == i % 3)
    # one row per customer of any segment and nation; each customer with each party would be 80 * 140
    assert max(df.count() for df in made) <= 80 * 3
