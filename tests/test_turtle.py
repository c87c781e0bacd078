import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleforge.operators.compaction import compact_files, equal_graphs, graph_catalogue, graph_classes, merge_graphs, plan_packing
from tripleforge.operators.store import COLUMNS, lift, read_store, write_store
from tripleforge.sources.turtle import XSD, TurtleError, parse_turtle, triple_line, triple_set, turtle_triples

HEAD = "@prefix s: <http://s/> .\n"


def lines(text):
    return triple_set(text)[0]


def test_notation_does_not_matter():
    a = HEAD + '<http://x> a s:Movie ; s:name "A" ; s:n 5, 7.5 , 1e3 ; s:ok true .'
    b = f"# c\r\nPREFIX q: <http://s/>\r\n<http://x> q:ok true ; q:n 1e3, 5 ,7.5;;\r\n q:name '''A'''^^<{XSD}string> ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> q:Movie , q:Movie ; ."
    assert triple_set(a) == triple_set(b) and len(lines(a)) == 6


def test_literals_differ_by_text_type_and_language():
    texts = ['"5"', "5", '"5"@en', '"5"^^s:t', "5.0", '"5.0"']
    assert len({lines(f"{HEAD}<http://x> s:p {t} .")[0] for t in texts}) == len(texts)
    assert lines(f'{HEAD}<http://x> s:p "5"^^<{XSD}integer> .') == lines(f"{HEAD}<http://x> s:p 5 .")


def test_escapes_blank_nodes_lists_base():
    assert "\\n" in lines(HEAD + '<http://x> s:p "a\\nb\\u00e9" .')[0] and "é" in lines(HEAD + '<http://x> s:p "a\\nb\\u00e9" .')[0]
    assert len(parse_turtle(HEAD + '<http://x> s:p [ s:q "1" ; s:r [] ; ] , ( 1 2 ) .')) == 8
    assert parse_turtle("@base <http://b/> . <x> <p> <y> .")[0][0][1] == "http://b/x"
    assert parse_turtle(HEAD + "_:a s:p _:a .")[0][0] == parse_turtle(HEAD + "_:a s:p _:a .")[0][2]


@pytest.mark.parametrize("text", ["<http://x> <http://p>", "q:a q:b q:c .", '<http://x> <http://p> "open .', "<http://x> <http://p> 1 . ; <http://q> 2 .", "<http://a b> <http://p> 1 ."])
def test_errors(text):
    with pytest.raises(TurtleError):
        parse_turtle(text)


def test_permissive_and_empty():
    assert len(parse_turtle("<http://a b> <http://p> 1 .", permissive=True)) == 1
    assert triple_set(None) == ([], None) and triple_set("# nothing\n") == ([], None)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.sampled_from([XSD + "string", XSD + "date", "http://t"]))
def test_round_trip(text, datatype):
    triple = (("I", "http://x", None, None), "http://p", ("L", text, datatype, None))
    assert parse_turtle(triple_line(triple)) == [triple]


def test_scan_reports_errors(spark):
    df = spark.createDataFrame([("a", HEAD + "<http://x> s:p [ s:q 1 ] ."), ("b", "nonsense"), ("c", None)], "id string, content string")
    rows = turtle_triples(df, "id", "content").collect()
    assert len([r for r in rows if r["g"] == "a"]) == 2
    assert [r["error"] is not None for r in rows if r["g"] == "b"] == [True]
    assert all(r["s"].startswith("a#") for r in rows if r["s_kind"] == "B")


def test_catalogue_and_merge(spark, tmp_path):
    one, two = HEAD + '<http://x> s:p "1" , "2" .', HEAD + '<http://x> s:p "2" ; s:p "1" .'
    files = [(1, "p", one), (2, "p", two), (3, "q", HEAD + '<http://x> s:p "2" .'), (4, "q", ""), (5, None, None), (6, "r", "broken"), (7, "r", one + "\n" + '<http://y> s:p "' + "z" * 200_000 + '" .')]
    df = spark.createDataFrame(files, "file_id long, path string, content string")
    catalogue = graph_catalogue(spark, df)
    assert catalogue.count() == 7
    assert [tuple(r) for r in equal_graphs(catalogue).collect()] == [(1, 2)]
    report = merge_graphs(catalogue, f"file://{tmp_path}/merged").first()
    assert (report["n_files"], report["n_invalid"], report["n_triples_out"]) == (7, 1, 3)
    assert spark.read.parquet(f"file://{tmp_path}/merged").count() == 3


def test_catalogue_of_nothing(spark):
    empty = spark.createDataFrame([], "file_id long, path string, content string")
    assert equal_graphs(graph_catalogue(spark, empty)).count() == 0


def test_compaction_keeps_every_row(spark, tmp_path):
    source = f"file://{tmp_path}/tiny"
    spark.range(500).selectExpr("id", "id % 7 as k", "map('a', id) as m").union(spark.range(3).selectExpr("id", "id % 7", "map('a', id)")).repartition(60).write.parquet(source)
    done = compact_files(spark, source, f"file://{tmp_path}/large")
    out = spark.read.parquet(f"file://{tmp_path}/large")
    assert done["rows"] == out.count() == 503 and len(out.inputFiles()) == 1
    with pytest.raises(RuntimeError):
        compact_files(spark, source, f"file://{tmp_path}/large")


def test_packing_plan():
    tiny, large = plan_packing(1_000_000, 10**9, 8), plan_packing(10, 10**12, 8)
    assert tiny.open_cost < 10_000 and tiny.output_files == 8
    assert large.split_bytes == 128 << 20 and large.open_cost == 4 << 20


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", None]), (2, None, None)], "id long, name string, tags array<string>")
    triples = lift(df, df.id, df.id, {"schema:name": "name", "schema:tag": "tags"}, "schema:Thing")
    write_store(triples, f"{tmp_path}/store")
    back = read_store(spark, f"{tmp_path}/store")
    assert back.columns == COLUMNS and sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, triples.collect()), key=repr)
    assert triples.count() == 4


def test_thousands_of_files_come_out_as_many_as_their_bytes_need(spark, tmp_path):
    """Number of files by bytes only, whatever the number of files and cores is; rows and their hash stay."""
    source = tmp_path / "tiny"
    source.mkdir()
    for i in range(3_000):
        (source / f"{i:05d}.txt").write_text("\n".join(f"{i} {j} " + "x" * 200 for j in range(5)))
    done = compact_files(spark, f"file://{source}", f"file://{tmp_path}/few", target_bytes=1 << 20, file_format="text")
    wanted = -(-sum(f.stat().st_size for f in source.iterdir()) // (1 << 20))
    assert done["rows"] == 15_000 and done["output_files"] == wanted
    assert len([x for x in (tmp_path / "few").iterdir() if x.name.startswith("part-")]) == wanted
    assert spark.read.parquet(f"file://{tmp_path}/few").exceptAll(spark.read.text(f"file://{source}")).isEmpty()


def test_classes_of_equal_graphs(spark):
    files = spark.createDataFrame([(1, "p", "<a> <b> 1 ."), (2, "p", "<a> <b> 1, 1 ."), (3, "q", "# nothing"), (4, "q", "<a> <b> 2 ."), (5, "r", None)], "file_id long, path string, content string")
    assert sorted(map(tuple, graph_classes(graph_catalogue(spark, files)).collect())) == [(1, 1, 2), (2, 1, 2), (4, 4, 1)]
