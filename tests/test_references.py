import datetime as dt
import random

from tripleforge.operators.references import RANGE, encode_keys, orphan_references, orphan_report, referenced_id

REFS = "source_table string, source_id string, target_id string, at timestamp_ntz"
PARENTS = "id string, appeared timestamp_ntz, deleted timestamp_ntz"


def states(spark, refs, parents):
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return {(r["source_table"], r["source_id"], r["target_id"], r["state"]) for r in out.collect()}


def brute(refs, parents):
    born, gone = {}, {}
    for i, a, d in parents:
        if i is not None:
            born.setdefault(i, []).append(a)
            gone.setdefault(i, []).append(d)
    out = set()
    for table, source, target, at in refs:
        if target is None:
            continue
        if target not in born:
            out.add((table, source, target, "missing"))
            continue
        d = min((x for x in gone[target] if x is not None), default=None)
        a = None if None in born[target] else min(born[target])
        if d is not None and at is not None and d <= at:
            out.add((table, source, target, "deleted"))
        elif a is not None and at is not None and a > at:
            out.add((table, source, target, "late"))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    when = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(4_000)) if r.random() < 0.95 else None
    parents = [(f"k{i}", when(), when() if r.random() < 0.3 else None) for i in range(300) for _ in range(r.choice([1, 1, 2]))]
    refs = [(r.choice(["a", "b"]), f"s{r.randrange(200)}", f"k{r.choice([7, r.randrange(340)])}", when()) for _ in range(3_000)] + [("a", "s", None, None)]
    assert states(spark, refs, parents) == brute(refs, parents)


def test_same_instant(spark):
    t = dt.datetime(2024, 5, 5)
    assert states(spark, [("a", "x", "k", t)], [("k", t, None)]) == set()
    assert states(spark, [("a", "x", "k", t)], [("k", None, t)]) == {("a", "x", "k", "deleted")}


def test_empty_tables(spark):
    t = dt.datetime(2024, 1, 1)
    assert states(spark, [], []) == set()
    assert states(spark, [], [("k", t, None)]) == set()
    assert states(spark, [("a", "x", "k", t), ("a", "x", "k", t)], []) == {("a", "x", "k", "missing")}


def test_clashing_columns(spark):
    refs = spark.createDataFrame([("a", "x", "k", None, 1, 2)], REFS + ", code int, period int")
    parents = spark.createDataFrame([("z", None, None, "q")], PARENTS + ", key string")
    assert orphan_references(refs, parents).count() == 1


def test_codes_are_dense(spark):
    codes = encode_keys(spark.range(RANGE + 100).selectExpr("concat('tt', id)"), spark.range(10).selectExpr("concat('tt', id)"))
    assert sorted(r["code"] for r in codes.collect()) == list(range(RANGE + 100))


def test_report(spark):
    t = dt.datetime(2024, 3, 9)
    out = orphan_references(spark.createDataFrame([("a", "x", "k", t), ("a", "y", "k", t)], REFS), spark.createDataFrame([], PARENTS))
    row = orphan_report(out).first()
    assert (row["period"], row["n_references"], row["n_targets"]) == (dt.date(2024, 3, 1), 2, 1)


def test_ids_in_iris(spark):
    iris = ["https://x.example/title/tt12/", "http://m.x.example/title/tt12?ref_=s_1", "tt12", "https://x.example/title/tt12/fullcredits", "https://x.example/title/", "att12", "", None]
    df = spark.createDataFrame([(i,) for i in iris], "iri string")
    assert [r[0] for r in df.select(referenced_id(df.iri)).collect()] == ["tt12"] * 4 + [None] * 4
