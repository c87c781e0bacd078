import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleforge.llm import leakage, packing
from tripleforge.llm import shared_spans as shared_spans_module
from tripleforge.llm.hashing import Rolling, code_points, sliding_min, winnow
from tripleforge.llm.shared_spans import shared_shares, shared_spans

WORDS = [f"w{i}" for i in range(400)]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 20))
def test_sliding_min(values, width):
    x = np.array(values, dtype=np.uint64)
    assert sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_hashes_do_not_depend_on_place():
    a, b = code_points("xyz" + "é😀abc" * 30), code_points("é😀abc" * 30)
    assert (Rolling(1).windows(a, 40)[3:] == Rolling(1).windows(b, 40)).all()
    assert len(Rolling(1).windows(b[:10], 40)) == 0


def test_winnow_chooses_in_every_window():
    h = Rolling(1).windows(code_points(prose(random.Random(1), 300)), 20)
    at = winnow(h, 30)
    assert np.diff(at).max() <= 30 and len(at) < len(h) / 5
    assert len(winnow(np.zeros(50, dtype=np.uint64), 30)) == 50


def brute_spans(docs, span):
    owners = {}
    for k, (_, t) in enumerate(docs):
        for p in range(len(t or "") - span + 1):
            owners.setdefault(t[p : p + span], set()).add(k)
    out = []
    for doc, t in docs:
        runs = []
        for p in range(len(t or "") - span + 1):
            if len(owners[t[p : p + span]]) > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + span
                else:
                    runs.append([p, p + span])
        out += [(doc, a, b) for a, b in runs]
    return sorted(out)


def found_spans(spark, docs, span=60, gram=20):
    df = spark.createDataFrame(docs, "doc_id long, body string")
    return sorted((r["doc_id"], r["start_pos"], r["end_pos"]) for r in shared_spans(df, "doc_id", "body", span, gram).collect())


def test_spans_against_brute_force(spark):
    r = random.Random(3)
    passages = [prose(r, 40) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [prose(r, 25)]
        for _ in range(r.choice([0, 1, 1, 2])):
            p = r.choice(passages)
            a = r.randrange(60)
            parts += [p[a : a + r.randrange(40, 160)], prose(r, 12)]
        docs.append((i, "é😀".join(parts)))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, None), (103, ""), (104, "short"), (105, "a" * 500), (106, "b" + "a" * 90)]
    assert found_spans(spark, docs) == brute_spans(docs, 60)


def test_spans_of_a_passage_most_texts_hold(spark):
    r = random.Random(8)
    hot = prose(r, 60)
    docs = [(i, prose(r, 30) + hot + prose(r, 30)) for i in range(80)]
    got = found_spans(spark, docs)
    assert len(got) == 80 and all(b - a >= len(hot) for _, a, b in got)


def test_spans_with_split_shards_and_regions(spark, monkeypatch):
    """Many parts per shard and many regions per text give the same runs."""
    monkeypatch.setattr(shared_spans_module, "SHARD_CHARS", 500)
    monkeypatch.setattr(shared_spans_module, "SHARD_PHRASES", 3)
    monkeypatch.setattr(shared_spans_module, "REGION", 64)
    r = random.Random(12)
    hot, docs = prose(r, 60), []
    for i in range(30):
        a = r.randrange(80)
        docs.append((i, prose(r, 10) + hot[a : a + r.randrange(70, 300)] + prose(r, 10)))
    assert found_spans(spark, docs) == brute_spans(docs, 60)


def test_spans_of_odd_tables(spark):
    assert found_spans(spark, []) == []
    df = spark.createDataFrame([(None, "x" * 100, 1, 2), (1, "x" * 100, 1, 2), (1, "x" * 100, 3, 4)], "doc_id long, body string, pos int, doc int")
    rows = shared_spans(df, "doc_id", "body", 60, 20)
    assert sorted(map(tuple, rows.select("doc_id", "start_pos", "end_pos").collect())) == [(1, 0, 100)] * 2
    assert shared_shares(rows.distinct(), "doc_id").first()["share"] == 1.0


def test_very_long_text(spark):
    r = random.Random(5)
    long = prose(r, 40_000)
    docs = [(1, long), (2, prose(r, 50) + long[70_000:70_400])]
    (one,) = [x for x in found_spans(spark, docs, 300, 100) if x[0] == 1]
    assert one[1] <= 70_000 and one[2] >= 70_400


def test_words():
    assert leakage.words_of("Don't STOP_me, É2!") == ["don", "t", "stop", "me", "é2"]
    assert leakage.words_of("İx") == ["i̇x"] and leakage.words_of(None) == leakage.words_of("...") == []


def test_run_and_subsequence():
    a, b = "a b c d e".split(), "x b c e d e".split()
    assert leakage.longest_run(a, b) == 2 and leakage.common_subsequence(a, b) == 4
    assert leakage.longest_run([], b) == 0 and leakage.common_subsequence(a, []) == 0


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, body string, cosine string")
    i = spark.createDataFrame(items, "item_id long, q string")
    return {(r["item_id"], r["doc_id"]): r for r in leakage.leaked_items(d, "doc_id", "body", i, "item_id", "q", **kw).collect()}


def test_leaks_against_brute_force(spark):
    r = random.Random(11)
    items = [(i, prose(r, 25)) for i in range(20)] + [(90, None), (91, ""), (92, "too short"), (0, None)]
    docs, want = [], set()
    for k in range(150):
        words = prose(r, r.randrange(0, 120)).split()
        if k % 3 == 0:
            i = r.randrange(20)
            n = r.randrange(8, 26)
            at = r.randrange(0, 26 - n)
            part = items[i][1].split()[at : at + n]
            place = r.randrange(len(words) + 1)
            words[place:place] = part
        docs.append((k, " ".join(w.upper() if k % 2 else w for w in words), "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, "?!", ""), (None, items[0][1], ""), (903, prose(r, 70_000) + " " + items[4][1] + " " + prose(r, 100), "")]
    for k, text, _ in docs:
        w = leakage.words_of(text)
        for i, q in items:
            v = leakage.words_of(q)
            if k is not None and leakage.longest_run(v, w) >= 12 if len(w) < 1_000 else i == 4:
                want.add((i, k))
    assert {k for k, r_ in leaks(spark, docs, items).items() if r_["kind"] == "verbatim"} == want


def test_rows_do_not_depend_on_blocks_of_items(spark, monkeypatch):
    r = random.Random(4)
    items = [(i, prose(r, 25)) for i in range(12)]
    docs = [(k, f"{prose(r, 30)} {' '.join(items[k % 12][1].split()[3:18])} {prose(r, 30)}", "") for k in range(40)]
    want = leaks(spark, docs, items)
    monkeypatch.setattr(leakage, "QUERY_BLOCK", 7)
    got = leaks(spark, docs, items)
    plain = lambda x: {k: (r_["kind"], r_["run_words"], r_["lcs_words"]) for k, r_ in x.items()}
    assert all(abs(x["cosine"] - want[k]["cosine"]) < 0.01 for k, x in got.items())
    assert plain(got) == plain(want) and {k for k, x in want.items() if x["kind"] == "verbatim"} >= {(k % 12, k) for k in range(40)}


def test_recall_of_rewordings(spark):
    """Items with every sixth word exchanged, so that few long stretches are left, in texts of other words."""
    r = random.Random(6)
    items = [(i, prose(r, 25)) for i in range(60)]
    docs, reworded = [], {}
    for i, text in items:
        words = text.split()
        for j in range(r.randrange(6), len(words), 6):
            words[j] = f"other{r.randrange(50)}"
        reworded[i] = " ".join(words)
        docs += [(i, f"{prose(r, 60)} {reworded[i]} {prose(r, 60)}", ""), (1_000 + i, prose(r, 140), "")]
    found = leaks(spark, docs, items)
    assert sum((i, i) in found for i, _ in items) / len(items) >= 0.9
    assert sum(i != d for i, d in found) <= 2


def test_paraphrase_and_empty(spark):
    item = "which pilot hands ivo the golden ferry before the premiere and how many of the 146 guests notice the promise"
    reworded = "they ask which pilot gives ivo the golden ferry before its premiere and how many of those 146 guests notice a promise made"
    filler = prose(random.Random(2), 60)
    got = leaks(spark, [(1, filler + " " + reworded, ""), (2, filler, "")], [(1, item)], threshold=0.3)
    assert got[1, 1]["kind"] == "paraphrase" and (1, 2) not in got
    assert leaks(spark, [], [(1, item)]) == {} and leaks(spark, [(1, "x", "")], []) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_best_fit(sizes):
    placed, capacities = packing.best_fit(sizes, [16, 32, 64])
    used = {}
    for (b, offset), n in zip(placed, sizes, strict=True):
        assert offset + n <= capacities[b]
        used.setdefault(b, []).append((offset, n))
    for b, parts in used.items():
        total = sum(n for _, n in parts)
        assert capacities[b] == min(c for c in (16, 32, 64) if c >= total)
        at = 0
        for offset, n in sorted(parts):
            assert offset == at or n == 0
            at += n
    costs = [sum(map(packing.sequence_cost, packing.best_fit(sizes, c)[1])) for c in ([16, 32, 64], [64])]
    assert costs[0] <= costs[1]


def test_lengths_compete():
    r = random.Random(2)
    sizes = [r.choice([r.randrange(1, 300), r.randrange(1, 4_096)]) for _ in range(4_000)]
    cost = lambda bins, **kw: sum(packing.sequence_cost(c, **kw) for c in bins)
    (_, many), (_, one) = packing.best_fit(sizes, [512, 1024, 2048, 4096]), packing.best_fit(sizes, [4096])
    assert len(set(many)) > 1 and cost(many) < 0.98 * cost(one) and sum(sizes) / sum(many) > 0.98
    # with a high cost per sequence and none of attention long ones are better
    assert set(packing.best_fit(sizes, [512, 4096], overhead=1e6, attention=0.0)[1]) == {4096}


def test_packing(spark, monkeypatch):
    r = random.Random(1)
    sizes = [r.choice([r.randrange(1, 300), r.randrange(1, 3000)]) for _ in range(3_000)] + [0, 0, 5_000, 4_096]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(9_000, None, "x"), (None, 3, "x")], "doc_id long, n_tokens long, capacity string")
    for shard in (64_000_000, 400_000):
        monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
        rows = packing.pack_documents(df, "doc_id", [512, 1024, 2048]).collect()
        whole = {}
        for x in rows:
            assert x["offset"] + x["n_tokens"] <= x["capacity"]
            whole.setdefault(x["doc_id"], []).append(x)
        assert len(whole) == len(sizes) + 2
        for i, n in enumerate(sizes):
            assert sum(x["n_tokens"] for x in whole[i]) == n and len(whole[i]) == max(1, -(-n // 2048))
        room = {x["sequence_id"]: x["capacity"] for x in rows}
        assert sum(x["n_tokens"] for x in rows) / sum(room.values()) > 0.98
    assert packing.pack_documents(df.limit(0), "doc_id", [512]).count() == 0


def test_token_counts(spark):
    from tripleforge.llm.queries import TOKENIZER

    try:
        encoder = packing.load_tokenizer(TOKENIZER)
    except OSError:
        pytest.skip("no tokenizer here")
    texts = ["Hello there, world!", "", None, "é😀", "<|endoftext|>", "x" * 200_000, "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, "doc_id", "body", TOKENIZER).collect()}
    assert got[0] == len(encoder.encode_ordinary(texts[0])) and got[1] == got[2] == 0 and got[4] == len(encoder.encode_ordinary(texts[4])) and got[5] == len(encoder.encode_ordinary(texts[5])) and got[6] >= 50_000


def test_part_of_a_long_item(spark):
    """A stretch of run words of an item of any length is found."""
    r = random.Random(21)
    items = [(i, prose(r, n)) for i, n in enumerate((40, 120, 300))]
    docs = [(10 * i + k, " ".join([prose(r, 50), *q.split()[at : at + 12], prose(r, 50)]), "") for i, q in items for k, at in enumerate((0, 13, len(q.split()) - 12))]
    want = {(i, 10 * i + k) for i in range(3) for k in range(3)}
    assert {k for k, x in leaks(spark, docs, items).items() if x["kind"] == "verbatim"} >= want
