"""Benchmark decontamination against a brute-force search of maximal matches."""

import random
import re

import pyarrow as pa

from veilframe.llm import decontaminate as D

DOCS = "doc_id long, text string, n_chars long, item_ids string, b int"


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(docs, items):
    """{document: {(first word, end word, item)}}: every alignment of a document with an item that agrees on enough words."""
    out = {}
    for d, text in docs:
        w, found = words(text), set()
        for item, it in items:
            v = words(it)
            need = len(v) if len(v) < 4 else max(4, -(-len(v) // 2))
            for shift in range(-len(v), len(w)):
                n = 0
                for k in range(len(v) + 1):
                    if k < len(v) and 0 <= shift + k < len(w) and w[shift + k] == v[k]:
                        n += 1
                        continue
                    if n >= min(8, need) and n:
                        found.add((shift + k - n, shift + k, item))
                    n = 0
        out[d] = found
    return out


def check(got, docs, items):
    """Every aligned match lies in a reported span that names its item; every span is such a match."""
    want = brute(docs, items)
    for d, _ in docs:
        spans = [(a, b, ids) for e, a, b, ids in got if e == d]
        for a, b, item in want[d]:
            assert any(x <= a and b <= y and item in ids for x, y, ids in spans), (d, a, b, item)
        assert {x[:2] for x in spans} <= {x[:2] for x in want[d]}


def test_equals_brute_force():
    r = random.Random(5)
    vocab = ["red", "blue", "tree", "sky", "Äpfel", "one", "two", "three"]
    items = [(k, " ".join(r.choices(vocab, k=n))) for k, n in enumerate([3, 5, 9, 14, 30, 30])]
    docs = []
    for d in range(60):
        w = r.choices([*vocab, "zzz", "qqq"], k=r.randint(0, 25))
        it = r.choice(items)[1].split()
        a = r.randint(0, len(it) - 1)
        docs.append((d, " ".join(w + it[a : a + r.randint(1, 20)] + r.choices(vocab, k=5))))
    index = D.build([k for k, _ in items], pa.array([t for _, t in items]))
    w = D.W.tokenize(pa.array([t for _, t in docs]))
    got = [(d, a - int(w.first[d]), b - int(w.first[d]), ids) for d, a, b, _, ids in D.find(index, w)]
    assert len(got) > 20
    check(got, docs, items)


def test_spans_are_cut_and_clean_text_stays(spark):
    passage = "Where did the quick Brown fox, jump over a very lazy dog today"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, "no id at all here")], "item_id long, text string")
    clean = "Äußerst sauber: the quick fox did something else entirely."
    docs = spark.createDataFrame([(1, f"Before. {passage.upper()}! After."), (2, clean), (3, None), (4, ""), (None, f"x {passage} y"), (1, clean), (5, "the quick brown fox jump over a very lazy dog")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "cast(length(text) as long) n_chars", "'x' item_ids", "1 b")
    out = D.remove_leaks(docs, items)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert len(rows) == 7
    assert {(x.doc_id, x.text) for x in rows} == {(1, "Before. ! After."), (2, clean), (3, None), (4, ""), (None, "x  y"), (1, clean), (5, "the quick brown fox ")} or {x.text for x in rows if x.doc_id == 1} == {"Before. ! After.", clean}
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in rows)
    found = D.leaks(docs, items).collect()
    hit = next(x for x in found if x.doc_id == 1)
    assert (hit.n_words, hit.coverage, hit.item_ids) == (13, 1.0, [1])
    assert not [x for x in found if x.doc_id in (2, 3, 4)]
    assert len([x for x in found if x.doc_id is None]) == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.remove_leaks(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b c", 5, "", 1)], DOCS)
    assert D.remove_leaks(one, items).first().text == "a b c"
    assert D.leaks(one, items).count() == 0


def test_shards_change_nothing(spark, monkeypatch):
    r = random.Random(2)
    items = [" ".join(r.choices("abcdef", k=20)) for _ in range(12)] + ["a1 a2 a3 a4 a5 a6 a7 a8 x9", "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"]
    items += ["alpha bravo charlie delta echo foxtrot " + " ".join(f"n{k}" for k in range(14)), "charlie delta echo foxtrot"]
    texts = [f"x {t} y" for t in items] + ["a1 a2 a3 a4 a5 a6 a7 a8 a9 a10", "zz bravo charlie delta echo foxtrot zz", None, "", "long " * 200_000 + items[0]]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k if k % 5 else None, t, 1, "", 2, 3, "r") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, item_ids string, hits int, row int, found string")
    key = lambda x: str(tuple(x))
    one = sorted(D.leaks(docs, bench).collect(), key=key), sorted(D.remove_leaks(docs, bench).collect(), key=key)
    monkeypatch.setattr(D, "SHARD_CHARS", 150)
    assert len(D.shards(bench)) > 3
    assert (sorted(D.leaks(docs, bench).collect(), key=key), sorted(D.remove_leaks(docs, bench).collect(), key=key)) == one
    assert len(one[1]) == len(texts) and {"zz bravo  zz"} <= {x.text for x in one[1]}


def test_short_item_inside_a_failing_match():
    items = ["p0 p1 a b w1 w2 w3 w4 " + " ".join(f"x{k}" for k in range(12)), "w1 w2 w3 w4", "b w1 w2 w3 z1 z2 z3"]
    docs = pa.array(["q0 a b w1 w2 w3 w4 q1", "q0 w1 w2 w3 w4", "q0 a b w1 w2 w3 q1"])
    w = D.W.tokenize(docs)
    got = {(d, a - int(w.first[d]), b - int(w.first[d]), *ids) for d, a, b, _, ids in D.find(D.build(range(3), pa.array(items)), w)}
    assert got == {(0, 3, 7, 1), (0, 2, 6, 2), (1, 1, 5, 1), (2, 2, 6, 2)}
