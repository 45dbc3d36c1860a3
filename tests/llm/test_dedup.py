"""Both substring dedups against brute force, on texts with many kinds of repeats."""

import random
from collections import defaultdict

import pytest

from veilframe.llm import substring_dedup, suffix_dedup


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5)))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 60, 130, 420)]
    docs = {}
    for i in range(36):
        words = fresh(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, 5)
            words += p[a : len(p) - r.randint(0, 5)] + fresh(r.randint(0, 30))
        docs[i] = words
    docs[50] = docs[51] = fresh(300)
    docs[52] = docs[50][:120] + ["x"] + docs[50][121:]
    docs[53] = ["same"] * 140
    docs[54] = ["same"] * 60
    docs[55] = fresh(30) * 8
    docs[56] = []
    docs[57] = fresh(49)
    docs[58] = list(docs[57])
    return {i: " ".join(w) for i, w in docs.items()}


def brute(texts, least=50):
    places = defaultdict(list)
    for i in sorted(texts):
        words = (texts[i] or "").lower().split()
        for k in range(len(words) - least + 1):
            places[tuple(words[k : k + least])].append((i, k))
    flag = {p: k == 0 for ps in places.values() if len(ps) > 1 for k, p in enumerate(sorted(ps))}
    out, run = set(), None
    for i, k in sorted(flag):
        if run and run[0] == i and run[2] == k and run[3] == flag[i, k]:
            run[2] = k + 1
            continue
        if run:
            out.add((run[0], run[1], run[2] + least - 1, run[3]))
        run = [i, k, k + 1, flag[i, k]]
    if run:
        out.add((run[0], run[1], run[2] + least - 1, run[3]))
    return out


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup], ids=["doubling", "suffix array"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, operator, seed):
    texts = corpus(seed)
    rows = [*texts.items(), (60, None), (61, ""), (None, texts[50]), (50, texts[50])]
    got = operator.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.start_word, x.end_word, x.first) for x in got}
    assert len(found) == len(got)
    assert found == brute(texts)
    assert all(x.n_words == x.end_word - x.start_word >= 50 for x in got)


def longest(texts, start, end, doc):
    """The greatest 50 * 2^k for which some window of that length that repeats holds a 50-word window of the stretch."""
    split = {i: t.lower().split() for i, t in texts.items()}
    best, size = 50, 100
    while True:
        places = defaultdict(list)
        for i, w in split.items():
            for k in range(len(w) - size + 1):
                places[tuple(w[k : k + size])].append((i, k))
        again = {p for ps in places.values() if len(ps) > 1 for p in ps}
        if not again:
            return best
        if any((doc, q) in again for q in range(max(0, start - size + 50), end - 49)):
            best = size
        size *= 2


@pytest.mark.parametrize("seed", [3, 4])
def test_longest_equals_brute_force(spark, seed):
    texts = corpus(seed)
    r = random.Random(seed)
    # a passage that two documents share, whose surroundings are shared with others
    words = [f"p{i}" for i in range(700)]
    for i in range(70, 82):
        a = r.randint(0, 400)
        texts[i] = " ".join([f"q{r.randint(0, 10**9)}" for _ in range(r.randint(0, 30))] + words[a : a + r.randint(60, 300)])
    got = substring_dedup.repeats(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert len({x.longest for x in got}) > 2
    for x in got:
        assert x.longest == longest(texts, x.start_word, x.end_word, x.doc_id), x


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup], ids=["doubling", "suffix array"])
def test_very_long_text(spark, operator):
    r = random.Random(5)
    words = [f"w{r.randint(0, 10**9)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[1000:301_000]))]
    got = {(x.doc_id, x.start_word, x.end_word, x.first) for x in operator.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1000, 301_000, True), (2, 1, 300_001, False)}


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup], ids=["doubling", "suffix array"])
def test_empty_table_and_clashing_columns(spark, operator):
    kind = "doc_id long, text string, b int, h binary, at string, first string, g int"
    assert operator.repeats(spark.createDataFrame([], kind)).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(i, text, 1, b"", "", "", 2) for i in (1, 2)]
    got = operator.repeats(spark.createDataFrame(rows, kind)).collect()
    assert {(x.doc_id, x.start_word, x.end_word, x.first) for x in got} == {(1, 0, 70, True), (2, 0, 70, False)}


def words_of(p, x):
    return tuple(p.word[x : x + 50].tolist())


@pytest.mark.parametrize("seed", range(6))
def test_corpus_order_numbers_equal_windows_equally(seed):
    import numpy as np
    import pyarrow as pa

    texts = corpus(seed)
    docs = pa.table({"b": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(list(texts), pa.int64()), "text": pa.array(list(texts.values()), pa.string())})
    p = suffix_dedup.Parse(docs)
    n = len(p.word) - 49
    x = np.flatnonzero(p.doc[:n] == p.doc[49:])
    lo = np.searchsorted(p.cut, x + suffix_dedup.TRIGGER)
    some = np.searchsorted(p.cut, x + 50, side="right") > lo
    x, owner = x[some], lo[some]
    number = suffix_dedup.corpus_order(p, x, owner)
    pairs = {(words_of(p, a), k) for a, k in zip(x, number.tolist())}
    assert len(pairs) == len({w for w, _ in pairs}) == len({k for _, k in pairs}) > 500
    # within one dictionary suffix the parse suffixes are in the order of their words
    order, shared = suffix_dedup.parse_order(p, np.unique(owner))
    j = np.unique(owner)[order]
    rest = [tuple(p.word[p.cut[k] - 4 : p.right[k]].tolist()) for k in j]
    whole = [r for r in rest if len(r) == 50]
    assert whole == sorted(whole)
    for a, b, k in zip(rest, rest[1:], shared[1:]):
        same = next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        assert k == same
