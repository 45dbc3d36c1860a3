"""Packing: every piece has one place, windows don't overflow or overlap, few are wasted."""

import random

import numpy as np

from veilframe.llm import packing as P

KIND = "doc_id long, text string, n_tokens string, salt int, tie int"


def check(rows, window):
    by = {}
    for x in rows:
        by.setdefault(x.window_id, []).append((x.offset, x.n_tokens))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset >= at
            at = offset + n
        assert at <= window
    return len(by)


def test_every_token_has_one_place(spark):
    r = random.Random(1)
    texts = {i: " ".join(["w"] * r.choice([1, 3, 7, 20, 33, 64, 65, 200, r.randint(1, 90)])) for i in range(700)}
    docs = spark.createDataFrame([(i, t, "", 1, 2) for i, t in texts.items()] + [(9000, None, "", 1, 2), (9001, "", "", 1, 2), (9002, " \n", "", 1, 2), (None, "a b", "", 1, 2), (3, texts[3], "", 1, 2)], KIND)
    rows = P.pack(docs, window=64).collect()
    windows = check(rows, 64)
    got = {}
    for x in rows:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.n_tokens
    want = {i: len(t.split()) * (2 if i == 3 else 1) for i, t in texts.items()} | {None: 2}
    assert got == want
    assert len({(x.window_id, x.offset) for x in rows}) == len(rows)
    assert windows <= sum(want.values()) / 64 * 1.08 + 1
    assert sorted(x.window_id for x in rows)[-1] == windows - 1


def test_plan_uses_the_whole_histogram():
    rng = np.random.default_rng(2)
    hist = np.zeros(129, np.int64)
    for n in rng.integers(1, 129, 4000):
        hist[n] += 1
    used = np.zeros_like(hist)
    windows = 0
    for lens, times in P.plan(hist, 128):
        assert sum(lens) <= 128
        windows += times
        for n in lens:
            used[n] += times
    assert (used == hist).all()
    assert windows <= (hist * np.arange(129)).sum() / 128 * 1.06


def test_nnls_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = int(rng.integers(2, 12))
        a = rng.integers(0, 4, (m, int(rng.integers(2, 60)))).astype(float)
        b = rng.integers(0, 500, m).astype(float)
        x = P.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and slope.min() > -1e-4 and np.abs(slope[x > 0]).max(initial=0) < 1e-4


def best(pieces, window):
    """The least number of windows, by trying every way to place each piece."""
    least = len(pieces)

    def place(k, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if k == len(pieces):
            least = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[k]}):
            rest = list(rooms)
            rest.remove(room)
            place(k + 1, [*rest, room - pieces[k]])
        place(k + 1, [*rooms, window - pieces[k]])

    place(0, [])
    return least


def test_query_on_small_tables_is_near_the_optimum(spark):
    r = random.Random(3)
    more = 0
    for _ in range(4):
        sizes = [r.randint(1, 30) for _ in range(11)]
        docs = spark.createDataFrame([(i, " ".join(["w"] * n), "", 1, 2) for i, n in enumerate(sizes)], KIND)
        windows = check(P.pack(docs, window=32).collect(), 32)
        least = best(sorted(sizes, reverse=True), 32)
        assert least <= windows <= least + 1
        more += windows - least
    assert more <= 2


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], KIND)).count() == 0
