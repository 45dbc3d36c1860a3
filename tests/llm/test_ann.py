"""Inverted multi-index: recall against exact search, order, cases."""

import numpy as np

from veilframe.llm import ann as A

KIND = "vec_id long, embedding array<float>, label int, i int, j string, v int"


def rows(x, start=0):
    return [(start + k, [float(e) for e in v], 0, 1, "", 2) for k, v in enumerate(x)]


def test_recall_and_distances(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 900)] + rng.normal(scale=0.4, size=(900, 16))).astype(np.float32)
    got = A.neighbours(spark.createDataFrame(rows(x), KIND), k=10, every=1).collect()
    by = {}
    for g in got:
        by.setdefault(g.vec_id, []).append((g.rank, g.neighbor_id, g.distance))
    assert set(by) == set(range(900))
    d = np.sqrt(np.maximum(0, ((x[:, None].astype(float) - x[None]) ** 2).sum(2)))
    np.fill_diagonal(d, np.inf)
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        assert all(abs(d[q, i] - dist) < 1e-3 for _, i, dist in found)
        assert [dist for *_, dist in found] == sorted(dist for *_, dist in found)
        hits += len({i for _, i, _ in found} & set(np.argsort(d[q])[:10].tolist()))
    assert hits / 9000 >= 0.9


def test_cases(spark):
    assert A.neighbours(spark.createDataFrame([], KIND)).count() == 0
    assert A.neighbours(spark.createDataFrame(rows([[1, 2]]), KIND)).count() == 0
    x = [[0, 0, 0, 0], [0, 0, 0, 0], [1, 0, 0, 0], [0, 3, 0, 0]]
    bad = [(10, None, 0, 1, "", 2), (11, [1.0], 0, 1, "", 2), (12, [1.0, None, 0.0, 0.0], 0, 1, "", 2), (13, [float("nan"), 0.0, 0.0, 0.0], 0, 1, "", 2), (None, [0.0, 0.0, 0.0, 0.0], 0, 1, "", 2), (3, [9.0, 9.0, 9.0, 9.0], 0, 1, "", 2)]
    got = {(g.vec_id, g.rank, g.neighbor_id, round(g.distance, 4)) for g in A.neighbours(spark.createDataFrame(rows(x) + bad, KIND), k=2, every=1).collect()}
    assert got == {(0, 1, 1, 0.0), (0, 2, 2, 1.0), (1, 1, 0, 0.0), (1, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0), (3, 1, 0, 3.0), (3, 2, 1, 3.0)}


def test_queries_lengths_ties_and_chunks(spark):
    rng = np.random.default_rng(4)
    same = np.tile(rng.normal(size=12) * 100, (150, 1))
    x = np.concatenate([same, rng.normal(size=(250, 12)) * 3]).astype(np.float32)
    y = rng.normal(size=(60, 5)).astype(np.float32)
    docs = spark.createDataFrame(rows(x) + rows(y, 1000), KIND)
    for options in ({}, {"group_bytes": 2000, "fit": 100}):
        got = {}
        for g in A.neighbours(docs, k=10, target=1.0, **options).collect():
            got.setdefault(g.vec_id, []).append((g.rank, g.neighbor_id))
        assert set(got) == {*range(0, 400, 20), *range(1000, 1060, 20)}
        for q in range(0, 150, 20):
            assert [i for _, i in sorted(got[q])] == [i for i in range(11) if i != q][:10]
        hits = 0
        for q, found in got.items():
            z, start = (x, 0) if q < 1000 else (y, 1000)
            d = ((z.astype(float) - z[q - start]) ** 2).sum(1)
            d[q - start] = np.inf
            hits += len({i for _, i in found} & set((np.lexsort((np.arange(len(d)), d))[:10] + start).tolist()))
        assert hits >= 0.9 * 10 * len(got)
