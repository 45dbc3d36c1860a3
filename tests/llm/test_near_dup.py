"""Near-duplicates: sketches against exact Jaccard, groups against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from veilframe.llm import near_dup as N

KIND = "doc_id long, text string, lang string, sketch int, band string, keeper long, gone int, again int, row string, __gone int, src int"


def grams(t):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def text(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def edited(r, t, k):
    w = t.split()
    for _ in range(k):
        w[r.randrange(len(w))] = "new" + str(r.randint(0, 999))
    return " ".join(w)


def test_sketch_estimates_similarity():
    r = random.Random(1)
    base = text(r, 300)
    others = [edited(r, base, k) for k in (0, 1, 3, 6, 12)]
    _, sig = N.signatures(pa.array([base, *others]))
    sk = N.odd_sketches(sig)
    est = N.similarity(N.ones(sk[:1], sk[1:])[0])
    true = [jaccard(base, o) for o in others]
    assert est[0] == 1
    assert np.abs(est - true).max() < 0.12
    far = N.odd_sketches(N.signatures(pa.array([text(r, 300), text(r, 300)]))[1])
    assert N.similarity(N.ones(far[:1], far[1:])[0, 0]) < 0.3


def test_copies_found_and_clean_documents_kept(spark):
    r = random.Random(3)
    rows, groups = [], []
    for g in range(25):
        base, size = text(r, r.choice([40, 120, 400])), r.choice([1, 2, 3, 6])
        ids = [g * 10 + k for k in range(size)]
        groups.append(ids)
        rows += [(i, base if i % 2 else edited(r, base, 1)) for i in ids]
    exact = text(r, 80)
    rows += [(i, exact) for i in range(1000, 1200)]
    groups.append(list(range(1000, 1200)))
    rows += [(5000, None), (5001, ""), (5002, ""), (5003, "!?"), (5004, "one"), (5005, "one"), (None, exact), (None, None)]
    groups.append([5004, 5005])
    docs = spark.createDataFrame([(i, t, "en", 1, "x", 9, 1, 1, "r", 1, 1) for i, t in rows], KIND).repartition(3)
    kept = [x.doc_id for x in N.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None and x < 5000) == sorted(min(g) for g in groups[:-1])
    assert {5000, 5001, 5002, 5003, 5004} <= set(kept) and 5005 not in kept
    assert kept.count(None) == 2
    found = {(x.doc_id, x.keeper, x.group_size) for x in N.report(docs).collect()}
    assert found == {(i, min(g), len(g)) for g in groups if len(g) > 1 for i in g}


def test_repeated_ids_and_empty_table(spark):
    assert N.keep_one(spark.createDataFrame([], KIND)).count() == 0
    assert N.report(spark.createDataFrame([], KIND)).count() == 0
    docs = spark.createDataFrame([(1, "b b b b", "x"), (1, "a a a a", "y"), (2, "c d e f", "z"), (2, "c d e f", "z")], "doc_id long, text string, row string")
    assert sorted((x.doc_id, x.text) for x in N.keep_one(docs).collect()) == [(1, "a a a a"), (2, "c d e f")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(100, i) for i in range(101, 130)] + [(129, 300), (200, 201)]
    got = {(x.doc_id, x.root) for x in N.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(i, 1) for i in range(2, 21)} | {(i, 100) for i in [*range(101, 130), 300]} | {(201, 200)}


def test_edited_copies_found_as_by_brute_force(spark):
    r = random.Random(8)
    rows = []
    for g in range(120):
        base = text(r, r.choice([60, 150, 400]))
        words = len(base.split())
        rows += [(2 * g, base), (2 * g + 1, edited(r, base, round(words * r.uniform(0.05, 0.1))))]
    exact = {(2 * g, 2 * g + 1) for g in range(120) if jaccard(rows[2 * g][1], rows[2 * g + 1][1]) >= N.THRESHOLD}
    assert len(exact) > 110
    got = {(x.keeper, x.doc_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact)


def test_links_connect_a_bucket():
    r = random.Random(9)
    base = text(r, 200)
    texts = [base, *(edited(r, base, k % 40) for k in range(299)), text(r, 200)]
    sk = N.odd_sketches(N.signatures(pa.array(texts))[1])
    sure, most = N.max_ones(0.75), N.max_ones(0.3)
    src, dst = N._links(sk, np.arange(len(sk)), sure, most)
    d = N.ones(sk, sk)
    assert (d[src, dst] <= most).all()

    def groups(edges):
        root = list(range(len(sk)))
        for i, j in edges:
            i, j = root[i], root[j]
            root = [min(i, j) if x in (i, j) else x for x in root]
        return root

    assert groups(zip(src, dst)) == groups(zip(*np.nonzero(d <= most)))


def brute_groups(rows, threshold):
    """Groups of all pairs at or above the threshold, by comparing every pair."""
    root = {i: i for i, _ in rows}
    sets = {i: grams(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return {(i, v) for i, v in root.items() if i != v}


def test_all_pairs_with_split_buckets_and_groups(spark):
    r = random.Random(11)
    base, rows = text(r, 150), []
    for k in range(90):  # one hot bucket of variants, in a chain and apart
        rows.append((k, edited(r, base if k % 3 else rows[-1][1] if rows else base, r.choice([1, 3, 8]))))
    rows += [(100 + k, text(r, 120)) for k in range(40)]
    rows.append((300, text(r, 60_000)))
    rows.append((301, edited(r, rows[-1][1], 500)))
    want = brute_groups(rows, N.THRESHOLD)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(x.doc_id, x.keeper) for x in N.near_duplicates(docs).collect()}
    tiles = {(x.doc_id, x.keeper) for x in N.near_duplicates(docs, tile=8, group=8).collect()}
    assert whole == tiles == want


def test_different_texts_of_one_bitmap_keep_their_links(spark):
    for seed in range(500):
        w = text(random.Random(seed), 201).split()
        texts = [" ".join(w), " ".join(w[:200]), " ".join(w[:101])]
        _, sig = N.signatures(pa.array(texts))
        bands = (sig[1:] == sig[0]).reshape(2, N.BANDS, N.ROWS).all(axis=2)
        if bands[0].all() and bands[1].any():
            break
    assert jaccard(texts[0], texts[2]) < N.THRESHOLD <= jaccard(texts[1], texts[2])
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[0].upper())], "doc_id long, text string")
    assert {(x.doc_id, x.keeper) for x in N.near_duplicates(docs).collect()} == {(2, 1), (3, 1), (4, 1)}
