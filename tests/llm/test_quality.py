"""Quality classifier: held-out accuracy on made-up documents, gradient, cases."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from veilframe.llm import quality as Q

KIND = "doc_id long, text string, quality string, keep int, p_low string"


def made(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(40, 400))]
        low, toxic = r.random() < 0.25, r.random() < 0.25
        if low:
            at = r.randrange(len(w))
            w[at:at] = [r.choice(["$$$", "%%%"]) + r.choice(vocab).upper() + "###" for _ in range(60)]
        if toxic:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(["vilewort", "nastyword", "slurish"]))
        rows.append((i, " ".join(w), int(not low), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1, 600)
    docs = spark.createDataFrame([(i, t, "", 1, "") for i, t, *_ in rows], KIND)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:400]] + [(None, 1, 1), (3, None, None), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    models = Q.train(docs, labels)
    got = {x.doc_id: x for x in Q.classify(docs, models).collect()}
    held = rows[400:]
    low = sum((got[i].p_low > 0.5) == (q == 0) for i, _, q, _ in held) / len(held)
    toxic = sum((got[i].p_toxic > 0.5) == (x == 1) for i, _, _, x in held) / len(held)
    assert low > 0.95 and toxic > 0.95
    kept = {x.doc_id for x in Q.keep_good(docs, models).collect()}
    assert kept == {i for i, x in got.items() if x.keep}
    assert all(0 <= x.top_passage < x.n_passages for x in got.values())
    again = Q.classify(docs.repartition(7), models).collect()
    assert {(x.doc_id, round(x.p_low, 5)) for x in again} == {(i, round(x.p_low, 5)) for i, x in got.items()}


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "", 1, ""), (2, "", "", 1, ""), (None, "text", "", 1, ""), (1, "x " * 200000, "", 1, "")], KIND)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    models = Q.train(docs, none)
    assert models == (None, None)
    rows = Q.classify(docs, models).collect()
    assert len(rows) == 4 and all(x.keep for x in rows)
    assert Q.keep_good(docs, models).count() == 4
    assert Q.keep_good(docs, models).schema.simpleString() == docs.schema.simpleString()
    assert Q.classify(spark.createDataFrame([], KIND), models).count() == 0
    rows = made(2, 120)
    model = Q.fit(Q.encode(pa.array([t for _, t, *_ in rows])), np.array([1 - q for *_, q, _ in rows], np.float32))
    out = Q.classify(docs, (model, None)).collect()
    assert len(out) == 4 and all(0 <= x.p_low <= 1 for x in out)


def test_attention_weights_sum_to_one():
    rows = made(3, 60)
    bags = Q.encode(pa.array([t for _, t, *_ in rows]))
    model = Q.fit(bags, np.array([1 - q for *_, q, _ in rows], np.float32), steps=20)
    _, att, _ = Q.forward(model.p, model.features(bags), bags.doc, bags.n_docs)
    assert np.allclose(np.bincount(bags.doc, weights=att), 1, atol=1e-5)


def test_training_keeps_the_sample_off_the_driver(spark):
    rows = made(4, 1500)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q, x if i % 3 else None) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    words = sum(len(t.split()) for _, t, *_ in rows)
    tracemalloc.start()
    models = Q.train(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * words  # the hash and the passage of each word alone take 16 bytes
    known = [r for r in rows if r[0] % 3]
    for model, some, y in ((models[0], rows, [1 - q for *_, q, _ in rows]), (models[1], known, [x for *_, x in known])):
        whole = Q.fit(Q.encode(pa.array([t for _, t, *_ in some])), np.array(y, np.float32))
        assert np.array_equal(model.vocabulary, whole.vocabulary) and len(model.vocabulary)
        assert all(np.array_equal(model.p[k], whole.p[k]) for k in whole.p)
