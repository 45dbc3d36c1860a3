"""The corpus pipeline on a small made-up folder: planted cases are caught, clean documents stay."""

import random

import pytest

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    d = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    vocab = [word() for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs, labels = {}, []
    for i in range(300):
        t, toxic, low = text(r.randint(60, 300)), i % 5 == 1, i % 5 == 2
        if toxic:
            t = " ".join(w if k % 12 else "vilewort nastyword" for k, w in enumerate(t.split()))
        if low:
            t = " ".join(f"$$${w.upper()}###" for w in t.split())
        docs[i] = t
        labels.append((i, int(not low), int(toxic)))
    item = "Which of these Rivers flows through the northern valley before it reaches the open sea at last?"
    docs[1000] = docs[0]
    docs[1001] = docs[3] + " " + word()
    docs[1002] = text(80) + " " + item + " " + text(40)
    docs[1003] = text(90) + " key = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b " + text(20)
    docs[1004] = text(5000)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, labels


def test_stages(spark, folder):
    d, docs, labels = folder
    stage = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    out = spark.read.parquet(f"{d}/documents.parquet")
    shape = out.schema.simpleString()
    good = {i for i, q, x in labels if q and not x} | {1000, 1001, 1002, 1003, 1004}
    out = stage["quality classifier"](spark, out, d)
    assert out.schema.simpleString() == shape
    kept = {x.doc_id for x in out.collect()}
    assert len(kept - good) <= 2 and len(good - kept) <= 2
    out = stage["MinHash near-dedup"](spark, out, d).cache()
    assert out.schema.simpleString() == shape
    assert kept - {x.doc_id for x in out.collect()} == {1000, 1001} & kept
    out = stage["benchmark decontamination"](spark, out, d)
    texts = {x.doc_id: x.text for x in out.collect()}
    assert "northern valley" not in texts[1002] and texts[0] == docs[0] and texts[1004] == docs[1004]
    out = stage["secret scans"](spark, out, d)
    texts = {x.doc_id: x.text for x in out.collect()}
    assert "9f86d081" not in texts[1003] and "[SECRET]" in texts[1003] and texts[1004] == docs[1004]
    places = stage["packing"](spark, out, d).collect()
    assert {x.doc_id for x in places} == set(texts)


def test_run_is_the_chain_of_stages(spark, folder):
    d = folder[0]
    a = {(x.doc_id, x.piece, x.n_tokens) for x in corpus_pipeline.run(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, d)
    assert a == {(x.doc_id, x.piece, x.n_tokens) for x in docs.collect()}


def test_empty_corpus_and_clashing_columns(spark, folder, tmp_path):
    d, docs, _ = folder
    names = "gone again row hits found src dst b h at item_ids keep p_low unit llr sketch tie salt n_tokens".split()
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    rows = [(i, t, "en", "s", len(t), *names) for i, t in docs.items() if i < 100 or i >= 1000]
    rows += [(2000, docs[0], "en", "s", 0, *names), (2000, docs[0], "en", "s", 0, *names), (None, docs[8], *[None] * 22), (2001, None, *[None] * 22), (2002, "", *[None] * 22)]
    rows.append((2003, " ".join(f"word{k}" for k in range(300_000)), "en", "s", 0, *names))
    for n, part in enumerate(([], rows)):
        out = spark.createDataFrame(part, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"{tmp_path}/{n}-{name}"
            stage(spark, out, d).write.parquet(path)
            out = spark.read.parquet(path)
            assert out.columns == [c.split()[0] for c in kind.split(", ")], name
        last = corpus_pipeline.STAGES[-1][1](spark, out, d).collect()
        if not part:
            assert not last
            continue
        kept = out.collect()
        ids = [x.doc_id for x in kept]
        assert ids.count(2000) <= 1 and {None, 2003} <= set(ids) and all(x.gone in ("gone", None) for x in kept)
        assert {x.doc_id for x in last} == {x.doc_id for x in kept if x.text}
