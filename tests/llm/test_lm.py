"""LM scoring against a brute-force model."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from veilframe.llm import lm

BOS, EOS = lm.BOS, lm.EOS


def brute(texts, order, discount):
    seqs = {}
    for i, t in enumerate(texts):
        seqs[i] = list(re.sub(r"[\x00-\x20]+", " ", (t or "").lower()).encode()) + [EOS]
    count = defaultdict(Counter)
    for s in seqs.values():
        row = [BOS] * (order - 1) + s
        for j in range(order - 1, len(row)):
            for n in range(order):
                count[tuple(row[j - n : j])][row[j]] += 1

    def p(w, h):
        if h not in count:
            return p(w, h[1:])
        ws, total = count[h], sum(count[h].values())
        low = 1 / 256 if not h else p(w, h[1:])
        return max(ws.get(w, 0) - discount, 0) / total + discount * len(ws) / total * low

    out = {}
    for i, s in seqs.items():
        row = [BOS] * (order - 1) + s
        out[i] = sum(math.log(p(row[j], tuple(row[j - order + 1 : j]))) for j in range(order - 1, len(row)))
    return out, seqs


@pytest.mark.parametrize("order", [5, 3, 4])
def test_scores_equal_brute_force(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choice(["The", "and", "Äpfel", "ion", "x9!", "thé"]) for _ in range(r.randint(0, 30))) for _ in range(40)]
    texts += [None, "", "\t\n  ", "long " * 700 + "end", "no id", "no id", None, "zzzz later text", "zzzz later text"]
    ids = [*range(44), None, None, None, 7, 7]
    docs = spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string")
    scores, seqs = brute(texts, order, lm.DISCOUNT)
    key = lambda x: (-1 if x[0] is None else x[0], x[1], x[2])
    want = sorted(((ids[i], len(seqs[i]), scores[i]) for i in scores), key=key)
    got = sorted(((x.doc_id, x.n_symbols, x.log_prob) for x in lm.score(docs, order).collect()), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=2e-5)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, b int, h string")
    assert lm.score(docs).count() == 0
    docs = spark.createDataFrame([(1, "abc", 5, "x")], "doc_id long, text string, b int, h string")
    assert lm.score(docs).columns == ["doc_id", "n_symbols", "log_prob", "perplexity"]
