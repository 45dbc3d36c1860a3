"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
(tanh of shape features and of learned word weights), a gated attention scores
the passages, and the attention-weighted passage representation gives the
document's probability.  Only documents carry labels.  Two such models are
trained: low quality and toxicity.

Training reads at most ``max_train`` labelled documents (the ones with the least
hash of their id), whole; scoring reads every text whole.  The sample's texts never reach the
driver: tasks count the words of each label and encode the passages; the driver descends
over batches of documents, whose shape features and vocabulary words lie in a file (``Spool``).

Cases: a null or empty text has one passage without words and gets a score like
any other; rows without an id are scored too (id null); repeated rows are scored
each; labels that contradict each other count as the worse one; null labels are
skipped; without labels of both kinds that model rejects nothing (probability 0); of equally
attended passages the first is the top one; documents of equal hash enter the sample by id;
an empty table gives no rows; a very long text is a bag of many passages; other columns pass
through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import drop, store

PASSAGE = 48
MAX_TRAIN = 8000
HIDDEN, ATTENTION, VOCABULARY = 16, 12, 384
N_SHAPE = 12
LABELS = ("low", "toxic")
COUNTS = [f"{n}_{c}" for c in LABELS for n in ("df", "pos")]
HIT = np.dtype([("passage", "<i4"), ("word", "<u2")])
SCHEMA = "doc_id long, p_low double, p_toxic double, n_passages int, top_passage int, keep boolean"

_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&*@^~+=<>\\{}[]_`")] = True
_UP = np.zeros(256, bool)
_UP[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True


@dataclass
class Bags:
    """Passages of a batch: ``doc`` is sorted; ``word_passage`` and ``word`` are one pair a word."""

    n_docs: int
    doc: np.ndarray
    shape: np.ndarray
    word_passage: np.ndarray
    word: np.ndarray


def _per(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32 if len(flags) < 1 << 31 else np.int64)])
    return (total[b] - total[a]).astype(np.float32)


def encode(texts: pa.Array) -> Bags:
    """Shape features and words of every passage; a text without words has one passage."""
    texts = W.fill(texts)
    w = W.tokenize(texts)
    low_off, _ = W.buffers(texts)
    raw_off, raw = low_off, W.buffers(texts)[1]
    n_words = w.counts()
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    doc = np.repeat(np.arange(w.n_docs), n_pass)
    base = np.cumsum(n_pass) - n_pass
    inside = np.arange(len(doc)) - base[doc]
    word_passage = base[w.doc] + (np.arange(len(w.doc)) - w.first[w.doc]) // PASSAGE
    # byte bounds, in proportion where lower-casing changed the length
    scale = np.diff(raw_off) / np.maximum(1, np.diff(w.offsets))
    rel = np.zeros(len(doc))
    lead = np.minimum(w.first[doc] + inside * PASSAGE, max(0, len(w.start) - 1))
    if len(w.start):
        rel = (w.start[lead] - w.offsets[doc]) * scale[doc]
    a = raw_off[doc] + np.where(inside == 0, 0, rel).astype(np.int64)
    last = inside == n_pass[doc] - 1
    b = np.where(last, raw_off[doc + 1], np.append(a[1:], len(raw)))
    a, b = np.clip(a, 0, len(raw)), np.clip(b, 0, len(raw))
    size = np.maximum(1, b - a).astype(np.float32)
    count = np.bincount(word_passage, minlength=len(doc)).astype(np.float32)
    some = np.maximum(1, count)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    key = W.mix(w.hash ^ W.mix(word_passage.astype(np.uint64) + np.uint64(7)))
    unique = np.bincount(word_passage[np.unique(key, return_index=True)[1]], minlength=len(doc)).astype(np.float32)
    length = np.bincount(word_passage, weights=w.end - w.start, minlength=len(doc)).astype(np.float32)
    shape = np.stack(
        [
            _per(_MARK[raw], a, b) / size * 5, _per(_UP[raw], a, b) / size * 3, _per(_DIGIT[raw], a, b) / size * 3, _per(raw == 124, a, b) / some * 3,
            np.bincount(word_passage, weights=same, minlength=len(doc)).astype(np.float32) / some * 3, unique / some, length / some / 8, _per(raw == 10, a, b) / some * 5,
            _per(_STOP[raw], a, b) / some * 3, np.log1p(n_words[doc]).astype(np.float32) / 8, some / PASSAGE, (count == 0).astype(np.float32),
        ],
        axis=1,
    ).astype(np.float32)
    return Bags(w.n_docs, doc, shape, word_passage, w.hash)


@dataclass
class Model:
    vocabulary: np.ndarray
    p: dict

    def features(self, bags: Bags) -> np.ndarray:
        x = np.zeros((len(bags.doc), N_SHAPE + len(self.vocabulary)), np.float32)
        x[:, :N_SHAPE] = bags.shape
        if len(self.vocabulary) and len(bags.word):
            at = np.minimum(np.searchsorted(self.vocabulary, bags.word), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == bags.word
            cell = bags.word_passage[hit] * x.shape[1] + N_SHAPE + at[hit]
            where, n = np.unique(cell, return_counts=True)
            x.ravel()[where] += n
        return x

    def predict(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each document and the index of its most attended passage."""
        prob, attention, _ = forward(self.p, self.features(bags), bags.doc, bags.n_docs)
        first = np.searchsorted(bags.doc, np.arange(bags.n_docs))
        best = np.lexsort((np.arange(len(bags.doc)), -attention, bags.doc))[first] if len(bags.doc) else first
        return prob, best - first


def forward(p: dict, x: np.ndarray, doc: np.ndarray, n: int):
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    s = (t * g) @ p["a"]
    top = np.full(n, -np.inf, np.float32)
    np.maximum.at(top, doc, s)
    e = np.exp(s - top[doc])
    z = np.bincount(doc, weights=e, minlength=n)
    att = (e / z[doc]).astype(np.float32)
    m = np.zeros((n, h.shape[1]), np.float32)
    first = np.searchsorted(doc, np.arange(n))
    m = np.add.reduceat(h * att[:, None], first, axis=0) if len(doc) else m
    prob = 1 / (1 + np.exp(-(m @ p["c"] + p["d"])))
    return prob, att, (h, t, g, m)


def part_of(bags: Bags, docs: np.ndarray) -> Bags:
    """The bags of some documents (ascending), renumbered."""
    keep = np.zeros(bags.n_docs, bool)
    keep[docs] = True
    number = np.cumsum(keep) - 1
    rows = np.flatnonzero(keep[bags.doc])
    place = np.cumsum(keep[bags.doc]) - 1
    of_word = np.flatnonzero(keep[bags.doc[bags.word_passage]])
    return Bags(len(docs), number[bags.doc[rows]], bags.shape[rows], place[bags.word_passage[of_word]], bags.word[of_word])


def word_counts(bags: Bags, known: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; of each label (a row of ``known`` and ``bad``) the known documents and the bad ones that have the word."""
    doc = bags.doc[bags.word_passage]
    both = np.unique(W.mix(bags.word) ^ W.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    words, inv = np.unique(bags.word[both], return_inverse=True)
    df, pos = (np.array([np.bincount(inv, weights=v[doc[both]], minlength=len(words)) for v in rows]) for rows in (known, bad))
    return words, df, pos


def telling(words: np.ndarray, df: np.ndarray, pos: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``VOCABULARY`` words whose rate of bad documents is farthest from ``rate``, and how far; of equal ones those of least hash."""
    z = np.abs(pos - df * rate) / np.sqrt(df * rate * (1 - rate) + 1e-9)
    z[(df < 3) | (z < 3.5)] = 0
    chosen = np.lexsort((words, -z))[:VOCABULARY]
    chosen = chosen[z[chosen] > 0]
    return words[chosen], z[chosen]


def fit(bags: Bags, y: np.ndarray, steps: int = 400, batch: int = 256, seed: int = 0, l2: float = 1e-4) -> Model | None:
    """A model of documents in memory; None unless both labels occur."""
    n = bags.n_docs
    if not 0 < y.sum() < n:
        return None
    words, df, pos = word_counts(bags, np.ones((1, n)), y[None])
    vocabulary = np.sort(telling(words, df[0], pos[0], y.mean())[0])
    hit = np.flatnonzero(np.isin(bags.word, vocabulary))
    hits = Bags(n, bags.doc, bags.shape, bags.word_passage[hit], bags.word[hit])
    return descend(vocabulary, lambda some: part_of(hits, some), y, steps, batch, seed, l2)


def descend(vocabulary: np.ndarray, take, y: np.ndarray, steps: int = 400, batch: int = 256, seed: int = 0, l2: float = 1e-4) -> Model:
    """Adam on the cross-entropy of batches of documents; ``take`` gives the bags of some documents (ascending)."""
    n, rate = len(y), y.mean()
    rng = np.random.default_rng(seed)
    model = Model(vocabulary, {})
    k = N_SHAPE + len(vocabulary)
    p = {
        "W": rng.normal(0, 0.3 / np.sqrt(N_SHAPE), (k, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.array(np.log(rate / (1 - rate))),
    }
    p = {q: v.astype(np.float32) for q, v in p.items()}
    m1 = {q: np.zeros_like(v) for q, v in p.items()}
    m2 = {q: np.zeros_like(v) for q, v in p.items()}
    order, at = rng.permutation(n), 0
    for step in range(1, steps + 1):
        if at >= n:
            order, at = rng.permutation(n), 0
        some = np.sort(order[at : at + batch])
        at += batch
        bag = take(some)
        x, doc, target, size = model.features(bag), bag.doc, y[some], bag.n_docs
        prob, att, (h, t, g, m) = forward(p, x, doc, size)
        err = ((prob - target) / size).astype(np.float32)
        grad = {"c": m.T @ err, "d": err.sum()}
        dm = err[:, None] * p["c"]
        datt = (h * dm[doc]).sum(1)
        mean = np.bincount(doc, weights=att * datt, minlength=size).astype(np.float32)
        ds = att * (datt - mean[doc])
        grad["a"] = (t * g).T @ ds
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        grad["V"], grad["U"] = h.T @ dt, h.T @ dg
        dh = (att[:, None] * dm[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grad["W"], grad["b"] = x.T @ dh + l2 * p["W"], dh.sum(0)
        rate_now = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for q in p:
            m1[q] = 0.9 * m1[q] + 0.1 * grad[q]
            m2[q] = 0.999 * m2[q] + 0.001 * np.square(grad[q])
            p[q] = (p[q] - rate_now * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.p = p
    return model


class Spool:
    """Encoded documents (``_encode``) in files of the driver, of which a batch at a time is read; ``ids`` are ascending."""

    def __init__(self, ids: np.ndarray, encoded: DataFrame, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.passages, self.hits = (np.zeros((len(ids), 2), np.int64) for _ in range(2))
        with tempfile.TemporaryFile() as shape, tempfile.TemporaryFile() as hits:
            for row in encoded.toLocalIterator():
                at = np.searchsorted(ids, row["doc_id"])
                for file, size, place in ((shape, 4 * N_SHAPE, self.passages), (hits, HIT.itemsize, self.hits)):
                    begin = file.tell() // size
                    file.write(row["shape" if file is shape else "hits"])
                    place[at] = begin, file.tell() // size
            self.shape, self.hit = (self._mapped(f, t) for f, t in ((shape, np.dtype("<f4")), (hits, HIT)))
        self.shape = self.shape.reshape(-1, N_SHAPE)

    @staticmethod
    def _mapped(file, kind: np.dtype) -> np.ndarray:
        file.flush()
        return np.asarray(np.memmap(file, kind, "r")) if file.tell() else np.zeros(0, kind)

    def take(self, docs: np.ndarray) -> Bags:
        """The bags of some documents, numbered as given, with their words in the vocabulary."""
        shape, hit = (np.concatenate([data[a:b] for a, b in place[docs]]) for data, place in ((self.shape, self.passages), (self.hit, self.hits)))
        n_pass, n_hit = (np.diff(place[docs])[:, 0] for place in (self.passages, self.hits))
        base = np.cumsum(n_pass) - n_pass
        return Bags(len(docs), np.repeat(np.arange(len(docs)), n_pass), shape, np.repeat(base, n_hit) + hit["passage"], self.vocabulary[hit["word"]])


def _marks(table) -> np.ndarray:
    """Of each label a row: 1 bad, 0 not, NaN not known."""
    return np.array([table.column(c).to_numpy(zero_copy_only=False) for c in LABELS], np.float32)


def _count(batches):
    for part in W.slices(batches):
        marks = _marks(part)
        words, df, pos = word_counts(encode(part.column("text")), ~np.isnan(marks), np.nan_to_num(marks))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(c.astype(np.int64)) for pair in zip(df, pos) for c in pair)], names=["word", *COUNTS])


def _telling(rates):
    def run(batches):
        for batch in batches:
            words, *counts = (batch.column(k).to_numpy() for k in range(1 + len(COUNTS)))
            for k, rate in enumerate(rates):
                if rate is not None:
                    some, z = telling(words.view(np.uint64), counts[2 * k], counts[2 * k + 1], rate)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.view(np.int64)), pa.array(z)], names=["label", "word", "z"])

    return run


def vocabularies(rows: DataFrame, rates: list) -> list[np.ndarray]:
    """Of each label with a rate the telling words (ascending); the driver gets those of each batch of distinct words."""
    total = rows.mapInArrow(_count, "word long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    best = total.mapInArrow(_telling(rates), "label int, word long, z double").toArrow()
    label, words, z = (best.column(c).to_numpy() for c in ("label", "word", "z"))
    out = []
    for k in range(len(rates)):
        own, far = words[label == k].view(np.uint64), z[label == k]
        out.append(np.sort(own[np.lexsort((own, -far))[:VOCABULARY]]))
    return out


def _encode(vocabulary: np.ndarray):
    def run(batches):
        for part in W.slices(batches):
            bags = encode(part.column("text"))
            doc_at = np.searchsorted(bags.doc, np.arange(bags.n_docs + 1))
            keep = np.flatnonzero(np.isin(bags.word, vocabulary))
            owner = bags.doc[bags.word_passage[keep]]
            hits = np.empty(len(keep), HIT)
            hits["passage"], hits["word"] = bags.word_passage[keep] - doc_at[owner], np.searchsorted(vocabulary, bags.word[keep])
            hit_at = np.searchsorted(owner, np.arange(bags.n_docs + 1))
            cells = (pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()) for data, at in ((bags.shape, doc_at), (hits, hit_at)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cells], names=["doc_id", "shape", "hits"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Model | None, Model | None]:
    """(low-quality model, toxicity model) from at most ``max_train`` labelled documents."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows, path = store(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col("quality") < 1).cast("float").alias("low"), (F.col("toxic") > 0).cast("float").alias("toxic")))
    known = rows.select("doc_id", *LABELS).toArrow().sort_by("doc_id")
    marked = [(np.flatnonzero(~np.isnan(m)), m[~np.isnan(m)]) for m in _marks(known)]
    rates = [y.mean() if 0 < y.sum() < len(y) else None for _, y in marked]
    out: list[Model | None] = [None, None]
    if any(rate is not None for rate in rates):
        words = vocabularies(rows, rates)
        both = np.union1d(*words)
        encoded, spooled = store(rows.mapInArrow(_encode(both), "doc_id long, shape binary, hits binary"))
        spool = Spool(known["doc_id"].to_numpy(), encoded, both)
        drop(spark, spooled)
        out = [None if rate is None else descend(vocabulary, lambda k, at=at: spool.take(at[k]), y) for (at, y), rate, vocabulary in zip(marked, rates, words)]
    drop(spark, path)
    return out[0], out[1]


def judge(models, texts: pa.Array, limit: float):
    """p_low, p_toxic, n_passages, top passage and keep of each text."""
    bags = encode(texts)
    low, bad = (m.predict(bags) if m else (np.zeros(bags.n_docs), np.zeros(bags.n_docs, np.int64)) for m in models)
    keep = (low[0] < limit) & (bad[0] < limit)
    top = np.where(bad[0] > low[0], bad[1], low[1])
    return low[0].astype(float), bad[0].astype(float), np.bincount(bags.doc, minlength=bags.n_docs), top, keep


def classify(docs: DataFrame, models, limit: float = 0.5) -> DataFrame:
    """(doc_id, p_low, p_toxic, n_passages, top_passage, keep) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for part in W.slices(batches):
            low, bad, n, top, keep = judge(shared.value, part.column("text"), limit)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(low), pa.array(bad), pa.array(n, pa.int32()), pa.array(top, pa.int32()), pa.array(keep)], names=["doc_id", "p_low", "p_toxic", "n_passages", "top_passage", "keep"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, models, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for part in W.slices(batches):
            yield part.filter(pa.array(judge(shared.value, part.column("text"), limit)[4]))

    return docs.mapInArrow(run, docs.schema)
