"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one generalised suffix automaton.
Each training text streams through it once; the matching length at every word
(the longest suffix read that occurs in some item) is tracked, and along the suffix
links the length for every item.  Each item's maximal match is removed if it has at
least ``MIN_WORDS`` words or covers at least ``COVERAGE`` of the item (items of fewer
than ``MIN_ITEM`` words count by coverage only if they match whole), whether or not a
longer match with another item holds it; a match inside a longer removed one adds its
item to that one.

A match that counts has at least as many words as the shortest need of any item, and so each
of its windows of that length is a window of some item: texts are first compared by hashed
windows in numpy, and only the stretches that such windows cover stream through the automaton.

The automaton is broadcast if the benchmark has at most ``SHARD_CHARS`` characters.  A larger
one is cut by item into shards within that bound, each with a pass of its own over the
(stored) texts; the matches of all passes meet by row, with the same result.

Cases: null and empty texts have no match; null or word-free items are ignored; rows without
an id are scanned (id null); each row is scanned alone, so repeated rows give repeated
results; repeated items count once each; of equal or nested spans the outer one is given,
with the items of all; empty tables give no spans; a very long text streams through like any
other; other columns pass through ``remove_leaks`` untouched, whatever their names, but
``n_chars``, which follows the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import cut, free_name

MIN_WORDS, COVERAGE, MIN_ITEM, SHARD_CHARS = 8, 0.5, 4, 2_000_000
SCHEMA = "doc_id long, start_char int, end_char int, n_words int, coverage double, item_ids array<long>"


class Automaton:
    """Generalised suffix automaton over integer symbols."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.last = 0

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """State for the suffixes of q's class that end with p's string and c."""
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, c: int) -> None:
        p, known = self.last, self.next[self.last].get(c)
        if known is not None:
            self.last = known if self.len[known] == self.len[p] + 1 else self._split(p, known, c)
            return
        new = self._state(self.len[p] + 1, {}, 0)
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        self.last = new

    def add(self, symbols) -> None:
        self.last = 0
        for c in symbols:
            self.extend(int(c))


@dataclass
class Index:
    """An automaton, the items (with their lengths) that pass through each state, and all windows of ``least`` words."""

    vocabulary: np.ndarray
    automaton: Automaton
    items: list[tuple[int, int]]
    at: list[set[int]]
    least: int
    windows: np.ndarray


def build(ids, texts: pa.Array, min_words: int = MIN_WORDS, coverage: float = COVERAGE) -> Index:
    w = W.tokenize(texts)
    vocab = np.unique(w.hash)
    number = np.searchsorted(vocab, w.hash)
    sam, items, seqs, least = Automaton(), [], [], min_words
    for k in range(w.n_docs):
        seq = number[w.first[k] : w.first[k + 1]].tolist()
        if not seq or ids[k] is None:
            continue
        sam.add(seq)
        items.append((int(ids[k]), len(seq)))
        seqs.append(seq)
        least = min(least, _needed(len(seq), min_words, coverage))
    at: list[set[int]] = [set() for _ in sam.next]
    for k, seq in enumerate(seqs):
        s = 0
        for c in seq:
            s = sam.next[s][c]
            t = s
            while t > 0 and k not in at[t]:
                at[t].add(k)
                t = sam.link[t]
    return Index(vocab, sam, items, at, max(1, least), np.unique(W.windows(w, max(1, least))[1]))


def _needed(item: int, min_words: int, coverage: float) -> int:
    """Words of a match with which an item of this length counts as leaked."""
    whole = item if item < MIN_ITEM else max(MIN_ITEM, int(np.ceil(coverage * item)))
    return min(min_words, whole)


def _matches(index: Index, seq: list[int]):
    """(start, end, item numbers) of the maximal matches of at least ``least`` words of every item with a run of known words."""
    nxt, link, length, least = index.automaton.next, index.automaton.link, index.automaton.len, index.least
    state = size = 0
    live: dict[int, int] = {}  # the words of each item's match that ends here
    for i, c in enumerate([*seq, None]):
        while state > 0 and c not in nxt[state]:
            state = link[state]
            size = length[state]
        to = nxt[state].get(c)
        state, size = (0, 0) if to is None else (to, size + 1)
        now: dict[int, int] = {}
        t, n = state, size
        while n >= least:
            for k in index.at[t]:
                now.setdefault(k, n)
            t = link[t]
            n = length[t]
        over: dict[int, list[int]] = {}
        for k, n in live.items():
            if now.get(k) != n + 1:
                over.setdefault(i - n, []).append(k)
        for start, found in over.items():
            yield start, i, found
        live = now


def raw(index: Index, w: W.Words, min_words: int = MIN_WORDS, coverage: float = COVERAGE):
    """(document, first word, end word, item id, share of the item) of every maximal match that counts."""
    i, h = W.windows(w, index.least)
    if not len(i) or not len(index.windows):
        return
    i = i[index.windows[np.minimum(np.searchsorted(index.windows, h), len(index.windows) - 1)] == h]
    step = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(step, i, 1)
    np.add.at(step, i + index.least, -1)
    inside = np.cumsum(step)[:-1] > 0
    edge = np.concatenate([[True], w.doc[1:] != w.doc[:-1]])
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.concatenate([inside[1:] & ~edge[1:], [False]])
    ends = np.flatnonzero(inside & ~after) + 1
    for a, b in zip(starts, ends):
        for i, j, found in _matches(index, np.searchsorted(index.vocabulary, w.hash[a:b]).tolist()):
            for item, n in (index.items[k] for k in found):
                if j - i >= _needed(n, min_words, coverage):
                    yield int(w.doc[a]), int(a + i), int(a + j), item, min(1.0, (j - i) / n)


def merge(matches):
    """(first word, end word, share of an item, item ids) of the outermost of a document's matches; spans may overlap."""
    spans: dict[tuple[int, int], dict[int, float]] = {}
    for i, j, item, share in matches:
        shares = spans.setdefault((i, j), {})
        shares[item] = max(shares.get(item, 0.0), share)
    kept: list[tuple[int, int, dict[int, float]]] = []
    for (i, j), shares in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
        around = [k for k in kept if k[1] >= j]
        for _, _, more in around:
            more.update({item: max(share, more.get(item, 0.0)) for item, share in shares.items()})
        if not around:
            kept.append((i, j, shares))
    return [(i, j, max(shares.values()), sorted(shares)) for i, j, shares in kept]


def find(index: Index, w: W.Words, min_words: int = MIN_WORDS, coverage: float = COVERAGE):
    """(document, first word, end word, share of an item, item ids) of every leaked span; spans of a document may overlap."""
    matches: dict[int, list] = {}
    for d, *match in raw(index, w, min_words, coverage):
        matches.setdefault(d, []).append(match)
    for d, found in matches.items():
        for i, j, share, items in merge(found):
            yield d, i, j, share, items


def load(benchmark: DataFrame, min_words: int = MIN_WORDS, coverage: float = COVERAGE) -> Index:
    table = benchmark.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    return build(table["item_id"].to_pylist(), table["text"], min_words, coverage)


def shards(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct items, in parts of about ``SHARD_CHARS`` characters at most."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _located(rows: DataFrame, parts: list[DataFrame], row: str, min_words: int, coverage: float) -> DataFrame:
    """The matches of each numbered row with the items of all shards."""
    kind, out = f"{row} long, i int, j int, item long, share double", None
    for part in parts:
        shared = rows.sparkSession.sparkContext.broadcast(load(part, min_words, coverage))

        def run(batches, shared=shared):
            for batch in W.slices(batches):
                w, ids = W.tokenize(batch.column("text")), batch.column(0)
                found = [(ids[d].as_py(), i - int(w.first[d]), j - int(w.first[d]), item, share) for d, i, j, item, share in raw(shared.value, w, min_words, coverage)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()])], names=[row, "i", "j", "item", "share"])

        hits = cut(rows.select(row, "text").mapInArrow(run, kind))
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy(row).agg(F.collect_list(F.struct("i", "j", "item", "share")).alias("found"))


def _spans(docs: DataFrame, benchmark: DataFrame, min_words: int, coverage: float, rewrite, schema) -> DataFrame:
    """``rewrite(batch, words, {document: merged spans})`` of every batch of ``docs``."""
    parts = shards(benchmark)
    if len(parts) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(load(parts[0], min_words, coverage))

        def run(batches):
            for part in W.slices(batches):
                w = W.tokenize(part.column("text"))
                spans: dict[int, list] = {}
                for d, *span in find(shared.value, w, min_words, coverage):
                    spans.setdefault(d, []).append(span)
                yield from rewrite(part, w, spans)

        return docs.mapInArrow(run, schema)
    row, hits = free_name(docs, "row"), free_name(docs, "hits")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = _located(rows, parts, row, min_words, coverage).withColumnRenamed("found", hits)
    names = docs.columns

    def join(batches):
        for part in W.slices(batches):
            w, spans = W.tokenize(part.column("text")), {}
            for d, matches in enumerate(part.column(hits).to_pylist()):
                if matches:
                    at = int(w.first[d])
                    spans[d] = [(i + at, j + at, share, items) for i, j, share, items in merge([(m["i"], m["j"], m["item"], m["share"]) for m in matches])]
            yield from rewrite(part.select(names), w, spans)

    return rows.join(found, row, "left").drop(row).select(*(F.col(f"`{c}`") for c in [*names, hits])).mapInArrow(join, schema)


def bounds(w: W.Words, text: str, doc: int, a: int, b: int) -> tuple[int, int]:
    """Character bounds in the text of words a..b-1."""
    lo, hi = int(w.start[a] - w.offsets[doc]), int(w.end[b - 1] - w.offsets[doc])
    if len(text) == w.offsets[doc + 1] - w.offsets[doc]:
        return lo, hi
    low = bytes(w.data[w.offsets[doc] : w.offsets[doc + 1]])
    lo, hi = len(low[:lo].decode()), len(low[:hi].decode())
    if len(text.lower()) != len(text):  # rare letters change their number when lowered
        where, n = [], 0
        for i, c in enumerate(text):
            where += [i] * len(c.lower())
        lo, hi = where[min(lo, len(where) - 1)], where[min(hi, len(where)) - 1] + 1
    return lo, hi


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, start_char, end_char, n_words, coverage, item_ids): each leaked span of each document."""

    def report(part, w, spans):
        texts, ids = part.column("text"), part.column("doc_id")
        rows = [(ids[d].as_py(), *bounds(w, texts[d].as_py(), d, a, b), b - a, share, items) for d, found in spans.items() for a, b, share, items in found]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start_char", "end_char", "n_words", "coverage", "item_ids"])

    return _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, min_words, coverage, report, SCHEMA)


def replace_text(part: pa.RecordBatch, new: dict[int, str]) -> pa.RecordBatch:
    """A batch with some texts replaced; an n_chars column follows."""
    if not new:
        return part
    cols, names = list(part.columns), part.schema.names
    text = part.column("text").to_pylist()
    for d, t in new.items():
        text[d] = t
    cols[names.index("text")] = pa.array(text, part.schema.field("text").type)
    if "n_chars" in names:
        n = part.column("n_chars").to_pylist()
        for d, t in new.items():
            n[d] = len(t)
        cols[names.index("n_chars")] = pa.array(n, part.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays(cols, schema=part.schema)


def cut_out(text: str, spans: list[tuple[int, int]], by: str = "") -> str:
    """Text without the union of the spans, each maximal stretch replaced by ``by``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at or (a == at and (a == 0 or not out)):
            out += [text[at:a], by]
        at = max(at, b)
    return "".join(out) + text[at:]


def remove_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``docs``, all rows and columns, with the leaked spans cut out of ``text`` (and ``n_chars`` set to the new length)."""

    def clean(part, w, spans):
        texts = part.column("text")
        yield replace_text(part, {d: cut_out(t := texts[d].as_py(), [bounds(w, t, d, a, b) for a, b, *_ in found]) for d, found in spans.items()})

    return _spans(docs, benchmark, min_words, coverage, clean, docs.schema)
