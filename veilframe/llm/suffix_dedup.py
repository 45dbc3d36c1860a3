"""Suffix-array dedup of a corpus by prefix-free parsing.

A rolling hash over ``TRIGGER`` words cuts every text where it is 0 modulo ``MODULUS``, so
equal passages are cut alike.  A *phrase* reaches from the trigger of one cut to the next cut,
which makes the phrases prefix-free.  The *dictionary* has each distinct phrase once, the
*parse* is a text's sequence of phrases.  Each window of ``LEAST`` = 50 words belongs to its
first cut: it is a *dictionary suffix* (from its start to that cut) and a prefix of a *parse
suffix* (the phrases from that cut on).

1. Blocks of documents exchange their dictionaries: a window that holds a phrase which the
   corpus has once can't repeat.
2. Blocks exchange their distinct contexts (what lies before a cut, and the parse suffix to the
   depth of a window).  Where a context occurs at several places all its windows repeat; only
   its first place goes on, for all of them: repetitive text is looked at once.
3. The windows that are left are put in corpus order in each block: the suffix array of the
   parse (prefix doubling over phrase ranks) with its longest common prefixes, and the order
   of the dictionary suffixes (a word prepended to a ranked suffix, each distinct one once)
   combine to the order of the windows, in which equal ones are neighbours.  The distinct ones
   meet across blocks.

The result is exact up to the chance that 64-bit hashes of different passages meet: a row is a
maximal stretch of starts whose 50 words occur at another place too, with one role; ``first``
stretches hold the first occurrence (least doc_id, then position) and stay in a deduplicated
corpus.

Cases: null and empty texts and texts under 50 words have no rows; rows without an id
aren't compared; several rows of one id count as one document, the least text; ties are
settled by doc_id and position; an empty table gives no rows; a very long text is one parse,
and its windows without any cut are looked up by their own hashes; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .exchange import by_bucket, docs_by_bucket, one_row_per_id, partitions
from .tally import ASK, ASK_FIELDS, Known, answers, ask, ask_distinct, firsts

LEAST, TRIGGER, MODULUS = 50, 4, 8
DEPTH = LEAST - TRIGGER  # words after a cut that a window of it can hold
SCHEMA = "doc_id long, start_word int, end_word int, n_words int, first boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32()), ("first", pa.bool_())])
_INVERSE = np.uint64(pow(W.BASE, -1, 1 << 64))


class Parse:
    """The words of a block of documents and their cuts."""

    def __init__(self, docs: pa.Table):
        hashes, ids, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in W.slices(docs.to_batches()):
            w = W.tokenize(part.column("text"))
            hashes.append(w.hash)
            ids.append(part.column("doc_id").to_numpy(zero_copy_only=False))
            counts.append(w.counts())
        self.word, self.ids = np.concatenate(hashes), np.concatenate(ids)
        count = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.doc = np.repeat(np.arange(len(count)), count)
        n = len(self.word)
        power = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
        self.sum = np.concatenate([[np.uint64(0)], np.cumsum(self.word * power(np.uint64(W.BASE))[:n])])
        self.inverse = power(_INVERSE)
        h = W.window_hash(self.word, TRIGGER)
        at = np.flatnonzero((h % np.uint64(MODULUS) == 0) & (self.doc[: len(h)] == self.doc[TRIGGER - 1 :][: len(h)])) if len(h) else np.zeros(0, np.int64)
        self.cut = at + TRIGGER
        d = self.doc[self.cut - 1]
        before = np.concatenate([[-1], self.cut[:-1]])
        self.left = np.maximum(np.maximum(self.first[d], np.where(before > self.first[d], before - TRIGGER + 1, 0)), self.cut - LEAST)
        self.right = np.minimum(self.first[d + 1], self.cut + DEPTH)
        #: whether the next cut is in the same document, so that a phrase begins here
        self.inner = np.append(d[1:] == d[:-1], False) if len(d) else np.zeros(0, bool)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words a..b-1."""
        return W.mix((self.sum[b] - self.sum[a]) * self.inverse[a] + (b - a).astype(np.uint64) * W.M1)

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Cut at which each phrase begins, and its hash."""
        j = np.flatnonzero(self.inner)
        return j, self.hash(self.cut[j] - TRIGGER, self.cut[j + 1])

    def windows(self, repeated: Known) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows whose phrases are all in the dictionary twice or more, and the first cut of each (-1: none)."""
        n = len(self.word) - LEAST + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.flatnonzero(self.doc[:n] == self.doc[LEAST - 1 :])
        lo, hi = np.searchsorted(self.cut, x + TRIGGER), np.searchsorted(self.cut, x + LEAST, side="right") - 1
        j, h = self.phrases()
        once = np.zeros(len(self.cut) + 1, np.int64)
        once[j] = repeated(h) == 0
        total = np.concatenate([[0], np.cumsum(once)])
        ok = (hi <= lo) | (total[np.maximum(hi, 0)] == total[np.minimum(lo, len(self.cut))])
        return x[ok], np.where(hi >= lo, lo, -1)[ok]

    def contexts(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts that own a window, and the hash of each one's context."""
        j = np.unique(owner[owner >= 0])
        return j, W.mix(self.hash(self.left[j], self.right[j]) + (self.cut[j] - self.left[j]).astype(np.uint64))


def parse_order(p: Parse, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the parse at the cuts j: their order, and the words that each shares with the one before it (from its trigger on)."""
    # the phrases that these suffixes reach, ranked as sequences of words
    reach = np.zeros(len(p.cut) + 1, np.int64)
    last = np.searchsorted(p.cut, p.right[j], side="right")
    np.add.at(reach, j, 1)
    np.add.at(reach, np.maximum(last, j + 1), -1)
    some = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
    start = p.cut[some] - TRIGGER
    d = p.doc[start]
    end = np.where(p.inner[some], p.cut[np.minimum(some + 1, len(p.cut) - 1)], p.first[d + 1])
    end = np.minimum(end, start + LEAST)
    _, one, which = np.unique(p.hash(start, end), return_index=True, return_inverse=True)
    size = (end - start)[one]
    rank = np.zeros(len(one), np.int64)
    groups = np.arange(len(one))
    for k in range(int(size.max(initial=0)) - 1, -1, -1):  # from the last word to the first: stable sorts
        word = np.where(size[groups] > k, p.word[np.minimum(start[one[groups]] + k, len(p.word) - 1)], np.uint64(0))
        groups = groups[np.argsort(word, kind="stable")]
    rank[groups] = np.arange(1, len(one) + 1)
    value = np.zeros(len(p.cut) + 1, np.int64)  # 0: beyond the document
    value[some] = rank[which]
    of = np.full(len(p.cut) + 1, -1)
    of[:-1] = p.doc[p.cut - 1]
    step = 1
    while step < DEPTH:
        ahead = np.minimum(np.arange(len(p.cut)) + step, len(p.cut))
        pair = (value[:-1] << 32) | np.where(of[ahead] == of[:-1], value[ahead], 0)
        value[:-1] = np.unique(pair, return_inverse=True)[1] + 1
        step *= 2
    order = np.argsort(value[j], kind="stable")
    a = p.cut[j[order]] - TRIGGER
    room = p.right[j[order]] - a
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        lo, hi = np.zeros(len(order) - 1, np.int64), np.minimum(room[1:], room[:-1])
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = p.hash(a[1:], a[1:] + mid) == p.hash(a[:-1], a[:-1] + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        shared[1:] = lo
    return order, shared


def corpus_order(p: Parse, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A number for each window (its start and first cut) in the order of the block's windows of one length of suffix; equal windows have equal numbers."""
    j, at = np.unique(owner, return_inverse=True)
    order, shared = parse_order(p, j)
    place = np.zeros(len(j), np.int64)
    place[order] = np.arange(len(order))
    # the dictionary: what lies before each cut, each distinct one once
    _, one, which = np.unique(W.mix(p.hash(p.left[j], p.cut[j]) + np.uint64(1)), return_index=True, return_inverse=True)
    cut, size = p.cut[j[one]], (p.cut - p.left)[j[one]]
    words = np.unique(p.word)
    s = p.cut[owner] - x
    by = np.argsort(s, kind="stable")
    bounds = np.searchsorted(s[by], np.arange(LEAST + 2))
    number, used = np.zeros(len(x), np.int64), 0
    rank, live = np.zeros(len(one), np.int64), np.arange(len(one))
    for n in range(1, LEAST + 1):
        live = live[size[live] >= n]
        if not len(live):
            break
        rank[live] = np.unique((np.searchsorted(words, p.word[cut[live] - n]) << 32) | rank[live], return_inverse=True)[1]
        mine = by[bounds[n] : bounds[n + 1]]
        if len(mine):
            same = np.cumsum(shared < LEAST - n + TRIGGER)  # one number for suffixes that share a window's rest
            pair = (rank[which[at[mine]]] << 32) | same[place[at[mine]]]
            u, inv = np.unique(pair, return_inverse=True)
            number[mine] = used + inv
            used += len(u)
    return number


def ask_phrases(n: int):
    def run(docs: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(ask(docs["b"][0].as_py(), n, Parse(docs).phrases()[1])), schema=ASK_FIELDS)

    return run


def ask_contexts(n: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            p = Parse(docs)
            j, h = p.contexts(p.windows(Known(known))[1])
            out = list(ask(docs["b"][0].as_py(), n, h, *_place(p, p.left[j])))
        return pa.Table.from_batches(out, schema=ASK_FIELDS)

    return run


def _place(p: Parse, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = p.doc[x]
    return p.ids[d], x - p.first[d]


def _open(p: Parse, known: pa.Table):
    """(starts, first cuts, whether the context repeats, whether the window is looked up) of the block's candidates."""
    x, owner = p.windows(Known(known))
    j, h = p.contexts(owner)
    code = Known(known, 1)(h)
    lead = firsts(h, *_place(p, p.left[j]), code)
    at = np.searchsorted(j, owner)
    has = owner >= 0
    at = np.where(has, at, 0)
    again = has & (code[at] > 0) if len(j) else has
    return x, owner, again, ~again | (lead[at] if len(j) else False)


def ask_windows(n: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            p, b = Parse(docs), docs["b"][0].as_py()
            x, owner, _, look = _open(p, known)
            x, owner = x[look], owner[look]
            if len(x):
                has = owner >= 0
                number = np.zeros(len(x), np.int64)
                number[has] = corpus_order(p, x[has], owner[has]) if has.any() else 0
                bare = p.hash(x[~has], x[~has] + LEAST)
                number[~has] = number.max(initial=0) + 1 + np.unique(bare, return_inverse=True)[1]
                doc, at = _place(p, x)
                order = np.lexsort((at, doc, number))
                lead = np.flatnonzero(np.concatenate([[True], number[order[1:]] != number[order[:-1]]]))
                many = np.diff(np.append(lead, len(order))) > 1
                lead = order[lead]
                out = list(ask_distinct(b, n, p.hash(x[lead], x[lead] + LEAST), many, doc[lead], at[lead]))
        return pa.Table.from_batches(out, schema=ASK_FIELDS)

    return run


def spans(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Maximal stretches of one role of each document of a block."""
    if not docs.num_rows:
        return _OUT.empty_table()
    p = Parse(docs)
    x, owner, again, look = _open(p, known)
    h = p.hash(x, x + LEAST)
    code = np.where(look, Known(known, 2)(h), 0)
    doc, at = _place(p, x)
    # a repeated context's first place that no other context's window equals is the first of its windows
    first = firsts(h, doc, at, code) | (look & again & (code == 0))
    some = again | (code > 0)
    doc, at, first = doc[some], at[some], first[some]
    order = np.lexsort((at, doc))
    doc, at, first = doc[order], at[order], first[order]
    s = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(s, len(doc))) + LEAST - 1
    return pa.table([pa.array(doc[s]), pa.array(at[s], pa.int32()), pa.array(at[s] + size, pa.int32()), pa.array(size, pa.int32()), pa.array(first[s])], schema=_OUT)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first) of each repeated passage of at least 50 words."""
    n = partitions(docs.sparkSession)
    rows = docs_by_bucket(one_row_per_id(docs), n)
    known = answers(rows.groupBy("b").applyInArrow(ask_phrases(n), ASK), n)
    for stage, step in ((1, ask_contexts), (2, ask_windows)):
        more = answers(rows.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(step(n), ASK), n, stage)
        known = by_bucket(known.unionByName(more), n)
    return rows.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(spans, SCHEMA)
