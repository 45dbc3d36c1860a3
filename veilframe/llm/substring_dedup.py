"""Substring dedup by level-wise doubling.

Lengths are in words.  Level 0 hashes windows of ``FIRST`` = 25 words at winnowed starts
(the least hash among 26 neighbouring windows), so every passage of 50 words holds at
least one.  Only around windows that repeat, level 1 hashes the window of ``LEAST`` = 50
words at every start: a start is *repeated* if its 50 words occur at another place of the
corpus.  From then on windows that repeat at one length alone are extended to twice that
length: at each level 100, 200, ... words every start whose two halves and all between them
repeated is looked up again, each hash made of its two halves' hashes, until no candidates
survive.

The result is exact for passages of 50 words and more, up to the chance that 64-bit hashes
of different windows meet: a row is a maximal stretch of repeated starts with one role.
``first`` stretches hold the first occurrence (least doc_id, then position) of their windows
and stay in a deduplicated corpus; the others are copies.  ``longest`` is the greatest level
at which a window that repeats holds a window of the stretch.  Occurrences within one
document count as well.

Cases: null and empty texts and texts under 50 words have no rows; rows without an id
aren't compared; several rows of one id count as one document, the least text; ties are
settled by doc_id and position; an empty table gives no rows; a very long text is cut
between no words: it has as many starts as words; other columns, whatever their names,
aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import by_bucket, cut, docs_by_bucket, one_row_per_id, partitions
from .tally import ASK, ASK_FIELDS, Known, answers, ask, firsts

FIRST, LEAST = 25, 50
SCHEMA = "doc_id long, start_word int, end_word int, n_words int, longest int, first boolean"
REGIONS = "b int, doc_id long, at int, n int, level int, g binary, first binary"
_REGIONS = pa.schema([("b", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("level", pa.int32()), ("g", pa.binary()), ("first", pa.binary())])


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over every window of ``size`` values."""
    out, width = x, 1
    while width < size:
        step = min(width, size - width)
        out = op(out[: len(out) - step], out[step:])
        width += step
    return out


def winnow(x: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Indices whose value is the least of some valid window of ``size`` values; valid[j]: the window that begins at j."""
    if len(x) < size:
        return np.zeros(0, np.int64)
    low = sliding(x, size, np.minimum)
    low = np.where(valid[: len(low)], low, 0)
    pad = np.zeros(size - 1, np.uint64)
    best = sliding(np.concatenate([pad, low, pad]), size, np.maximum)
    return np.flatnonzero((best == x) & (best > 0))


def anchors(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of each winnowed window of FIRST words."""
    h = W.window_hash(w.hash, FIRST)
    if len(w.hash) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = winnow(h, w.doc[: len(w.doc) - LEAST + 1] == w.doc[LEAST - 1 :], LEAST - FIRST + 1)
    return at, h[at]


def ask_anchors(n: int):
    def run(batches):
        """Distinct winnowed windows of each block of a partition."""
        held: dict[int, list[np.ndarray]] = {}
        for part in W.slices(batches):
            w = W.tokenize(part.column("text"))
            i, h = anchors(w)
            home = part.column("b").to_numpy(zero_copy_only=False)[w.doc[i]]
            for b in np.unique(home):
                held.setdefault(int(b), []).append(np.unique(h[home == b], return_counts=True))
        for b, parts in held.items():
            # a hash with several places in a slice is listed twice
            yield from ask(b, n, np.concatenate([np.repeat(u, np.minimum(c, 2)) for u, c in parts]))

    return run


def candidates(docs: pa.Table, repeated: Known):
    """(hash, doc_id, position) of the windows of LEAST words that hold a repeated anchor, of each slice of a block."""
    for part in W.slices(docs.to_batches()):
        w = W.tokenize(part.column("text"))
        at, h = anchors(w)
        at = at[repeated(h) > 0]
        if not len(at):
            continue
        mark = np.zeros(len(w.hash) + 1, np.int32)
        mark[at] = 1
        total = np.concatenate([[0], np.cumsum(mark)])
        i, h = W.windows(w, LEAST)
        near = total[i + LEAST - FIRST + 1] - total[i] > 0
        i, h = i[near], h[near]
        d = w.doc[i]
        yield h, part.column("doc_id").to_numpy(zero_copy_only=False)[d], i - w.first[d]


def _block(found) -> tuple[np.ndarray, ...]:
    parts = list(found)
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def widen(n: int):
    """Asks for the windows of LEAST words at every start whose window holds a repeated anchor."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and known.num_rows:
            out = list(ask(docs["b"][0].as_py(), n, *_block(candidates(docs, Known(known)))))
        return pa.Table.from_batches(out, schema=ASK_FIELDS)

    return run


def regions(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Stretches of repeated starts of each document of a block, with the hashes and roles of their windows."""
    rows = []
    if docs.num_rows and known.num_rows:
        second, kept = Known(known, 1), []
        for h, doc, at in candidates(docs, Known(known)):
            code = second(h)
            some = code > 0
            kept.append((h[some], doc[some], at[some], code[some]))
        if kept:
            h, doc, at, code = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((at, doc))
            h, doc, at, code = h[order], doc[order], at[order], code[order]
            first, g = firsts(h, doc, at, code), (W.mix(h) >> np.uint64(32)).astype("<u4")
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
            b = docs["b"][0].as_py()
            rows = [(b, int(doc[s]), int(at[s]), int(e - s), LEAST, g[s:e].tobytes(), np.packbits(first[s:e]).tobytes()) for s, e in zip(starts, np.append(starts[1:], len(doc)))]
    return _table(rows)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_REGIONS), _REGIONS)], schema=_REGIONS)


def doubled(g: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the windows of ``level`` words at each start, from those of LEAST words."""
    h, size = g.astype(np.uint64), LEAST
    while size < level:
        if len(h) <= size:
            return h[:0]
        h = W.mix(W.mix(h[:-size]) * W.M1 + h[size:])
        size *= 2
    return h


def longer(n: int, level: int):
    """Asks for the windows of ``level`` words at every start of each region."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, g in zip(batch.column("b").to_pylist(), batch.column("g")):
                held.setdefault(b, []).append(doubled(np.frombuffer(g.as_buffer(), "<u4"), level))
        for b, parts in held.items():
            yield from ask(b, n, np.concatenate(parts))

    return run


def survivors(level: int):
    """The maximal stretches of starts of each region that repeat at ``level``."""

    def run(left: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and known.num_rows:
            repeated = Known(known)
            for b, doc, at, g in zip(*(left[c].to_pylist() for c in ("b", "doc_id", "at", "g"))):
                g = np.frombuffer(g, "<u4")
                for s, e in zip(*W.runs(repeated(doubled(g, level)) > 0)):
                    part = g[s : e + level - LEAST]
                    rows.append((b, doc, at + int(s), len(part), level, part.tobytes(), None))
        return _table(rows)

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, longest, first) of each repeated passage of at least 50 words."""
    n = partitions(docs.sparkSession)
    rows = docs_by_bucket(one_row_per_id(docs), n)
    zero = answers(rows.mapInArrow(ask_anchors(n), ASK), n)
    one = answers(rows.groupBy("b").cogroup(zero.groupBy("b")).applyInArrow(widen(n), ASK), n, 1)
    both = by_bucket(zero.unionByName(one), n)
    levels, level = [cut(rows.groupBy("b").cogroup(both.groupBy("b")).applyInArrow(regions, REGIONS))], LEAST
    while True:
        level *= 2
        long = levels[-1].where(F.col("n") > level - LEAST)
        known = answers(long.mapInArrow(longer(n, level), ASK), n)
        now = cut(by_bucket(long.select("b", "doc_id", "at", "g"), n).groupBy("b").cogroup(known.groupBy("b")).applyInArrow(survivors(level), REGIONS))
        if now.isEmpty():
            break
        levels.append(now)
    graded = levels[0].select("b", "doc_id", "at", "n", "level", "first")
    for x in levels[1:]:
        graded = graded.unionByName(x.select("b", "doc_id", "at", "n", "level", "first"))
    return by_bucket(graded, n).mapInArrow(spans, SCHEMA)


def spans(batches):
    """The stretches of one role of each document of a partition, and the greatest level of each."""
    rows = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    doc, at, n, level = (rows[c].to_numpy() for c in ("doc_id", "at", "n", "level"))
    base = np.flatnonzero(level == LEAST)
    base = base[np.lexsort((at[base], doc[base]))]
    docs = np.unique(doc)
    key = (np.searchsorted(docs, doc) << 32) + at
    size = n[base].astype(np.int64)
    offset = np.cumsum(size) - size
    packed = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows["first"].take(pa.array(base)).combine_chunks()]
    bits = np.unpackbits(np.concatenate(packed))
    lengths = np.array([len(x) for x in packed]) * 8
    inside = np.arange(size.sum()) - np.repeat(offset, size)
    role = bits[np.repeat(np.cumsum(lengths) - lengths, size) + inside].astype(bool)
    longest = np.full(len(role), LEAST, np.int32)
    for lv in np.unique(level[level > LEAST]):
        mine = np.flatnonzero(level == lv)
        r = np.searchsorted(key[base], key[mine], side="right") - 1
        place = offset[r] + at[mine] - at[base[r]]
        step = np.zeros(len(role) + 1, np.int32)
        np.add.at(step, place, 1)
        np.add.at(step, place + n[mine], -1)
        longest[np.cumsum(step)[:-1] > 0] = lv
    edge = np.zeros(len(role), bool)
    edge[offset] = True
    edge[1:] |= role[1:] != role[:-1]
    s = np.flatnonzero(edge)
    r = np.searchsorted(offset, s, side="right") - 1
    start = at[base[r]] + inside[s]
    words = (np.diff(np.append(s, len(role))) + LEAST - 1).astype(np.int32)
    top = np.maximum.reduceat(longest, s)
    for k in range(0, len(s), 100_000):
        p = slice(k, k + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[base[r[p]]]), pa.array(start[p], pa.int32()), pa.array((start + words)[p], pa.int32()), pa.array(words[p]), pa.array(top[p]), pa.array(role[s[p]])], names=["doc_id", "start_word", "end_word", "n_words", "longest", "first"]
        )
