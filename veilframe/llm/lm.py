"""Language-model scoring with a weighted backoff automaton.

Symbols are the UTF-8 bytes of the lower-cased text (each run of white space is one
space), framed by a start and an end symbol.  n-grams up to ``ORDER`` are counted over the
whole corpus and smoothed by interpolated absolute discounting:

    p(w | h) = max(c(hw) - D, 0) / c(h.) + lambda(h) p(w | h'),   lambda(h) = D N1+(h.) / c(h.)

which in backoff form is an automaton: each context is a state; a seen n-gram is an arc
with weight log p(w | h) to the longest context that ends the text read; every state has a
failure arc with weight log lambda(h) to the state of its context without the oldest symbol.
No n-gram is pruned: the model holds all that the corpus has, and grows with it.

The model is never gathered whole: documents are hashed to blocks; a block counts its own n-grams, the counts meet by context, and exactly the arcs
that a block's documents can take come back to it.  There the automaton is built and each
text is read once from left to right, carrying the state.

Cases: a null or empty text is scored as start, end (n_symbols 1); every row counts and is
scored, rows without an id (id null) and several rows of one id too, so equal rows have equal
scores; a very long text is read in lanes of ``LANE`` symbols whose states are the same as in
one pass; an empty corpus gives no rows; other columns of the table, whatever their names,
aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from .exchange import Packer, by_bucket, partitions, rows_by_bucket, schema, unpack

ORDER, DISCOUNT = 5, 0.75
BOS, EOS, ALPHABET = 1, 2, 256
LANE = 256
SCHEMA = "doc_id long, n_symbols int, log_prob double, perplexity double"
COUNTS = (["h", "sym", "n", "home"], ["<u8", "u1", "<u4", "<i4"])
ARCS = (["h", "sym", "share", "rest"], ["<u8", "u1", "<f4", "<f4"])


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and symbols of all texts, each ending with EOS (the start is not stored)."""
    clean = pc.replace_substring_regex(pc.utf8_lower(W.fill(texts)), r"[\x00-\x20]+", " ")
    off, data = W.buffers(clean)
    n = len(texts)
    out = np.full(len(data) + n, EOS, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))
    out[at] = data
    return off + np.arange(n + 1), out


def grams(off: np.ndarray, data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The ``order`` symbols that end at each position, as one integer (oldest symbol highest; BOS before the text)."""
    code = np.zeros(len(data), np.uint64)
    for k in range(order - 1, -1, -1):
        prev = np.full(len(data), BOS, np.uint64)
        prev[k:] = data[: len(data) - k]
        if k:
            head = off[:-1][:, None] + np.arange(k)
            head = head[head < off[1:][:, None]]
            prev[head] = BOS
        code = (code << np.uint64(8)) | prev
    return code


def context(codes: np.ndarray, n: int) -> np.ndarray:
    return codes | np.uint64(n << 56)


def count_blocks(n: int, order: int):
    def run(batches):
        """A partition's documents, by block; only distinct n-grams leave it."""
        held: dict[int, list[np.ndarray]] = {}
        for part in W.slices(batches):
            home = part.column("b").to_numpy(zero_copy_only=False)
            off, data = symbols(part.column("text"))
            code = grams(off, data, order)
            owner = np.repeat(home, np.diff(off))
            for b in np.unique(home):
                u, c = np.unique(code[owner == b], return_counts=True)
                held.setdefault(int(b), []).append((u, c))
        packer = Packer(*COUNTS, n)
        for b, parts in held.items():
            full = np.concatenate([p[0] for p in parts])
            count = np.concatenate([p[1] for p in parts])
            for h, sym, c in _merge(full, count, order):
                yield from packer.add(W.mix(h) % np.uint64(n), h, sym, c, np.full(len(h), b))
        yield from packer.flush()

    return run


def _merge(full: np.ndarray, count: np.ndarray, order: int):
    """(context, symbol, count) of the n-grams of every order; a context's length is its highest byte."""
    for n in range(order, 0, -1):
        part = full & np.uint64((1 << (8 * n)) - 1)
        o = np.argsort(part, kind="stable")
        s = part[o]
        if not len(s):
            continue
        lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        part, c = s[lead], np.add.reduceat(count[o], lead)
        yield context(part >> np.uint64(8), n - 1), (part & np.uint64(255)).astype(np.uint8), c
        full, count = part, c


def smooth(h: np.ndarray, count: np.ndarray, discount: float):
    """share = (c - D) / c(h.) and rest = lambda(h) of each distinct, sorted (context, symbol)."""
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(lead, len(h)))
    total = np.repeat(np.add.reduceat(count.astype(np.float64), lead), size)
    return (count - discount) / total, discount * np.repeat(size, size) / total


def smooth_blocks(n: int, discount: float):
    def run(batches):
        h, sym, count, home = unpack(batches, *COUNTS)
        order = np.lexsort((sym, h))
        h, sym, count, home = h[order], sym[order], count[order], home[order]
        packer = Packer(*ARCS, n)
        if len(h):
            lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (sym[1:] != sym[:-1])]))
            share, rest = smooth(h[lead], np.add.reduceat(count.astype(np.int64), lead), discount)
            which = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(h))))
            yield from packer.add(home, h, sym, share[which], rest[which])
        yield from packer.flush()

    return run


class Automaton:
    """States are contexts; arcs lie in a hash table keyed by (state, symbol)."""

    def __init__(self, h: np.ndarray, sym: np.ndarray, share: np.ndarray, rest: np.ndarray, order: int = ORDER):
        o = np.lexsort((sym, h))
        h, sym, share, rest = h[o], sym[o], share[o].astype(np.float64), rest[o].astype(np.float64)
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.order, self.states = order, h[lead]
        self.n = len(self.states)
        size = (self.states >> np.uint64(56)).astype(np.int64)
        body = self.states & np.uint64((1 << 56) - 1)
        # failure: the longest shorter context that is a state
        self.fail = np.full(self.n, -1, np.int64)
        for k in range(self.n and order - 1, 0, -1):
            mine = np.flatnonzero(size == k)
            left = mine
            for m in range(k - 1, -1, -1):
                to = self.state(context(body[left] & np.uint64((1 << (8 * m)) - 1), m))
                self.fail[left[to >= 0]] = to[to >= 0]
                left = left[to < 0]
        self.rest = np.log(np.maximum(rest[lead], 1e-30))
        source = np.repeat(np.arange(self.n), np.diff(np.append(lead, len(h))))
        # p(w | h) from the lower orders upwards
        key = (source.astype(np.uint64) << np.uint64(8)) | sym
        p = np.zeros(len(h))
        arc_size = size[source]
        for k in range(order):
            mine = np.flatnonzero(arc_size == k)
            if not len(mine):
                continue
            if k == 0:
                p[mine] = share[mine] + rest[mine] / ALPHABET
            else:
                p[mine] = share[mine] + rest[mine] * np.exp(self._lower(key, p, self.fail[source[mine]], sym[mine]))
        self.log_p = np.log(p)
        # target: the longest state that ends context + symbol
        target = np.full(len(h), -1, np.int64)
        whole = ((h & np.uint64((1 << 56) - 1)) << np.uint64(8)) | sym
        open_ = np.arange(len(h))
        for m in range(order - 1, -1, -1):
            can = open_[np.minimum(arc_size[open_] + 1, order - 1) >= m]
            to = self.state(context(whole[can] & np.uint64((1 << (8 * m)) - 1), m))
            target[can[to >= 0]] = to[to >= 0]
            open_ = open_[target[open_] < 0]
        self.target = target
        # open addressing, at most half full
        bits = max(4, int(len(h) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_arc = np.zeros(1 << bits, np.int32)
        todo, at = np.arange(len(h)), self._slot(key)
        while len(todo):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = key[todo[free]].astype(np.int64)
            self.slot_arc[at[free]] = todo[free]
            lost = self.slot_key[at] != key[todo].astype(np.int64)
            todo, at = todo[lost], (at[lost] + 1) & ((1 << bits) - 1)
        # a first state: the longest one that ends a row of BOS
        self.begin = next(int(s[0]) for m in range(order - 1, -1, -1) if (s := self.state(context(np.array([int.from_bytes(bytes([BOS]) * m, "big")], np.uint64), m)))[0] >= 0) if self.n else 0

    def state(self, contexts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.states, contexts), max(0, self.n - 1))
        return np.where(self.states[at] == contexts, at, -1)

    def _lower(self, key, p, state, sym):
        """log p(sym | state) with the arcs whose p is known; backs off."""
        out = np.zeros(len(state))
        live, s = np.arange(len(state)), state.copy()
        while len(live):
            want = (s[live].astype(np.uint64) << np.uint64(8)) | sym[live]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[at] == want
            out[live[hit]] += np.log(p[at[hit]])
            live = live[~hit]
            out[live] += self.rest[s[live]]
            root = self.fail[s[live]] < 0
            out[live[root]] -= np.log(ALPHABET)
            live = live[~root]
            s[live] = self.fail[s[live]]
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def arc(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Number of the arc of each (state, symbol); -1 where there is none."""
        key = (state.astype(np.uint64) << np.uint64(8)) | sym
        at = self._slot(key)
        key = key.astype(np.int64)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_arc[at], -1)
        live = np.flatnonzero((found != key) & (found >= 0))
        last = len(self.slot_key) - 1
        while len(live):
            at[live] = (at[live] + 1) & last
            found = self.slot_key[at[live]]
            hit = found == key[live]
            out[live[hit]] = self.slot_arc[at[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log-probabilities; failure arcs are followed until a symbol's arc exists."""
        arc = self.arc(state, sym)
        score, to = self.log_p[arc], self.target[arc]
        live = np.flatnonzero(arc < 0)
        if len(live):
            score[live], s = 0.0, state[live]
            while len(live):
                score[live] += self.rest[s]
                s = self.fail[s]
                root = s < 0
                if root.any():  # a symbol that the empty context doesn't know
                    score[live[root]] -= np.log(ALPHABET)
                    to[live[root]] = self.state(np.zeros(1, np.uint64))[0]
                    live, s = live[~root], s[~root]
                arc = self.arc(s, sym[live])
                hit = arc >= 0
                score[live[hit]] += self.log_p[arc[hit]]
                to[live[hit]] = self.target[arc[hit]]
                live, s = live[~hit], s[~hit]
        return to, score

    def read(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Sum of log-probabilities of each text.

        All texts are read side by side.  A long text is read in lanes of ``LANE`` symbols;
        a lane is brought to its state by the ``order - 1`` symbols before it, on which alone
        the state depends.
        """
        size = np.diff(off)
        lanes = np.maximum(1, -(-size // LANE))
        doc = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = off[doc] + k * LANE
        stop = np.minimum(start + LANE, off[doc + 1])
        state = np.full(len(doc), self.begin, np.int64)
        total = np.zeros(len(doc))
        for back in range(self.order - 1, 0, -1):
            at = start - back
            live = np.flatnonzero((k > 0) & (at >= off[doc]))
            if len(live):
                if back == self.order - 1:
                    state[live] = self.state(np.zeros(1, np.uint64))[0]
                state[live] = self.step(state[live], data[at[live]])[0]
        rank = np.argsort(-(stop - start), kind="stable")
        state, total, start, length = state[rank], total[rank], start[rank], (stop - start)[rank]
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, side="left"))
            state[:m], score = self.step(state[:m], data[start[:m] + t])
            total[:m] += score
        return np.bincount(doc[rank], weights=total, minlength=len(size))


def score_block(order: int):
    def run(docs: pa.Table, arcs: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            machine = Automaton(*unpack(arcs, *ARCS), order)
            for part in W.slices(docs.to_batches()):
                off, data = symbols(part.column("text"))
                n = np.diff(off)
                total = machine.read(off, data)
                out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int32()), pa.array(total), pa.array(np.exp(-total / n))], names=["doc_id", "n_symbols", "log_prob", "perplexity"]))
        return pa.Table.from_batches(out, schema=pa.schema([("doc_id", pa.int64()), ("n_symbols", pa.int32()), ("log_prob", pa.float64()), ("perplexity", pa.float64())]))

    return run


def score(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) of every document under the model of all documents."""
    n = partitions(docs.sparkSession)
    rows = rows_by_bucket(docs, n)
    counts = by_bucket(rows.mapInArrow(count_blocks(n, order), schema(COUNTS[0])), n)
    arcs = by_bucket(counts.mapInArrow(smooth_blocks(n, discount), schema(ARCS[0])), n)
    return rows.groupBy("b").cogroup(arcs.groupBy("b")).applyInArrow(score_block(order), SCHEMA)
