"""Packing token sequences into fixed windows by non-negative least squares.

A document's length is its number of words and punctuation marks (see ``lengths``);
one longer than the window is cut into whole windows and a rest.  The pieces' length
histogram has at most ``window`` bins whatever the corpus.  Shallow combinations (one
to ``DEPTH`` lengths that fill a window to at least ``FULL``) are enumerated over
representative lengths, repeat counts are solved against the histogram by non-negative
least squares, rounded down, and what is left is packed greedily (best fit decreasing,
on the histogram).  The plan is a list of (pattern of lengths, repeats); documents take
its places by their rank within their length, so no document passes through the driver.

Cases: null, empty and token-free texts need no place and get no row; rows without an id
are packed like any other (doc_id null); repeated rows are packed each; ties in length are
broken by id, those without one first, and then by a hash of the text; an empty table gives
no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW, DEPTH, FULL = 2048, 3, 0.99
SCHEMA = "doc_id long, piece int, n_tokens int, tie long"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lengths(texts: pa.Array) -> np.ndarray:
    """Tokens of each text: its words, and each ASCII punctuation character."""
    texts = W.fill(texts)
    off, data = W.buffers(texts)
    if not len(data):
        return np.zeros(len(texts), np.int64)
    word = W.word_bytes(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1]] = True
    token = (word & (~np.concatenate([[False], word[:-1]]) | edge[:-1])) | (~word & ~_SPACE[data] & (data < 128) & (data > 32))
    total = np.concatenate([[0], np.cumsum(token)])
    return total[off[1:]] - total[off[:-1]]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| over x >= 0, by active sets: columns enter one by one until none would lower the residual."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    barred = np.zeros(a.shape[1], bool)
    while True:
        gain = np.where(used | barred, -np.inf, a.T @ (b - a @ x))
        k = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[k] <= tol:
            return x
        used[k] = True
        while True:
            s = np.zeros(len(x))
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (s <= 0)
            if not low.any():
                break
            if low[k] and x[k] == 0:  # no descent but by rounding
                used[k], barred[k], s = False, True, x
                break
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            used &= x > 1e-12
            x[~used] = 0
        if s is not x:
            x, barred = s, np.zeros(len(x), bool)


def plan(hist: np.ndarray, window: int = WINDOW, depth: int = DEPTH, groups: int = 120) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of windows that together hold every piece of the histogram (index: length) exactly once."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    present = np.flatnonzero(left)
    if len(present) > 1:
        # groups of lengths with about equal mass; a place of a group takes its lengths from the longest down
        mass = np.cumsum(left[present] * present)
        group = np.minimum((mass - 1) * groups // mass[-1], groups - 1)
        group = np.unique(group, return_inverse=True)[1]
        n = group.max() + 1
        top = np.array([present[group == k].max() for k in range(n)])
        low = np.array([present[group == k].min() for k in range(n)])
        count = np.array([left[present[group == k]].sum() for k in range(n)], float)
        combos = [(k,) for k in range(n) if low[k] >= FULL * window]
        combos += [(i, j) for i in range(n) for j in range(i, n) if FULL * window <= top[i] + top[j] <= window]
        if depth > 2:
            combos += [(i, j, k) for i in range(n) for j in range(i, n) for k in range(j, n) if FULL * window <= top[i] + top[j] + top[k] <= window]
        if combos:
            a = np.zeros((n, len(combos)))
            for c, combo in enumerate(combos):
                for k in combo:
                    a[k, c] += 1
            repeat = np.floor(nnls(a, count) + 1e-6).astype(np.int64)
            queue = [[[int(x), int(left[x])] for x in present[group == k][::-1]] for k in range(n)]
            for c in np.argsort(-repeat, kind="stable"):
                out += _draw(queue, combos[c], int(repeat[c]), left)
    return out + greedy(left, window)


def _draw(queue, combo, repeat: int, left) -> list[tuple[tuple[int, ...], int]]:
    """Up to ``repeat`` windows of a combination of groups, as runs of equal lengths."""
    out = []
    need = {k: combo.count(k) for k in combo}
    while repeat > 0:
        if any(sum(c for _, c in queue[k]) < n for k, n in need.items()):
            break
        pick = []
        for k, n in need.items():
            # n pieces of the group: the same length if there are enough of it
            at, got = 0, []
            while n:
                length, c = queue[k][at]
                take = min(n, c)
                got.append((k, length, take, c))
                n, at = n - take, at + 1
            pick += got
        times = min([repeat] + [c // take for _, _, take, c in pick])
        for k, length, take, _ in pick:
            entry = next(e for e in queue[k] if e[0] == length)
            entry[1] -= take * times
            left[length] -= take * times
            if not entry[1]:
                queue[k].remove(entry)
        out.append((tuple(length for _, length, take, _ in pick for _ in range(take)), times))
        repeat -= times
    return out


def greedy(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram; equal windows are filled at once."""
    left = hist.astype(np.int64).copy()
    out = []
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        room, used = window, {}
        while True:
            some = np.flatnonzero(left[: room + 1] - np.array([used.get(x, 0) for x in range(room + 1)]) > 0) if used else np.flatnonzero(left[: room + 1])
            if not len(some):
                break
            x = int(some[-1])
            take = min(room // x, int(left[x]) - used.get(x, 0))
            used[x] = used.get(x, 0) + take
            room -= x * take
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        out.append((tuple(x for x, n in used.items() for _ in range(n)), times))


def places(patterns) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: rows (first rank, first window, pieces of it in each window, offset of the first)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    window = 0
    for lens, times in patterns:
        at = 0
        for x in dict.fromkeys(lens):
            n = lens.count(x)
            runs.setdefault(x, []).append((taken.get(x, 0), window, n, at))
            taken[x] = taken.get(x, 0) + n * times
            at += x * n
        window += times
    return {x: np.array(r, np.int64) for x, r in runs.items()}


def _pieces(window: int):
    def run(batches):
        for part in W.slices(batches):
            n = lengths(part.column("text"))
            d = np.flatnonzero(n)
            count = -(-n[d] // window)
            doc = np.repeat(d, count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(window, n[doc] - piece * window)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), part.column("tie").take(pa.array(doc))], names=["doc_id", "piece", "n_tokens", "tie"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, salts: int = 64) -> DataFrame:
    """(doc_id, piece, n_tokens, window_id, offset): where each piece of each document goes.

    Ranks within a length are made in two steps (within length and salt, then the salts'
    offsets), so that a frequent length doesn't meet in one task.
    """
    spark = docs.sparkSession
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    pieces = rows.mapInArrow(_pieces(window), SCHEMA).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("n_tokens", "salt").count().collect()  # at most window * salts rows
    hist, table = np.zeros(window + 1, np.int64), np.zeros((window + 1, salts), np.int64)
    for r in counts:
        table[r["n_tokens"], r["salt"]] += r["count"]
    hist = table.sum(axis=1)
    before = np.cumsum(table, axis=1) - table
    shared = spark.sparkContext.broadcast((places(plan(hist, window, depth)), before))

    def run(batches):
        """Rows sorted by length and salt: a group's ranks go on over batches."""
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, before = shared.value
            size, salt = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "salt"))
            key = size * salts + salt
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            where, offset = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(key))):
                if key[a] != last:
                    last, seen = key[a], 0
                rank = before[size[a], salt[a]] + seen + np.arange(b - a)
                seen += b - a
                r = runs[int(size[a])]
                k = np.searchsorted(r[:, 0], rank, side="right") - 1
                inside = rank - r[k, 0]
                where[a:b] = r[k, 1] + inside // r[k, 2]
                offset[a:b] = r[k, 3] + inside % r[k, 2] * size[a]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(where), pa.array(offset, pa.int32())], names=["doc_id", "piece", "n_tokens", "window_id", "offset"])

    ranked = pieces.repartition("n_tokens", "salt").sortWithinPartitions("n_tokens", "salt", "doc_id", "piece", "tie")
    return ranked.select("doc_id", "piece", "n_tokens", "salt").mapInArrow(run, "doc_id long, piece int, n_tokens int, window_id long, offset int")
