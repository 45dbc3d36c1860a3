"""Boxes of many groups at once in numpy, for Arrow batches.

A set of boxes is four integer arrays and the number of boxes of each group.  Memory is bounded: groups
are taken in slices, a group of very many boxes by itself and in parts.
"""

from __future__ import annotations

import numpy as np

#: Cells of a temporary table.
CELLS = 1 << 20
FAR = -(1 << 62)


def flat(column, keys: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of an Arrow list column and the flat arrays of its structs' fields; nulls are empty lists and zeros."""
    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = lists.flatten()
    return n, [rows.field(rows.type.get_field_index(k)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]


def starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n)))


def join_sets(a, b):
    """The boxes of two sets, group by group: (lengths, fields)."""
    (na, fa), (nb, fb) = a, b
    n = na + nb
    at = starts(n)
    out = [np.empty(at[-1], np.int64) for _ in fa]
    ia = np.repeat(at[:-1] - starts(na)[:-1], na) + np.arange(na.sum())
    ib = np.repeat(at[:-1] + na - starts(nb)[:-1], nb) + np.arange(nb.sum())
    for o, x, y in zip(out, fa, fb):
        o[ia], o[ib] = x, y
    return n, out


def clip(boxes, width: int, height: int):
    """A set cut to a canvas."""
    n, (x1, y1, x2, y2) = boxes
    return n, [np.maximum(x1, 0), np.maximum(y1, 0), np.minimum(x2, width), np.minimum(y2, height)]


def union_area(boxes) -> np.ndarray:
    """Area of the union of each group's boxes, slab by slab between the x edges; empty boxes count nothing."""
    n, (x1, y1, x2, y2) = boxes
    good = (x2 > x1) & (y2 > y1)
    if not good.all():
        owner = np.repeat(np.arange(len(n)), n)[good]
        n = np.bincount(owner, minlength=len(n))
        x1, y1, x2, y2 = x1[good], y1[good], x2[good], y2[good]
    at, out = starts(n)[:-1], np.zeros(len(n), np.int64)
    for k in np.unique(n):
        if not k:
            continue
        which = np.flatnonzero(n == k)
        step = max(1, CELLS // (2 * k))
        for i in range(0, len(which), step):
            some = which[i : i + step]
            place = at[some, None] + np.arange(k)
            place = np.take_along_axis(place, np.argsort(y1[place], axis=1), 1)
            l, r, t, b = x1[place], x2[place], y1[place], y2[place]
            if k == 1:
                out[some] = ((r - l) * (b - t))[:, 0]
                continue
            edges = np.sort(np.concatenate((l, r), axis=1), axis=1)
            lo, hi = edges[:, :-1], edges[:, 1:]
            covered, end = np.zeros(lo.shape, np.int64), np.full(lo.shape, FAR)
            for j in range(k):
                low = np.where((l[:, j, None] <= lo) & (r[:, j, None] >= hi), b[:, j, None], FAR)
                covered += np.maximum(0, low - np.maximum(t[:, j, None], np.minimum(end, low)))
                np.maximum(end, low, out=end)
            out[some] = (covered * (hi - lo)).sum(axis=1)
    return out


def evaluated(gold, pred, least: float) -> dict[str, np.ndarray]:
    """Of each group: one-to-one matches by falling (IoU, gold index, prediction index) down to ``least``, sum of best IoUs, sum of covered shares (J11, SP8, SP9).

    Both sets have the fields idx, x1, y1, x2, y2, rows of a group in order of idx.
    """
    (n, g), (m, p) = gold, pred
    owner = np.repeat(np.arange(len(n)), n)
    many, first = m[owner], starts(m)[owner]
    g_area, p_area = (np.maximum(0, f[3] - f[1]) * np.maximum(0, f[4] - f[2]) for f in (g, p))
    best, cover, kept = np.zeros(len(owner)), np.zeros(len(owner)), []
    ends, lo = np.cumsum(many), 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        k = many[lo:hi]
        gi = np.repeat(np.arange(lo, hi), k)
        at = starts(k)
        pi = np.arange(at[-1]) + np.repeat(first[lo:hi] - at[:-1], k)
        cut = [np.maximum(g[1][gi], p[1][pi]), np.maximum(g[2][gi], p[2][pi]), np.minimum(g[3][gi], p[3][pi]), np.minimum(g[4][gi], p[4][pi])]
        both = np.maximum(0, cut[2] - cut[0]) * np.maximum(0, cut[3] - cut[1])
        iou = np.where(both > 0, both / np.maximum(1, g_area[gi] + p_area[pi] - both), 0.0)
        some = np.flatnonzero(k)
        if len(some):
            best[lo + some] = np.maximum.reduceat(iou, at[some])
            cover[lo:hi] = union_area((k, cut)) / np.maximum(1, g_area[lo:hi])
        keep = iou >= least
        kept.append((gi[keep], pi[keep], iou[keep]))
        lo = hi
    total = lambda v: np.bincount(owner, v, len(n))
    return {"tp": _greedy(n, m, g[0], p[0], owner, kept), "iou": total(best), "cov": total(cover)}


def _greedy(n, m, g_idx, p_idx, owner, kept) -> np.ndarray:
    tp = np.zeros(len(n), np.int64)
    if not sum(len(x[0]) for x in kept):
        return tp
    gi, pi, iou = (np.concatenate(x) for x in zip(*kept))
    who = owner[gi]
    order = np.lexsort((-p_idx[pi], -g_idx[gi], -iou, who))
    gi, pi, who = gi[order], pi[order], who[order]

    def ids(owners, idx):  # rows of one index count as one box
        return np.cumsum(np.concatenate(([True], (owners[1:] != owners[:-1]) | (idx[1:] != idx[:-1])))) - 1

    gi, pi = ids(owner, g_idx)[gi], ids(np.repeat(np.arange(len(m)), m), p_idx)[pi]
    free_g, free_p = np.ones(len(g_idx), bool), np.ones(len(p_idx), bool)
    begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    left = np.diff(np.append(begin, len(who)))
    for rank in range(left.max()):
        on = left > rank
        begin, left = begin[on], left[on]
        at = begin + rank
        at = at[free_g[gi[at]] & free_p[pi[at]]]
        free_g[gi[at]] = free_p[pi[at]] = False
        tp[who[at]] += 1
    return tp
