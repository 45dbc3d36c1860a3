"""Vectorised tokenisation of Arrow string columns.

A word is a maximal run of ASCII letters or digits and of non-ASCII characters,
after Unicode lower-casing.  U+0080-U+00BF, U+2000-U+203F and U+3000-U+303F
(punctuation and spaces) separate words as ASCII punctuation does.  Everything
works on the UTF-8 buffer of a whole batch, so no Python object exists per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
BASE = 0xD6E8FEB86659FD93
_MASK = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], dtype=np.uint64)

WORD = np.zeros(256, dtype=bool)
WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    WORD[_c] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def fill(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones, with 64-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a non-null large_string array; offsets begin at 0."""
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


@dataclass
class Words:
    """Words of a batch in reading order; byte positions refer to ``data``."""

    n_docs: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    is_word = WORD[data]
    for lead in (0xC2,):
        at = np.flatnonzero(data == lead)
        is_word[at] = False
        is_word[np.minimum(at + 1, len(data) - 1)] = False
    for lead, second in ((0xE2, 0x80), (0xE3, 0x80)):
        at = np.flatnonzero(data[:-2] == lead) if len(data) > 2 else np.zeros(0, np.int64)
        at = at[data[at + 1] == second]
        for k in range(3):
            is_word[at + k] = False
    return is_word


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(pad) - 7,), dtype="<u8", buffer=pad, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = size[live] - at
        out[live] = mix(out[live] ^ (eight[start[live] + at] & _MASK[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    return out


def tokenize(texts: pa.Array, lower: bool = True) -> Words:
    """Words of each text; null and empty texts have none."""
    texts = fill(texts)
    if lower:
        texts = pc.utf8_lower(texts)
    off, data = buffers(texts)
    n = len(texts)
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(n, z, z, z, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), off, data)
    is_word = word_bytes(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off[:-1]] = True
    before = np.concatenate([[False], is_word[:-1]])
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate([is_word[1:], [False]])
    edge_end = np.zeros(len(data) + 1, dtype=bool)
    edge_end[off[1:]] = True
    end = np.flatnonzero(is_word & (~after | edge_end[1:])) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(n, doc, start, end, hash_spans(data, start, end), first, off, data)


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive values (length n - size + 1)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, done, cur, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out, done = cur, width
            else:
                m = len(h) - (done + width) + 1
                out = out[:m] * np.uint64(pow(BASE, width, 1 << 64)) + cur[done : done + m]
                done += width
        if done == size:
            return mix(out)
        m = len(h) - 2 * width + 1
        cur = cur[:m] * np.uint64(pow(BASE, width, 1 << 64)) + cur[width : width + m]
        width *= 2


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indices and hashes of all windows that lie inside one document."""
    h = window_hash(w.hash, size)
    if not len(h):
        return np.zeros(0, np.int64), h
    ok = np.flatnonzero(w.doc[: len(h)] == w.doc[size - 1 : size - 1 + len(h)])
    return ok, h[ok]


def slices(batches, column: str = "text", most: int = 6_000_000):
    """Cut record batches so that a piece holds about ``most`` bytes of text; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals in which a boolean array is true."""
    d = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
