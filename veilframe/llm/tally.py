"""Which hashes occur at more than one place of the corpus.

Blocks of documents *ask* with their distinct hashes (so a passage with millions of copies
is one record a block), a hash's bucket counts the places over all blocks, and the *answer*
brings each block those of its hashes that occur twice or more, with the code 2 where the
first place of all (least doc_id, then position) lies in that block, 1 elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import by_bucket

ASK = "b int, home int, h binary, many binary, doc binary, at binary"
ANSWER = "b int, stage int, h binary, code binary"
ASK_FIELDS = pa.schema([("b", pa.int32()), ("home", pa.int32()), *((c, pa.binary()) for c in ("h", "many", "doc", "at"))])
_ANSWER_FIELDS = pa.schema([("b", pa.int32()), ("stage", pa.int32()), ("h", pa.binary()), ("code", pa.binary())])


def ask(home: int, n: int, h: np.ndarray, doc: np.ndarray | None = None, at: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row a bucket: the block's distinct hashes, which have several places here, and the first of them."""
    if not len(h):
        return
    order = np.argsort(h, kind="stable") if doc is None else np.lexsort((at, doc, h))
    lead = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    many = np.diff(np.append(lead, len(order))) > 1
    lead = order[lead]
    yield from ask_distinct(home, n, h[lead], many, None if doc is None else doc[lead], None if at is None else at[lead])


def ask_distinct(home: int, n: int, h: np.ndarray, many: np.ndarray, doc: np.ndarray | None, at: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The same for hashes that are distinct already."""
    to = h % np.uint64(n)
    by = np.argsort(to, kind="stable")
    ids, start = np.unique(to[by], return_index=True)
    out: dict[str, list] = {f.name: [] for f in ASK_FIELDS}
    for b, part in zip(ids, np.split(by, start[1:])):
        place = (b"", b"") if doc is None else (doc[part].astype("<i8").tobytes(), at[part].astype("<i4").tobytes())
        row = (int(b), home, h[part].tobytes(), np.packbits(many[part]).tobytes(), *place)
        for c, v in zip(out, row):
            out[c].append(v)
    yield pa.RecordBatch.from_pydict(out, schema=ASK_FIELDS)


def _column(rows: list[pa.RecordBatch], name: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for r in rows for x in r.column(r.schema.get_field_index(name))]


def _answer(stage: int):
    def run(batches):
        rows = list(batches)
        hs = _column(rows, "h", "<u8")
        if not hs:
            return
        homes = np.concatenate([r.column(1).to_numpy(zero_copy_only=False) for r in rows])
        size = np.array([len(x) for x in hs])
        h = np.concatenate(hs)
        many = np.concatenate([np.unpackbits(m)[:k] for m, k in zip(_column(rows, "many", "u1"), size)]).astype(bool)
        doc, at = np.concatenate(_column(rows, "doc", "<i8")), np.concatenate(_column(rows, "at", "<i4"))
        order = np.lexsort((at, doc, h)) if len(doc) else np.argsort(h, kind="stable")
        s = h[order]
        lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(lead, len(s)))
        twice = (count > 1) | np.logical_or.reduceat(many[order], lead)
        code = np.zeros(len(h), np.uint8)
        code[order] = np.repeat(twice, count)
        code[order[lead[twice]]] = 2
        for k, (a, b) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size))):
            keep = np.flatnonzero(code[a:b]) + a
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array([homes[k]], pa.int32()), pa.array([stage], pa.int32()), pa.array([h[keep].tobytes()], pa.binary()), pa.array([code[keep].tobytes()], pa.binary())], schema=_ANSWER_FIELDS)

    return run


def answers(asked: DataFrame, n: int, stage: int = 0) -> DataFrame:
    return by_bucket(by_bucket(asked, n).mapInArrow(_answer(stage), ANSWER), n)


class Known:
    """The answers of one stage that reached a block."""

    def __init__(self, table: pa.Table, stage: int = 0):
        rows = [b for b in table.filter(pa.compute.equal(table["stage"], stage)).to_batches() if b.num_rows]
        h = np.concatenate([np.zeros(0, "<u8"), *_column(rows, "h", "<u8")])
        code = np.concatenate([np.zeros(0, "u1"), *_column(rows, "code", "u1")])
        order = np.lexsort((code, h))
        self.h, self.code = h[order], code[order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """0, 1 or 2 for each hash."""
        if not len(self.h):
            return np.zeros(len(h), np.uint8)
        at = np.searchsorted(self.h, h, side="right") - 1
        return np.where((at >= 0) & (self.h[at] == h), self.code[at], 0).astype(np.uint8)


def firsts(h: np.ndarray, doc: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which of a block's places are the first of all: of each hash with code 2 the block's least."""
    out = np.zeros(len(h), bool)
    some = np.flatnonzero(code == 2)
    if len(some):
        order = some[np.lexsort((at[some], doc[some], h[some]))]
        out[order[np.concatenate([[True], h[order[1:]] != h[order[:-1]]])]] = True
    return out
