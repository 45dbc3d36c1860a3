"""Approximate nearest neighbours with an inverted multi-index.

Each half of the vectors is quantised by its own codebook (Lloyd's algorithm over at most
about ``FIT`` vectors, those with the least hashes of their ids); every vector is indexed: it
lies in the cell of its two centroids.  Queries are the rows whose id is divisible by ``every``
(20; 1 takes all), against all rows.  For each a heap walks the centroid pairs in the order of
their summed distances until the cells met hold ``need`` vectors; those are reranked by
exact distance.

How many candidates are needed depends on the data (for vectors without structure it is a
large share), so it is measured: for ``CALIBRATION`` queries (those with the least hash of
their id) the exact neighbours are found by one scan, and as many candidates are taken as
put a share of ``TARGET`` of them within reach.

Only the codebooks, the cells' sizes (at most ``MOST`` squared numbers) and the calibration
queries are on the driver.  Entries are grouped by their first centroid, a large group in
chunks; queries travel to the chunks of the first centroids that their walk meets, split into
salts by a bound on a group's size.

Cases: null and empty vectors and vectors with null or non-finite values are ignored; vectors
of different lengths have no distance: each length is searched by itself; several rows of one
id count as one, the least vector; rows without an id are ignored; a vector isn't its own
neighbour, equal vectors of other ids are; equal distances are ranked by id, of any number of
equal vectors; with fewer than k other vectors there are fewer rows; an empty table gives no
rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import Packer, by_bucket, cut, partitions, schema, unpack

K, EVERY, CALIBRATION, TARGET, ROUNDS, CELL = 10, 20, 128, 0.96, 6, 50
FIT, MOST, GROUP_BYTES = 200_000, 2048, 48_000_000
SCHEMA = "vec_id long, neighbor_id long, rank int, distance double"


def matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) if len(col) else np.zeros((0, dim), np.float32)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with finite vectors, one row an id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < 1e30)")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def halves(dim: int):
    return (slice(0, dim // 2), slice(dim // 2, dim))


def learn(rows: DataFrame, dim: int, k: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Two codebooks; each round is one pass that returns one row for each centroid."""
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).toArrow()
    start = matrix(seeds.to_batches()[0] if seeds.num_rows else pa.RecordBatch.from_pylist([], schema=seeds.schema), "v", dim) if seeds.num_rows else np.zeros((0, dim), np.float32)
    books = [start[:, s].copy() for s in halves(dim)]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def run(batches, shared=shared):
            total = None
            for batch in batches:
                x = matrix(batch, "v", dim)
                if total is None:
                    total = [np.zeros((len(b), b.shape[1] + 1)) for b in shared.value]
                for t, b, s in zip(total, shared.value, halves(dim)):
                    near = distances(x[:, s], b).argmin(1)
                    order = np.argsort(near, kind="stable")
                    ids, first = np.unique(near[order], return_index=True)
                    t[ids, :-1] += np.add.reduceat(x[order][:, s].astype(np.float64), first, axis=0) if len(ids) else 0
                    t[ids, -1] += np.diff(np.append(first, len(order)))
            for h, t in enumerate(total or []):
                used = np.flatnonzero(t[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), h), pa.int32()), pa.array(used, pa.int32()), pa.array([r.tobytes() for r in t[used]], pa.binary())], names=["half", "c", "s"])

        def add(rows_: pa.Table) -> pa.Table:
            s = np.sum([np.frombuffer(x.as_py(), np.float64) for x in rows_["s"]], axis=0)
            return pa.table({"half": rows_["half"][:1], "c": rows_["c"][:1], "s": pa.array([s.tobytes()], pa.binary())})

        for r in rows.mapInArrow(run, "half int, c int, s binary").groupBy("half", "c").applyInArrow(add, "half int, c int, s binary").collect():
            s = np.frombuffer(r["s"], np.float64)
            books[r["half"]][r["c"]] = (s[:-1] / s[-1]).astype(np.float32)
    return books


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, need: int):
    """Cells (i, j) by summed distance, least first, until they hold ``need`` vectors."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, width = [(s1[0] + s2[0], 0, 0)], [0] * len(o1)
    got, n1, n2 = 0, len(o1), len(o2)
    while heap and got < need:
        _, a, b = heapq.heappop(heap)
        i, j = o1[a], o2[b]
        got += int(sizes[i, j])
        yield i, j, got
        if b + 1 < n2:
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < n1:
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))


def exact(rows: DataFrame, dim: int, ids: np.ndarray, queries: np.ndarray, k: int):
    """The true k neighbours of some queries: arrays of ids and vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches):
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch, "v", dim), batch.column(0).to_numpy(zero_copy_only=False)
            d = distances(q, x)
            d[ids[:, None] == own[None]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            which = np.repeat(np.arange(len(q)), top.shape[1])
            d = d[which, top.ravel()]
            fine = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(which[fine], pa.int32()), pa.array(d[fine].astype(float)), pa.array(own[top.ravel()][fine]), pa.array(list(x[top.ravel()][fine]), pa.list_(pa.float32()))], names=["q", "d", "id", "v"])

    found = rows.mapInArrow(run, "q int, d double, id long, v array<float>")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "v"))), 1, k).alias("best")).select("q", F.explode("best").alias("n")).select("q", "n.id", "n.v").toArrow()
    return best


def _assign(shared, dim):
    def run(batches):
        for batch in batches:
            x = matrix(batch, "v", dim)
            c = [distances(x[:, s], b).argmin(1) if len(x) else np.zeros(0, np.int64) for b, s in zip(shared.value, halves(dim))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32())], names=["vec_id", "v", "i", "j"])

    return run


def _entries(base: np.ndarray, chunks: np.ndarray, salts: int, dim: int):
    def run(batches):
        packer = Packer(["id", "j", "v"], ["<i8", "<i4", "<f4"], 0)
        for batch in batches:
            ids, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("vec_id", "i", "j"))
            x = matrix(batch, "v", dim)
            chunk = (W.mix(ids.astype(np.uint64)) % chunks[i].astype(np.uint64)).astype(np.int64)
            for s in range(salts):
                yield from packer.add(base[i] + chunk * salts + s, ids, j, x)
        yield from packer.flush()

    return run


def _queries(shared, base: np.ndarray, chunks: np.ndarray, salts: int, dim: int):
    def run(batches):
        books, sizes, need = shared.value
        packer = Packer(["id", "v", "cells"], ["<i8", "<f4", "u1"], 0)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch, "v", dim)
            d1, d2 = (distances(x[:, s], b) for b, s in zip(books, halves(dim)))
            for a in range(0, len(ids), 512):
                who, cell = [], []
                for q in range(a, min(a + 512, len(ids))):
                    for i, j, _ in walk(d1[q], d2[q], sizes, need):
                        who.append(q * sizes.shape[0] + i)
                        cell.append(j)
                who, cell = np.array(who, np.int64), np.array(cell, np.int64)
                keys, at = np.unique(who, return_inverse=True)
                bits = np.zeros((len(keys), sizes.shape[1]), bool)
                bits[at, cell] = True
                bits = np.packbits(bits, axis=1)
                q, i = keys // sizes.shape[0], keys % sizes.shape[0]
                salt = (W.mix(ids[q].astype(np.uint64) + np.uint64(1)) % np.uint64(salts)).astype(np.int64)
                for c in range(int(chunks[i].max(initial=0))):
                    m = np.flatnonzero(chunks[i] > c)
                    yield from packer.add(base[i[m]] + c * salts + salt[m], ids[q[m]], x[q[m]], bits[m])
        yield from packer.flush()

    return run


def _rerank(dim: int, n_second: int, k: int, n: int):
    fields = pa.schema([("b", pa.int32()), ("q", pa.binary()), ("id", pa.binary()), ("d", pa.binary())])

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        packer, out = Packer(["q", "id", "d"], ["<i8", "<i8", "<f8"], n), []
        if entries.num_rows and queries.num_rows:
            ids, j, x = unpack(entries, ["id", "j", "v"], ["<i8", "<i4", "<f4"])
            qid, q, cells = unpack(queries, ["id", "v", "cells"], ["<i8", "<f4", "u1"])
            x, q = x.reshape(-1, dim), q.reshape(-1, dim)
            cells = np.unpackbits(cells.reshape(len(qid), -1), axis=1)[:, :n_second].astype(bool)
            for a in range(0, len(qid), 256):
                part, mask = q[a : a + 256], cells[a : a + 256]
                use = np.flatnonzero(mask.any(axis=0)[j])
                if not len(use):
                    continue
                d = distances(part, x[use])
                d[~mask[:, j[use]] | (qid[a : a + 256, None] == ids[use][None])] = np.inf
                # all that the k nearest may be: up to the k-th distance and the rounding of both
                m = min(len(use), k)
                far = np.partition(d, m - 1, axis=1)[:, m - 1]
                slack = 1e-5 * ((part * part).sum(1) + (x[use] * x[use]).sum(1).max()) + 1e-12
                who, pick = np.nonzero((d <= (far + slack)[:, None]) & np.isfinite(d))
                pick = use[pick]
                real = np.square(part[who].astype(np.float64) - x[pick]).sum(axis=1)
                order = np.lexsort((ids[pick], real, who))
                who, pick, real = who[order], pick[order], real[order]
                first = np.searchsorted(who, who)
                good = np.arange(len(who)) - first < k
                who, pick, real = who[good], pick[good], real[good]
                own = qid[a + who]
                out.extend(packer.add(W.mix(own.astype(np.uint64)) % np.uint64(n), own, ids[pick], real))
        out.extend(packer.flush())
        return pa.Table.from_batches(out, schema=fields)

    return run


def _best(k: int):
    def run(batches):
        q, ids, d = unpack(batches, ["q", "id", "d"], ["<i8", "<i8", "<f8"])
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        good = rank < k
        yield pa.RecordBatch.from_arrays([pa.array(q[good]), pa.array(ids[good]), pa.array(rank[good] + 1, pa.int32()), pa.array(np.sqrt(d[good]))], names=["vec_id", "neighbor_id", "rank", "distance"])

    return run


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, target: float = TARGET, fit: int = FIT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance): the k nearest other vectors of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = cut(clean(vectors))
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()}
    out = spark.createDataFrame([], SCHEMA)
    for dim, total in lengths.items():
        if total > 1:
            found = _search(rows.where(F.size("v") == dim), dim, total, k, every, target, fit, group_bytes)
            out = found if len(lengths) == 1 else out.unionByName(found)
    return out


def _search(rows: DataFrame, dim: int, total: int, k: int, every: int, target: float, fit: int, group_bytes: int) -> DataFrame:
    spark = rows.sparkSession
    size = int(np.clip(np.sqrt(total / CELL), 1, MOST))
    some = rows if total <= fit else cut(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(fit / total * (1 << 40))))
    books = learn(some, dim, size)
    placed = cut(rows.mapInArrow(_assign(spark.sparkContext.broadcast(books), dim), "vec_id long, v array<float>, i int, j int"))
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    cells = placed.groupBy("i", "j").count().toArrow()  # at most MOST squared rows
    sizes[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["count"].to_numpy()
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(CALIBRATION).toArrow().combine_chunks()
    sample = np.concatenate([matrix(b, "v", dim) for b in some.to_batches()])
    true = exact(rows, dim, some["vec_id"].to_numpy(), sample, k)
    near = np.array(true["v"].to_pylist(), np.float32).reshape(-1, dim)
    cell = [distances(near[:, s], b).argmin(1) for b, s in zip(books, halves(dim))]
    d1, d2 = (distances(sample[:, s], b) for b, s in zip(books, halves(dim)))
    reach, share = [], []
    for q in range(len(sample)):
        mine = np.flatnonzero(true["q"].to_numpy() == q)
        wanted = {(int(cell[0][m]), int(cell[1][m])): 0 for m in mine}
        for i, j, got in walk(d1[q], d2[q], sizes, total):
            if (i, j) in wanted:
                wanted[i, j] = got
        reach += [wanted[int(cell[0][m]), int(cell[1][m])] for m in mine]
    need = int(np.quantile(reach, target, method="higher"))
    for q in range(len(sample)):
        share.append(len({i for i, _, _ in walk(d1[q], d2[q], sizes, need)}) / len(books[0]))
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    salts = max(1, int(np.ceil(asked.count() * float(np.mean(share)) * (dim * 4 + 40) / group_bytes)))
    chunks = np.maximum(1, -(-sizes.sum(axis=1) * (dim * 4 + 12) // group_bytes))
    base = (np.cumsum(chunks) - chunks) * salts
    n = partitions(spark)
    entries = by_bucket(placed.mapInArrow(_entries(base, chunks, salts, dim), schema(["id", "j", "v"])), n)
    queries = by_bucket(asked.mapInArrow(_queries(spark.sparkContext.broadcast((books, sizes, need)), base, chunks, salts, dim), schema(["id", "v", "cells"])), n)
    found = entries.groupBy("b").cogroup(queries.groupBy("b")).applyInArrow(_rerank(dim, len(books[1]), k, n), schema(["q", "id", "d"]))
    return by_bucket(found, n).mapInArrow(_best(k), SCHEMA)
