"""MinHash near-duplicates: odd sketches choose candidates, exact Jaccard settles them.

``SAMPLES`` MinHash values over hashed word shingles give ``BANDS`` bands of
``ROWS`` values for candidates, and are folded into a parity bitmap of ``BITS``
bits: each (sample number, value) flips one bit.  For two documents the number d
of ones in the XOR of their bitmaps estimates how many samples differ, hence the
Jaccard similarity: 1 + BITS / (4 * SAMPLES) * ln(1 - 2 d / BITS), which is sharpest
where similarity is high.

Of documents with the same shingles, each as often (a hash of 128 bits tells), only the least
id goes on, so groups of thousands of exact copies cost one row each; different texts all go
on, also those of one bitmap.  Inside a band's bucket every pair is compared; no bucket is capped: one of more than ``TILE``
bitmaps is cut into parts, and each pair of parts is a task's work of its own.  A pair is a
candidate if its estimate is at most ``MARGIN`` below the threshold; pairs of one bucket that
a chain of estimates ``SURE`` above the threshold joins already aren't listed again.  Each
candidate's exact Jaccard similarity over its shingle sets then decides; the texts of
one connected group of candidates meet for that, in one task up to ``GROUP`` documents, in
tiles of a pair of parts beyond.  Pairs at or above the threshold are joined into groups by
alternating star contraction.

Cases: null, empty and word-free texts have no shingles and never have duplicates;
texts shorter than a shingle count as one shingle; a very long text is one document like any
other, held whole; rows without an id aren't compared and stay; several rows of one id count
as one document (the one with the least text); of a group the least id stays; an empty table
gives no rows; other columns pass through ``keep_one`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .exchange import cut, drop, free_name, partitions, store

SHINGLE, SAMPLES, BANDS, ROWS, BITS, THRESHOLD = 3, 96, 24, 4, 512, 0.5
MARGIN, SURE, MOST_SLOTS, TILE, GROUP = 0.2, 0.25, 1 << 26, 4096, 512
SKETCH_SCHEMA = "doc_id long, same binary, sketch binary, bands array<long>"
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def shingles(w: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle; a text of fewer words is one shingle."""
    at, h = W.windows(w, size)
    doc = w.doc[at]
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            extra[has] = W.mix(extra[has] + w.hash[w.first[short[has]] + k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and their MinHash values (documents x SAMPLES, uint32)."""
    return minhashes(*shingles(W.tokenize(texts)))


def minhashes(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((0, SAMPLES), np.uint32)
    ids, first = np.unique(doc, return_index=True)
    out = np.empty((len(ids), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(((h * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), first)
    return ids, out


def same_keys(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each document that has shingles two sums over them: equal for the same shingles, each as often (documents x 2, uint64)."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return np.stack([np.add.reduceat(W.mix(h ^ salt), first) for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))], axis=1)


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x BITS/64, uint64)."""
    k = np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)
    bit = (W.mix(sig.astype(np.uint64) | k) % np.uint64(BITS)).astype(np.int64)
    flat = np.bincount((np.arange(len(sig))[:, None] * BITS + bit).ravel(), minlength=len(sig) * BITS).reshape(len(sig), BITS)
    return np.packbits((flat & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(len(sig), BITS // 64)


def similarity(ones: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the ones in the XOR of two bitmaps."""
    ratio = np.maximum(1e-9, 1 - 2 * ones / BITS)
    return np.clip(1 + BITS / (4 * SAMPLES) * np.log(ratio), 0, 1)


def max_ones(threshold: float) -> int:
    """Most differing bits that still reach the threshold."""
    d = np.arange(BITS // 2 + 1)
    return int(d[similarity(d) >= threshold].max())


def ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ones in the XOR of each row of ``a`` with each row of ``b``."""
    x = (a[:, None, :] ^ b[None, :, :]).view(np.uint16)
    return _POP[x].sum(axis=2, dtype=np.int32)


def _sketch(batches):
    for part in W.slices(batches):
        at, h = shingles(W.tokenize(part.column("text")))
        if not len(at):
            continue
        ids, sig = minhashes(at, h)
        sk = odd_sketches(sig)
        bands = np.stack([W.window_hash(sig[:, b * ROWS : (b + 1) * ROWS].astype(np.uint64).ravel(), ROWS)[::ROWS] + np.uint64(b) for b in range(BANDS)], axis=1)
        doc = part.column("doc_id").take(pa.array(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([doc, *(pa.array([r.tobytes() for r in c], pa.binary()) for c in (same_keys(at, h), sk)), lists], names=["doc_id", "same", "sketch", "bands"])


def _links(sk: np.ndarray, ids: np.ndarray, sure: int, most: int, split: int = 0):
    """Candidates of one bucket: edges that connect what at most ``sure`` ones apart connects, and all other pairs at most ``most`` apart.

    With ``split`` only pairs of one row before it and one from it on are looked at.
    """
    group = np.arange(len(ids))
    tree, loose = [], []
    for a in range(0, split or len(ids), 256):
        stop = min(a + 256, split or len(ids))
        for b in range(split or a, len(ids), 1024):
            d = ones(sk[a:stop], sk[b : b + 1024])
            i, j = np.nonzero(d <= most)
            close = d[i, j] <= sure
            i, j = i + a, j + b
            ahead = i < j
            i, j, close = i[ahead], j[ahead], close[ahead]
            x, y = i[close], j[close]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
            for lo, hi in zip(first, [*first[1:], len(x)]):
                other, at = np.unique(group[y[lo:hi]], return_index=True)
                new = other != group[x[lo]]
                if new.any():
                    tree += [(x[lo], k) for k in y[lo:hi][at[new]]]
                    group[np.isin(group, other[new])] = group[x[lo]]
            apart = ~close & (group[i] != group[j])
            loose.append((i[apart], j[apart]))
    i, j = (np.concatenate(c) for c in zip(*loose))
    apart = group[i] != group[j]
    x, y = np.array(tree, np.int64).reshape(-1, 2).T
    return ids[np.concatenate([x, i[apart]])], ids[np.concatenate([y, j[apart]])]


def _pairs(threshold: float):
    sure, most = max_ones(min(1.0, threshold + SURE)), max_ones(max(0.05, threshold - MARGIN))

    def close(parts):
        key, own, ids, sk = (np.concatenate(x) for x in zip(*parts))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(key))
        one = key[starts, 1] == key[starts, 2]
        two = (ends - starts == 2) & one
        s = starts[two]
        near = _POP[(sk[s] ^ sk[s + 1]).view(np.uint16)].sum(axis=1, dtype=np.int32) <= most
        a, b = [ids[s[near]]], [ids[s[near] + 1]]
        for i, j, whole in zip(starts, ends, one):
            split = 0 if whole else int((own[i:j] == own[i]).sum())
            if (j - i > 2 if whole else split < j - i):
                x, y = _links(sk[i:j], ids[i:j], sure, most, split)
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def run(batches):
        """Rows of a partition, sorted by bucket (band, pair of parts); a bucket may span batches."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            band, p, q, own, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            key = np.stack([band, p, q], axis=1)
            sk = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(5)), np.uint64).reshape(len(ids), -1)
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield close([*held, (key[:last], own[:last], ids[:last], sk[:last])])
                held = []
            elif held and (held[-1][0][-1] != key[0]).any():
                yield close(held)
                held = []
            held.append((key[last:], own[last:], ids[last:], sk[last:]))
        if held:
            yield close(held)

    return run


def _settle(threshold: float):
    def edges(texts: dict[int, list[np.ndarray]], near: dict[int, list[int]]):
        """Edges that connect what the candidates at or above the threshold connect."""
        parent = {i: i for i in texts}

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, others in near.items():
            for j in others:
                a, b = root(i), root(j)
                if a != b and any(jaccard(x, y) >= threshold for x in texts[i] for y in texts[j]):
                    parent[max(a, b)] = min(a, b)
                    yield min(i, j), max(i, j)

    def run(batches):
        """Rows of a partition, sorted by group; a group may span batches."""
        now, texts, near = None, {}, {}
        for part in W.slices(batches):
            doc, h = shingles(W.tokenize(part.column("text")))
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            groups, ids = list(zip(*(part.column(c).to_pylist() for c in ("root", "p", "q")))), part.column("doc_id").to_pylist()
            found = []
            for k, (group, i) in enumerate(zip(groups, ids)):
                if group != now:
                    found += edges(texts, near)
                    now, texts, near = group, {}, {}
                texts.setdefault(i, []).append(np.unique(h[first[k] : first[k + 1]]))
                near[i] = part.column("near")[k].as_py() or []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["src", "dst"])
        if found := list(edges(texts, near)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["src", "dst"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values; two empty ones have 0."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _having(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose doc_id isn't in ``ids``, unshuffled; a bitmap of hashes of bounded size lets some others pass."""
    slots = min(MOST_SLOTS, 1 << max(12, (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(slots // 64, np.int64)
    bitmap[words["at"].to_numpy()] = words["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for part in batches:
            s = part.column("slot").to_numpy()
            yield part.filter(pa.array((shared.value[s >> 6] >> (s & 63)) & 1 == 1)).select(["doc_id", "text"])

    return rows.select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id long, text string")


def _parts(size, most: int, ident: str):
    """Which of the parts of at most about ``most`` an id lies in."""
    return F.pmod(F.xxhash64(ident), F.greatest(F.lit(1), F.ceil(size / most))).cast("long")


def verified(pairs: DataFrame, rows: DataFrame, threshold: float, group: int = GROUP) -> DataFrame:
    """Edges (src, dst) of exact Jaccard similarity at or above the threshold that connect what all such pairs among ``pairs`` connect."""
    found = components(pairs)
    roots = found.unionByName(found.select(F.col("root").alias("doc_id"), "root").distinct())
    size = found.groupBy("root").agg((F.count("*") + 1).alias("size"))
    part = cut(roots.join(size, "root").select("doc_id", "root", _parts(F.col("size"), group, "doc_id").alias("part")))
    end = lambda c, p: part.select(F.col("doc_id").alias(c), F.col("part").alias(p))
    tiled = pairs.join(part.select(F.col("doc_id").alias("src"), "root", F.col("part").alias("x")), "src").join(end("dst", "y"), "dst")
    tiled = cut(tiled.select("root", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "src", "dst"))
    tile = ["root", "p", "q"]
    near = tiled.groupBy(*tile, F.col("src").alias("doc_id")).agg(F.collect_set("dst").alias("near"))
    ends = tiled.join(near.select(*tile, F.col("doc_id").alias("dst")), [*tile, "dst"], "left_anti").select(*tile, F.col("dst").alias("doc_id")).distinct()
    placed = cut(near.unionByName(ends.withColumn("near", F.lit(None).cast("array<long>"))))
    grouped = _having(rows, placed.select("doc_id").distinct()).join(placed, "doc_id").repartition(partitions(rows.sparkSession), *tile).sortWithinPartitions(*tile)
    return grouped.select(*tile, "doc_id", "text", "near").mapInArrow(_settle(threshold), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) for each vertex of an undirected graph (src < dst): the root is the least id of its component.

    Alternates the large-star and small-star steps until the edges stay the same; each
    round is written out, so lineage and shuffle files don't grow with the rounds.  A
    vertex's edges are joined with its least neighbour, never gathered in a row.
    """
    spark = edges.sparkSession
    total = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    edges, path = store(edges.distinct())
    before = total(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
        large = edges.join(least, "src").select(F.col("m").alias("src"), "dst").distinct()
        low = large.groupBy("dst").agg(F.min("src").alias("m"))
        small = large.join(low, "dst").select(F.col("m").alias("src"), F.col("src").alias("dst")).unionByName(low.select(F.col("m").alias("src"), "dst"))
        (edges, now), old = store(small.where("src < dst").distinct()), path
        drop(spark, old)
        path, after = now, total(edges)
        if after == before:
            return edges.select(F.col("dst").alias("doc_id"), F.col("src").alias("root"))
        before = after


def _buckets(banded: DataFrame, tile: int) -> DataFrame:
    """(band, p, q, own, head, sketch): each row once, in part (0, 0), for a band of at most ``tile`` rows; else in every pair that has its part."""
    hot = cut(banded.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > tile))
    if hot.isEmpty():
        return banded.select("band", *(F.lit(0).cast("long").alias(c) for c in ("p", "q", "own")), "head", "sketch")
    split = banded.join(hot, "band", "left").withColumn("n", F.coalesce(F.ceil(F.col("size") / tile), F.lit(1))).withColumn("own", _parts(F.col("n"), 1, "head"))
    each = split.select("band", "own", "head", "sketch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    return each.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "head", "sketch")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(doc_id, keeper) for each document that a group keeps another document for; keeper is the group's least id."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(rows.mapInArrow(_sketch, SKETCH_SCHEMA))
    # documents of the same shingles are a star around the least id, which alone goes on
    heads = sketched.groupBy("same").agg(F.min("doc_id").alias("head"))
    named = sketched.join(heads, "same")
    copies = named.where("doc_id > head").select(F.col("head").alias("src"), F.col("doc_id").alias("dst"))
    banded = cut(named.where("doc_id = head").select("head", "sketch", "bands")).select(F.explode("bands").alias("band"), "head", "sketch")
    placed = _buckets(banded, tile).repartition(partitions(spark), "band", "p", "q").sortWithinPartitions("band", "p", "q", "own", "head")
    pairs = placed.mapInArrow(_pairs(threshold), "src long, dst long")
    near = verified(cut(pairs.where("src < dst").distinct()), rows, threshold, group)
    return components(near.unionByName(copies)).select("doc_id", F.col("root").alias("keeper"))


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keeper, group_size): every document of a group of near-duplicates, the kept one included."""
    found = near_duplicates(docs, threshold)
    size = found.groupBy("keeper").agg((F.count("*") + 1).alias("group_size"))
    heads = size.select(F.col("keeper").alias("doc_id"), "keeper", "group_size")
    return found.join(size, "keeper").select("doc_id", "keeper", "group_size").unionByName(heads)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the documents that are near-duplicates of a kept one.

    Rows without an id stay.  Of several rows with one id the least text stays.
    """
    gone, again, row = (free_name(docs, c) for c in ("gone", "again", "row"))
    left = docs.join(near_duplicates(docs, threshold).select(F.col("doc_id").alias(gone)), docs["doc_id"] == F.col(gone), "left_anti")
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(again)))
    if twice.isEmpty():
        return left
    cond = left["doc_id"] == F.col(again)
    several = left.join(twice, cond, "left_semi")
    chosen = several.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias(row)).select(f"{row}.*")
    return left.join(twice, cond, "left_anti").unionByName(chosen)
