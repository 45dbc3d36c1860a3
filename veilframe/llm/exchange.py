"""Moving many small fixed-width records between partitions.

Records that numpy produces by the million are shuffled as one binary row for each
(task, bucket) instead of one row each: Spark still plans, shuffles, retries and
spills the exchange, but its cost per record is a few bytes of copying.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLUSH = 48_000_000


def partitions(spark: SparkSession) -> int:
    """Buckets of an exchange: the session's shuffle partitions, which follow the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def schema(names: Sequence[str]) -> str:
    return "b int, " + ", ".join(f"{n} binary" for n in names)


class Packer:
    """Collects records by bucket and yields them as binary rows."""

    def __init__(self, names: Sequence[str], dtypes: Sequence[str], buckets: int):
        self.names, self.dtypes, self.buckets = list(names), list(dtypes), buckets
        self.parts: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.bytes = 0

    def add(self, bucket: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            cols = [np.ascontiguousarray(c, dtype=t) for c, t in zip(cols, self.dtypes)]
            self.parts.append((bucket.astype(np.int32), cols))
            self.bytes += sum(c.nbytes for c in cols)
            if self.bytes > FLUSH:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bucket = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(bucket, kind="stable")
        ids, at = np.unique(bucket[order], return_index=True)
        ends = [*at[1:], len(order)]
        out = [pa.array(ids, pa.int32())]
        for k in range(len(self.names)):
            col = np.concatenate([p[1][k] for p in self.parts])[order]
            out.append(pa.array([col[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()))
        self.parts, self.bytes = [], 0
        yield pa.RecordBatch.from_arrays(out, names=["b", *self.names])


def unpack(batches, names: Sequence[str], dtypes: Sequence[str]) -> list[np.ndarray]:
    """All records of an iterator of binary rows (or of an Arrow table), as numpy columns."""
    if isinstance(batches, pa.Table):
        batches = batches.to_batches()
    got: list[list[bytes]] = [[] for _ in names]
    for batch in batches:
        for k, n in enumerate(names):
            got[k].extend(x.as_buffer() for x in batch.column(batch.schema.get_field_index(n)) if x.is_valid)
    return [np.frombuffer(b"".join(g), dtype=t) for g, t in zip(got, dtypes)]


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """Bucket k in partition k: hashing the bucket once more would leave a third of the partitions empty."""
    return df.repartitionById(n, F.col("b"))


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared folder, deleted when the driver ends.

    Only a session of one process (``local`` master) may do without ``spark.checkpoint.dir``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="veilframe-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = "file://" + _own[0]
    path = f"{base.rstrip('/')}/veilframe-{uuid.uuid4().hex}"
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    return path


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write and reread, which ends the lineage in storage that outlives executors; the folder is for ``drop``."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return store(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``store`` that nothing reads any more."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """A table that has fewer splits than the session has cores over all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def docs_by_bucket(docs: DataFrame, n: int) -> DataFrame:
    """(b, doc_id, text) of documents with an id, hashed on the id.

    The plan holds no Python, so that every use of it is one and the same exchange,
    which Spark then runs once.
    """
    return by_bucket(docs.where(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("b"), F.col("doc_id").cast("long").alias("doc_id"), "text"), n)


def rows_by_bucket(docs: DataFrame, n: int) -> DataFrame:
    """(b, doc_id, text) of all rows, hashed on id and text, so that rows without an id don't meet in one bucket."""
    return by_bucket(docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("b"), F.col("doc_id").cast("long").alias("doc_id"), "text"), n)


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text): several rows of one id become one, with the least text.  Looks at the ids alone unless there are such rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))
