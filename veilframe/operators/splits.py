"""Leakage-safe dataset splits, their counts and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.privacy import group_split
from ..sources.shared import folder


def split_counts(items: DataFrame, group: str, positive: Column, annotations: Column, seed: int = 0, fraction: float = 0.2) -> DataFrame:
    """Images, positives, annotations and groups by split."""
    rows = items.withColumn("split", group_split(F.col(group), seed, fraction))
    return rows.groupBy("split").agg(F.count("*").alias("images"), F.count_if(positive).alias("positives"), F.sum(annotations).cast("bigint").alias("annotations"), F.count_distinct(group).alias("groups"))


def shared_groups(items: DataFrame, group: str, split: str) -> DataFrame:
    """Groups on both sides; has to be empty."""
    side = lambda s: items.where(F.col(split) == s).select(group)
    return side("train").intersect(side("val"))


def positional_split(items: DataFrame, key: str, train: float, val: float) -> DataFrame:
    """(key, split) by place in the sorted list of keys, at least one each where there are three (M9).

    Keys are cut into ranges and numbered within each, to which the sizes of the ranges before are
    added; the ranges are stored, as their bounds come from a sample.
    """
    path = folder(items.sparkSession)
    items.select(key).distinct().repartitionByRange(key).withColumn("__p", F.spark_partition_id()).write.parquet(f"{path}/keys")
    rows = items.sparkSession.read.parquet(f"{path}/keys")
    size = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    # one row a range
    before = size.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    total = rows.agg(F.count("*").alias("n"))
    at = F.row_number().over(W.partitionBy("__p").orderBy(key)) - 1 + F.col("__before")
    n = F.col("n")
    t = F.greatest(F.lit(1), F.floor(n * train))
    v = F.floor(n * val)
    v = F.when((n >= 3) & F.lit(val > 0), F.greatest(F.lit(1), v)).otherwise(v)
    t = F.when((t + v >= n) & (n > 1), F.greatest(F.lit(1), n - v - 1)).otherwise(t)
    out = rows.join(before, "__p").withColumn("at", at).crossJoin(F.broadcast(total)).withColumns({"t": t, "v": v})
    return out.select(key, F.when(F.col("at") < F.col("t"), "train").when(F.col("at") < F.col("t") + F.col("v"), "val").otherwise("test").alias("split"))


def smallest_sources(files: DataFrame, patient: str, size: str, path: str, limit: int, rows: Column, columns: Column, frames: Column, most: int = 4 << 20) -> DataFrame:
    """The smallest admissible files of each patient."""
    ok = (rows >= 1) & (columns >= 1) & (frames == 1) & (rows.cast("bigint") * columns <= most)
    return files.where(ok).withColumn("__k", F.row_number().over(W.partitionBy(patient).orderBy(size, path))).where(F.col("__k") <= limit).drop("__k")


def manifest(items: DataFrame, uid: str, patient: str, seed: int = 0, fraction: float = 0.2) -> DataFrame:
    """Rows without plain identifiers: hashes, split and paths (P13, SC21)."""
    split = group_split(F.col(patient), seed, fraction)
    stem = F.replace(F.col(uid), F.lit("."), F.lit("_"))
    path = lambda kind, end: F.concat(F.lit(kind + "/"), split, F.lit("/"), stem, F.lit(end))
    return items.select(
        F.sha2(uid, 256).alias("instance_uid_sha256"), F.sha2(patient, 256).alias("patient_key_sha256"), split.alias("split"), path("images", ".jpg").alias("image_path"), path("labels", ".txt").alias("label_path"),
        *[c for c in items.columns if c not in (uid, patient)],
    )
