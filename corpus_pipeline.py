"""The corpus pipeline: each stage works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.  All but the
last return the columns of documents.

In every stage rows without an id and rows with a null or empty text pass through as far as
the stage's docstring says, an empty table gives an empty table, texts are read whole however
long they are, and columns beside doc_id, text and n_chars are carried along untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontaminate, near_dup, packing, quality, secrets
from veilframe.llm.exchange import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject as low in quality or as toxic.

    A null or empty text is judged as one passage without words; each row is judged alone,
    repeated rows alike; without labels of both kinds nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Rows without an id or without words stay; of several rows with one id the one with the
    least text stays.
    """
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of benchmark items.

    Null and empty texts stay as they are; repeated rows are cleaned each; spans that touch or
    overlap are cut as one; without items nothing is cut.
    """
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced.

    Null and empty texts stay as they are; repeated rows are cleaned each; of equally likely
    stretches the one that ends first is taken first, and what is left is searched again.
    """
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training windows.

    Rows without an id are packed (doc_id null) and repeated rows each; a text without tokens
    has no piece; pieces of one length are placed by id and then by a hash of the text.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: Learned models, sketches and automata aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
