"""Privacy audit over every subset of the quasi-identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FIELDS = 8


def value_key(c: Column) -> Column:
    """Null and blank as values of their own, before grouping sets make nulls (A4)."""
    t = F.trim(c.cast("string"))
    return F.when(c.isNull(), "<NULL>").when(t == "", "<EMPTY>").otherwise(t)


def classes(records: DataFrame, fields: Sequence[str], sensitive: str) -> DataFrame:
    """(fields.., gid, s, n): how often each sensitive value occurs in each class of each subset.

    Rows are counted once at the finest grain, and the cube runs over those counts: what it
    expands is the number of distinct combinations, not of records.
    """
    if not fields or len(fields) > MOST_FIELDS:
        raise ValueError(f"between 1 and {MOST_FIELDS} fields, as subsets double with each")
    fine = records.groupBy(*[value_key(F.col(f)).alias(f) for f in fields], value_key(F.col(sensitive)).alias("s")).agg(F.count("*").alias("n"))
    sets = fine.withColumn("__s", F.col("s")).drop("s")
    # the sensitive value belongs to every grouping set
    out = sets.groupingSets([[*[f for k, f in enumerate(fields) if mask >> k & 1], "__s"] for mask in range(1, 1 << len(fields))], *fields, "__s").agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    return out.select(*fields, F.col("__s").alias("s"), "gid", "n")


def k_anonymity(records: DataFrame, fields: Sequence[str], sensitive: str, k: int, least_distinct: int | None = None) -> DataFrame:
    """One row: classes over all subsets, the smallest, those below k, what they lack, and classes with too few sensitive values (A4, A5)."""
    cls = classes(records, fields, sensitive).groupBy(*fields, "gid").agg(F.sum("n").alias("size"), F.count("*").alias("distinct"))
    lack = F.greatest(F.lit(k) - F.col("size"), F.lit(0))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return cls.agg(
        F.count_distinct("gid").alias("qi_projection_count"), F.count("*").alias("equivalence_class_count"), F.min("size").cast("bigint").alias("minimum_equivalence_class_size"), F.count_if(lack > 0).alias("underprotected_pattern_count"),
        n(lack).alias("frequency_deficit_total"), F.coalesce(F.max(lack), F.lit(0)).cast("bigint").alias("synthetic_padding_lower_bound"), F.count_if(F.col("distinct") < (least_distinct or 0)).alias("l_diversity_violation_count"),
    )


def t_closeness(records: DataFrame, fields: Sequence[str], sensitive: str, t: float) -> DataFrame:
    """One row: classes whose sensitive values are further than t from all records', and the greatest distance.

    distance = (sum over the class's values of |p - q| + share of the values it lacks) / 2, so
    values that a class lacks need no row.
    """
    cls = classes(records, fields, sensitive)
    base = records.groupBy(value_key(F.col(sensitive)).alias("s")).agg(F.count("*").alias("m"))
    share = base.crossJoin(F.broadcast(base.agg(F.sum("m").alias("all")))).select("s", (F.col("m") / F.col("all")).alias("q"))
    # a class has at most as many values as there are sensitive values
    size = cls.join(share, "s").groupBy(*fields, "gid").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("n", "q"))).alias("v"))
    apart = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x["n"] / F.col("size") - x["q"]) - x["q"])
    dist = size.select((F.lit(0.5) * (apart + 1.0)).alias("d"))
    d = F.round("d", 9)
    return dist.agg(F.count("*").alias("equivalence_class_count"), F.count_if(d > t).alias("t_closeness_violation_count"), F.max(d).alias("max_t_closeness_distance"))
