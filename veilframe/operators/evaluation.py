"""Predictions against gold records: key joins, field metrics, confusion, similarity statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import ratio_udf, token_sort_udf

NAMES = tuple("examiner_last_name examiner_first_name last_name first_name".split())


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (M6)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def record_key(fields: Sequence[str], ordinal: str) -> Column:
    """The key fields' values, or the row's ordinal if one of them is blank."""
    parts = [X.scalar(F.col(f).cast("string")) for f in fields]
    whole = parts[0] != ""
    for p in parts[1:]:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws("\x1f", *parts)).otherwise(F.concat(F.lit("__idx__:"), F.col(ordinal).cast("string")))


def keyed(records: DataFrame, fields: Sequence[str], ordinal: str) -> DataFrame:
    """One row a key: of several the one with the greatest ordinal, as if each overwrote the one before."""
    row = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(record_key(fields, ordinal).alias("__key")).agg(F.max_by(row, F.col(ordinal)).alias("r"), F.count("*").alias("__rows"))


def matched(pred: DataFrame, gold: DataFrame, fields: Sequence[str], ordinal: str) -> DataFrame:
    """(__key, p, g): full outer join of both sides' records; a missing side is null."""
    p = keyed(pred, fields, ordinal).select("__key", F.col("r").alias("p"), F.col("__rows").alias("p_rows"))
    g = keyed(gold, fields, ordinal).select("__key", F.col("r").alias("g"), F.col("__rows").alias("g_rows"))
    return p.join(g, "__key", "full_outer")


def unmatched(pred: DataFrame, gold: DataFrame, fields: Sequence[str], ordinal: str) -> DataFrame:
    """One row of totals: raw rows of both sides; distinct keys matched, missing, extra; keys overwritten."""
    both, no_p, no_g = F.col("p").isNotNull() & F.col("g").isNotNull(), F.col("p").isNull(), F.col("g").isNull()
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return matched(pred, gold, fields, ordinal).agg(
        n("g_rows").alias("total_gold"), n("p_rows").alias("total_predictions"), F.count_if(both).alias("matched"), F.count_if(no_p).alias("missing"),
        F.count_if(no_g).alias("extra"), n(F.col("g_rows") - 1).alias("duplicate_gold"), n(F.col("p_rows") - 1).alias("duplicate_predictions"),
    )


def similarity(field: str, a: Column, b: Column, how: str = "ratio") -> Column:
    """ratio: common subsequence, of sorted words for names; edit: built-in edit distance."""
    if how == "edit":
        near = X.edit_similarity(a, b)
    else:
        near = (token_sort_udf if field in NAMES else ratio_udf)(a, b)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(near)


def field_metrics(pred: DataFrame, gold: DataFrame, fields: Sequence[str], key: Sequence[str], ordinal: str, how: str = "ratio") -> DataFrame:
    """One row a field: support, exact matches, similarity, presence precision, recall and F1 over matched records (A1)."""
    pairs = matched(pred, gold, key, ordinal).where("p is not null and g is not null")
    values = F.array(*[F.struct(F.lit(f).alias("field"), X.canonical(F.col(f"p.{f}").cast("string"), f in NAMES).alias("a"), X.canonical(F.col(f"g.{f}").cast("string"), f in NAMES).alias("b")) for f in fields])
    rows = pairs.select(F.inline(values))
    near = F.lit(None).cast("double")
    for kind in (True, False):
        some = [f for f in fields if (f in NAMES) is kind]
        if some:
            near = F.when(F.col("field").isin(*some), similarity(some[0], F.col("a"), F.col("b"), how)).otherwise(near)
    rows = rows.withColumn("near", near)
    has_a, has_b = F.col("a") != "", F.col("b") != ""
    out = rows.groupBy("field").agg(
        F.count_if(has_a | has_b).alias("support"), F.count_if((has_a | has_b) & (F.col("a") == F.col("b"))).alias("exact"), F.sum(F.when(has_a | has_b, F.col("near"))).alias("near"),
        F.count_if(has_a & has_b).alias("tp"), F.count_if(has_a & ~has_b).alias("fp"), F.count_if(~has_a & has_b).alias("fn"),
    )
    c = F.col
    p, r = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return out.select(
        "field", "support", ratio(c("exact"), c("support")).alias("exact_match_rate"), ratio(c("near"), c("support")).alias("mean_similarity"), p.alias("presence_precision"), r.alias("presence_recall"),
        f1(p, r).alias("presence_f1"), (c("tp") + c("fn")).alias("gold_non_empty"), (c("tp") + c("fp")).alias("predicted_non_empty"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Unweighted means over fields (A2)."""
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("exact_match_rate", "mean_similarity", "presence_f1")])


def cohort(gold: DataFrame, predictions: dict[str, DataFrame], key: Sequence[str], ordinal: str) -> DataFrame:
    """Keys that gold and every prediction set have."""
    sides = {"": gold, **predictions}
    one = None
    for name, df in sides.items():
        keys = df.select(record_key(key, ordinal).alias("record_key"), F.lit(name).alias("side"))
        one = keys if one is None else one.unionByName(keys)
    return one.distinct().groupBy("record_key").agg(F.count("*").alias("n")).where(F.col("n") == len(sides)).select("record_key")


def with_fallback(pred: DataFrame, feedback: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """(p, g) pairs by key or, if no key matches at all, by position.

    Both plans are declared; a one-row aggregate over the key join switches the positional one off.
    """
    by_key = matched(pred, feedback, key, ordinal).where("p is not null and g is not null").select("p", "g")
    any_key = by_key.agg((F.count("*") > 0).alias("__any"))
    row = lambda df, name: df.select(F.struct("*").alias(name), F.col(ordinal).alias("__at"))
    by_place = row(pred, "p").join(row(feedback, "g"), "__at").crossJoin(F.broadcast(any_key)).where("not __any").select("p", "g")
    return by_key.unionByName(by_place)


def confusion(pairs: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: counts of the four outcomes, accuracy, precision, recall, F1; unknown labels don't count (A3)."""
    rows = pairs.select(predicted.alias("x"), actual.alias("y")).where("x is not null and y is not null")
    x, y = F.col("x"), F.col("y")
    out = rows.agg(F.count("*").alias("evaluated_pairs"), F.count_if(x & y).alias("tp"), F.count_if(~x & ~y).alias("tn"), F.count_if(x & ~y).alias("fp"), F.count_if(~x & y).alias("fn"))
    c = F.col
    p, r = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return out.select("*", ratio(c("tp") + c("tn"), c("evaluated_pairs")).alias("accuracy"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def similarity_stats(pairs: DataFrame, group: str, value: str, perfect: float = 100.0) -> DataFrame:
    """Mean, sample deviation, median and perfect count, by group and overall (group null)."""
    v = F.col(value)
    return pairs.rollup(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.count_if(v == perfect).alias("perfect"))


def pipeline_summary(results: DataFrame, by: Sequence[str], metrics: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Counts by status and rounded means; skipped runs count only where all were skipped."""
    skipped = F.col("status") == "skipped"
    some = F.max(F.when(skipped, 0).otherwise(1)) == 1
    mean = lambda m: F.when(some, F.avg(F.when(~skipped, F.col(m)))).otherwise(F.avg(m))
    rounded = lambda m: F.round(F.coalesce(mean(m), F.lit(None if m in optional else 0.0)), 6).alias(f"mean_{m}")
    # both means in one pass: no group's rows are brought together
    return results.groupBy(*by).agg(
        F.count_if(~skipped).alias("attempted"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(skipped).alias("skipped"),
        *[rounded(m) for m in (*metrics, *optional)],
    )


def ranked(summary: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """Rank within a group by falling score."""
    return summary.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), F.col(tie))))


_PARTS = "phi_field_recall field_accuracy text_score speed_score box_coverage over_redaction_score stability_score"
UTILITY = dict(zip(_PARTS.split(), (0.35, 0.25, 0.15, 0.1, 0.05, 0.05, 0.05)))


def speed_score(latency: Column, target: float) -> Column:
    """Target over latency, 1 at most (M5)."""
    return F.when(latency <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(target) / latency))


def stability_score(ok: Column, rss_mb: Column, budget: float = 256.0) -> Column:
    """0 for a failure, less with every MB that memory grew (M5)."""
    return F.when(~ok, 0.0).when(rss_mb.isNull() | (rss_mb <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - rss_mb / budget)))


def utility_score(parts: dict[str, Column], gate: float = 0.95) -> Column:
    """Weighted sum, 0 below the recall gate (M3)."""
    total = sum((parts[k] * w for k, w in UTILITY.items()), F.lit(0.0))
    return F.when(parts["phi_field_recall"] < gate, 0.0).otherwise(total)


def golden_set_audit(items: DataFrame, min_samples: int = 20, min_subjects: int = 5, min_groups: int = 3) -> DataFrame:
    """One row: counts and the list of reasons why a sample set is no benchmark."""
    by = items.groupBy("input_type").agg(F.count("*").alias("n"), F.count_distinct("source_group_id").alias("groups"))
    wanting = by.select(
        F.array_compact(
            F.array(
                F.when(F.col("n") < min_samples, F.format_string(f"%s has %d samples; require at least {min_samples}", "input_type", "n")),
                F.when(F.col("groups") < min_groups, F.format_string(f"%s has %d independent source groups; require at least {min_groups}", "input_type", "groups")),
            )
        ).alias("issues")
    ).agg(F.array_sort(F.flatten(F.collect_list("issues"))).alias("by_type"))
    c = F.col
    whole = items.agg(
        F.count("*").alias("sample_count"), F.count_distinct("subject_id").alias("subject_count"), F.count_distinct("source_group_id").alias("source_group_count"),
        F.count_if(c("subject_id").isNull()).alias("no_subject"), F.count_if(c("source_group_id").isNull()).alias("no_group"),
    )
    issues = F.concat(
        F.array_compact(
            F.array(
                F.when(c("no_subject") > 0, F.format_string("%d samples are missing subject_id", "no_subject")),
                F.when(c("no_group") > 0, F.format_string("%d samples are missing source_group_id", "no_group")),
                F.when(c("subject_count") < min_subjects, F.format_string(f"only %d independent subjects; require at least {min_subjects}", "subject_count")),
            )
        ),
        c("by_type"),
    )
    return whole.crossJoin(F.broadcast(wanting)).select("sample_count", "subject_count", "source_group_count", F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("benchmark_ready"))
