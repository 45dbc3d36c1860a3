"""Queries that hold predictions against gold records, and scores of pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import text as X
from ..operators import evaluation as V
from .q_text import _canon, _near, _scalar
from .tables import query

KEY = ("file", "report_id")


def _keyed(name: str, src: str) -> str:
    k = f"CASE WHEN {_scalar('file')} <> '' AND {_scalar('report_id')} <> '' THEN {_scalar('file')} || chr(31) || {_scalar('report_id')} ELSE '__idx__:' || ord END"
    return f"{name} AS (SELECT * FROM (SELECT *, {k} AS key, count(*) OVER (PARTITION BY {k}) AS dup, row_number() OVER (PARTITION BY {k} ORDER BY ord DESC) AS rn FROM {src}) WHERE rn = 1)"


_BOTH = f"{_keyed('p', 'predicted')}, {_keyed('g', 'gold')}"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b}) * 1e0, 0), 0e0)"


def _sim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1e0 WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE {_near(a, b)} END"


_FIELDS = " UNION ALL ".join(f"SELECT '{f}' AS field, {_canon(f'p.{f}', n)} AS a, {_canon(f'g.{f}', n)} AS b FROM p JOIN g USING (key)" for f, n in (("first_name", True), ("last_name", True), ("dob", False)))
_METRICS = f"""WITH {_BOTH}, v AS ({_FIELDS}), c AS (SELECT field, count(*) FILTER (a <> '' OR b <> '') AS support, count(*) FILTER ((a <> '' OR b <> '') AND a = b) AS exact, sum({_sim("a", "b")}) FILTER (a <> '' OR b <> '') AS near,
    count(*) FILTER (a <> '' AND b <> '') AS tp, count(*) FILTER (a <> '' AND b = '') AS fp, count(*) FILTER (a = '' AND b <> '') AS fn FROM v GROUP BY field),
    m AS (SELECT *, {_ratio("tp", "tp + fp")} AS p, {_ratio("tp", "tp + fn")} AS r FROM c),
    f AS (SELECT field, support, round({_ratio("exact", "support")}, 6) AS exact_match_rate, round({_ratio("near", "support")}, 6) AS mean_similarity, round(p, 6) AS presence_precision, round(r, 6) AS presence_recall, round({_ratio("2 * p * r", "p + r")}, 6) AS presence_f1,
      tp + fn AS gold_non_empty, tp + fp AS predicted_non_empty FROM m)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _metrics(t):
    return _rounded(V.field_metrics(t.predicted(), t.gold(), ["first_name", "last_name", "dob"], KEY, "ord", how="edit"))


@query("record_eval_fields", f"{_METRICS} SELECT * FROM f", ("predicted",))
def record_eval_fields(t):
    """Support, exactness, similarity and presence of each field."""
    return _metrics(t)


@query("record_eval_macro", f"{_METRICS} SELECT round(avg(exact_match_rate), 5) AS macro_exact_match_rate, round(avg(mean_similarity), 5) AS macro_mean_similarity, round(avg(presence_f1), 5) AS macro_presence_f1 FROM f", ("predicted",))
def record_eval_macro(t):
    """Unweighted means over fields."""
    m = V.macro(_metrics(t))
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query(
    "record_eval_unmatched",
    f"WITH {_BOTH} SELECT sum(g.dup)::BIGINT AS total_gold, sum(p.dup)::BIGINT AS total_predictions, count(*) FILTER (p.key IS NOT NULL AND g.key IS NOT NULL) AS matched, count(*) FILTER (p.key IS NULL) AS missing, count(*) FILTER (g.key IS NULL) AS extra, sum(g.dup - 1)::BIGINT AS duplicate_gold, sum(p.dup - 1)::BIGINT AS duplicate_predictions FROM p FULL JOIN g ON p.key = g.key",
    ("predicted",),
)
def record_eval_unmatched(t):
    """Keys matched, missing, extra and overwritten."""
    return V.unmatched(t.predicted(), t.gold(), KEY, "ord")


def _key_of(src: str) -> str:
    f, r = _scalar("file"), _scalar("report_id")
    return f"SELECT CASE WHEN {f} <> '' AND {r} <> '' THEN {f} || chr(31) || {r} ELSE '__idx__:' || ord END AS record_key FROM {src}"



@query(
    "cohort_intersection",
    f"WITH c AS ({_key_of("gold")} INTERSECT {_key_of("predicted")} INTERSECT {_key_of("(SELECT * FROM gold WHERE ord % 7 <> 0)")} INTERSECT {_key_of("(SELECT * FROM gold WHERE ord % 11 <> 0)")}) SELECT record_key FROM c",
    ("predicted",),
)
def cohort_intersection(t):
    """Keys that gold and three prediction sets share (J3, SC22)."""
    g = t.gold()
    return V.cohort(g, {"a": t.predicted(), "b": g.where("ord % 7 <> 0"), "c": g.where("ord % 11 <> 0")}, KEY, "ord")


@query(
    "feedback_confusion",
    """WITH l AS (SELECT doc_id, quality < 1 AS y, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN true ELSE false END ELSE regexp_matches(text, '[!#$%&*|]') END AS x FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT count(*) AS evaluated_pairs, count(*) FILTER (x AND y) AS tp, count(*) FILTER (NOT x AND NOT y) AS tn, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (NOT x AND y) AS fn FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
    d AS (SELECT *, coalesce(tp / nullif((tp + fp) * 1e0, 0), 0e0) AS p, coalesce(tp / nullif((tp + fn) * 1e0, 0), 0e0) AS r FROM c)
    SELECT evaluated_pairs, tp, tn, fp, fn, round(coalesce((tp + tn) / nullif(evaluated_pairs * 1e0, 0), 0e0), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0e0), 6) AS f1 FROM d""",
)
def feedback_confusion(t):
    """Inferred changes against labels."""
    d = F.col("doc_id")
    flag = F.when(d % 5 == 0, F.when(d % 2 == 0, "changed").otherwise("no"))
    anonymised = F.regexp_replace("text", "[!#$%&*|]", "x")
    pairs = t.labels.join(t.documents, "doc_id")
    return _rounded(V.confusion(pairs, E.changed([flag], F.col("text"), anonymised), F.col("quality") < 1))


@query(
    "feedback_by_position",
    """WITH g AS (SELECT count(*) AS n FROM customer) SELECT count(*) AS pairs, count(*) FILTER (a.c_mktsegment = b.s) AS same FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_mktsegment FROM customer) a
    JOIN (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_mktsegment AS s FROM customer) b USING (i)""",
)
def feedback_by_position(t):
    """Records that share no key pair up by position."""
    rows = t.customer.select("c_custkey", "c_mktsegment")
    a = rows.select(F.col("c_custkey").alias("ord"), F.lit("a").alias("file"), F.col("c_custkey").cast("string").alias("report_id"), "c_mktsegment")
    pairs = V.with_fallback(a, a.withColumn("file", F.lit("b")), KEY, "ord")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("p.c_mktsegment") == F.col("g.c_mktsegment")).alias("same"))


@query(
    "name_similarity_stats",
    f"""WITH {_BOTH}, v AS (SELECT p.file AS file, round(100 * {_sim(_canon("p.last_name", True), _canon("g.last_name", True))}, 6) AS s FROM p JOIN g USING (key))
    SELECT file, count(s) AS n, round(avg(s), 4) AS mean, round(stddev_samp(s), 4) AS std, round(median(s), 4) AS median, count(*) FILTER (s = 100) AS perfect FROM v GROUP BY ROLLUP (file)""",
    ("predicted",),
)
def name_similarity_stats(t):
    """Mean, deviation, median and perfect scores by file and overall."""
    m = V.matched(t.predicted(), t.gold(), KEY, "ord").where("p is not null and g is not null")
    a, b = (X.canonical(F.col(f"{k}.last_name"), True) for k in ("p", "g"))
    s = V.similarity_stats(m.select(F.col("p.file").alias("file"), F.round(100 * V.similarity("last_name", a, b, "edit"), 6).alias("s")), "file", "s")
    return s.select("file", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")], "perfect")


_RESULTS = """r AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 2 = 0 THEN 'video_frame' ELSE 'text_report' END AS input_type, 'V' || (l_linenumber % 3 + 1) AS pipeline_id, CASE WHEN l_linenumber % 3 = 2 AND l_suppkey % 2 = 0 THEN 'skipped' WHEN l_partkey % 11 = 0 THEN 'failed' WHEN l_partkey % 13 = 0 THEN 'skipped' ELSE 'ok' END AS status,
    1e0 - (l_partkey % 10) / 1e2 AS phi_field_recall, (l_suppkey % 9) / 8e0 AS field_accuracy, (l_partkey % 8) / 7e0 AS text_score, (l_partkey % 7) / 6e0 AS box_coverage, (l_partkey % 6) / 5e0 AS over_redaction_score, l_quantity / 1e1 AS latency,
    CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE (l_partkey % 400) * 1e0 END AS rss, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_suppkey % 5) / 4e0 END AS removed FROM lineitem),
    s AS (SELECT *, CASE WHEN latency <= 0 THEN 1e0 ELSE least(1e0, 5e-1 / latency) END AS speed_score, CASE WHEN status <> 'ok' THEN 0e0 WHEN rss IS NULL OR rss <= 0 THEN 1e0 ELSE greatest(0e0, least(1e0, 1e0 - rss / 256e0)) END AS stability_score FROM r),
    u AS (SELECT *, CASE WHEN phi_field_recall < 95e-2 THEN 0e0 ELSE 35e-2 * phi_field_recall + 25e-2 * field_accuracy + 15e-2 * text_score + 5e-2 * box_coverage + 5e-2 * over_redaction_score + 1e-1 * speed_score + 5e-2 * stability_score END AS utility_score FROM s)"""


def _results(t):
    c = F.col
    k, s = c("l_partkey"), c("l_suppkey")
    r = t.lineitem.select(
        F.when(s % 2 == 0, "video_frame").otherwise("text_report").alias("input_type"), F.concat(F.lit("V"), (c("l_linenumber") % 3 + 1).cast("string")).alias("pipeline_id"),
        F.when((c("l_linenumber") % 3 == 2) & (s % 2 == 0), "skipped").when(k % 11 == 0, "failed").when(k % 13 == 0, "skipped").otherwise("ok").alias("status"), (1.0 - (k % 10) / 100.0).alias("phi_field_recall"), ((s % 9) / 8.0).alias("field_accuracy"),
        ((k % 8) / 7.0).alias("text_score"), ((k % 7) / 6.0).alias("box_coverage"), ((k % 6) / 5.0).alias("over_redaction_score"), (c("l_quantity") / 10.0).alias("latency"), F.when(k % 4 != 0, (k % 400) * 1.0).alias("rss"), F.when(k % 3 != 0, (s % 5) / 4.0).alias("removed"),
    )
    r = r.withColumns({"speed_score": V.speed_score(c("latency"), 0.5), "stability_score": V.stability_score(c("status") == "ok", c("rss"))})
    return r.withColumn("utility_score", V.utility_score({m: c(m) for m in V.UTILITY}))


@query("utility_scores", f"WITH {_RESULTS} SELECT input_type, pipeline_id, status, count(*) AS n, round(sum(utility_score), 4) AS utility, round(sum(speed_score), 4) AS speed, round(sum(stability_score), 4) AS stability, count(*) FILTER (phi_field_recall < 95e-2) AS gated FROM u GROUP BY ALL")
def utility_scores(t):
    """Gated utility, speed and stability (M3, M5, M6)."""
    s = lambda m, a: F.round(F.sum(m), 4).alias(a)
    return _results(t).groupBy("input_type", "pipeline_id", "status").agg(F.count("*").alias("n"), s("utility_score", "utility"), s("speed_score", "speed"), s("stability_score", "stability"), F.count_if(F.col("phi_field_recall") < 0.95).alias("gated"))


_M = ("utility_score", "phi_field_recall", "field_accuracy", "speed_score")


@query(
    "pipeline_summary",
    f"""WITH {_RESULTS}, w AS (SELECT *, max(CASE WHEN status = 'skipped' THEN 0 ELSE 1 END) OVER (PARTITION BY input_type, pipeline_id) AS ran FROM u),
    g AS (SELECT input_type, pipeline_id, count(*) FILTER (status <> 'skipped') AS attempted, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
      {", ".join(f"round(coalesce(avg({m}) FILTER (status <> 'skipped' OR ran = 0), 0e0), 6) AS mean_{m}" for m in _M)}, round(avg(removed) FILTER (status <> 'skipped' OR ran = 0), 6) AS mean_removed FROM w GROUP BY input_type, pipeline_id)
    SELECT *, row_number() OVER (PARTITION BY input_type ORDER BY mean_utility_score DESC, pipeline_id) AS rank FROM g""", wide="rank")
def pipeline_summary(t):
    """Counts, means and rank of each pipeline."""
    s = V.pipeline_summary(_results(t), ["input_type", "pipeline_id"], _M, ["removed"])
    return V.ranked(s, "input_type", "mean_utility_score", "pipeline_id")


@query(
    "golden_set_audit",
    """WITH i AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'text_report' ELSE 'video_frame' END AS input_type, CASE WHEN doc_id % 10 > 0 THEN doc_id % 4 END AS subject_id, CASE WHEN doc_id % 7 > 0 THEN doc_id % 2 END AS grp FROM labels),
    b AS (SELECT input_type, count(*) AS n, count(DISTINCT grp) AS g FROM i GROUP BY input_type), t AS (SELECT input_type || ' has ' || n || ' samples; require at least 20' AS m FROM b WHERE n < 20 UNION ALL SELECT input_type || ' has ' || g || ' independent source groups; require at least 3' FROM b WHERE g < 3),
    w AS (SELECT count(*) AS sample_count, count(DISTINCT subject_id) AS subject_count, count(DISTINCT grp) AS source_group_count, count(*) FILTER (subject_id IS NULL) AS ns, count(*) FILTER (grp IS NULL) AS ng FROM i)
    SELECT sample_count, subject_count, source_group_count, concat_ws('; ', CASE WHEN ns > 0 THEN ns || ' samples are missing subject_id' END, CASE WHEN ng > 0 THEN ng || ' samples are missing source_group_id' END,
      CASE WHEN subject_count < 5 THEN 'only ' || subject_count || ' independent subjects; require at least 5' END, (SELECT string_agg(m, '; ' ORDER BY m) FROM t)) AS issues, false AS benchmark_ready FROM w""",
)
def golden_set_audit(t):
    """Why a sample set is no benchmark."""
    d = F.col("doc_id")
    i = t.labels.select(F.when(F.col("toxic") == 1, "text_report").otherwise("video_frame").alias("input_type"), F.when(d % 10 > 0, d % 4).alias("subject_id"), F.when(d % 7 > 0, d % 2).alias("source_group_id"))
    return V.golden_set_audit(i)


@query(
    "result_projection",
    """SELECT conv_id, turn, length(text) AS recognized_text_chars, sha256(text) AS recognized_text_sha256, role <> 'system' AS has_name, text <> '' AS has_text FROM conversations""", wide="recognized_text_chars")
def result_projection(t):
    """A result without its text: length, hash and presence flags (SC19, F21)."""
    from ..sources.sinks import private_view

    return private_view(t.conversations, ["conv_id", "turn"], "text", {"has_name": F.when(F.col("role") != "system", F.col("role")), "has_text": F.col("text")})
