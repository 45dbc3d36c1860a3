"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import sensitive as N
from ..functions import text as X
from ..functions.fuzzy import best_match, compose
from ..operators import frames as FR
from ..operators import redact as R
from .tables import lit, query

SP, WORD = X.SP, X.WORD
TOKENS = lit(f"[^{SP}]+")


def _n(c: str, members: str) -> str:
    return f"length(regexp_replace({c}, {lit(f'[^{members}]')}, '', 'g'))"


def _without(c: str, members: str) -> str:
    return f"length(regexp_replace({c}, {lit(f'[{members}]')}, '', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {lit(rf'\A[{SP}]+|[{SP}]+\z')}, '', 'g')"


def _hit(c: str, p: str) -> str:
    return f"regexp_matches({c}, {lit(p)})"


_EDGE = lit(E.NUMBER)
_MARKS = "regexp_replace(regexp_replace(regexp_replace(text, {e}, '[EMAIL]', 'g'), {p}, '[PHONE]', 'g'), {i}, '[IP]', 'g')".format(e=lit(E.EMAIL), p=lit(E.PHONE), i=lit(E.IPV4))
_ALL_MARKS = "text"
for _p, _m in ((E.EMAIL, "[EMAIL]"), (E.PHONE, "[PHONE]"), *N.MARKS, (E.IPV4, "[IP]")):
    _ALL_MARKS = f"regexp_replace({_ALL_MARKS}, {lit(_p)}, {lit(_m)}, 'g')"


@query(
    "pii_redact_documents",
    rf"""SELECT doc_id, lang, len(regexp_extract_all(text, {lit(E.EMAIL)})) AS n_email, len(regexp_extract_all(text, {lit(E.PHONE)})) AS n_phone, len(regexp_extract_all(text, {lit(E.IPV4)})) AS n_ip,
        len(list_filter(string_split(regexp_replace(text, {lit(f"[^{WORD}]+")}, ' ', 'g'), ' '), lambda w: regexp_full_match(w, '[0-9]{{5,}}'))) AS n_long_number,
        {" + ".join(f"len(regexp_extract_all(text, {lit(p)}))" for p, _ in N.MARKS)} AS n_sensitive, regexp_replace(regexp_replace({_ALL_MARKS}, {_EDGE}, '\1[NUMBER]\2', 'g'), {_EDGE}, '\1[NUMBER]\2', 'g') AS redacted FROM documents""", wide="n_email n_phone n_ip n_long_number n_sensitive")
def pii_redact_documents(t):
    """Identifiers counted and replaced."""
    return t.documents.select("doc_id", "lang", *[c.alias(k) for k, c in R.pii_counts(F.col("text")).items()], R.pii_redact(F.col("text")).alias("redacted"))


@query(
    "pii_by_language",
    rf"""SELECT lang, count(*) AS documents, sum(len(regexp_extract_all(text, {lit(E.EMAIL)})))::BIGINT AS n_email, sum(len(regexp_extract_all(text, {lit(E.PHONE)})))::BIGINT AS n_phone, sum(len(regexp_extract_all(text, {lit(E.IPV4)})))::BIGINT AS n_ip,
        sum(length({_MARKS}))::BIGINT AS n_chars FROM documents GROUP BY lang""",
)
def pii_by_language(t):
    """Hits of each kind by language."""
    c = F.col("text")
    marks = c
    for p, m in ((E.EMAIL, "[EMAIL]"), (E.PHONE, "[PHONE]"), (E.IPV4, "[IP]")):
        marks = F.regexp_replace(marks, p, m)
    return t.documents.groupBy("lang").agg(F.count("*").alias("documents"), *[F.sum(x).cast("bigint").alias(k) for k, x in R.pii_counts(c).items() if k not in ("n_long_number", "n_sensitive")], F.sum(F.length(marks)).cast("bigint").alias("n_chars"))


_ALLOWED = lit(f"[^{WORD}{SP}.,:;/-ÄÖÜäöüß]")


def _normal(c: str) -> str:
    c = f"regexp_replace(nfc_normalize({c}), {_ALLOWED}, '', 'g')"
    for m in (r"\.", ",", ":", ";"):
        c = f"regexp_replace({c}, {lit(m + '{2,}')}, {lit(m[-1])}, 'g')"
    c = rf"regexp_replace({c}, '([.,:;])[.,:;]+', '\1', 'g')"
    return _strip(f"regexp_replace({c}, {lit(f'[{SP}]{{2,}}')}, ' ', 'g')")


@query("normalize_text", f"SELECT doc_id, {_normal('text')} AS normal, lower({_strip(f'regexp_replace(text, {lit(f"[{SP}]+")}, {lit(" ")}, {lit("g")})')}) AS dedup_key FROM documents")
def normalize_text(t):
    """Overlay normal form and comparison key."""
    return t.documents.select("doc_id", X.normalize_overlay(compose(F.col("text"))).alias("normal"), X.dedup_key(F.col("text")).alias("dedup_key"))


@query("structured_overlay_flags", f"SELECT doc_id, {_hit('text', X.STRICT_OVERLAY)} AS strict, {_hit('text', X.LOOSE_OVERLAY)} AS loose FROM documents")
def structured_overlay_flags(t):
    """Whether a text holds clocks, dates, codes or ratios."""
    return t.documents.select("doc_id", X.structured_strict(F.col("text")).alias("strict"), X.structured_loose(F.col("text")).alias("loose"))


_GIB = f"""WITH a AS (SELECT doc_id, text, length(text) AS n, {_n("text", r"\p{L}")} AS letters, {_without("text", X.STANDARD)} AS odd, {_without("text", rf"\p{{L}}\p{{N}}{SP}.,:;/\-")} AS marks,
    list_filter(regexp_extract_all(text, {TOKENS}), lambda w: length(w) > 1) AS words, len(list_distinct(regexp_extract_all(replace(text, ' ', ''), '(?s).'))) AS uniq FROM documents),
    b AS (SELECT *, len(words) AS k, len(list_filter(words, lambda w: regexp_matches(w, {lit(X.VOWEL)}))) AS v FROM a)"""


@query(
    "text_quality_documents",
    _GIB
    + f""", s AS (SELECT *, regexp_extract_all(text, '[{X.LATIN}]{{2,}}') AS lw FROM b),
    r AS (SELECT *, len(lw) AS lk, list_sum(list_transform(lw, lambda w: length(w))) AS ll, len(list_filter(lw, lambda w: length(w) >= 3 AND length(replace(w, w[1], '')) > 0)) AS rd, {_n("text", r"\p{P}\p{S}")} / n AS pr, (n % 100) / 1e2 AS conf,
        least({" + ".join(f"CASE WHEN {_hit('text', p)} THEN 1e-1 ELSE 0e0 END" for p in X.CLINICAL)}, 3e-1) AS med FROM s)
    SELECT doc_id, CASE WHEN n < 3 THEN true WHEN {_hit("text", X.STRICT_OVERLAY)} THEN false WHEN letters / n < 2e-1 THEN true WHEN odd > n * 4e-1 THEN true WHEN NOT {_hit("text", f"[^{SP}]")} THEN true
        WHEN k > 0 AND v < k * 15e-2 THEN true ELSE uniq < n * 1e-1 END AS is_gibberish,
      round(greatest(0e0, least(1e0, CASE WHEN letters / n < 2e-1 THEN 35e-2 WHEN letters / n < 35e-2 THEN 15e-2 ELSE 0e0 END + least(odd / n * 8e-1, 4e-1) + least(marks / n * 6e-1, 2e-1)
        + CASE WHEN k > 0 AND v / k < 15e-2 THEN 25e-2 WHEN k > 0 AND v / k < 3e-1 THEN 1e-1 ELSE 0e0 END)), 6) AS gibberish_score,
      round(greatest(0e0, least(1e0, (conf * 4e-1 + CASE WHEN lk > 0 THEN med + CASE WHEN ll / lk >= 4 THEN 1e-1 ELSE 0e0 END + rd / lk * 2e-1 ELSE 0e0 END) * CASE WHEN n < 4 THEN 1e0 WHEN pr > 5e-1 THEN 3e-1 WHEN pr > 3e-1 THEN 7e-1 ELSE 1e0 END
        + least(n / 1e3, 1e-1))), 6) AS quality FROM r""",
)
def text_quality_documents(t):
    """Noise test, noise score and readability."""
    c = F.col("text")
    conf = (F.length(c) % 100) / 100.0
    return t.documents.select("doc_id", X.is_gibberish(c).alias("is_gibberish"), F.round(X.gibberish_score(c), 6).alias("gibberish_score"), F.round(X.quality_score(c, conf), 6).alias("quality"))


@query(
    "valid_overlay_frames",
    f"""WITH a AS (SELECT conv_id, turn, text, length(text) AS n, list_filter(regexp_extract_all(text, {TOKENS}), lambda w: length(w) > 1) AS words FROM conversations),
    b AS (SELECT *, len(words) AS k, len(list_filter(words, lambda w: regexp_matches(w, {lit(X.VOWEL)}))) AS v FROM a)
    SELECT conv_id, turn, CASE WHEN length({_strip("text")}) < 3 THEN false WHEN {_hit("text", X.STRICT_OVERLAY)} THEN true WHEN {_n("text", r"\p{L}")} / n < 2e-1 THEN false WHEN {_without("text", X.STANDARD)} > n * 4e-1 THEN false
      WHEN k = 0 THEN false ELSE NOT (k > 2 AND v < k * 15e-2) END AS valid,
      CASE WHEN n < 3 THEN false ELSE NOT ({_without("text", r"\x00-\x7f\p{L}")} > n * 3e-1) AND len(list_filter(regexp_extract_all(text, '[{X.LATIN}]{{2,}}'), lambda w: length(w) >= 3 AND length(replace(w, w[1], '')) > 0)) > 0 END AS readable FROM b""",
)
def valid_overlay_frames(t):
    """Admission tests of two frame readers."""
    return t.conversations.select("conv_id", "turn", X.is_valid_overlay(F.col("text")).alias("valid"), X.is_quality_text(F.col("text")).alias("readable"))


@query(
    "text_profile_documents",
    f"""WITH a AS (SELECT doc_id, text, length(text) AS n, {_n("text", X.HARD_MARKS)} AS m, regexp_extract_all(text, '[{X.LATIN}]{{2,}}') AS lw, {_without("text", r"\x00-\x7f\p{L}")} AS odd,
      {" + ".join(f"len(regexp_extract_all(text, {lit(p)}))" for p in X._REPEATS)} AS rep FROM documents),
    b AS (SELECT *, m / greatest(n, 1) AS share, len(list_filter(lw, lambda w: length(w) >= 3 AND length(replace(w, w[1], '')) > 0)) AS rd FROM a),
    c AS (SELECT *, CASE WHEN share > 5e-1 THEN 4e-1 ELSE 0e0 END + CASE WHEN rd = 0 THEN 3e-1 ELSE 0e0 END + CASE WHEN rep > 2 THEN 2e-1 ELSE 0e0 END + CASE WHEN odd > n * 2e-1 THEN 1e-1 ELSE 0e0 END AS score FROM b)
    SELECT doc_id, {_n("text", r"\p{L}")} AS n_letters, {_n("text", r"\p{Nd}")} AS n_digits, m AS n_marks, {_n("text", SP)} AS n_spaces, round(share, 6) AS mark_share, len(lw) AS n_words, rd AS n_readable, rep AS n_repeats, odd AS n_odd,
      round(score, 6) AS noise, score > 6e-1 OR share > 7e-1 AS is_noise FROM c""", wide="n_letters n_digits n_marks n_spaces n_words n_readable n_repeats n_odd")
def text_profile_documents(t):
    """Counts, shares and the coarse noise score."""
    p = X.profile(F.col("text"))
    rows = t.documents.select("doc_id", *[c.alias(k) for k, c in p.items()])
    return rows.select("doc_id", *[k for k in p if k != "n_chars"], *[(c if k == "is_noise" else F.round(c, 6)).alias(k) for k, c in X.noise_of({k: F.col(k) for k in p}).items()])


@query(
    "diagnostic_summary",
    f"""WITH a AS (SELECT lang, length(text) AS n, {_n("text", X.HARD_MARKS)} / greatest(length(text), 1) AS share, (length(text) % 100) / 1e2 AS conf FROM documents),
    b AS (SELECT lang, count(*) AS total_samples, count(*) FILTER (share > 5e-2) AS marked_samples, round(avg(conf), 6) AS avg_confidence, round(avg(share), 6) AS avg_noise FROM a GROUP BY lang)
    SELECT *, CASE WHEN avg_confidence < 2e-1 THEN 'LOW_CONFIDENCE' WHEN avg_noise > 7e-1 THEN 'HIGH_GIBBERISH' WHEN avg_confidence > 6e-1 AND avg_noise < 3e-1 THEN 'GOOD_QUALITY' ELSE 'MODERATE_ISSUES' END AS recommendation FROM b""",
)
def diagnostic_summary(t):
    """Means and the four-way recommendation by language."""
    c = F.col("text")
    # a column of its own: the aggregates would count the marks once each
    rows = t.documents.select("lang", F.length(c).alias("n"), X.count_of(c, X.HARD_MARKS).alias("marks"))
    n, share = F.col("n"), F.col("marks") / F.greatest("n", F.lit(1))
    out = rows.groupBy("lang").agg(F.count("*").alias("total_samples"), F.count_if(share > 0.05).alias("marked_samples"), F.round(F.avg((n % 100) / 100.0), 6).alias("avg_confidence"), F.round(F.avg(share), 6).alias("avg_noise"))
    q, n = F.col("avg_confidence"), F.col("avg_noise")
    return out.withColumn("recommendation", F.when(q < 0.2, "LOW_CONFIDENCE").when(n > 0.7, "HIGH_GIBBERISH").when((q > 0.6) & (n < 0.3), "GOOD_QUALITY").otherwise("MODERATE_ISSUES"))


@query(
    "dedup_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    s AS (SELECT doc_id, pos, {_strip("line")} AS line FROM l), k AS (SELECT *, regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM s WHERE length(line) >= 4),
    f AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM k WHERE k <> '' GROUP BY doc_id, k) SELECT doc_id, left(string_agg(line, ' | ' ORDER BY pos), 1500) AS lines FROM f GROUP BY doc_id""",
)
def dedup_lines(t):
    """First occurrences of lines, joined."""
    return FR.distinct_lines(t.documents, "doc_id", "text")


@query("keyword_precheck", f"""SELECT doc_id, length({_strip("text")}) >= 10 AND ({" + ".join(f"contains(lower(text), {lit(h)})::INT" for h in X.HINTS)}) >= 2 AS has_hints FROM documents""")
def keyword_precheck(t):
    """At least two patient hints."""
    return t.documents.select("doc_id", X.has_patient_hints(F.col("text")).alias("has_hints"))


@query(
    "text_cutoffs",
    """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda x: contains(x, '. ')), true), 0) AS spot FROM a)
    SELECT doc_id, array_to_string(CASE WHEN spot > 0 THEN l[spot:] ELSE l END, chr(10)) AS below, array_to_string(CASE WHEN spot > 0 THEN l[1:spot] ELSE l END, chr(10)) AS above,
      regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\\n{2,}', chr(10), 'g'), '\\n', ' ', 'g') AS flat FROM b""".replace("\\\\", "\\"),
)
def text_cutoffs(t):
    """Text from, and up to, the first line with a flag; text as one line."""
    c = F.col("text")
    return t.documents.select("doc_id", X.cut_above(c, [". "]).alias("below"), X.cut_below(c, [". "]).alias("above"), X.flatten_lines(c).alias("flat"))


@query("text_chunks", "SELECT doc_id, i::INT AS chunk, substr(text, (i * 2048 + 1)::INT, 2048) AS piece FROM documents, generate_series(0, (length(text) - 1) // 2048) g(i) WHERE length(text) > 0")
def text_chunks(t):
    """Fixed windows of 2048 characters."""
    return t.documents.select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "piece"))


_FOLD = "text"
for _a, _b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"


@query(
    "text_folding",
    f"""SELECT doc_id, {_FOLD} AS umlauts, regexp_replace(translate(text, {lit(X._ACCENTS)}, {lit(X._BARE)}), '[^\\x00-\\x7f]', '', 'g') AS ascii,
      CASE WHEN coalesce(regexp_replace(left(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), 180), '\\A_+|_+\\z', '', 'g'), '') = '' THEN 'frame' ELSE regexp_replace(left(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), 180), '\\A_+|_+\\z', '', 'g') END AS file_name
    FROM documents""",
)
def text_folding(t):
    """Umlauts, ASCII and file names."""
    c = F.col("text")
    return t.documents.select("doc_id", X.fold_umlauts(c).alias("umlauts"), X.fold_ascii(c).alias("ascii"), X.safe_name(c).alias("file_name"))


_TITLES = "[" + ", ".join(map(lit, sorted(X.TITLES))) + "]"
_EVAL = ", ".join(map(lit, X.EVAL_BLANK))


def _scalar(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND lower({_strip(c)}) NOT IN ({_EVAL}) THEN {_strip(c)} ELSE '' END"


def _canon(c: str, name: bool) -> str:
    s = f"regexp_replace(lower({_scalar(c)}), {lit(f'[^{WORD}]')}, ' ', 'g')"
    return f"array_to_string(list_filter(regexp_extract_all({s}, {TOKENS}), lambda w: NOT list_contains({_TITLES}, w)), ' ')" if name else f"trim({s})"


@query("canonical_values", f"SELECT ord, {_canon('first_name', True)} AS first_name, {_canon('last_name', True)} AS last_name, {_canon('dob', False)} AS dob FROM predicted", ("predicted",))
def canonical_values(t):
    """What the record evaluation compares."""
    return t.predicted().select("ord", X.canonical(F.col("first_name"), True).alias("first_name"), X.canonical(F.col("last_name"), True).alias("last_name"), X.canonical(F.col("dob"), False).alias("dob"))


_MATRIX = ", ".join(map(lit, X.MATRIX_BLANK))


def _field(c: str, date: bool) -> str:
    k = f"lower({_strip(f'regexp_replace({c}, {lit(f"[{SP}]+")}, {lit(" ")}, {lit("g")})')})"
    v = f"CASE WHEN {c} IS NOT NULL AND lower({_strip(c)}) NOT IN ({_MATRIX}) THEN {k} ELSE '' END"
    return f"translate({v}, '/-', '..')" if date else v


def _near(a: str, b: str) -> str:
    return f"greatest(0e0, 1e0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1))"


def _fsim(a: str, b: str, digits: bool) -> str:
    da, db = (f"regexp_replace({x}, '[^0-9]', '', 'g')" for x in (a, b))
    near = f"CASE WHEN {da} <> '' AND {db} <> '' THEN {_near(da, db)} ELSE {_near(a, b)} END" if digits else _near(a, b)
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1e0 WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE {near} END"


def _fmatch(a: str, b: str, digits: bool) -> str:
    return f"CASE WHEN {b} = '' THEN {a} = '' WHEN {a} = '' THEN false ELSE contains({a}, {b}) OR contains({b}, {a}) OR {_fsim(a, b, digits)} >= 85e-2 END"


@query(
    "field_scores",
    f"""WITH j AS (SELECT g.ord, {_field("p.first_name", False)} AS pf, {_field("g.first_name", False)} AS gf, {_field("p.last_name", False)} AS pl, {_field("g.last_name", False)} AS gl, {_field("p.dob", True)} AS pd, {_field("g.dob", True)} AS gd FROM gold g JOIN predicted p USING (ord)),
    s AS (SELECT ord, [CASE WHEN gf <> '' THEN ({_fmatch("pf", "gf", False)})::INT END, CASE WHEN gl <> '' THEN ({_fmatch("pl", "gl", False)})::INT END, CASE WHEN gd <> '' THEN ({_fmatch("pd", "gd", True)})::INT END] AS hit,
      ({_fsim("pf", "gf", False)} + {_fsim("pl", "gl", False)} + {_fsim("pd", "gd", True)}) / 3 AS acc FROM j)
    SELECT ord, coalesce(round(list_sum(hit) / nullif(len(list_filter(hit, lambda x: x IS NOT NULL)), 0), 6), 1e0) AS phi_field_recall, round(acc, 6) AS field_accuracy FROM s""",
    ("gold", "predicted"),
)
def field_scores(t):
    """Recall and accuracy of the record's fields."""
    kinds = (("first_name", False), ("last_name", False), ("dob", True))
    j = t.gold().alias("g").join(t.predicted().alias("p"), "ord")
    pair = {f: (X.field_value(F.col(f"p.{f}"), d), X.field_value(F.col(f"g.{f}"), d), d) for f, d in kinds}
    hits = F.array_compact(F.array(*[F.when(b != "", X.field_match(a, b, d).cast("int")) for a, b, d in pair.values()]))
    acc = sum((X.field_similarity(a, b, d) for a, b, d in pair.values()), F.lit(0.0)) / len(pair)
    recall = F.when(F.size(hits) == 0, 1.0).otherwise(F.aggregate(hits, F.lit(0), lambda s, x: s + x) / F.size(hits))
    return j.select("ord", F.round(recall, 6).alias("phi_field_recall"), F.round(acc, 6).alias("field_accuracy"))


@query(
    "fuzzy_best_match",
    """WITH n AS (SELECT DISTINCT last_name AS name FROM gold WHERE last_name IS NOT NULL), v AS (SELECT DISTINCT last_name AS value FROM predicted WHERE last_name IS NOT NULL),
    s AS (SELECT value, name, round(jaro_winkler_similarity(value, name), 9) AS r FROM v, n), m AS (SELECT value, max(r) AS ratio, arg_min(name, {'r': -r, 'p': name}) AS best FROM s GROUP BY value)
    SELECT ord, CASE WHEN ratio >= 6e-1 THEN best END AS match, round(ratio, 6) AS ratio FROM predicted LEFT JOIN m ON last_name = value""",
    ("predicted",),
)
def fuzzy_best_match(t):
    """The most similar known name of each read one, if similar enough."""
    names = t.gold().where("last_name is not null").select(F.col("last_name").alias("name")).distinct()
    best = best_match(t.predicted().select(F.col("last_name").alias("value")), names, 0.6)
    return t.predicted().select("ord", F.col("last_name").alias("value")).join(best, "value", "left").select("ord", "match", F.round("ratio", 6).alias("ratio"))


@query(
    "closest_field",
    """WITH s AS (SELECT p_partkey, b.p_type AS p_type, levenshtein(a.p_type, b.p_type) AS d, length(a.p_type) AS n, length(b.p_type) AS m FROM (SELECT p_partkey, replace(p_type, 'O', '0') AS p_type FROM part) a, (SELECT DISTINCT p_type FROM part) b)
    SELECT p_partkey, arg_min(p_type, {'d': d, 'p': p_type}) AS field, round(max(1e0 - d / greatest(n, m, 1)), 6) AS similarity FROM s GROUP BY p_partkey""",
)
def closest_field(t):
    """The standard value nearest to a misread one by edit distance."""
    std = t.part.select(F.col("p_type").alias("std")).distinct()
    a = t.part.select("p_partkey", F.replace("p_type", F.lit("O"), F.lit("0")).alias("a"))
    # few distinct misreadings: the comparison runs once for each
    pairs = a.select("a").distinct().crossJoin(std).withColumns({"d": F.levenshtein("a", "std"), "s": X.edit_similarity(F.col("a"), F.col("std"))})
    best = pairs.groupBy("a").agg(F.min_by("std", F.struct("d", "std")).alias("field"), F.round(F.max("s"), 6).alias("similarity"))
    return a.join(best, "a").select("p_partkey", "field", "similarity")


def _g(p: str, k: int = 1) -> str:
    return f"nullif(regexp_extract(text, {lit(p)}, {k}), '')"


_A, _B = zip(*[(_g(p, 1), _g(p, 2)) for p in E.NAME_RULES])
_CASES = "coalesce(" + ", ".join(_g(p) for p in E.CASE_RULES) + ")"
_CLOCKS = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({_g(p)}, '\\A[0-9]{{1,2}}:[0-9]{{2}}\\z') THEN {_g(p)} END" for p in E.TIME_RULES) + ")"


@query(
    "overlay_metadata",
    f"""WITH n AS (SELECT ord, text, CASE {" ".join(f"WHEN {a} IS NOT NULL THEN {a}" for a in _A)} END AS a, CASE {" ".join(f"WHEN {a} IS NOT NULL THEN {b}" for a, b in zip(_A, _B))} END AS b FROM overlays),
    s AS (SELECT *, strpos(text, ',') > 0 AND strpos(text, ',') < strpos(text, b) AS swap FROM n)
    SELECT ord, CASE WHEN swap THEN b ELSE a END AS first_name, CASE WHEN swap THEN a ELSE b END AS last_name, {_strip(f"regexp_replace({_CASES}, {lit(f'[{SP}]+')}, ' ', 'g')")} AS casenumber, {_CLOCKS} AS examination_time,
      CASE lower({_g(rf"(?i)(?:\A|[^{WORD}])(männlich|weiblich|male|female|m|f|w)(?:[^{WORD}]|\z)")}) WHEN 'male' THEN 'M' WHEN 'm' THEN 'M' WHEN 'männlich' THEN 'M' WHEN 'weiblich' THEN 'F' WHEN 'female' THEN 'F' WHEN 'f' THEN 'F' WHEN 'w' THEN 'F' END AS gender FROM s""",
    ("overlays",),
)
def overlay_metadata(t):
    """Names, case number, clock and gender of an overlay."""
    c = F.col("text")
    first, last = E.patient_name(c)
    return t.overlays().select("ord", first.alias("first_name"), last.alias("last_name"), E.case_number(c).alias("casenumber"), E.examination_time(c).alias("examination_time"), E.gender(c).alias("gender"))


@query(
    "overlay_dates",
    r"""SELECT ord, CASE ord % 4 WHEN 0 THEN CASE WHEN ord % 17 <> 0 THEN make_date((ord % 60 + 1940)::INT, (ord % 12 + 1)::INT, (ord % 28 + 1)::INT) END
      WHEN 1 THEN CASE WHEN ord % 17 <> 0 THEN make_date((ord % 60 + 1940)::INT, (ord % 12 + 1)::INT, (ord % 28 + 1)::INT) END END AS dob, CASE WHEN ord % 4 = 1 THEN date '2021-04-03' END AS exam FROM gold""",
    ("gold",), text="dob exam")
def overlay_dates(t):
    """Which date is the birth and which the examination (E3); the layouts tell the answer."""
    return t.overlays().select("ord", E.date_roles(F.col("text")).alias("r")).select("ord", "r.dob", "r.exam")


@query(
    "date_parsing",
    r"""SELECT o_orderkey, o_orderdate::DATE AS dotted, CASE WHEN year(o_orderdate) >= 1950 THEN o_orderdate::DATE END AS short, o_orderdate::DATE AS compact, o_orderdate::DATE AS record, NULL::DATE AS wrong FROM orders""", text="dotted short compact record wrong")
def date_parsing(t):
    """Dates written in the reference's forms and read again."""
    d = F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    return t.orders.select(
        "o_orderkey", E.german_date(f("d . M-yyyy")).alias("dotted"), E.report_date(f("dd MM yy")).alias("short"), E.compact_date(f("ddMMyyyy")).alias("compact"), E.any_date(f("yyyy/MM/dd")).alias("record"), E.any_date(f("MM-dd-yy")).alias("wrong")
    )


@query(
    "patient_fallback",
    f"""SELECT ord, CASE WHEN {_g(E.FULL_RULE, 1)} IS NOT NULL THEN {_g(E.FULL_RULE, 2)} WHEN {_g(E.SIMPLE_RULE, 1)} IS NOT NULL THEN {_g(E.SIMPLE_RULE, 2)} END AS first_name,
      CASE WHEN {_g(E.FULL_RULE, 1)} IS NOT NULL THEN {_g(E.FULL_RULE, 1)} ELSE {_g(E.SIMPLE_RULE, 1)} END AS last_name, CASE WHEN {_g(E.FULL_RULE, 1)} IS NOT NULL THEN try_strptime({_g(E.FULL_RULE, 3)}, '%d.%m.%Y')::DATE END AS dob,
      {_g(E.FULL_RULE, 4)} AS casenumber FROM overlays""",
    ("overlays",), text="dob")
def patient_fallback(t):
    """Names, birth and case by the three report rules."""
    return t.overlays().select("ord", E.patient_fallback(F.col("text")).alias("r")).select("ord", "r.first_name", "r.last_name", "r.dob", "r.casenumber")


@query(
    "report_lines",
    r"""SELECT o_orderkey, 'Meier' AS examiner_last_name, 'Eva' AS examiner_first_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE (o_orderdate + INTERVAL 1 DAY)::DATE END AS examination_date, '10:15' AS examination_time, 'GIF 100' AS endoscope_type, o_orderkey::VARCHAR AS endoscope_sn FROM orders""", text="examination_date")
def report_lines(t):
    """Report lines routed by their markers; the last line of a kind wins."""
    day, after = F.date_format("o_orderdate", "dd.MM.yyyy"), F.date_format(F.date_add("o_orderdate", 1), "dd.MM.yyyy")
    s = F.lit
    text = F.concat(
        s("Befund\n1. Unters.: Dr. Meier, Eva U-datum: "), day, s(" 10:15\nGerät: GIF 100 Seriennummer: "), F.col("o_orderkey").cast("string"), s("\nText"), F.when(F.col("o_orderkey") % 2 == 1, F.concat(s("\nEingang am: "), after)).otherwise("")
    )
    # the lines of a report stay one row's array: no exchange is needed to pick the last hit
    rows = t.orders.select("o_orderkey", F.split(text, "\n").alias("lines"))
    rows = rows.withColumns({"exam": F.transform("lines", E.examination_line), "scope": F.transform("lines", E.endoscope_line)})
    exam, scope = F.col("exam"), F.col("scope")
    last = lambda a, k: F.element_at(F.concat(F.array(F.lit(None).cast("date" if k == "examination_date" else "string")), F.filter(F.transform(a, lambda x: x[k]), lambda v: v.isNotNull())), -1).alias(k)
    return rows.select("o_orderkey", *[last(exam, k) for k in ("examiner_last_name", "examiner_first_name", "examination_date", "examination_time")], *[last(scope, k) for k in ("endoscope_type", "endoscope_sn")])


@query(
    "representative_text",
    """SELECT ord, concat_ws(' | ', nullif(concat_ws(' ', nullif(trim(first_name), ''), nullif(trim(last_name), '')), ''), 'Case: ' || nullif(report_id, ''), 'DOB: ' || nullif(dob, '')) AS text,
      round((CASE WHEN coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '' THEN 3e-1 WHEN coalesce(first_name, '') <> '' OR coalesce(last_name, '') <> '' THEN 25e-2 ELSE 0e0 END) + 2e-1 + 15e-2, 6) AS confidence FROM predicted""",
    ("predicted",),
)
def representative_text(t):
    """A record as one line, and how much of it is known."""
    c = F.col
    none = F.lit(None).cast("string")
    m = {"first_name": c("first_name"), "last_name": c("last_name"), "examination_date": none, "casenumber": c("report_id"), "dob": c("dob"), "gender": none, "examiner_first_name": none, "examiner_last_name": none}
    return t.predicted().select("ord", X.representative(c("first_name"), c("last_name"), Case=c("report_id"), DOB=c("dob")).alias("text"), F.round(X.metadata_confidence(m), 6).alias("confidence"))


@query("text_similarity")
def text_similarity(t):
    """One minus the mean of character and word error rates against the turn before."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("a"), before.alias("b")).where("b is not null")
    return rows.select("conv_id", "turn", F.round(X.text_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))
