"""Queries that pseudonymise, audit and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import privacy as P
from ..operators import audit as A
from ..operators import records as RE
from ..operators import redact as R
from ..operators import splits as S
from .tables import lit, query

#: For the queries only; a deployment reads its own secret from a file.
SECRET = b"only-for-the-queries-0123456789abcdef"


def _blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


_PAD = SECRET.ljust(64, b"\0")
_IN, _OUT = (_blob(bytes(b ^ x for b in _PAD)) for x in (0x36, 0x5C))


def _hmac(space: str, v: str) -> str:
    return f"sha256({_OUT} || unhex(sha256({_IN} || encode('{space}:' || {v}))))"


def _int(h: str) -> str:
    return f"('0x' || {h})::UBIGINT"


_DAYS = f"(SELECT c_name AS who, CASE WHEN v % 2 = 1 THEN -(v % 3650 + 1) ELSE v % 3650 + 1 END::INT AS days FROM (SELECT c_name, {_int('left(' + _hmac('date-shift', 'c_name') + ', 8)')}::BIGINT AS v FROM customer))".replace("END::INT", "END")


@query("pseudonym_patients", f"SELECT c_name AS id_old, 'PAT_' || left({_hmac('patient', 'c_name')}, 32) AS id_new FROM customer")
def pseudonym_patients(t):
    """Keyed patient pseudonyms."""
    return R.mapping(t.customer, "c_name", P.patient_pseudonym(SECRET, F.col("c_name")))


@query("pseudonym_seeds", f"SELECT c_name AS id_old, CASE WHEN c_custkey % 10 = 0 THEN 'SEED_' || c_custkey ELSE 'PAT_' || left({_hmac('patient', 'c_name')}, 32) END AS id_new FROM customer")
def pseudonym_seeds(t):
    """Pseudonyms with earlier mappings first (P2, SC14)."""
    seeds = t.customer.where("c_custkey % 10 = 0").select(F.col("c_name").alias("id_old"), F.concat(F.lit("SEED_"), F.col("c_custkey").cast("string")).alias("id_new"))
    return R.seeded(t.customer, "c_name", P.patient_pseudonym(SECRET, F.col("c_name")), seeds)


@query("pseudonym_collisions", """WITH m AS (SELECT c_name AS id_old, CASE WHEN c_custkey % 77 = 0 THEN ' ' WHEN c_custkey % 50 = 0 THEN 'N' || (c_custkey + 1) ELSE 'N' || c_custkey END AS id_new FROM customer UNION ALL SELECT c_name, 'M' || c_custkey FROM customer WHERE c_custkey % 60 = 0),
    r AS (SELECT DISTINCT * FROM m) SELECT id_old, id_new, 'blank' AS problem FROM m WHERE trim(id_old) = '' OR trim(id_new) = '' UNION ALL SELECT *, 'conflict' FROM r WHERE id_old IN (SELECT id_old FROM r GROUP BY id_old HAVING count(*) > 1)
    UNION ALL SELECT *, 'collision' FROM r WHERE id_new IN (SELECT id_new FROM r GROUP BY id_new HAVING count(*) > 1)""")
def pseudonym_collisions(t):
    """Rows of a faulty mapping that break one-to-one."""
    k = F.col("c_custkey")
    new = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    id_new = F.when(k % 77 == 0, " ").when(k % 50 == 0, new("N", k + 1)).otherwise(new("N", k))
    more = t.customer.where("c_custkey % 60 = 0").select(F.col("c_name").alias("id_old"), new("M", k).alias("id_new"))
    return R.collisions(t.customer.select(F.col("c_name").alias("id_old"), id_new.alias("id_new")).unionByName(more))


@query("pseudonym_one_to_one", "SELECT count(*) AS ids, count(*) AS pseudonyms, 0::BIGINT AS problems FROM customer")
def pseudonym_one_to_one(t):
    """The pseudonyms of all patients: as many as patients, without a problem."""
    m = R.mapping(t.customer, "c_name", P.patient_pseudonym(SECRET, F.col("c_name")))
    return m.agg(F.count("*").alias("ids"), F.count_distinct("id_new").alias("pseudonyms")).crossJoin(R.collisions(m).agg(F.count("*").alias("problems")))


@query("synthetic_identities")
def synthetic_identities(t):
    """Made-up persons, the same for each secret."""
    return RE.synthetic_identities(t.spark, 1000, SECRET, R.FIRST_NAMES, R.LAST_NAMES)


@query("pseudonym_uids", f"SELECT '1.2.' || o_orderkey AS id_old, '2.25.' || ('0x' || left({_hmac('uid', chr(39) + '1.2.' + chr(39) + ' || o_orderkey')}, 32))::UHUGEINT::VARCHAR AS id_new FROM orders")
def pseudonym_uids(t):
    """128-bit identifiers in decimal."""
    uid = F.concat(F.lit("1.2."), F.col("o_orderkey").cast("string"))
    return t.orders.select(uid.alias("id_old"), P.uid_pseudonym(SECRET, uid).alias("id_new"))


@query("shift_dates_per_patient", f"SELECT o_orderkey, strftime(o_orderdate + to_days(days), '%Y%m%d') AS shifted FROM orders JOIN customer ON o_custkey = c_custkey JOIN {_DAYS} ON who = c_name".replace("to_days(days)", "to_days(days::INT)"))
def shift_dates_per_patient(t):
    """Dates moved by a patient's own number of days (M2)."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", P.shift_compact_date(F.date_format("o_orderdate", "yyyyMMdd"), P.shift_days(SECRET, F.col("c_name"))).alias("shifted"))


@query(
    "shift_dates_text",
    """WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS d, sha256(o_orderkey::VARCHAR || strftime(o_orderdate, '%Y-%m-%d')) AS h FROM orders),
    b AS (SELECT *, ((('0x' || left(h, 32))::UHUGEINT % 836) * ((('0x' || 'ffffffffffffffffffffffffffffffff')::UHUGEINT % 836 + 1) % 836) + ('0x' || right(h, 32))::UHUGEINT % 836) % 836 AS m FROM a) SELECT o_orderkey, (d + (m::INT - 1200))::DATE AS shifted FROM b""", text="shifted")
def shift_dates_text(t):
    """Dates moved within a window by their own hash (M1)."""
    return t.orders.select("o_orderkey", P.shift_date(F.col("o_orderdate").cast("date"), -1200, -365, F.col("o_orderkey").cast("string")).alias("shifted"))


def _split(s: str) -> str:
    return f"CASE WHEN {_int(f'left(sha256({s}), 16)')}::HUGEINT < 3689348814741910528 THEN 'val' ELSE 'train' END"



@query(
    "group_hash_split",
    f"""WITH a AS (SELECT doc_id, source, toxic, quality, {_split("'0:' || source")} AS split FROM documents JOIN labels USING (doc_id)) SELECT split, count(*) AS images, count(*) FILTER (toxic = 1) AS positives, sum(quality)::BIGINT AS annotations, count(DISTINCT source) AS groups FROM a GROUP BY split""",
)
def group_hash_split(t):
    """Counts of a split that keeps sources apart."""
    return S.split_counts(t.documents.join(t.labels, "doc_id"), "source", F.col("toxic") == 1, F.col("quality"))


@query("split_leaks", "SELECT source FROM documents WHERE doc_id % 7 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 7 <> 0")
def split_leaks(t):
    """Sources on both sides of a split that went by document."""
    return S.shared_groups(t.documents.withColumn("split", F.when(F.col("doc_id") % 7 == 0, "val").otherwise("train")), "source", "split")


@query(
    "positional_split",
    """WITH a AS (SELECT DISTINCT source FROM documents), b AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS spot, count(*) OVER () AS n FROM a), c AS (SELECT *, greatest(1, floor(n * 8e-1)) AS t, CASE WHEN n >= 3 THEN greatest(1, floor(n * 1e-1)) ELSE floor(n * 1e-1) END AS v FROM b),
    d AS (SELECT *, CASE WHEN t + v >= n AND n > 1 THEN greatest(1, n - v - 1) ELSE t END AS t2 FROM c) SELECT source, CASE WHEN spot < t2 THEN 'train' WHEN spot < t2 + v THEN 'val' ELSE 'test' END AS split FROM d""",
)
def positional_split(t):
    """Split by place in the list of groups (M9)."""
    return S.positional_split(t.documents, "source", 0.8, 0.1)


@query(
    "training_manifest",
    f"""SELECT sha256('1.2.' || o_orderkey) AS instance_uid_sha256, sha256(o_custkey::VARCHAR) AS patient_key_sha256, {_split("'0:' || o_custkey")} AS split, 'images/' || {_split("'0:' || o_custkey")} || '/1_2_' || o_orderkey || '.jpg' AS image_path,
      'labels/' || {_split("'0:' || o_custkey")} || '/1_2_' || o_orderkey || '.txt' AS label_path, o_orderpriority AS modality, o_orderstatus = 'F' AS positive FROM orders""",
)
def training_manifest(t):
    """Manifest rows without plain identifiers (P13, SC21)."""
    items = t.orders.select(F.concat(F.lit("1.2."), F.col("o_orderkey").cast("string")).alias("uid"), F.col("o_custkey").cast("string").alias("patient"), F.col("o_orderpriority").alias("modality"), (F.col("o_orderstatus") == "F").alias("positive"))
    return S.manifest(items, "uid", "patient")


_KEPT = ", ".join(map(lit, sorted(R.KEPT_UIDS)))
_EMPTY = ", ".join(map(lit, sorted(R.EMPTIED)))
_FREE = ", ".join(map(lit, sorted(R.FREE_TEXT)))
_DEID = f"""d AS (SELECT instance, patient, keyword, vr, CASE WHEN keyword = 'PatientID' THEN 'PAT_' || left({_hmac("patient", "value")}, 32) WHEN vr = 'PN' THEN CASE WHEN keyword = 'PatientName' THEN 'ANON^PATIENT' ELSE '' END
    WHEN vr = 'UI' AND keyword NOT IN ({_KEPT}) AND NOT suffix(keyword, 'ClassUID') THEN '2.25.' || ('0x' || left({_hmac("uid", "value")}, 32))::UHUGEINT::VARCHAR WHEN vr IN ('DA', 'DT') THEN strftime(strptime(left(value, 8), '%Y%m%d') + to_days(days::INT), '%Y%m%d') || substr(value, 9)
    WHEN keyword IN ({_EMPTY}) THEN '' WHEN vr IN ({_FREE}) AND contains(value, patient) THEN '' ELSE value END AS value, is_private FROM elements JOIN {_DAYS} ON who = patient WHERE NOT is_private)"""


@query("deidentify_elements", f"WITH {_DEID} SELECT instance, keyword, vr, value FROM d", ("elements",))
def deidentify_elements(t):
    """Tag elements by the rule table."""
    return R.deidentify(t.elements(), SECRET).select("instance", "keyword", "vr", "value")


@query("residual_identifier_check", "SELECT instance, keyword FROM elements WHERE instance % 9 = 0 AND contains(value, patient)", ("elements",))
def residual_identifier_check(t):
    """Elements that still hold an original id, where a ninth of the instances was left as it was (P5)."""
    e = t.elements()
    after = R.deidentify(e, SECRET).where("instance % 9 <> 0").unionByName(e.where("instance % 9 = 0"))
    return R.residual(e, after).select("instance", "keyword")


QI = ["c_mktsegment", "n_name", "o_orderpriority", "month"]
_CLS = f"cls AS (SELECT grouping_id({', '.join(QI)}) AS gid, {', '.join(QI)}, count(*) AS size, count(DISTINCT o_orderstatus) AS d, list(o_orderstatus) AS vals FROM qi GROUP BY CUBE ({', '.join(QI)}) HAVING grouping_id({', '.join(QI)}) < 15)"


@query(
    "k_anonymity_cube",
    f"WITH {_CLS} SELECT count(DISTINCT gid) AS qi_projection_count, count(*) AS equivalence_class_count, min(size) AS minimum_equivalence_class_size, count(*) FILTER (size < 10) AS underprotected_pattern_count, sum(greatest(10 - size, 0))::BIGINT AS frequency_deficit_total, max(greatest(10 - size, 0)) AS synthetic_padding_lower_bound, count(*) FILTER (d < 3) AS l_diversity_violation_count FROM cls",
    ("qi",),
)
def k_anonymity_cube(t):
    """Class sizes and diversity over all subsets of the quasi-identifiers (A4, A5)."""
    return A.k_anonymity(t.qi_records(), QI, "o_orderstatus", 10, 3)


@query(
    "t_closeness",
    f"""WITH q AS (SELECT o_orderstatus AS s, count(*) / (SELECT count(*) FROM qi) AS q FROM qi GROUP BY 1), c AS (SELECT grouping_id({", ".join(QI)}) AS gid, {", ".join(QI)}, row_number() OVER () AS cid, count(*) AS size, list(o_orderstatus) AS vals FROM qi GROUP BY CUBE ({", ".join(QI)}) HAVING grouping_id({", ".join(QI)}) < 15),
    d AS (SELECT cid, 5e-1 * sum(abs(len(list_filter(vals, lambda v: v = s)) / size - q)) AS d FROM c, q GROUP BY cid) SELECT count(*) AS equivalence_class_count, count(*) FILTER (round(d, 9) > 2e-1) AS t_closeness_violation_count, round(max(d), 9) AS max_t_closeness_distance FROM d""",
    ("qi",),
)
def t_closeness(t):
    """Distance of each class's sensitive values from all records' (A6)."""
    return A.t_closeness(t.qi_records(), QI, "o_orderstatus", 0.2)


_WORDS = lit(f"[{P.WORD}]+|[^{P.WORD}]+")


def _digits(w: str) -> str:
    h = f"({_hmac('number', w)} || {_hmac('number2', w)})"
    return f"array_to_string(list_transform(generate_series(0, length({w}) - 1), lambda i: (('0x' || substr({h}, (i % 64 * 2 + 1)::INT, 2))::UBIGINT % 10)::VARCHAR), '')"


@query("long_number_digits", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, {_WORDS}), lambda w: CASE WHEN regexp_full_match(w, '[0-9]{{5,}}') THEN {_digits('w')} ELSE w END), '') AS text FROM documents")
def long_number_digits(t):
    """Long numbers replaced by keyed digits."""
    return t.documents.select("doc_id", P.redact_long_numbers(SECRET, F.col("text")).alias("text"))


@query("pseudonym_draw", f"SELECT c_custkey, list_extract({[*R.FIRST_NAMES]}, (('0x' || left({_hmac('first', 'c_name')}, 12))::UBIGINT % {len(R.FIRST_NAMES)} + 1)::INT) AS first_name FROM customer")
def pseudonym_draw(t):
    """A fixed name for each value."""
    return t.customer.select("c_custkey", P.draw(R.FIRST_NAMES, SECRET, "first", F.col("c_name")).alias("first_name"))


@query("anonymise_reports")
def anonymise_reports(t):
    """Report texts without persons, long numbers and dates."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    s = F.lit
    text = F.concat(s("Letterhead\nPatient: SCHULTZE, Anna "), F.date_format(day, "dd.MM.yyyy"), s(" Nr "), (F.col("o_orderkey") + 100000).cast("string"), s("\nanna  Schultze, Dr. Weich\nFooter"))
    rows = o.select("o_orderkey", "c_name", day.alias("day"), text.alias("text"))
    out = R.anonymise_report(rows, "text", SECRET, F.col("c_name"), s("Anna"), s("Schultze"), F.lit(None).cast("date"), F.col("day"), ["Patient"], ["Weich"], ["Weich"])
    return rows.select("o_orderkey", out.alias("text"))


@query("source_groups", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ts_s' || p_partkey WHEN 1 THEN 'nih_xray_' || p_partkey END AS grp FROM part")
def source_groups(t):
    """Group of a file stem."""
    k = F.col("p_partkey").cast("string")
    stem = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ts_s"), k, F.lit("_1_2"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("nih_xray_"), k, F.lit("_001_0"))).otherwise(F.concat(F.lit("other_"), k))
    return t.part.select("p_partkey", E.source_group(stem).alias("grp"))


@query("frame_rates", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE round((p_partkey % 50) * 1e0 / nullif(p_partkey % 4, 0), 6) END AS rate FROM part WHERE p_partkey % 50 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 50 = 0")
def frame_rates(t):
    """Rates from fractions."""
    p = F.col("p_partkey")
    return t.part.select("p_partkey", F.round(E.frame_rate(F.concat_ws("/", (p % 50).cast("string"), (p % 4).cast("string"))), 6).alias("rate"))


@query("smallest_sources", "WITH a AS (SELECT p_partkey, p_brand, p_size, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part WHERE p_partkey % 3000 >= 1 AND (p_partkey % 3000)::BIGINT * 2000 <= 4194304) SELECT p_partkey, p_brand FROM a WHERE k <= 5")
def smallest_sources(t):
    """The smallest admissible sources of a group."""
    return S.smallest_sources(t.part, "p_brand", "p_size", "p_partkey", 5, F.col("p_partkey") % 3000, F.lit(2000), F.lit(1)).select("p_partkey", "p_brand")
