"""De-identification of element tables and of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import privacy as P
from ..functions import sensitive as N
from ..functions import text as X
from ..functions.fuzzy import replace_name_udf

EMPTIED = frozenset(
    """StudyID RequestingService ReferringPhysicianTelephoneNumbers ReferringPhysicianAddress PatientTelephoneNumbers PatientMotherBirthName
    PatientComments PatientAddress OtherPatientNames OtherPatientIDs Occupation MilitaryRank MedicalAlerts InstitutionalDepartmentName
    InstitutionName InstitutionAddress AdmittingDiagnosesDescription AdditionalPatientHistory AccessionNumber""".split()
)
KEPT_UIDS = frozenset("TransferSyntaxUID ContextGroupExtensionCreatorUID CodingSchemeUID".split())
FREE_TEXT = frozenset("UT UR UC ST SH LT LO AE".split())


def pii_counts(c: Column) -> dict[str, Column]:
    """Hits of each kind of identifier."""
    return {
        "n_email": N.count(c, E.EMAIL), "n_phone": N.count(c, E.PHONE), "n_ip": N.count(c, E.IPV4),
        "n_sensitive": sum((N.count(c, p) for p, _ in N.MARKS), F.lit(0)),
        "n_long_number": N.count(c, f"(?<![{X.WORD}])[0-9]{{5,}}+(?![{X.WORD}])"),
    }


def pii_redact(c: Column) -> Column:
    """E-mail and street addresses, names, examiners, dates, case, social security and phone numbers, IP addresses and long numbers as marks."""
    c = N.replace(c, E.EMAIL, "[EMAIL]")
    c = N.mark(N.replace(c, E.PHONE, "[PHONE]"))
    for pattern, mark in ((E.EMAIL, "[EMAIL]"), (E.PHONE, "[PHONE]"), (E.IPV4, "[IP]")):
        c = N.replace(c, pattern, mark)
    # an edge belongs to one match alone, so numbers side by side take a second pass
    for _ in range(2):
        c = N.replace(c, E.NUMBER, "$1[NUMBER]$2")
    return c


def maps_uid(keyword: Column) -> Column:
    """Whether a UI element is an identifier: no class, syntax or scheme."""
    return (keyword != "") & ~keyword.isin(*sorted(KEPT_UIDS)) & ~keyword.endswith("ClassUID")


def deidentify(elements: DataFrame, secret: bytes) -> DataFrame:
    """Elements (instance, keyword, vr, value, patient, ..) by the rule table; private ones are dropped.

    ``patient`` is the instance's original patient id, on each of its rows.
    """
    k, vr, v, who = (F.col(c) for c in ("keyword", "vr", "value", "patient"))
    days = P.shift_days(secret, who)
    new = (
        F.when(k == "PatientID", P.patient_pseudonym(secret, v))
        .when(vr == "PN", F.when(k == "PatientName", "ANON^PATIENT").otherwise(""))
        .when((vr == "UI") & maps_uid(k), F.coalesce(P.uid_pseudonym(secret, v), v))
        .when(vr == "DA", P.shift_compact_date(v, days))
        .when(vr == "DT", P.shift_compact_datetime(v, days))
        .when(k.isin(*sorted(EMPTIED)), "")
        .when(vr.isin(*sorted(FREE_TEXT)) & F.contains(v, who), "")
        .otherwise(v)
    )
    rows = elements.where(~F.col("is_private")) if "is_private" in elements.columns else elements
    return rows.withColumn("value", new)


def residual(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the result that still hold their instance's original patient id; has to be empty (P5)."""
    # one exchange: rows of an instance are together for the distinct ids and for the join
    who = before.where(F.col("keyword") == "PatientID").select("instance", F.col("value").alias("__id")).repartition("instance").distinct()
    return after.join(who, "instance").where((F.col("__id") != "") & F.contains("value", F.col("__id"))).drop("__id")


def mapping(values: DataFrame, column: str, pseudonym: Column) -> DataFrame:
    """(id_old, id_new), distinct and sorted as the mapping file is (SC15)."""
    return values.select(F.trim(column).alias("id_old"), pseudonym.alias("id_new")).where("id_old <> ''").distinct()


def collisions(table: DataFrame) -> DataFrame:
    """Rows of a mapping that break one-to-one: a blank side, an old id with two new ones, a new id of two old ones."""
    blank = table.where("trim(coalesce(id_old, '')) = '' or trim(coalesce(id_new, '')) = ''").select("id_old", "id_new", F.lit("blank").alias("problem"))
    rows = table.distinct()
    out = blank
    for key, other, what in (("id_old", "id_new", "conflict"), ("id_new", "id_old", "collision")):
        several = rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
        out = out.unionByName(rows.join(several, key, "left_semi").select("id_old", "id_new", F.lit(what).alias("problem")))
    return out


def seeded(values: DataFrame, column: str, pseudonym: Column, seeds: DataFrame) -> DataFrame:
    """(id_old, id_new) where earlier mappings take precedence."""
    fresh = mapping(values, column, pseudonym)
    return fresh.join(seeds.select("id_old", F.col("id_new").alias("__old")), "id_old", "left").select("id_old", F.coalesce("__old", "id_new").alias("id_new"))


FIRST_NAMES = ["Anja", "Bruno", "Clara", "David", "Elena", "Felix", "Greta", "Henrik", "Ida", "Jonas", "Klara", "Leo", "Mira", "Nils", "Olga", "Paul"]
LAST_NAMES = ["Ahrens", "Bergmann", "Claussen", "Dietrich", "Ehlers", "Falk", "Grothe", "Hansen", "Ihde", "Jessen", "Kramer", "Lorenz", "Mertens", "Nolte", "Otto", "Petersen"]


def anonymise_report(
    docs: DataFrame, text: str, secret: bytes, seed: Column, first: Column, last: Column, dob: Column, exam: Column, above: Sequence[str] = (), below: Sequence[str] = (), staff: Sequence[str] = ()
) -> Column:
    """A report's text without its persons and dates (P6): cut-offs, full name, last, first, staff, long numbers, birth and examination.

    ``seed`` makes pseudonyms and shifts a document's own.  Dates count as DD.MM.YYYY and ISO.
    """
    c = F.col(text)
    if above:
        c = X.cut_above(c, above)
    if below:
        c = X.cut_below(c, below)
    fake_first, fake_last = P.draw(FIRST_NAMES, secret, "first", seed), P.draw(LAST_NAMES, secret, "last", seed)
    both = lambda a, b: F.concat(a, F.lit(" "), b)
    for old, new in ((both(first, last), both(fake_first, fake_last)), (last, fake_last), (first, fake_first)):
        c = replace_name_udf(c, old, new)
    for k, name in enumerate(staff):
        c = F.replace(c, F.lit(name), P.draw(LAST_NAMES, secret, f"staff{k}", seed))
    c = P.redact_long_numbers(secret, c)
    for day, (lo, hi) in ((dob, (-1200, -365)), (exam, (-30, 30))):
        bound = F.struct(c.alias("text"), day.alias("old"), P.shift_date(day, lo, hi, seed).alias("new"))

        def moved(s: Column) -> Column:
            out = s["text"]
            for form in ("dd.MM.yyyy", "yyyy-MM-dd"):
                out = F.replace(out, F.date_format(s["old"], form), F.date_format(s["new"], form))
            return F.when(s["old"].isNotNull(), out).otherwise(s["text"])

        c = X.let(bound, moved)
    return c
