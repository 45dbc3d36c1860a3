"""Personal data found by rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SP, WORD, collapse, let, strip, tokens

NAME = "A-Za-zÄÖÜäöüß"
_N = f"[{NAME}]"
_GAP = f"[:{SP}]*"
_LABEL = rf"[.:{SP}]*"
_D2 = "[0-9]{1,2}"
_YEAR = "[0-9]{2,4}"
_DOTTED = rf"{_D2}\.{_D2}\.{_YEAR}"

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ .\-][0-9]{3,4}[ .\-]?[0-9]{2,5}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
NUMBER = rf"(\A|[^{WORD}])[0-9]{{5,}}([^{WORD}]|\z)"


def _pair(label: str) -> str:
    return rf"(?i){label}({_N}+)[,{SP}]*({_N}+)"


#: Labelled names first, then 'Last, First'; the first that matches counts.  The reference's last resort, any word of three letters, is left to ``loose``.
NAME_RULES = (
    _pair(f"Patient{_GAP}"), _pair(rf"Pat{_LABEL}"), _pair(f"Name{_GAP}"),
    rf"(?i)({_N}{{2,}})[{SP}]*,[{SP}]*({_N}{{2,}})",
)
LOOSE_NAME = rf"{'(?:'}\A|[^{WORD}])([A-Z][a-zäöüß]{{2,}})(?:[^{WORD}]|\z)"
CASE_RULES = (rf"(?i)Fall[nr]*{_LABEL}([0-9]+)", f"(?i)Case{_GAP}([0-9]+)", f"(?i)Fallnummer{_GAP}([0-9]+)", f"(?i)ID{_GAP}([0-9]+)", rf"(?i)(?:\A|[^{WORD}])([A-Z][{SP}]*[0-9]{{2,}})(?:[^{WORD}]|\z)")
_CLOCK = "([0-9]{1,2}[:.][0-9]{2}(?:[:.][0-9]{2})?)"
TIME_RULES = tuple(f"(?i){x}{_CLOCK}" for x in (f"Zeit{_GAP}", f"Time{_GAP}", ""))
_WHO = rf"([{NAME}{SP}.\-]{{3,50}})(?:[{SP}]|\z)"
EXAMINER_RULES = tuple(f"(?i){x}{_WHO}" for x in (f"Arzt{_GAP}", rf"Dr[.:{SP}]+", f"Untersucher{_GAP}", f"Examiner{_GAP}"))
DOB_RULES = tuple(f"(?i){x}({_DOTTED})" for x in (rf"geb{_LABEL}", f"geboren{_GAP}", rf"Geb\.Dat{_LABEL}", f"DOB{_GAP}"))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_of(c: Column, patterns, group: int = 1) -> Column:
    return F.coalesce(*[first_group(c, p, group) for p in patterns])


def patient_name(c: Column, loose: bool = False) -> tuple[Column, Column]:
    """(first, last) by the first rule that matches; 'Last, First' if a comma precedes the second name."""
    first, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    if loose:
        first = first_group(c, LOOSE_NAME)
    for rule in reversed(NAME_RULES):
        a, b = first_group(c, rule, 1), first_group(c, rule, 2)
        comma = F.instr(c, ",")
        swap = (comma > 0) & (comma < F.position(b, c))  # the reference compares with the first place of the second name
        first = F.when(a.isNotNull(), F.when(swap, b).otherwise(a)).otherwise(first)
        last = F.when(a.isNotNull(), F.when(swap, a).otherwise(b)).otherwise(last)
    return first, last


def case_number(c: Column) -> Column:
    """The first rule's number."""
    return collapse(first_of(c, CASE_RULES))


def examination_time(c: Column) -> Column:
    """h:mm; a clock with seconds or dots counts only if another rule finds better."""
    found = [first_group(c, p) for p in TIME_RULES]
    return F.coalesce(*[F.when(x.rlike(r"\A[0-9]{1,2}:[0-9]{2}\z"), x) for x in found])


def gender(c: Column, literal: bool = False) -> Column:
    """M or F (E4): the first gender word; ``literal`` takes any single letter as the reference does."""
    p = "(?i)(männlich|weiblich|male|female|m|f|w)" if literal else rf"(?i)(?:\A|[^{WORD}])(männlich|weiblich|male|female|m|f|w)(?:[^{WORD}]|\z)"
    g = F.lower(first_group(c, p))
    return F.when(g.isin("männlich", "male", "m"), "M").when(g.isin("weiblich", "female", "f", "w"), "F")


def _examiner_ok(name: Column) -> Column:
    words = tokens(name)
    good = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"\A[\p{L}.\-]*\p{L}[\p{L}.\-]*\z"))
    single = F.filter(words, lambda w: F.length(w) == 1)
    n = F.size(words)
    marks = F.length(F.regexp_replace(name, r"[^.\-]", "")) / F.length(name)
    return (F.length(name) >= 3) & (F.length(name) <= 50) & (marks <= 0.3) & (F.size(good) > 0) & (F.size(good) >= n / 2) & ~((n > 2) & (F.size(single) > n / 2))


def examiner(c: Column) -> tuple[Column, Column]:
    """(first, last) of the first rule whose find looks like a name (E5)."""
    name = F.coalesce(*[F.when(_examiner_ok(x), x) for x in (collapse(first_group(c, p)) for p in EXAMINER_RULES)])
    words = F.split(name, " ")
    return words[0], F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))


def german_date(c: Column, pivot: int = 50) -> Column:
    """Day, month, year with any of the separators; two-digit years from ``pivot`` on are of the last century."""

    def iso(part: Column) -> Column:
        y = part[2].cast("int")
        y = F.when(F.length(part[2]) <= 2, y + F.when(y < pivot, 2000).otherwise(1900)).otherwise(y)
        return let(y, lambda v: F.when(v.between(1900, 2100), F.try_to_date(F.format_string("%04d-%02d-%02d", v, part[1].cast("int"), part[0].cast("int")), "yyyy-MM-dd")))

    # each step is bound, as otherwise every mention of the text repeats all before it
    text = F.regexp_replace(strip(c), rf"[{SP}]*[.\-/][{SP}]*|[{SP}]+", ".")
    return let(text, lambda t: F.when(t.rlike(rf"\A{_DOTTED}\z"), let(F.split(t, r"\."), iso)))


def compact_date(c: Column) -> Column:
    """DDMMYYYY, with two more digits at most."""
    d = F.regexp_replace(c, "[^0-9]", "")
    ok = (F.length(d) == 8) | ((F.length(d) == 10) & F.substring(d, 5, 4).cast("int").between(1900, 2100))
    return F.when(ok, F.try_to_date(F.left(d, F.lit(8)), "ddMMyyyy"))


def report_date(c: Column) -> Column:
    """The report reader's dates: eight digits, or day, month and year with dots or spaces; pivot 69."""

    def either(t: Column) -> Column:
        dotted = F.regexp_replace(t, f"[{SP}]+", ".")
        return F.when(t.rlike(r"\A[0-9]{8}\z"), F.try_to_date(t, "ddMMyyyy")).otherwise(let(dotted, lambda d: F.when(d.rlike(r"\A[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})\z"), german_date(d, 69))))

    return let(strip(c), either)


def any_date(c: Column) -> Column:
    """Dates a metadata record accepts: ISO, with slashes, or day first (section 1)."""
    t = strip(c)
    iso = F.when(t.rlike(r"\A[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}\z"), F.try_to_date(F.translate(t, "/", "-"), "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(t.rlike(r"\A[0-9]{2}([./-])[0-9]{2}\1[0-9]{4}\z|\A[0-9]{2}\.[0-9]{2}\.[0-9]{2}\z"), german_date(t)))


def birth_date(c: Column) -> Column:
    """Labelled, then compact, then any separated date."""
    labelled = [german_date(first_group(c, p)) for p in DOB_RULES]
    compact = [compact_date(first_group(c, p)) for p in ("([0-9]{10})", "([0-9]{8})")]
    return F.coalesce(*labelled, *compact, german_date(first_group(c, rf"({_D2}[./-]{_D2}[./-]{_YEAR})")))


def examination_date(c: Column) -> Column:
    """The first labelled or, failing that, any date (E6, the single-role form)."""
    sep = rf"[./\-{SP}]+"
    day = f"({_D2}{sep}{_D2}{sep}{_YEAR})"
    return F.coalesce(*[german_date(first_group(c, f"(?i){x}{day}")) for x in (f"Datum{_GAP}", f"Date{_GAP}", f"Untersuchung{_GAP}", "")])


_ANY_DATE = rf"(?<![0-9])(?:{_D2}\s*([./-])\s*{_D2}\s*\1\s*{_YEAR}|{_D2}\s+{_D2}\s+{_YEAR})(?![0-9])"


def date_candidates(c: Column) -> Column:
    """Array of (at, day, role, timed) of every date in reading order.

    Java splits the text around the dates, so that positions follow from the pieces' lengths.
    """
    found = F.regexp_extract_all(c, F.lit(_ANY_DATE), F.lit(0))
    around = F.split(c, _ANY_DATE)
    step = lambda s, d: F.struct(
        (s["i"] + 1).alias("i"),
        F.array_append(
            s["out"],
            F.struct(
                s["i"].alias("at"),
                german_date(d).alias("day"),
                F.when(F.right(around[s["i"]], F.lit(32)).rlike(r"(?i)(?:Geburtsdatum|Geb\.Dat(?:um|)|\bgeb(?:oren|)|\bDOB)\s*[-:.]?\s*\z"), "dob")
                .when(F.right(around[s["i"]], F.lit(32)).rlike(r"(?i)(?:\bExam(?:ination|)|\bUntersuchung|\bDat(?:um|e))\s*[-:.]?\s*\z"), "exam")
                .alias("role"),
                F.left(around[s["i"] + 1], F.lit(16)).rlike(r"\A\s+[0-9]{1,2}[:.][0-9]{2}").alias("timed"),
            ),
        ).alias("out"),
    )
    none = F.array().cast("array<struct<at:int,day:date,role:string,timed:boolean>>")
    return F.filter(F.aggregate(found, F.struct(F.lit(0).alias("i"), none.alias("out")), step)["out"], lambda d: d["day"].isNotNull())


def date_roles(c: Column) -> Column:
    """struct(dob, exam): which date is the birth, which the examination.

    A label decides; a clock after a date makes it the examination; otherwise the oldest
    date is the birth and the newest the examination.  No date gets both roles.
    """
    return let(date_candidates(c), _roles)


def _roles(known: Column) -> Column:
    pick = lambda test: F.get(F.filter(known, test), F.lit(0))
    first = F.struct(
        pick(lambda d: d["role"] == "dob").alias("born"), F.coalesce(pick(lambda d: d["role"] == "exam"), pick(lambda d: d["timed"])).alias("seen"), F.transform(known, lambda d: d["day"]).alias("days")
    )

    def dates(s: Column) -> Column:
        seen = s["seen"]["day"]
        oldest = F.array_min(F.filter(s["days"], lambda d: seen.isNull() | (d != seen)))
        return F.struct(F.coalesce(s["born"]["day"], oldest).alias("dob"), seen.alias("seen"), s["born"]["role"].alias("role"), s["days"].alias("days"))

    def both(s: Column) -> Column:
        dob = s["dob"]
        newest = F.array_max(F.filter(s["days"], lambda d: dob.isNull() | (d != dob)))
        # the role of the date that became the birth: its own where a label chose it, else that of the first candidate with its day
        own = F.coalesce(s["role"], pick(lambda d: d["day"] == dob)["role"])
        return F.struct(dob.alias("dob"), F.coalesce(s["seen"], newest).alias("exam"), F.coalesce(own == "dob", F.lit(False)).alias("labelled"))

    def settle(s: Column) -> Column:
        dob, exam = s["dob"], s["exam"]
        same, late = F.coalesce(dob == exam, F.lit(False)), F.coalesce(dob > exam, F.lit(False))
        return F.struct(
            F.when(same & ~s["labelled"], F.lit(None)).when(late, exam).otherwise(dob).alias("dob"),
            F.when(same & s["labelled"], F.lit(None)).when(late, dob).otherwise(exam).alias("exam"),
        )

    return let(let(let(first, dates), both), settle)


_PAT = r"(?i)(?:Patientin|Patient|Pat\.|Pat):?"
_S = f"[{SP}]"
_HN = f"[{NAME}-]+"
FULL_RULE = rf"{_PAT}{_S}*({_HN})[,{SP}]+({_HN}){_S}+(?:geboren am|geboren|Geb\.Dat\.|geb\.):?{_S}*([0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})(?:.*?(?:Fall-Nr|Fall\.Nr\.|Fallnr\.|Fallnummer):?{_S}*([0-9]+))?"
SIMPLE_RULE = rf"{_PAT}{_S}*({_HN})[,{SP}]+({_HN})"
TITLED_RULE = rf"{_PAT}{_S}*((?:Dr\.|Prof\.|Herr|Frau)?{_S}*[{NAME}\-{SP}]+)"


def patient_fallback(c: Column) -> Column:
    """struct of names, birth, case and gender by three rules, the fullest first."""
    g = [first_group(c, FULL_RULE, k) for k in range(1, 5)]
    full = g[0].isNotNull()
    a, b = first_group(c, SIMPLE_RULE, 1), first_group(c, SIMPLE_RULE, 2)
    words = tokens(first_group(c, TITLED_RULE))
    titled = F.coalesce(F.size(words) >= 2, F.lit(False))
    at = F.position(g[1], c)
    window = F.substring(c, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)) + F.length(g[1]) + 30)
    return F.struct(
        F.when(full, g[1]).when(a.isNotNull(), b).when(titled, words[0]).alias("first_name"),
        F.when(full, g[0]).when(a.isNotNull(), a).when(titled, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).alias("last_name"),
        F.when(full, german_date(g[2])).alias("dob"),
        F.when(full, g[3]).alias("casenumber"),
        F.when(full, F.when(F.contains(window, F.lit("Patientin")), "female").when(F.contains(window, F.lit("Patient")), "male")).alias("gender"),
    )


_UNTERS = rf"Unters\.:{_S}*([{WORD}{SP}.]+),{_S}*([{WORD}{SP}]+?){_S}*U-datum:{_S}*([0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}){_S}*([0-9]{{2}}:[0-9]{{2}})"
_ENTRY = rf"Eingang am:{_S}*([0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}})"
_DOCTOR = rf"(?i)untersuchender{_S}+arzt{_S}*:{_S}*(?:dr\.?{_S}*)?(\p{{L}}+){_S}+(\p{{L}}+)"
_SCOPE = rf"(?i)ger(?:ä|ae)t{_S}*:{_S}*(.+?){_S}*,?{_S}*seriennummer{_S}*:?{_S}*([{WORD}-]+)"


def _untitled(c: Column) -> Column:
    from .text import TITLES

    return F.array_join(F.filter(tokens(c), lambda w: ~F.lower(w).isin(*sorted(TITLES))), " ")


def examination_line(c: Column) -> Column:
    """struct of examiner, date and time of one report line in either format."""
    none = F.lit(None)

    def full(g: Column) -> Column:
        return F.struct(_untitled(g["b"]).alias("examiner_first_name"), _untitled(g["a"]).alias("examiner_last_name"), F.coalesce(german_date(g["day"]), entry()).alias("examination_date"), F.nullif(g["at"], F.lit("")).alias("examination_time"))

    def entry() -> Column:
        return F.when(F.contains(c, F.lit("Eingang am:")), german_date(first_group(c, _ENTRY)))

    # only lines with a marker meet the long patterns, and each group is read once
    parts = F.struct(*[F.regexp_extract(c, _UNTERS, k).alias(n) for k, n in enumerate(("a", "b", "day", "at"), 1)])
    other = F.struct(none.cast("string").alias("examiner_first_name"), none.cast("string").alias("examiner_last_name"), entry().alias("examination_date"), none.cast("string").alias("examination_time"))
    return F.when(F.contains(c, F.lit("Unters.:")), let(parts, lambda g: F.when(g["a"] != "", full(g)).otherwise(other))).otherwise(other)


def examiner_line(c: Column) -> Column:
    """struct(first, last) after 'Untersuchender Arzt:' (E11)."""
    return F.struct(first_group(c, _DOCTOR, 1).alias("examiner_first_name"), first_group(c, _DOCTOR, 2).alias("examiner_last_name"))


def endoscope_line(c: Column) -> Column:
    """struct(type, sn) of a device line."""
    find = F.struct(strip(first_group(c, _SCOPE, 1)).alias("endoscope_type"), first_group(c, _SCOPE, 2).alias("endoscope_sn"))
    none = F.lit(None).cast("string")
    # a cheap test keeps other lines from the pattern
    return F.when(c.rlike("(?i)seriennummer"), find).otherwise(F.struct(none.alias("endoscope_type"), none.alias("endoscope_sn")))


def key_values(c: Column) -> Column:
    """Map of the 'label: value' lines of an answer that is no JSON, empty and unknown values left out."""
    fields = {"first_name": "first[_ ]?name|vorname", "last_name": "last[_ ]?name|nachname", "dob": "dob|geburtsdatum", "casenumber": "case[_ ]?number|fallnummer", "gender": "gender|geschlecht"}
    value = lambda p: strip(first_group(c, rf"(?im)^[ \t]*-?[ \t]*(?:{p})[ \t]*[:=][ \t]*[\x22']?([{WORD}.\-/ ]+?)[\x22']?$"))
    kept = {k: value(p) for k, p in fields.items()}
    kept["dob"] = let(kept["dob"], lambda d: F.coalesce(F.date_format(report_date(d), "yyyy-MM-dd"), d))
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in kept]), F.array(*kept.values()))
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~(k.isin("first_name", "last_name") & F.lower(v).isin("unknown", "unbekannt")))


def titled_examiner(c: Column) -> Column:
    """'Dr.' or 'Dr.med.' with one to five capitalised words."""
    return first_group(c, rf"(Dr\.(?:med\.)?{_S}[A-Z][a-z]+(?:{_S}[A-Z][a-z]+){{0,4}})")


def frame_rate(c: Column) -> Column:
    """A rate written as a number or a fraction; null for 0, N/A and what is no number."""
    p = F.split(F.trim(c), "/")
    rate = F.try_divide(F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)), F.lit("1")).try_cast("double"))
    return F.when(rate > 0, rate)


SOURCE_GROUPS = (r"\A(ts_s[0-9]+)", r"\A(nih_xray_[0-9]+)", r"\A(msd_brain_BRATS_[0-9]+)", r"\A(bs80k_[0-9]+)")


def source_group(stem: Column, strict: bool = False) -> Column:
    """The group of a file stem; null, or an error if ``strict``, for an unknown form."""
    g = first_of(stem, SOURCE_GROUPS)
    return F.coalesce(g, F.raise_error(F.concat(F.lit("unsupported stem: "), stem)).cast("string")) if strict else g


def bool_text(c: Column) -> Column:
    """A flag in words or digits; null if it is neither."""
    t = F.lower(strip(c))
    return F.when(t.isin("1", "true", "yes", "y", "changed"), True).when(t.isin("0", "false", "no", "n", "unchanged"), False)


def changed(flags, text: Column, anonymised: Column) -> Column:
    """The first explicit flag, else whether the texts differ beyond white space."""
    return F.coalesce(*[bool_text(x) for x in flags], collapse(text) != collapse(anonymised))
