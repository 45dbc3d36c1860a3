"""Sensitive spans of clinical text: nine kinds of patterns, and the marks that replace them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import java, let

_UP, _LOW = "[A-ZÄÖÜ]", "[a-zäöüß]"
_ANY = "[A-Za-zÄÖÜäöüß]"
_NAME = rf"{_ANY}+\s*,\s*{_ANY}+"
_PERSON = rf"(?:[Dd][Rr]\.\s?(?:[Mm][Ee][Dd]\.\s?)?)?{_ANY}{_ANY}+(?:\s+{_ANY}{_ANY}+)?"
_CASE = r"(?:[Ff][Aa][Ll][Ll][Nn][Uu][Mm][Mm][Ee][Rr]|[Ff][Aa][Ll][Ll][Nn][Rr]|[Ff][Aa][Ll][Ll]\.[Nn][Rr])[:\s]*\d+"
_DAY = r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"
_SOCIAL = r"\b\d{2}\s?\d{2}\s?\d{2}\s?\d{4}\b"
_PHONE = r"\b(?:\+49\s?)?(?:\d{3,5}[\s\-]?)?\d{6,8}\b"
_STREET = r"(?:[Ss][Tt][Rr]\.|[Ss][Tt][Rr][Aa]ß[Ee]|[Pp][Ll][Aa][Tt][Zz]|[Ww][Ee][Gg]|[Gg][Aa][Ss][Ss][Ee])\s*\d+"

#: Kinds and patterns without regard to case.  A street's name is looked for in the 60 characters before
#: its type, so that the time is linear in the text.
PATTERNS = {
    "first_name": _NAME, "last_name": _NAME, "birth_date": _DAY, "casenumber": _CASE, "social_security": _SOCIAL, "phone_number": _PHONE,
    "address": rf"{_ANY}[A-Za-zÄÖÜäöüß\s]{{1,60}}{_STREET}", "examiner_first_name": _PERSON, "examiner_last_name": _PERSON,
}

#: What redaction replaces, in this order.  Names need their capitals and examiners their title, as without
#: regard to case the patterns above take any two words for a person.
MARKS = (
    (rf"{_UP}[A-Za-zÄÖÜäöüß\s]{{1,60}}{_STREET}", "[ADDRESS]"), (_CASE, "[CASE]"), (rf"Dr\.\s?(?:med\.\s?)?{_UP}{_LOW}+(?:\s+{_UP}{_LOW}+)?", "[EXAMINER]"), (rf"{_UP}{_LOW}+\s*,\s*{_UP}{_LOW}+", "[NAME]"),
    (_DAY, "[DATE]"), (_SOCIAL, "[SOCIAL]"), (_PHONE, "[PHONE]"),
)


def spans(c: Column) -> Column:
    """Array of (kind, found): the kinds that occur in a text and all their matches."""

    def found(p: str) -> Column:
        hits = F.regexp_extract_all(c, F.lit(java(p)), F.lit(0))
        # the search for a street's name goes back 60 characters at each letter: only where there is a street
        return F.when(c.rlike(java(_STREET)), hits).otherwise(F.array().cast("array<string>")) if p.endswith(_STREET) else hits

    def named(p: str):
        return lambda f: F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("found")) for k, q in PATTERNS.items() if q == p])

    # each pattern once, whatever the number of its kinds
    each = [let(found(p), named(p)) for p in dict.fromkeys(PATTERNS.values())]
    return F.filter(F.flatten(F.array(*each)), lambda s: F.size(s["found"]) > 0)


def may_hold(c: Column, pattern: str) -> Column:
    """A cheap test that every text with a match passes."""
    if pattern.endswith(_STREET):
        return c.rlike(java(_STREET))
    sign = next((s for s in ("@", r"\+[", "Dr\\.", r"\s*,\s*") if s in pattern), None)
    return F.contains(c, F.lit({"@": "@", r"\+[": "+", "Dr\\.": "Dr.", r"\s*,\s*": ","}[sign])) if sign else c.rlike("[0-9]")


def count(c: Column, pattern: str) -> Column:
    """Matches in a text."""
    return F.when(~may_hold(c, pattern), 0).otherwise(F.regexp_count(c, F.lit(java(pattern))))


def replace(c: Column, pattern: str, by: str) -> Column:
    """A text with the matches replaced."""
    return let(c, lambda x: F.when(may_hold(x, pattern), F.regexp_replace(x, java(pattern), by)).otherwise(x))


def mark(c: Column) -> Column:
    """A text with its sensitive spans replaced by marks."""
    for pattern, by in MARKS:
        c = replace(c, pattern, by)
    return c
