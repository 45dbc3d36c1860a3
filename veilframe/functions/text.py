"""Text predicates, scores and normal forms as Column expressions.

Everything here stays inside the JVM.  Patterns use only syntax that Java and RE2
read alike (no lookaround, no backreference), so that a SQL engine can repeat them:
``[0-9]`` for digits, ``SP`` for Unicode white space, ``WORD`` for letters, digits and
the underscore, and explicit edges where a word boundary is meant.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SP = r"\t-\r\x1c-\x20\x85\xa0\p{Z}"
WORD = r"\p{L}\p{N}_"
LATIN = "A-Za-zÄÖÜäöüß"
STANDARD = LATIN + r"0-9 .,:;/()\[\]\-"
VOWEL = "[AEIOUÄÖÜaeiouäöü]"
LEFT, RIGHT = rf"(?:\A|[^{WORD}])", rf"(?:[^{WORD}]|\z)"

CLOCK = r"[0-9]{1,2}:[0-9]{2}"
_SEP = r"[./-]"
DATE = rf"[0-9]{{4}}{_SEP}[0-9]{{1,2}}{_SEP}[0-9]{{1,2}}|[0-9]{{1,2}}{_SEP}[0-9]{{1,2}}{_SEP}[0-9]{{4}}"
CASE = rf"[A-Z][{SP}]*[0-9]{{4,}}/[0-9]{{4}}"
CODE = rf"{LEFT}[A-Z][{SP}]*[0-9]{{5,}}{RIGHT}"
SERIAL = "[0-9]{8,}"
_NUM = "[0-9]+(?:[.,][0-9]+)?"
RATIO = f"{LEFT}{_NUM}/{_NUM}{RIGHT}"
FOUR = f"{LEFT}[0-9]{{4,}}{RIGHT}"
STRICT_OVERLAY = "|".join(f"(?:{x})" for x in (CLOCK, DATE, CASE, CODE, SERIAL, RATIO))
LOOSE_OVERLAY = "|".join(f"(?:{x})" for x in (CLOCK, CODE, RATIO, FOUR))

CLINICAL = (
    "(?i)behandlung|befund|diagnose|untersuchung|patient",
    "(?i)%|°|grad|cm|mm",
    "(?i)posterior|anterior|medial|lateral|rechts|links",
    "(?i)monat|tag|jahr",
)
TITLES = frozenset("prof prof. dr dr. med med. dipl dipl. ing ing. pr. herr herrn frau fru monsieur madame mr mrs ms professor".split())
#: Substrings of which two make a text worth an expensive extraction.
HINTS = tuple(
    sorted(
        """- . / 19 20 akte alter arzt aufnahme aufzeichnung befund bildgebung case case-id datum diagnose doktor dr endoskopie
        entlassung examination fall fallnummer frau gastroskopie geb. geboren geburt herr id jahr jahre kasenummer koloskopie mr mrs
        männlich name nr. nummer pat-id patient patient-id prof scope termin time uhr untersucher untersuchung weiblich zeit""".split()
    )
)


_ITEM = re.compile(r"\\p\{\w+\}|\\x[0-9a-fA-F]{2}|\\.|.", re.S)


def _members(inside: str) -> str:
    """The same character class with its Latin-1 members first and one by one.

    Java keeps these in a table as long as they come together; after anything else each one is a
    further test of every character.
    """
    items, low, rest, k = _ITEM.findall(inside), [], [], 0
    code = lambda x: int(x[2:], 16) if x[:2] == "\\x" else {"t": 9, "n": 10, "r": 13, "f": 12}.get(x[1], None if x[1].isalnum() else ord(x[1])) if x[0] == "\\" else ord(x)
    while k < len(items):
        a = code(items[k])
        if a is not None and k + 2 < len(items) and items[k + 1] == "-" and (b := code(items[k + 2])) is not None:
            low += range(a, min(b, 255) + 1)
            if b > 255:
                rest.append(f"{chr(max(a, 256))}-{chr(b)}")
            k += 3
            continue
        if a is None or a > 255:
            rest.append(items[k])
            # letters and digits of ASCII are met before their Unicode class
            low += {"\\p{L}": [*range(65, 91), *range(97, 123)], "\\p{N}": range(48, 58), "\\p{Z}": [32]}.get(items[k], [])
        else:
            low.append(a)
        k += 1
    return "".join(f"\\x{x:02x}" for x in sorted(set(low))) + "".join(rest)


@lru_cache(maxsize=None)
def java(pattern: str) -> str:
    """A pattern with all its character classes written as Java tests them fastest."""
    return re.sub(r"(?<!\\)\[(\^?)((?:\\.|[^\]\\])+)\]", lambda m: f"[{m[1]}{_members(m[2])}]", pattern, flags=re.S)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda nothing else shares it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A[{SP}]+|[{SP}]+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"[{SP}]+", " "))


def dedup_key(c: Column) -> Column:
    """Lower-cased, white space collapsed."""
    return F.lower(collapse(c))


def tokens(c: Column) -> Column:
    """Pieces between white space."""
    return F.regexp_extract_all(c, F.lit(f"[^{SP}]+"), F.lit(0))


def count_of(c: Column, members: str) -> Column:
    """Characters of ``c`` in a character class; the others go in runs.

    Single members beyond Latin-1 are counted by themselves, and only in texts beyond ASCII: in one class
    with the others they make Java's test of each character many times slower.
    """
    far = "".join(dict.fromkeys(x for x in members if ord(x) > 255))
    near = "".join(x for x in members if ord(x) < 256)
    n = F.length(F.regexp_replace(c, java(f"[^{near}]+"), ""))
    return n + F.when(_ascii(c), 0).otherwise(F.length(c) - count_not(c, far)) if far else n


def count_not(c: Column, members: str) -> Column:
    """Characters of ``c`` outside a character class."""
    return F.length(F.regexp_replace(c, java(f"[{members}]+"), ""))


# What is only counted is counted by patterns, without an array of the words.  Java's lookaround keeps a
# pattern to the starts of words, so that the time is linear in the text.
_STARTS = f"(?<![^{SP}])"
_WORDS = f"[^{SP}]{{2,}}"
_VOICED = rf"{_STARTS}(?:{VOWEL}[^{SP}]+|[^{SP}{VOWEL[1:-1]}]++{VOWEL}[^{SP}]*)"
_LONE = f"(?<![{LATIN}])[{LATIN}](?![{LATIN}])"
_READABLE = rf"(?<![{LATIN}])(?!([{LATIN}])\1*+(?![{LATIN}]))[{LATIN}]{{3,}}"


def count_hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(java(pattern)))


def latin_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{LATIN}]{{2,}}"), F.lit(0))


def any_contains(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def structured_strict(c: Column) -> Column:
    """Clock, date, case, code, serial or ratio (X5, the default of the two)."""
    return F.coalesce(c.rlike("[0-9]") & c.rlike(java(STRICT_OVERLAY)), F.lit(False))


def structured_loose(c: Column) -> Column:
    """Clock, code, ratio or four digits."""
    return F.coalesce(c.rlike(LOOSE_OVERLAY), F.lit(False))


def normalize_overlay(c: Column) -> Column:
    """Overlay text without unexpected characters, repeated punctuation and wide gaps.

    The input is taken as composed (see ``unicode.compose`` for text that isn't).  The class of
    allowed characters spans from the slash to the capital A umlaut, as documented in the survey.
    """
    c = F.regexp_replace(c, rf"[^{WORD}{SP}.,:;/-ÄÖÜäöüß]", "")
    for mark in (r"\.", ",", ":", ";"):
        c = F.regexp_replace(c, f"{mark}{{2,}}", mark.lstrip("\\"))
    c = F.regexp_replace(c, "([.,:;])[.,:;]+", "$1")
    return strip(F.regexp_replace(c, f"[{SP}]{{2,}}", " "))


def _vowel_share(words: Column) -> tuple[Column, Column]:
    return F.size(F.filter(words, lambda w: w.rlike(VOWEL))), F.size(words)


def is_gibberish(c: Column) -> Column:
    """Text that no structured overlay explains and that doesn't look like words."""
    n = F.length(c)
    distinct = F.size(F.array_distinct(F.split(F.replace(c, F.lit(" "), F.lit("")), "")))
    return (
        F.when(c.isNull() | (n < 3), True)
        .when(structured_strict(c), False)
        .when(count_of(c, r"\p{L}") / n < 0.2, True)
        .when(count_not(c, STANDARD) > n * 0.4, True)
        .when(~c.rlike(f"[^{SP}]"), True)
        .when((count_hits(c, _WORDS) > 0) & (count_hits(c, _VOICED) < count_hits(c, _WORDS) * 0.15), True)
        .otherwise(distinct < n * 0.1)
    )


def gibberish_score(c: Column) -> Column:
    """0 (text) to 1 (noise)."""
    n = F.greatest(F.length(c), F.lit(1))
    letters = count_of(c, r"\p{L}") / n
    odd = count_not(c, STANDARD) / n
    marks = count_not(c, rf"\p{{L}}\p{{N}}{SP}.,:;/\-") / n
    share = F.try_divide(count_hits(c, _VOICED), count_hits(c, _WORDS))
    score = (
        let(letters, lambda x: F.when(x < 0.2, 0.35).when(x < 0.35, 0.15).otherwise(0.0))
        + F.least(odd * 0.8, F.lit(0.4))
        + F.least(marks * 0.6, F.lit(0.2))
        + let(share, lambda x: F.when(x < 0.15, 0.25).when(x < 0.3, 0.1).otherwise(0.0))
    )
    return F.when(c.isNull() | (c == ""), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def is_valid_overlay(c: Column, min_letters: float = 0.2, min_length: int = 3) -> Column:
    """The frame reader's admission test."""
    n = F.length(c)
    vowels, words = _vowel_share(F.filter(tokens(c), lambda w: F.length(w) > 1))
    return (
        F.when(c.isNull() | (F.length(strip(c)) < min_length), False)
        .when(structured_strict(c), True)
        .when(count_of(c, r"\p{L}") / n < min_letters, False)
        .when(F.length(F.regexp_replace(c, f"[{STANDARD}]", "")) > n * 0.4, False)
        .when(words == 0, False)
        .otherwise(~((words > 2) & (vowels < words * 0.15)))
    )


def _readable(words: Column) -> Column:
    """Words of three letters and more that aren't one letter repeated."""
    return F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(F.replace(w, F.left(w, F.lit(1)), F.lit(""))) > 0))


def _clinical(c: Column) -> Column:
    return F.least(sum((F.when(c.rlike(java(p)), 0.1).otherwise(0.0) for p in CLINICAL), F.lit(0.0)), F.lit(0.3))


def quality_score(c: Column, conf: Column) -> Column:
    """Readability of a frame's text with its reader's confidence, 0 to 1."""
    n = F.length(c)
    conf = F.when(conf.isNull() | F.isnan(conf), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))

    def wordy(k: Column) -> Column:
        letters = count_of(c, LATIN) - count_hits(c, _LONE)
        return F.when(k > 0, _clinical(c) + F.when(letters / k >= 4.0, 0.1).otherwise(0.0) + count_hits(c, _READABLE) / k * 0.2).otherwise(0.0)

    text = let(count_hits(c, f"[{LATIN}]{{2,}}"), wordy)
    factor = let(count_of(c, r"\p{P}\p{S}") / n, lambda m: F.when(n < 4, 1.0).when(m > 0.5, 0.3).when(m > 0.3, 0.7).otherwise(1.0))
    score = (conf * 0.4 + text) * factor + F.least(n / 1000.0, F.lit(0.1))
    return F.when(c.isNull() | (n == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


HARD_MARKS = r"""°§•…–—‚~`"'?!;:,.<>|/\\{}()\[\]\^&%$#@*+_"""


def enhanced_score(c: Column, conf: Column) -> Column:
    """The variant with a fixed list of marks and a bonus that is full at ten characters."""
    n = F.length(c)
    words = latin_words(c)
    k = F.size(words)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    text = F.when(k > 0, _clinical(c) + F.when(letters / k >= 4, 0.1).otherwise(0.0) + F.size(F.filter(words, lambda w: F.length(w) >= 3)) / k * 0.2).otherwise(0.0)
    marks = count_of(c, HARD_MARKS) / n
    factor = F.when(marks > 0.5, 0.3).when(marks > 0.3, 0.7).otherwise(1.0)
    return F.when(c.isNull() | (n == 0), 0.0).otherwise(F.least((conf * 0.4 + text) * factor + F.least(n / 100, F.lit(0.1)), F.lit(1.0)))


def is_quality_text(c: Column) -> Column:
    """Has a readable word and few foreign signs (X9's gate)."""
    odd = F.length(F.regexp_replace(c, r"[\x00-\x7f\p{L}]", ""))
    return F.coalesce((F.length(c) >= 3) & ~(odd > F.length(c) * 0.3) & (F.size(_readable(latin_words(c))) > 0), F.lit(False))


def profile(c: Column) -> dict[str, Column]:
    """Counts of a text (X7); ``noise_of`` has the shares and the score.  The input is taken as composed."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return {
        "n_chars": zero(F.length(c)), "n_letters": zero(count_of(c, r"\p{L}")), "n_digits": zero(count_of(c, r"\p{Nd}")), "n_marks": zero(count_of(c, HARD_MARKS)), "n_spaces": zero(count_of(c, SP)),
        "n_words": zero(F.when(c.isNotNull(), F.size(latin_words(c)))), "n_readable": zero(F.when(c.isNotNull(), F.size(_readable(latin_words(c))))),
        "n_repeats": zero(F.regexp_count(c, F.lit("|".join(_REPEATS)))), "n_odd": zero(F.length(F.regexp_replace(c, r"[\x00-\x7f\p{L}]", ""))),
    }


def noise_of(p: dict[str, Column]) -> dict[str, Column]:
    """Share of marks, coarse noise score and verdict from the counts of ``profile``."""
    n = p["n_chars"]
    share = p["n_marks"] / F.greatest(n, F.lit(1))
    score = F.when(share > 0.5, 0.4).otherwise(0.0) + F.when(p["n_readable"] == 0, 0.3).otherwise(0.0) + F.when(p["n_repeats"] > 2, 0.2).otherwise(0.0) + F.when(p["n_odd"] > n * 0.2, 0.1).otherwise(0.0)
    return {"mark_share": share, "noise": F.when(n == 0, 1.0).otherwise(score), "is_noise": F.when(n == 0, True).otherwise((score > 0.6) | (share > 0.7))}


#: A character repeated four times and more; of the characters that OCR repeats, as RE2 has no backreference.
_REPEATS = tuple(f"{x}{{4,}}" for x in (r"\.", "-", "_", "=", r"\*", "#", "%", "&", r"\$", "!", r"\?", "~", "'", " ", "0", "1", "a", "e", "i", "l", "o"))


def strip_titles(c: Column) -> Column:
    """Lower-cased words without honorifics; signs separate words."""
    words = tokens(F.regexp_replace(F.lower(c), f"[^{WORD}]", " "))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*sorted(TITLES))), " ")


def plain(c: Column) -> Column:
    """Lower-cased, signs as spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), f"[^{WORD}]", " "))


EVAL_BLANK = ("", "-", "n/a", "na", "nan", "none", "null", "undefined", "unknown")
FRAME_BLANK = ("", "-", "n/a", "na", "none", "unbekannt", "undefined", "unknown")
MATRIX_BLANK = ("", "-", "n/a", "na", "none", "null", "unbekannt", "unknown")
PAPER_BLANK = ("", "-", "n/a", "na", "none", "null", "undefined", "unknown")


def nonblank(c: Column, blank: Sequence[str] = FRAME_BLANK) -> Column:
    """Not null and none of a module's words for nothing."""
    return F.coalesce(~F.lower(strip(c)).isin(*blank), F.lit(False))


def scalar(c: Column) -> Column:
    """Trimmed text; empty for null and the evaluation's words for nothing."""
    t = strip(c)
    return F.when(nonblank(c, EVAL_BLANK), t).otherwise("")


def canonical(c: Column, is_name: bool) -> Column:
    """What the record evaluation compares."""
    return strip_titles(scalar(c)) if is_name else plain(scalar(c))


def field_value(c: Column, is_date: bool = False) -> Column:
    """What the backend matrix compares."""
    t = dedup_key(c)
    t = F.when(nonblank(c, MATRIX_BLANK), t).otherwise("")
    return F.translate(t, "/-", "..") if is_date else t


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def field_similarity(a: Column, b: Column, digits: bool) -> Column:
    """Similarity of two values that went through ``field_value``; dates and case numbers by their digits."""
    da, db = F.regexp_replace(a, "[^0-9]", ""), F.regexp_replace(b, "[^0-9]", "")
    near = F.when((da != "") & (db != ""), edit_similarity(da, db)).otherwise(edit_similarity(a, b)) if digits else edit_similarity(a, b)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(near)


def field_match(a: Column, b: Column, digits: bool) -> Column:
    """Whether value ``a`` recalls the expected ``b``."""
    return F.when(b == "", a == "").when(a == "", False).otherwise(F.contains(a, b) | F.contains(b, a) | (field_similarity(a, b, digits) >= 0.85))


def word_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance between two arrays of words."""
    from .fuzzy import word_distance_udf

    # the words as hex digits: a word may hold a space of its own
    text = lambda words: F.array_join(F.transform(words, lambda w: F.concat(F.lit("w"), F.hex(w))), " ")
    return word_distance_udf(text(a), text(b)).cast("int")


def text_similarity(predicted: Column, expected: Column) -> Column:
    """1 - mean of character and word error rates (X11); distances are measured in Arrow batches, bit-parallel."""
    from .fuzzy import edit_distance_udf, word_distance_udf

    p, e = collapse(predicted), collapse(expected)
    word = F.lit(f"[{WORD}]+")
    pw, ew = (F.regexp_extract_all(F.lower(x), word, F.lit(0)) for x in (p, e))
    cer = edit_distance_udf(p, e) / F.greatest(F.length(p), F.length(e), F.lit(1))
    wer = word_distance_udf(F.array_join(pw, " "), F.array_join(ew, " ")) / F.greatest(F.size(pw), F.size(ew), F.lit(1))
    return F.when((p == "") & (e == ""), 1.0).when((p == "") | (e == ""), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (cer + wer) / 2.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared lower-cased words over all words; 0 if either has none."""
    x, y = (F.array_distinct(tokens(F.lower(c))) for c in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull() | (F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / either)


def fold_umlauts(c: Column) -> Column:
    """Umlauts as two letters; a sharp s stays."""
    out = c
    for old, new in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(_ascii(c), c).otherwise(out)


def _ascii(c: Column) -> Column:
    """As many bytes as characters: nothing to fold."""
    return F.octet_length(c) == F.length(c)


_ACCENTS = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BARE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def fold_ascii(c: Column) -> Column:
    """Latin accents dropped, other characters beyond ASCII removed."""
    # only what lies beyond ASCII is looked at: character by character the whole text would be slow
    out = c
    for bare in dict.fromkeys(_BARE):
        out = F.regexp_replace(out, "[" + "".join(a for a, b in zip(_ACCENTS, _BARE) if b == bare) + "]", bare)
    return F.when(_ascii(c), c).otherwise(F.regexp_replace(out, r"[^\x00-\x7f]+", ""))


def safe_name(c: Column) -> Column:
    """Usable as a file name, 180 characters at most."""
    # 180 characters come from as many signs and runs of others, so the rest of the text isn't replaced
    head = F.regexp_extract(c, r"\A(?:[A-Za-z0-9_.-]|[^A-Za-z0-9_.-]++){0,180}+", 0)
    t = F.regexp_replace(F.substring(F.regexp_replace(head, "[^A-Za-z0-9_.-]+", "_"), 1, 180), r"\A_+|_+\z", "")
    return let(t, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "frame").otherwise(x))


def cut_above(c: Column, flags: Sequence[str]) -> Column:
    """From the first line that holds a flag on."""
    lines = F.split(c, "\n")
    at = F.array_position(F.transform(lines, lambda x: any_contains(x, flags)), True)
    return F.when(at > 0, F.array_join(F.slice(lines, at, F.size(lines)), "\n")).otherwise(c)


def cut_below(c: Column, flags: Sequence[str]) -> Column:
    """Up to and with the first line that holds a flag."""
    lines = F.split(c, "\n")
    at = F.array_position(F.transform(lines, lambda x: any_contains(x, flags)), True)
    return F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), at), "\n")).otherwise(c)


def flatten_lines(c: Column) -> Column:
    """One line (X22)."""
    return F.regexp_replace(F.regexp_replace(c, "\n{2,}", "\n"), "\n", " ")


def chunks(c: Column, size: int = 2048) -> Column:
    """Array of pieces of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def confidence(c: Column) -> Column:
    """A reader's confidence as 0 to 1."""
    d = c.cast("double")
    d = F.when(d > 1.0, d / 100.0).otherwise(d)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(d, F.lit(1.0))), F.lit(0.0))


def has_patient_hints(c: Column) -> Column:
    """At least two of the hints occur."""
    low = F.lower(c)
    n = sum((F.contains(low, F.lit(h)).cast("int") for h in HINTS), F.lit(0))
    return F.coalesce((F.length(strip(c)) >= 10) & (n >= 2), F.lit(False))


def representative(first: Column, last: Column, **labelled: Column) -> Column:
    """'First Last | Case: .. | ..' of the non-empty parts."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.nullif(F.concat_ws(" ", some(first), some(last)), F.lit(""))
    return F.concat_ws(" | ", name, *[F.concat(F.lit(k + ": "), F.nullif(v, F.lit(""))) for k, v in labelled.items()])


def metadata_confidence(m: dict[str, Column]) -> Column:
    """How much of a record an extractor found, 0 to 1."""
    low = lambda k: F.lower(m[k])
    has = lambda k: F.coalesce(~low(k).isin("", "null", "unknown"), F.lit(False))
    filled = lambda k: F.coalesce(m[k] != "", F.lit(False))
    full = F.lower(F.trim(F.concat_ws(" ", m["first_name"], m["last_name"])))
    name = F.when(filled("first_name") & filled("last_name") & ~full.isin("unknown", "patient", "null", "nix"), 0.3).when(has("first_name") | has("last_name"), 0.25).otherwise(0.0)
    score = name
    for k, w in (("examination_date", 0.2), ("casenumber", 0.2), ("dob", 0.15)):
        score = score + F.when(has(k), w).otherwise(0.0)
    score = score + F.when(F.coalesce(low("gender").isin("male", "female"), F.lit(False)), 0.05).otherwise(0.0)
    for k in ("examiner_first_name", "examiner_last_name"):
        score = score + F.when(has(k), 0.05).otherwise(0.0)
    return F.least(score, F.lit(1.0))
