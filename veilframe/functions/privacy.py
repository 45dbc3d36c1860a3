"""Keyed pseudonyms, date shifts and splits, from built-in functions only."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, let

BLOCK = 64


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column (P1); the secret has 32 bytes at least."""
    if len(secret) < 32:
        raise ValueError("the secret needs at least 32 bytes")
    key = hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def keyed(secret: bytes, space: str, value: Column) -> Column:
    """Hex digest of ``space:value``."""
    return hmac_sha256(secret, F.concat(F.lit(space + ":"), value))


def patient_pseudonym(secret: bytes, original: Column) -> Column:
    """PAT_ and 32 hex digits of the trimmed id (P2); null and blank ids have none."""
    t = F.trim(original)
    return F.when(t != "", F.concat(F.lit("PAT_"), F.left(keyed(secret, "patient", t), F.lit(32))))


def hex_to_decimal(digits: Column) -> Column:
    """Decimal notation of a 128-bit hex number.

    128 bits are more than 38 digits, so that the last decimal digit is kept apart from the others.
    """
    word = F.lit(Decimal(1 << 64))
    half = lambda k: F.lpad(F.conv(F.substring(digits, k, 16), 16, 10), 20, "0")

    def text(h: Column) -> Column:
        rest = F.substring(h["hi"], 20, 1).cast("decimal(1,0)") * word + h["lo"].cast("decimal(20,0)")
        return let(F.lpad(rest.cast("string"), 21, "0"), lambda r: F.concat((F.left(h["hi"], F.lit(19)).cast("decimal(19,0)") * word + F.left(r, F.lit(20)).cast("decimal(20,0)")).cast("string"), F.right(r, F.lit(1))))

    value = let(F.struct(half(1).alias("hi"), half(17).alias("lo")), text)
    return F.regexp_replace(value, r"\A0+(?=[0-9])", "")


def uid_pseudonym(secret: bytes, original: Column) -> Column:
    """2.25. and the first 128 bits of the digest in decimal (P3); null and blank ids have none."""
    t = F.trim(original)
    number = let(F.left(keyed(secret, "uid", t), F.lit(32)), hex_to_decimal)  # bound: the digest is computed once
    return F.when(t != "", F.concat(F.lit("2.25."), number))


def shift_days(secret: bytes, patient: Column) -> Column:
    """1 to 3650 days, back or forth, fixed for a patient (M2)."""
    v = F.conv(F.left(keyed(secret, "date-shift", patient), F.lit(8)), 16, 10).cast("bigint")
    return let(v, lambda x: F.when(x % 2 == 1, -(x % 3650 + 1)).otherwise(x % 3650 + 1).cast("int"))


def shift_compact_date(value: Column, days: Column) -> Column:
    """A yyyyMMdd text moved by ``days``; blank stays blank, what is no date becomes empty (M2)."""
    raw = F.trim(value)
    moved = F.date_format(F.date_add(F.try_to_date(F.when(raw.rlike(r"\A[0-9]{8}"), F.left(raw, F.lit(8))), "yyyyMMdd"), days), "yyyyMMdd")
    return F.when(raw == "", raw).otherwise(F.coalesce(moved, F.lit("")))


def shift_compact_datetime(value: Column, days: Column) -> Column:
    """The same for a text that goes on after the date; the rest stays (M2)."""
    raw = F.trim(value)
    moved = shift_compact_date(F.left(raw, F.lit(8)), days)
    return F.when(raw == "", raw).when((F.length(raw) < 8) | (moved == ""), "").otherwise(F.concat(moved, F.substring(raw, F.lit(9), F.length(raw))))


def hex_mod(digits: Column, modulus: int) -> Column:
    """A hex number of any length modulo ``modulus``, four digits at a time."""
    parts = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(4)), lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: (a * 65536 + x) % modulus)


def shift_date(day: Column, low: int, high: int, seed: Column) -> Column:
    """A date moved by low..high days, fixed for a seed and the date (M1)."""
    n = high - low + 1
    delta = hex_mod(F.sha2(F.concat(seed, F.date_format(day, "yyyy-MM-dd")), 256), n) + low
    return F.date_add(day, delta.cast("int"))


def hash_fraction_below(key: Column, fraction: float) -> Column:
    """Whether the first 64 bits of sha256(key) lie below a fraction of their range."""
    limit = int(fraction * float(1 << 64))
    return F.conv(F.left(F.sha2(key, 256), F.lit(16)), 16, 10).cast("decimal(20,0)") < F.lit(str(limit)).cast("decimal(20,0)")


def group_split(group: Column, seed: int = 0, fraction: float = 0.2) -> Column:
    """val or train, the same for all rows of a group."""
    return F.when(hash_fraction_below(F.concat(F.lit(f"{seed}:"), group), fraction), "val").otherwise("train")


def digits_like(secret: bytes, number: Column) -> Column:
    """Digits of the same number, as many, keyed (P9): each digit pair of the digest gives one."""
    at = F.sequence(F.lit(0), F.length(number) - 1)
    digit = lambda h, i: (F.conv(F.substring(h, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string")
    return let(F.concat(keyed(secret, "number", number), keyed(secret, "number2", number)), lambda h: F.array_join(F.transform(at, lambda i: digit(h, i)), ""))


def redact_long_numbers(secret: bytes, text: Column) -> Column:
    """Every whole-word number of five digits and more replaced by keyed digits, in one pass."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0))
    parts = F.transform(pieces, lambda p: F.when(p.rlike(r"\A[0-9]{5,}\z"), digits_like(secret, p)).otherwise(p))
    return F.array_join(parts, "")


def draw(lexicon: list[str], secret: bytes, space: str, value: Column) -> Column:
    """A word of the list, fixed for a value."""
    at = F.conv(F.left(keyed(secret, space, value), F.lit(12)), 16, 10).cast("bigint") % len(lexicon)
    return F.element_at(F.array(*[F.lit(x) for x in lexicon]), (at + 1).cast("int"))
