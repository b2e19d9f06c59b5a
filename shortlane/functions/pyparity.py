"""Column functions with Python's text semantics: strip, canonical int, float, NaN-safe comparison."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip removes, and the texts its int and float accept.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CANONICAL_INT = r"^(0|-?[1-9][0-9]*)\z"
FINITE = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?\z"
NAN = r"(?i)^[+-]?nan\z"
INFINITE = r"(?i)^[+-]?inf(inity)?\z"
#: Python refuses to convert longer digit strings.
MAX_INT_DIGITS = 4300
#: The decimal digits of other scripts, and the ASCII digits that float takes them for.
DIGITS = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None]


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def is_canonical_int(text: Column) -> Column:
    """Whether str(int(text)) == text."""
    return text.rlike(CANONICAL_INT) & (F.length(F.ltrim(text, F.lit("-"))) <= MAX_INT_DIGITS)


def int_order(text: Column) -> Column:
    """A sort key of canonical ints of any length: sign, then length and digits (reversed for negative ones)."""
    negative = text.startswith("-")
    digits = F.ltrim(text, F.lit("-"))
    size = F.length(digits)
    return F.struct(
        F.when(negative, -size).otherwise(size).alias("size"),
        F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"),
    )


def ascii_digits(text: Column) -> Column:
    """The text with decimal digits of any script as ASCII digits."""
    from_, to = ("".join(x) for x in zip(*DIGITS, strict=True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, from_, to)).otherwise(text)


def is_float(text: Column) -> Column:
    """Whether float(text) succeeds."""
    return ascii_digits(text).rlike(FINITE) | text.rlike(NAN) | text.rlike(INFINITE)


def to_float(text: Column) -> Column:
    """float(text), or NULL where it fails."""
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    plain = ascii_digits(text)
    return (
        F.when(plain.rlike(FINITE), F.regexp_replace(plain, "_", "").try_cast("double"))
        .when(text.rlike(NAN), F.lit(float("nan")))
        .when(text.rlike(INFINITE), sign * F.lit(float("inf")))
    )


def less(a: Column, b: Column) -> Column:
    """a < b as Python compares doubles: false if either is NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def equal(a: Column, b: Column) -> Column:
    """a == b as Python compares doubles: NaN equals nothing."""
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)
