"""Locale-explicit money parsing and exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compatibility_form, strip

CENTS = "decimal(18,2)"
STORED = "decimal(38,9)"

# locale -> (well-formed amount, grouping mark, decimal mark); '~' marks an amount in brackets
_SHAPES = {
    "de": (r"[+-]?(?:\d{1,3}(?:\.\d{3})+|\d*)(?:,\d+)?", ".", ","),
    "en": (r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d*)(?:\.\d+)?", ",", "."),
}
_EXPONENT = r"[+-]?\d+[eE][+-]?\d+"


def parse_decimal(value: Column, locale: str) -> Column:
    """Amount text to DECIMAL(38,9), NULL when it is not well formed for the locale.

    One chain of replacements in which every step is used once, so the expression stays small.
    """
    shape, grouping, mark = _SHAPES[locale]
    text = strip(compatibility_form(value.cast("string")))
    marked = F.regexp_replace(text, r"^\((.*)\)$", "~$1")
    bare = F.regexp_replace(marked, r"(?i)EUR|USD|GBP|€|\$|£| |'", "")
    formed = F.regexp_extract(bare, rf"^(~?{shape}|~?{_EXPONENT})$", 1)
    plain = F.translate(F.translate(formed, grouping, ""), mark, ".")
    signed = F.regexp_replace(F.regexp_replace(plain, r"^~-", ""), r"^~\+?", "-")
    return signed.try_cast(STORED)


def money(value: Column) -> Column:
    """German reading first, then English, else NULL."""
    return F.coalesce(parse_decimal(value, "de"), parse_decimal(value, "en"))


def to_cents(value: Column) -> Column:
    """Store as cents; ties go away from zero, as a cast does."""
    return value.cast(CENTS)


def quantize_cents(value: Column) -> Column:
    """Round to cents with ties to even, then store as cents."""
    return F.bround(value, 2).cast(CENTS)


def first_digit(amount: Column) -> Column:
    """First significant digit of the magnitude, without floating point."""
    digit = F.regexp_extract(F.abs(amount).cast("string"), "[1-9]", 0)
    return F.when(digit != "", digit.cast("int"))


def positive_difference(left: Column, right: Column, tolerance: Column) -> Column:
    """Zero inside the tolerance, the full difference beyond it."""
    gap = left - right
    return F.when(gap <= tolerance, F.lit(0)).otherwise(gap).cast(CENTS)
