"""Locale-explicit date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _reading(text: Column, pattern: str, rebuilt: str) -> Column:
    """The text rearranged to year-month-day when it has the pattern and is a real date."""
    return F.regexp_replace(F.regexp_extract(text, f"^({pattern})$", 1), f"^{pattern}$", rebuilt).try_cast("date")


def parse_date(value: Column, locale: str) -> Column:
    """ISO first, then the locale's day order; NULL when no reading is a real date.

    Two-digit years pivot at 69: 69-99 are 19xx, 00-68 are 20xx.
    """
    text = strip(value.cast("string"))
    iso = _reading(text, r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1-$2-$3")
    first, order = (r"(\d{1,2})\.(\d{1,2})\.", "$2-$1") if locale == "de" else (r"(\d{1,2})/(\d{1,2})/", "$1-$2")
    return F.coalesce(
        iso, _reading(text, first + r"(\d{4})", "$3-" + order),
        _reading(text, first + r"(69|[7-9]\d)", "19$3-" + order), _reading(text, first + r"([0-5]\d|6[0-8])", "20$3-" + order))


def as_date(value: Column) -> Column:
    return F.coalesce(parse_date(value, "de"), parse_date(value, "en"))


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
