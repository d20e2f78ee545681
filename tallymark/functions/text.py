"""Text normalisation and keyword tests as native column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _compatibility_table() -> tuple[str, str]:
    """Every character whose compatibility form is one other character, built from Unicode data."""
    source, target = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        form = unicodedata.normalize("NFKC", char)
        if len(form) == 1 and form != char:
            source.append(char)
            target.append(form)
    return "".join(source), "".join(target)


# Multi-character compatibility forms and decomposed umlauts seen in ledger exports.
_EXPANSIONS = (
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("™", "TM"), ("№", "No"),
    ("ä", "ä"), ("ö", "ö"), ("ü", "ü"),
    ("Ä", "Ä"), ("Ö", "Ö"), ("Ü", "Ü"),
)


def compatibility_form(text: Column) -> Column:
    """NFKC for the characters that occur in exports; pure ASCII text skips the work."""
    source, target = _compatibility_table()
    expanded = text
    for old, new in _EXPANSIONS:
        expanded = F.replace(expanded, F.lit(old), F.lit(new))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(expanded, source, target)).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonical_header(name: str) -> str:
    """Lower-case and keep only a-z and 0-9, so umlauts and punctuation vanish."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def canonical_header_column(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def normalize_identifier(value: Column, uppercase: bool = True) -> Column:
    """Compatibility form, single spaces, optional upper case; blank gives NULL.

    Identifiers that are already normal, which is the common case, pass after one short test.
    """
    text = value.cast("string")
    collapsed = F.regexp_replace(strip(compatibility_form(text)), r"(?U)\s+", " ")
    cased = F.nullif(F.upper(collapsed) if uppercase else collapsed, F.lit(""))
    normal = r"^[!-`{-~]+$" if uppercase else r"^[!-~]+$"
    return F.when(text.rlike(normal), text).otherwise(cased)


def fold(text: Column) -> Column:
    """Caseless form used for word matching."""
    return F.replace(F.lower(compatibility_form(text)), F.lit("ß"), F.lit("ss"))


def fold_literal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def matching_terms(text: Column, terms: Iterable[str]) -> Column:
    """The terms that occur in the text as whole words, sorted by their folded form."""
    ordered = sorted(set(terms), key=fold_literal)
    folded = fold(F.coalesce(text, F.lit("")))
    hits = [
        F.when(folded.rlike(rf"(?U)(?<!\w){re.escape(fold_literal(term))}(?!\w)"), F.lit(term))
        for term in ordered
    ]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def any_term(text: Column, terms: Iterable[str], folded: bool = False) -> Column:
    """Does any of the terms occur as a whole word? One pattern, one pass over the text."""
    pattern = "|".join(re.escape(fold_literal(t)) for t in sorted(set(terms)))
    plain = F.coalesce(text, F.lit(""))
    return (plain if folded else fold(plain)).rlike(rf"(?U)(?<!\w)(?:{pattern})(?!\w)")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Plain substring test on lower-cased text, not whole words."""
    pattern = "|".join(re.escape(word) for word in words)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(pattern)


def blob(*parts: Column) -> Column:
    """Space-joined lower-case text of several columns."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def passage(text: Column) -> Column:
    return F.left(text, F.lit(200))
