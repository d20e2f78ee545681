"""Content-addressed identifiers, hashes, coordinates and deterministic JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import passage as cut_passage

# The name scheme is a parameter: pass the prefix of an existing evidence store to keep its ids.
EVIDENCE_PREFIX = "evidence/"
CASE_PREFIX = "case"


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Version-5 UUID as a native expression."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def raw_hash(raw: Column) -> Column:
    return F.sha2(raw.cast("string"), 256)


def _text(value: Column | None) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) if value is not None else F.lit("")


def evidence_uuid(
    source_path: Column, raw: Column, *, row: Column | None = None, sheet: Column | None = None,
    cell: Column | None = None, page: Column | None = None, passage: Column | None = None,
    prefix: str = EVIDENCE_PREFIX,
) -> Column:
    """UUID over the source coordinate and the hash of the raw value; absent parts are empty."""
    locator = F.concat_ws("|", *[_text(p) for p in (source_path, row, sheet, cell, page, passage)])
    return uuid5(uuid.NAMESPACE_URL, F.concat(F.lit(prefix), locator, F.lit("|"), raw_hash(_text(raw))))


def registry_id(
    source_path: Column, raw: Column, *, row: Column | None = None, sheet: Column | None = None,
    cell: Column | None = None, page: Column | None = None,
) -> Column:
    """Short citable id; absent coordinates print as None."""
    def part(tag: str, value: Column | None) -> Column:
        shown = F.coalesce(value.cast("string"), F.lit("None")) if value is not None else F.lit("None")
        return F.concat(F.lit(f"|{tag}"), shown)

    locator = F.concat(
        source_path, part("r", row), part("s", sheet), part("c", cell), part("p", page),
        F.lit("|"), _text(raw),
    )
    return F.concat(F.lit("ev_"), F.left(F.sha2(locator, 256), F.lit(16)))


def case_id(engagement: Column, run: Column, control: Column, subject: Column,
            prefix: str = CASE_PREFIX) -> Column:
    namespace = uuid.uuid5(uuid.NAMESPACE_URL, prefix)
    return uuid5(namespace, F.concat_ws(":", engagement, run, control, subject))


def column_letter(one_based: Column) -> Column:
    """Bijective base 26 for the 16 384 columns a sheet can have."""
    n = one_based.cast("int")
    first, second, third = n - 1, F.floor((n - 27) / 26).cast("int"), F.floor((n - 703) / 676).cast("int")
    letter = lambda i: F.char(F.lit(65) + F.pmod(i, F.lit(26)))
    return (
        F.when(n <= 26, letter(first))
        .when(n <= 702, F.concat(letter(second), letter(first)))
        .otherwise(F.concat(letter(third), letter(second), letter(first)))
    )


def cell_coordinate(one_based_column: Column, row: Column) -> Column:
    return F.concat(column_letter(one_based_column), row.cast("string"))


def human_source(
    path: Column, *, sheet: Column, row: Column, cell: Column, page: Column, passage: Column
) -> Column:
    """Readable pointer; absent parts are skipped."""
    def shown(label: str, value: Column, quote: str = "") -> Column:
        text = value.cast("string")
        return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(f"{label} {quote}"), text, F.lit(quote)))

    return F.concat_ws(
        " · ", F.coalesce(path, F.lit("(unknown source)")), shown("sheet", sheet, "'"), shown("row", row),
        shown("cell", cell), shown("page", page), shown("passage", passage),
    )


def deterministic_json(**fields: Column) -> Column:
    """JSON with sorted keys, no spaces and nulls kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def evidence_columns(source: Column, row: Column, raw: Column) -> Column:
    """The evidence struct of one row-addressed value."""
    return F.struct(
        registry_id(source, raw, row=row).alias("evidence_id"), source.alias("source_path"),
        row.cast("long").alias("row"), raw.cast("string").alias("raw_value"), raw_hash(raw).alias("raw_value_sha256"),
    )


__all__ = [
    "uuid5", "raw_hash", "evidence_uuid", "registry_id", "case_id", "column_letter", "cell_coordinate",
    "human_source", "deterministic_json", "evidence_columns", "cut_passage",
]
