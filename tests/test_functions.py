import uuid
from datetime import date
from decimal import Decimal
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallymark.functions import dates, identity, money, roles, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "locale", "want"), [
    ("1.234,50 EUR", "de", "1234.50"), ("(1,234.50)", "en", "-1234.50"), ("12,50", "de", "12.50"), ("12.34,50", "de", None), ("1.234", "de", "1234"),
    ("1,234", "de", "1.234"), ("€ 1'000,5", "de", "1000.5"), ("", "de", None), ("abc", "de", None), ("5,", "de", None), (",50", "de", "0.50"), ("1e3", "de", "1000"),
    ("--5", "de", None), ("(-5)", "de", "5"), ("1,2,3", "de", None), ("1.234,567.8", "de", None), ("+7", "en", "7"), ("１２", "de", "12"), ("NaN", "en", None)])
def test_parse_decimal(spark, raw, locale, want):
    got = value(spark, money.parse_decimal(F.lit(raw), locale))
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("raw", "want"), [("1,234", "1.234"), ("1.234", "1234"), ("12.50", "12.50"), ("x", None)])
def test_money_reads_german_first(spark, raw, want):
    assert value(spark, money.money(F.lit(raw))) == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("raw", "locale", "want"), [
    ("18.07.2026", "de", date(2026, 7, 18)), ("07/18/2026", "en", date(2026, 7, 18)), ("2026-07-18", "de", date(2026, 7, 18)), ("18/07/2026", "en", None),
    ("18.07.85", "de", date(1985, 7, 18)), ("1.2.68", "de", date(2068, 2, 1)), ("1.2.69", "de", date(1969, 2, 1)), ("31.02.2026", "de", None), (" 2026-7-8 ", "en", date(2026, 7, 8))])
def test_parse_date(spark, raw, locale, want):
    assert value(spark, dates.parse_date(F.lit(raw), locale)) == want


def test_identifiers(spark):
    assert value(spark, text.normalize_identifier(F.lit("  ab- 42 "))) == "AB- 42"
    assert value(spark, text.normalize_identifier(F.lit(" ﬁrma　ＡＢ "))) == "FIRMA AB"
    assert value(spark, text.normalize_identifier(F.lit("   "))) is None
    assert value(spark, text.normalize_identifier(F.lit("ab  c"), uppercase=False)) == "ab c"


def test_whole_words_next_to_umlauts(spark):
    terms = ("überholung", "wartung", "ersatz")
    assert value(spark, text.matching_terms(F.lit("Überholung und WARTUNG"), terms)) == ["wartung", "überholung"]
    assert value(spark, text.matching_terms(F.lit("Generalüberholung, Ersatzteil"), terms)) == []


def test_ids_equal_their_definitions(spark):
    raw = "Änderung"
    digest = sha256(raw.encode()).hexdigest()
    name = f"evidence/a.csv|2|||7||{digest}"
    got = value(spark, identity.evidence_uuid(F.lit("a.csv"), F.lit(raw), row=F.lit(2), page=F.lit(7)))
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    short = "ev_" + sha256(f"a.csv|r2|sNone|cNone|pNone|{raw}".encode()).hexdigest()[:16]
    assert value(spark, identity.registry_id(F.lit("a.csv"), F.lit(raw), row=F.lit(2))) == short
    letters = [r["v"] for r in spark.range(1, 16385).select(identity.column_letter(F.col("id")).alias("v")).collect()]
    assert (letters[0], letters[25], letters[26], letters[701], letters[702], letters[-1]) == ("A", "Z", "AA", "ZZ", "AAA", "XFD")


def test_half_even_quantization(spark):
    assert value(spark, money.quantize_cents(F.lit("2.345").cast("decimal(10,3)"))) == Decimal("2.34")
    assert value(spark, money.to_cents(F.lit("2.345").cast("decimal(10,3)"))) == Decimal("2.35")


def test_roles_resolve_in_table_order():
    columns = ["Beleg-Nr.", "BELEGNUMMER", "Buchungsbetrag", "Geaendert_Von"]
    assert roles.resolve_column(columns, "document_no") == "BELEGNUMMER"
    assert roles.resolve_column(columns, "changed_by") == "Geaendert_Von"
    assert roles.resolve_column(["geändert_von"], "changed_by") is None
    assert roles.resolve_column(["paragraph"], "paragraph") == "paragraph"
    assert len(roles.SYNONYMS) == 24
