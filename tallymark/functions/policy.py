"""Policy facts read from narrative text: approval threshold and balance-sheet date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import as_date
from .money import money
from .text import contains_any

# Phrases that announce a second approval.
SECOND_APPROVAL = ("zweite freigabe", "vier-augen", "vier augen", "second approval", "two approvers",
                   "dual approval")
# How an amount before the currency and a period end are written.
_AMOUNT_BEFORE_EURO = r"(?i)(\d[\d.\s]*\d|\d)\s*(?:EUR|€)"
_PERIOD_END = r"(?i)(?:stichtag|year[- ]?end|per)\D{0,12}(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})"


def threshold_amounts(text: Column) -> Column:
    """Positive euro amounts of a policy sentence, in reading order."""
    raw = F.regexp_extract_all(text, F.lit(_AMOUNT_BEFORE_EURO), 1)
    parsed = F.transform(raw, lambda r: money(F.replace(r, F.lit(" "), F.lit(""))))
    return F.filter(parsed, lambda a: a > 0)


def approval_threshold(texts: DataFrame, *, text: str = "text", order: tuple[str, ...] = ("table_no", "row")) -> DataFrame:
    """One row: the first stated second-approval amount in (table, row, position) order, if any."""
    hits = texts.where(contains_any(F.col(text), SECOND_APPROVAL)).select(
        *order, F.get(threshold_amounts(F.col(text)), F.lit(0)).alias("threshold"), F.col(text).alias("sentence")
    ).where(F.col("threshold").isNotNull())
    first = F.min(F.struct(*order, "threshold", "sentence")).alias("f")
    return hits.agg(first).where(F.col("f").isNotNull()).select("f.*")


def period_end_date(text: Column) -> Column:
    """Date announced as the balance-sheet date in one text, NULL when there is none."""
    raw = F.regexp_extract(text, _PERIOD_END, 1)
    return as_date(F.when(raw != "", raw))


def balance_sheet_date(texts: DataFrame, *, text: str = "text", order: tuple[str, ...] = ("table_no", "row")) -> DataFrame:
    hits = texts.select(*order, period_end_date(F.col(text)).alias("period_end"), F.col(text).alias("sentence"))
    first = F.min(F.struct(*order, "period_end", "sentence")).alias("f")
    return hits.where("period_end is not null").agg(first).where(F.col("f").isNotNull()).select("f.*")
