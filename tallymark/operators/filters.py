"""Row predicates of the controls, as column expressions over role names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.text import contains_any


def payment_leg(kind: Column, text: Column, amount: Column, reference: Column) -> Column:
    """A vendor disbursement with a reference, counted once on its debit leg."""
    everything = F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(text, F.lit("")))
    return (
        contains_any(kind, V.PAYMENT_KINDS) & ~contains_any(everything, V.NOT_PAYMENTS)
        & (amount > 0) & (F.trim(reference) != "")
    )


def vendor_creation(change_type: Column, field_changed: Column) -> Column:
    words = F.concat_ws(" ", F.coalesce(change_type, F.lit("")), F.coalesce(field_changed, F.lit("")))
    return contains_any(words, V.VENDOR_WORDS) & contains_any(words, V.CREATION_WORDS)


def carried_forward(text: Column) -> Column:
    return contains_any(text, V.CARRY_FORWARD_WORDS)


def invoice_leg(text: Column, amount: Column) -> Column:
    """Charges are negative legs that are not opening balances."""
    return ~carried_forward(text) & (amount < 0)


def asset_addition(kind: Column, amount: Column, description: Column,
                   repair_words: Iterable[str] = V.REPAIR_WORDS,
                   addition_words: Iterable[str] = V.ADDITION_WORDS) -> Column:
    return contains_any(kind, addition_words) & (amount > 0) & contains_any(description, repair_words)


def crosses_period_end(service: Column, invoice: Column, period_end: Column, amount: Column) -> Column:
    return (service <= period_end) & (invoice > period_end) & (amount != 0)


def round_number(amount: Column, minimum: Column, multiple: Column) -> Column:
    return (F.abs(amount) >= minimum) & (F.abs(amount) % multiple == 0)


def qualifies_as_split(count: Column, smallest: Column, largest: Column, total: Column,
                       threshold: Column, minimum_count: int = 2) -> Column:
    return (count >= minimum_count) & (smallest > 0) & (largest < threshold) & (total >= threshold)


def in_period(posted: Column, start: Column, end: Column) -> Column:
    return posted.between(start, end)


def subsequent_invoice(invoice: Column, posting: Column, period_end: Column) -> Column:
    return (invoice > period_end) & (F.coalesce(posting, invoice) > period_end)


def accepted(status: Column) -> Column:
    return status == "accepted"


def of_source_type(df: DataFrame, source_type: str | None, known: Sequence[str]) -> DataFrame:
    """Optional source-type filter; an unknown type is an error, not an empty result."""
    if source_type is None:
        return df
    if source_type not in known:
        raise ValueError(f"unknown source type {source_type!r}; known: {sorted(known)}")
    return df.where(F.col("source_type") == source_type)


def holds_text(value: Column, query: str) -> Column:
    return F.contains(F.lower(value), F.lit(query.lower()))


def has_verdict(df: DataFrame, verdict: str | None) -> DataFrame:
    return df if verdict is None else df.where(F.col("verdict") == verdict)


def covers_columns(columns: Column, required: Sequence[str]) -> Column:
    """Table-catalog filter: the table has every required header."""
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), columns)) == 0


def within_days(later: Column, earlier: Column, limit: int) -> Column:
    """Both ends included; a negative gap never fires."""
    return F.datediff(later, earlier).between(0, limit)
