"""Row checks, key checks and reconciliations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RejectedRecords(ValueError):
    """Raised in strict mode when input rows break a rule."""


def violations(
    *, ids: Mapping[str, Column] | None = None, dates: Mapping[str, Column] | None = None,
    money: Mapping[str, Column] | None = None, signed: Mapping[str, Column] | None = None,
    reversal: tuple[Column, Column] | None = None, evidence: Column | None = None,
) -> Column:
    """Array of the rules a row breaks; empty when it is sound."""
    rules = []
    for name, value in (ids or {}).items():
        rules.append(F.when(F.coalesce(F.trim(value.cast("string")), F.lit("")) == "", F.lit(f"{name} is required")))
    for name, value in (dates or {}).items():
        rules.append(F.when(value.isNull(), F.lit(f"{name} must be a date")))
    for name, value in (money or {}).items():
        rules.append(F.when(value.isNull() | (value < 0), F.lit(f"{name} must be finite and non-negative")))
    for name, value in (signed or {}).items():
        rules.append(F.when(value.isNull(), F.lit(f"{name} must be finite")))
    if reversal is not None:
        target, amount = reversal
        rules.append(F.when(target.isNotNull() & (amount >= 0), F.lit("an explicit reversal must have a negative amount")))
    if evidence is not None:
        rules.append(F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, F.lit("each record requires evidence")))
    return F.array_compact(F.array(*rules))


def split_rejects(df: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejected rows with the rules they break)."""
    marked = df.withColumn("violations", broken)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def conflicting_records(df: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys that occur with more than one content."""
    fingerprint = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    # min <> max is the two-value test without the memory of a distinct count.
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(fingerprint).alias("_a"), F.max(fingerprint).alias("_b"))
        .where("_a <> _b").drop("_a", "_b")
    )


def require_none(df: DataFrame, message: str) -> None:
    """Strict mode: fail before evaluation when any offending row exists; looks at one row only."""
    offender = df.limit(1).collect()
    if offender:
        raise RejectedRecords(f"{message}: {offender[0].asDict()}")


def reconcile_counts(expected: DataFrame, found: DataFrame, key: str = "source_path") -> DataFrame:
    """Expected row counts against the rows found, per source, including sources on one side only."""
    actual = found.groupBy(key).agg(F.count(F.lit(1)).alias("parsed_rows"))
    both = expected.select(key, F.col("source_rows")).join(actual, key, "full_outer")
    return both.select(
        key, F.coalesce("source_rows", F.lit(0)).cast("long").alias("source_rows"),
        F.coalesce("parsed_rows", F.lit(0)).cast("long").alias("parsed_rows"),
    ).withColumn("reconciled", F.col("source_rows") == F.col("parsed_rows"))


def unsafe_path(path: Column) -> Column:
    return path.rlike(r"^[/\\]") | path.rlike(r"(^|/)\.\.(/|$)")


def tampered(raw: Column, stored_hash: Column) -> Column:
    return F.sha2(raw.cast("string"), 256) != stored_hash


def unknown_citations(cited: DataFrame, evidence: DataFrame, owner: str, ids: str = "evidence_ids") -> DataFrame:
    """One row per cited id that no evidence row carries."""
    single = cited.select(owner, F.explode(F.array_distinct(F.col(ids))).alias("evidence_id"))
    return single.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").select(owner, "evidence_id")


def same_id_set(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def unsupported_inputs(inputs: DataFrame, pool: DataFrame, owner: str) -> DataFrame:
    """Calculation inputs whose evidence is not in their own case's pool."""
    return inputs.join(pool.select(owner, "evidence_id").distinct(), [owner, "evidence_id"], "left_anti")
