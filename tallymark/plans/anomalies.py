"""Generic leads over one ledger: round amounts, repeated references, first-digit deviation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.money import CENTS, first_digit
from tallymark.operators import aggregates, filters
from tallymark.operators.ordering import sample_per_key
from tallymark.plans.base import Findings, Wording, counter, finish, single_row, step, union_findings

ROUND = Wording("Unusually round, large postings", "Accuracy / existence (lead)", "low", "control",
                "Trace a sample of the postings to their documents.", "Rounding alone is no error.")
REPEATED = Wording("Document reference and amount booked repeatedly", "Existence / accuracy (lead)", "medium", "control",
                   "Reconcile the repeated postings with documents and reversals.", "A repeated reference need not be a duplicate.")
DIGITS = Wording("First digits deviate from the expected law", "Completeness / accuracy (lead)", "low", "control",
                 "Stratify by account and review the over-represented band.", "Some populations deviate legitimately.")


@dataclass(frozen=True)
class AnomalyParameters:
    round_multiple: Decimal = Decimal("1000")
    round_min_magnitude: Decimal = Decimal("1000")
    duplicate_min_count: int = 2
    benford_min_sample: int = 200
    benford_max_abs_deviation: Decimal = Decimal("0.05")
    max_findings_per_signal: int | None = None
    evidence_sample_size: int = 8  # evidence ids shown in a chain; the inputs table holds every posting

    def __post_init__(self) -> None:
        if self.round_multiple <= 0 or self.round_min_magnitude < 0:
            raise ValueError("round grid must be positive")
        if self.duplicate_min_count < 2 or self.benford_min_sample < 1:
            raise ValueError("duplicate_min_count must be at least 2 and benford_min_sample positive")
        if not 0 <= self.benford_max_abs_deviation <= 1:
            raise ValueError("benford_max_abs_deviation must lie within [0, 1]")
        if (self.max_findings_per_signal or 1) < 1 or self.evidence_sample_size < 1:
            raise ValueError("report sizes must be positive")

    @classmethod
    def from_params(cls, params: Mapping[str, object]) -> AnomalyParameters:
        """Read ``anomaly_*`` parameters; unreadable values fall back to the defaults."""
        chosen = {}
        for item in fields(cls):
            raw = params.get(f"anomaly_{item.name}")
            if raw is None:
                continue
            try:
                if item.default is None or isinstance(item.default, int):
                    chosen[item.name] = int(raw)  # type: ignore[arg-type]
                elif (number := Decimal(str(raw))).is_finite():
                    chosen[item.name] = number
            except (InvalidOperation, ValueError, TypeError):
                continue
        return cls(**chosen)


def _gate() -> Column:
    """A lead is never a verdict: this required test only a person can run."""
    return counter("auditor_substantive_procedure", "not_applicable", "a substantive procedure by the auditor is required")


class AnomalyDiscovery:
    """Table ``ledger``: amount (cents), document_no, account, evidence_id."""

    id = "anomaly_discovery"
    version = "1.0.0"

    def run(self, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> Findings:
        ledger = tables["ledger"].where("amount is not null")
        chosen = AnomalyParameters.from_params(params or {})
        return union_findings([self.round_numbers(ledger, chosen), self.duplicates(ledger, chosen), self.digits(ledger, chosen)])

    def _sample(self, rows: DataFrame, size: int) -> DataFrame:
        ids = sample_per_key(rows.withColumn("k", F.lit(1)), ["k"], ["evidence_id"], "evidence_id", size)
        return ids.agg(F.sort_array(F.collect_list("evidence_id")).alias("sample"))

    def round_numbers(self, ledger: DataFrame, p: AnomalyParameters) -> Findings:
        hits = ledger.where(filters.round_number(F.col("amount"), F.lit(p.round_min_magnitude), F.lit(p.round_multiple)))
        total = aggregates.round_posting_total(ledger, p.round_min_magnitude, p.round_multiple)
        rows = single_row(total, self._sample(hits, p.evidence_sample_size)).where("postings > 0")
        findings = finish(
            rows, self.id, self.version, ROUND, finding_id=F.lit("anomaly:round-number-postings"),
            subject=F.lit("anomaly:round-number-postings"), narrative=F.format_string("%d round postings", "postings"),
            exposure=F.col("exposure"), expression=F.lit("sum of posting magnitudes"), input_count=F.col("postings"),
            chain=F.array(step("postings on the round grid", F.col("sample"))),
            counter_tests=F.array(_gate(), counter("documented_estimate_or_contract_sum", "not_applicable", "context not evaluated", False)),
        )
        inputs = hits.select(F.lit("anomaly:round-number-postings").alias("finding_id"), F.lit("round posting").alias("label"),
                             F.abs("amount").cast(CENTS).alias("value"), "evidence_id")
        return Findings(findings, inputs)

    def duplicates(self, ledger: DataFrame, p: AnomalyParameters) -> Findings:
        groups = aggregates.duplicate_references(ledger, p.duplicate_min_count, p.max_findings_per_signal)
        groups = groups.withColumn("finding_id", F.concat_ws(
            ":", F.lit("anomaly:duplicate-reference"), "document_no", F.abs("amount").cast("string")))
        members = ledger.withColumn("document_no", F.trim("document_no")).join(
            groups.select("document_no", "amount", "finding_id"), ["document_no", "amount"])
        sample = sample_per_key(members, ["document_no", "amount"], ["evidence_id"], "evidence_id", p.evidence_sample_size)
        sample = sample.groupBy("document_no", "amount").agg(F.sort_array(F.collect_list("evidence_id")).alias("sample"))
        rows = groups.join(sample, ["document_no", "amount"])
        findings = finish(
            rows, self.id, self.version, REPEATED, finding_id=F.concat_ws("#", "finding_id", F.when(F.col("amount") < 0, F.lit("negative"))),
            subject=F.col("finding_id"), narrative=F.format_string("reference %s booked %d times", "document_no", "postings"),
            exposure=F.col("exposure"), expression=F.concat(F.lit("("), F.col("postings"), F.lit(" - 1) * "), F.abs("amount").cast("string")),
            input_count=F.col("postings"), chain=F.array(step("repeated postings", F.col("sample"))),
            counter_tests=F.array(
                _gate(), counter("distinct_underlying_transactions", "not_applicable", "documents not inspected", False),
                counter("reversal_or_correction", "not_applicable", "reversals not reconciled", False)),
        )
        inputs = members.select("finding_id", F.concat(F.lit("reference "), "document_no").alias("label"),
                                F.abs("amount").cast(CENTS).alias("value"), "evidence_id")
        return Findings(findings, inputs)

    def digits(self, ledger: DataFrame, p: AnomalyParameters) -> Findings:
        flagged = aggregates.benford_deviations(ledger, p.benford_min_sample, p.benford_max_abs_deviation)
        summary = flagged.agg(
            F.max("population").alias("population"), F.sort_array(F.collect_list("digit")).alias("digits"),
            F.min(F.struct("worst_rank", "digit", "deviation", "n")).alias("worst")).where("worst is not null")
        summary = summary.withColumn("digit", F.col("worst.digit"))
        of_digit = ledger.withColumn("digit", first_digit(F.col("amount"))).join(F.broadcast(summary.select("digit")), "digit")
        shown = sample_per_key(of_digit, ["digit"], ["evidence_id", "amount"], "evidence_id", p.evidence_sample_size)
        sample = shown.groupBy("digit").agg(F.sort_array(F.collect_list("evidence_id")).alias("sample"))
        findings = finish(
            summary.join(sample, "digit", "left"), self.id, self.version, DIGITS, finding_id=F.lit("anomaly:benford-first-digit"),
            subject=F.lit("anomaly:benford-first-digit"),
            narrative=F.concat(F.lit("digits "), F.array_join(F.col("digits").cast("array<string>"), ", "), F.lit(" deviate")),
            exposure=F.lit(0), expression=F.concat(F.lit("largest deviation "), F.col("worst.deviation").cast("string")),
            input_count=F.col("worst.n"), chain=F.array(step("amounts with the worst digit", F.coalesce("sample", F.array().cast("array<string>")))),
            counter_tests=F.array(_gate(), counter("naturally_bounded_population", "not_applicable", "population not assessed", False)),
        )
        inputs = of_digit.select(F.lit("anomaly:benford-first-digit").alias("finding_id"),
                              F.concat(F.lit("leading digit "), "digit").alias("label"), F.abs("amount").cast(CENTS).alias("value"), "evidence_id")
        return Findings(findings, inputs)
