"""Payments split under an approval limit, over a posting table."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.money import CENTS
from tallymark.functions.policy import approval_threshold
from tallymark.functions.text import contains_any
from tallymark.operators import aggregates, filters
from tallymark.plans.base import Findings, Wording, counter, finish, step

WORDS = Wording(
    title="Payments split below the approval limit", assertion="Authorisation / approval limits",
    severity="control", exposure_label="control",
    action="Check whether the payments needed a second approval.",
)


class PaymentSplit:
    """Table ``postings``: payment_reference, document_no, posting_date (as text, compared as written),
    amount, posting_kind, posting_text, evidence_id. Optional ``narratives`` state the limit."""

    id = "split_payment"
    version = "1.0.0"

    def threshold(self, tables: Mapping[str, DataFrame], params: Mapping[str, object]) -> Decimal:
        """Policy text first, then the parameter, then 10000. One row reaches the driver."""
        if "narratives" in tables:
            stated = approval_threshold(tables["narratives"]).select("threshold").collect()
            if stated:
                return stated[0][0]
        return Decimal(str(params.get("approval_threshold", "10000")))

    def run(self, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> Findings:
        limit = self.threshold(tables, params or {})
        postings = tables["postings"].withColumn(
            "reference", F.trim(F.coalesce("payment_reference", "document_no")))
        members = postings.where(filters.payment_leg(
            F.col("posting_kind"), F.col("posting_text"), F.col("amount"), F.col("reference")))
        worded = lambda words: F.max(contains_any(F.col("posting_text"), words).cast("int")) == 1
        text_known = F.count("posting_text") > 0
        grouped = members.groupBy("reference", "posting_date").agg(
            F.count(F.lit(1)).alias("payments"), aggregates.cents_sum(F.col("amount")).alias("total"),
            F.min("amount").alias("smallest"), F.max("amount").alias("largest"),
            aggregates.more_than_one(F.col("document_no")).alias("documents_differ"), text_known.alias("text_known"),
            worded(V.INSTALMENT_WORDS).alias("instalment"), worded(V.SPLIT_REVERSAL_WORDS).alias("reversal"),
            F.min("evidence_id").alias("first_evidence"),
        ).where(filters.qualifies_as_split(F.col("payments"), F.col("smallest"), F.col("largest"), F.col("total"), F.lit(limit)))
        grouped = grouped.withColumn("finding_id", F.concat_ws("|", F.lit(self.id), "reference", "posting_date"))
        outcome = lambda c: F.when(F.col(c), "present").otherwise("absent")
        searched = lambda c: F.when(~F.col("text_known"), "not_applicable").otherwise(outcome(c))
        tests = F.array(
            counter("separate_invoices", outcome("documents_differ"), "distinct documents among the payments"),
            counter("instalment_plan", searched("instalment"), "payment texts searched for instalments"),
            counter("reversal_present", searched("reversal"), "payment texts searched for reversals"),
            counter("second_approval", "absent", "no second approval on record"),
        )
        findings = finish(
            grouped, self.id, self.version, WORDS, finding_id=F.col("finding_id"), subject=F.col("reference"),
            narrative=F.format_string("%d payments on %s share a reference and stay below the limit one by one", "payments", "posting_date"),
            exposure=F.col("total"), expression=F.lit("sum of the group's payments"), input_count=F.col("payments"),
            chain=F.array(step("same-day payments share one reference", F.array("first_evidence"))), counter_tests=tests,
        )
        inputs = members.join(grouped.select("reference", "posting_date", "finding_id"), ["reference", "posting_date"]).select(
            "finding_id", F.col("document_no").alias("label"), F.col("amount").cast(CENTS).alias("value"), "evidence_id")
        return Findings(findings, inputs)
