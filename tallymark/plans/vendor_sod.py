"""Vendor segregation of duties over master-change, posting, receipt and permission tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.money import CENTS
from tallymark.operators import filters
from tallymark.plans.base import Findings, Wording, counter, finish, step

WORDS = Wording(
    title="Vendor set up and paid without segregation of duties",
    assertion="Occurrence / segregation of duties", severity="high", exposure_label="gross",
    action="Obtain the contract, an independent approval and delivery evidence.",
    uncertainty="Services need no goods receipt, so a missing receipt alone proves nothing.",
)


class VendorSegregation:
    """Tables: ``masters`` (change_type, field_changed, account, changed_by, approved_by, evidence_id),
    ``postings`` (account, amount, posting_text, evidence_id), ``receipts`` (vendor, goods_receipt_no,
    evidence_id) and ``toxic_users`` (user_id)."""

    id = "vendor_sod"
    version = "1.0.0"

    def creations(self, masters: DataFrame) -> DataFrame:
        return masters.where(filters.vendor_creation(F.col("change_type"), F.col("field_changed")))

    def charges(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """(account, label, value, evidence_id): the inputs that all findings of one created vendor share, once each."""
        accounts = self.creations(tables["masters"]).select("account").distinct()
        return tables["postings"].where(filters.invoice_leg(F.col("posting_text"), F.col("amount"))).join(accounts, "account", "left_semi").select(
            "account", F.left("posting_text", F.lit(40)).alias("label"), (-F.col("amount")).cast(CENTS).alias("value"), "evidence_id")

    def run(self, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> Findings:
        created = self.creations(tables["masters"])
        accounts = created.select("account").distinct()
        # Only postings of created vendors take part; the semi join comes before the shuffle.
        postings = tables["postings"].join(accounts, "account", "left_semi")
        charge = filters.invoice_leg(F.col("posting_text"), F.col("amount"))
        opening = filters.carried_forward(F.col("posting_text"))
        totals = postings.groupBy("account").agg(
            F.coalesce(F.sum(F.when(charge, -F.col("amount"))), F.lit(0)).cast(CENTS).alias("exposure"),
            F.count(F.when(charge, F.lit(1))).alias("charges"),
            F.min(F.when(charge, F.col("evidence_id"))).alias("first_charge"),
            F.min(F.when(opening, F.col("evidence_id"))).alias("first_opening"),
        )
        receipts = tables["receipts"].withColumnRenamed("vendor", "account").join(accounts, "account", "left_semi").groupBy("account").agg(
            F.count(F.lit(1)).alias("receipt_count"), F.min("evidence_id").alias("first_receipt"))
        toxic = tables["toxic_users"].select(F.col("user_id").alias("changed_by"), F.lit(True).alias("toxic"))
        rows = (
            created.join(totals, "account", "left").join(receipts, "account", "left").join(toxic, "changed_by", "left")
            .withColumn("four_eyes", ~F.col("changed_by").eqNullSafe(F.col("approved_by")))
        )
        one = lambda c: F.array_compact(F.array(F.col(c)))
        outcome = lambda fired: F.when(fired, "present").otherwise("absent")
        four_eyes, receipt, opening_seen = F.col("four_eyes"), F.col("receipt_count") > 0, F.col("first_opening").isNotNull()
        chain = F.array_compact(F.array(
            step(F.when(four_eyes, F.format_string("vendor created by %s and approved by %s", "changed_by", "approved_by"))
                 .otherwise(F.format_string("vendor created and approved by %s", "changed_by")), one("evidence_id")),
            F.when(F.col("toxic"), step(F.format_string("%s may create vendors, post and pay", "changed_by"), one("evidence_id"))),
            F.when(F.col("charges") > 0, step("charges booked against the vendor", one("first_charge"))),
        ))
        tests = F.array(
            counter("independent_approval", outcome(four_eyes), "creator and approver compared", True, one("evidence_id")),
            counter("goods_receipt", outcome(F.coalesce(receipt, F.lit(False))), "goods-receipt lists searched", True, one("first_receipt")),
            counter("prior_year_history", outcome(opening_seen), "opening balances searched", True, one("first_opening")),
        )
        findings = finish(
            rows, self.id, self.version, WORDS, finding_id=F.col("evidence_id"), subject=F.col("account"),
            narrative=F.when(four_eyes, "New vendor with a second approver.").otherwise("New vendor approved by its creator."),
            exposure=F.coalesce("exposure", F.lit(0)), expression=F.lit("sum of charge magnitudes, opening balances excluded"),
            input_count=F.coalesce("charges", F.lit(0)), chain=chain, counter_tests=tests,
        )
        inputs = created.select(F.col("evidence_id").alias("finding_id"), "account").join(self.charges(tables), "account")
        return Findings(findings, inputs.select("finding_id", "label", "value", "evidence_id"))
