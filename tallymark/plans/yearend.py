"""Year-end cut-off over typed records: single-use receipts, closing records and adjustments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.money import CENTS
from tallymark.functions.text import normalize_identifier
from tallymark.operators import checks, filters
from tallymark.operators.allocation import single_use_picks, whole_takes
from tallymark.operators.bands import near_pairs
from tallymark.operators.ordering import first_per_key, global_position
from tallymark.plans.base import outcome_counter, parameter_map, review_reasons
from tallymark.session import materialize

HIERARCHY = ("invoice_id", "document_id", "receipt_id", "vendor_amount")
IDS = ("invoice_id", "vendor_id", "document_id", "receipt_id")


@dataclass(frozen=True)
class CutoffParameters:
    fiscal_period_start: date
    fiscal_period_end: date
    amount_tolerance: Decimal = Decimal("0.00")
    matching_hierarchy: tuple[str, ...] = HIERARCHY

    def __post_init__(self) -> None:
        if self.fiscal_period_start > self.fiscal_period_end:
            raise ValueError("fiscal period start must not follow its end")
        if self.amount_tolerance < 0 or not self.amount_tolerance.is_finite():
            raise ValueError("amount_tolerance must be finite and non-negative")
        fields = self.matching_hierarchy
        if not fields or len(set(fields)) != len(fields) or not set(fields) <= set(HIERARCHY):
            raise ValueError("matching hierarchy must contain unique known fields")


def ranked_links(invoices: DataFrame, candidates: DataFrame, hierarchy: Sequence[str], tolerance: Decimal) -> DataFrame:
    """(consumer, seq, resource, rank): the first field of the hierarchy on which a pair agrees.

    One equi join per field; the amount band joins on vendor and amount bucket.
    """
    parts = []
    for rank, name in enumerate(hierarchy):
        if name != "vendor_amount":
            if name not in candidates.columns or name not in invoices.columns:
                continue
            left = invoices.where(F.col(name).isNotNull()).select("consumer", "seq", name)
            parts.append(left.join(candidates.where(F.col(name).isNotNull()).select("resource", name), name).select(
                "consumer", "seq", "resource", F.lit(rank).alias("rank")))
        elif {"vendor_id", "net_amount"} <= set(candidates.columns):
            near = near_pairs(invoices, candidates, tolerance)
            parts.append(near.select("consumer", "seq", "resource", F.lit(rank).alias("rank")))
    if not parts:
        return invoices.select("consumer", "seq").join(candidates.select("resource"), F.lit(False)).withColumn("rank", F.lit(0))
    return reduce(DataFrame.unionByName, parts).groupBy("consumer", "seq", "resource").agg(F.min("rank").alias("rank"))


def written(df: DataFrame) -> DataFrame:
    """The frame, written since links and facts read it again, without references that no row has: to look
    for links by those would move all rows of the other side for nothing."""
    df = materialize(df)
    names = [c for c in HIERARCHY if c in df.columns]
    filled = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if not filled[c]])


def generic_counts(invoices: DataFrame, generic: DataFrame, links: DataFrame) -> DataFrame:
    """(consumer, generic_records): generic records of the invoice's vendor, and linked ones of other vendors.

    A vendor's records are counted once and joined as a number, so no invoice is paired with each of
    its vendor's records. ``links`` holds distinct (consumer, resource) pairs that name each other.
    """
    per_vendor = materialize(generic.where("vendor_id is not null").groupBy("vendor_id").agg(F.count(F.lit(1)).alias("_own")))
    own = invoices.select("consumer", "vendor_id").join(per_vendor, "vendor_id").select("consumer", F.col("_own").alias("_n"))
    ours, theirs = invoices.select("consumer", F.col("vendor_id").alias("_ours")), generic.select("resource", F.col("vendor_id").alias("_theirs"))
    named = links.join(ours, "consumer").join(theirs, "resource").where(~F.coalesce(F.col("_ours") == F.col("_theirs"), F.lit(False)))
    return own.unionByName(named.groupBy("consumer").agg(F.count(F.lit(1)).alias("_n"))).groupBy("consumer").agg(F.sum("_n").alias("generic_records"))


def collapse_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts of one identity, day and status are one receipt, the smallest record id's.

    Receipts without receipt and invoice id share an empty identity and collapse per day and status.
    """
    identity = F.coalesce("receipt_id", "invoice_id", F.lit(""))
    rest = [c for c in receipts.columns if c not in ("occurrence_date", "status")]
    chosen = first_per_key(receipts.withColumn("_identity", identity), ["_identity", "occurrence_date", "status"], ["record_id"], rest)
    return chosen.drop("_identity")


class YearEndCutoff:
    """Tables: invoices, receipts, closing, adjustments, exceptions."""

    control_id = "year_end_cutoff_unrecorded_liability"
    version = "1.0.0"

    def evaluate(self, tables: Mapping[str, DataFrame], params: CutoffParameters, strict: bool = False) -> DataFrame:
        t = {n: df.withColumns({c: normalize_identifier(F.col(c)) for c in IDS if c in df.columns}) for n, df in tables.items()}
        if strict:
            content = ["net_amount", "vat_amount", "gross_amount", "invoice_date"]
            checks.require_none(checks.conflicting_records(t["invoices"], ["vendor_id", "invoice_id"], content), "conflicting duplicate invoice")
        start, end, tolerance = F.lit(params.fiscal_period_start), F.lit(params.fiscal_period_end), F.lit(params.amount_tolerance)
        fields = [c for c in t["invoices"].columns if c not in ("vendor_id", "invoice_id")]
        invoices = first_per_key(t["invoices"], ["vendor_id", "invoice_id"], ["record_id"], fields)
        later = invoices.where(filters.subsequent_invoice(F.col("invoice_date"), F.col("posting_date"), end))
        later = materialize(global_position(later, ["invoice_date", "vendor_id", "invoice_id", "record_id"], "seq").withColumnRenamed("record_id", "consumer"))
        resource = lambda df: df.withColumnRenamed("record_id", "resource")
        link = lambda inv, df: ranked_links(inv, df, params.matching_hierarchy, params.amount_tolerance)

        # A receipt is used up even by an invoice that then drops out for later service.
        receipts = written(resource(collapse_receipts(t["receipts"])))
        picks = single_use_picks(link(later, receipts)).select("consumer", "resource")
        received = picks.join(receipts.select("resource", "occurrence_date", F.col("status").alias("receipt_status")), "resource")
        rows = later.join(received.withColumnRenamed("resource", "receipt_record"), "consumer", "left")
        rows = materialize(rows.where(F.col("occurrence_date").isNull() | (F.col("occurrence_date") <= end)))

        excused = link(rows, resource(t["exceptions"])).groupBy("consumer").agg(F.count(F.lit(1)).alias("exceptions")) if "exceptions" in t else None
        closing = written(resource(t["closing"].dropDuplicates(["record_id"])))
        linked = materialize(link(rows, closing).join(closing.select("resource", "posting_date", F.col("net_amount").alias("covers"), "generic", "accounting_period_known"), "resource"))
        unclear = ~F.col("accounting_period_known") | F.col("posting_date").isNull()
        doubtful = linked.where(~F.col("generic") & unclear).groupBy("consumer").agg(F.count(F.lit(1)).alias("doubtful_closing"), F.min("resource").alias("doubtful_record"))
        generic_rows = closing.where("generic")
        generic = generic_counts(rows, generic_rows, link(rows, generic_rows).select("consumer", "resource").distinct())
        usable = linked.where(~F.col("generic") & ~unclear & filters.in_period(F.col("posting_date"), start, end))
        coverage = self.closing_coverage(usable.join(rows.select("consumer", "net_amount"), "consumer"), params).groupBy("consumer").agg(
            F.sum("covers").cast(CENTS).alias("covered"), F.count(F.lit(1)).alias("closing_records"))

        # Every matching adjustment is taken, so the earliest matching invoice has it.
        adjustments = written(resource(t["adjustments"].dropDuplicates(["record_id"])))
        owner = first_per_key(link(rows, adjustments), ["resource"], ["seq"], ["consumer"])
        adjusted = owner.join(adjustments.select("resource", "net_amount"), "resource").groupBy("consumer").agg(
            F.sum("net_amount").cast(CENTS).alias("adjusted"), F.count(F.lit(1)).alias("adjustment_records"))

        for part in (doubtful, generic, coverage, adjusted, *([excused] if excused is not None else [])):
            rows = rows.join(part, "consumer", "left")
        if excused is None:
            rows = rows.withColumn("exceptions", F.lit(0))
        counts = ("doubtful_closing", "generic_records", "closing_records", "adjustment_records", "exceptions", "covered", "adjusted")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        return self.judge(rows, params, start, tolerance)

    @staticmethod
    def closing_coverage(edges: DataFrame, params: CutoffParameters) -> DataFrame:
        """Closing records consumed whole: an invoice takes records in (rank, id) order while more than
        the tolerance is uncovered; a record taken by an earlier invoice is gone."""
        return whole_takes(edges.withColumnRenamed("net_amount", "need"), F.lit(params.amount_tolerance))

    def judge(self, rows: DataFrame, params: CutoffParameters, start, tolerance) -> DataFrame:  # noqa: ANN001
        c = F.col
        adjustment = F.least(c("net_amount"), c("adjusted")).cast(CENTS)
        covered = F.least(c("net_amount") - adjustment, c("covered")).cast(CENTS)
        rest = F.greatest(F.lit(0), c("net_amount") - adjustment - covered)
        exposure = F.when(rest <= tolerance, F.lit(0)).otherwise(rest).cast(CENTS)
        rows = rows.withColumns({"adjustment_net": adjustment, "closing_coverage_net": covered}).withColumn("exposure", exposure)
        refused = c("receipt_record").isNotNull() & (c("receipt_status") != "accepted")
        dismissed = refused | (c("exceptions") > 0) | (c("adjustment_net") >= c("net_amount") - tolerance) | (c("exposure") == 0)
        # The reasons for review, compared by fixtures.
        doubts = review_reasons(
            F.when(~c("accounting_period_known"), "invoice accounting period is uncertain"),
            F.when(c("receipt_record").isNull() | c("occurrence_date").isNull(), "service, delivery, or receipt date is missing"),
            F.when(c("occurrence_date") < start, "occurrence predates the configured fiscal period"),
            F.when(c("doubtful_closing") > 0, F.concat(F.lit("closing record "), c("doubtful_record"), F.lit(" has uncertain accounting period"))),
            F.when(c("generic_records") > 0, "generic accrual lacks a defensible transaction link"))
        rows = rows.withColumn("uncertainty", doubts).withColumn("cleared", F.coalesce(dismissed, F.lit(False)))
        status = F.when(F.size("uncertainty") > 0, "review_needed").when(c("cleared"), "dismissed").otherwise("confirmed_candidate")
        refuted = refused | (c("exceptions") > 0) | (c("doubtful_closing") > 0) | (c("generic_records") > 0)
        closing = F.when((c("exposure") == 0) & (c("closing_coverage_net") > 0), "accounted_for").when(c("generic_records") > 0, "unresolved").otherwise("not_found")
        found = lambda test: F.when(F.coalesce(test, F.lit(False)), "accounted_for").otherwise("not_found")
        return rows.select(
            F.lit(self.control_id).alias("control_id"), F.lit(self.version).alias("control_version"), status.alias("status"),
            "invoice_id", c("invoice_id").alias("subject"), F.create_map(F.lit("invoice_id"), c("invoice_id")).alias("group_key"),
            parameter_map(params).alias("rule_parameters"), "exposure", "closing_coverage_net", "adjustment_net",
            c("vat_amount").alias("invoice_vat_amount"), c("gross_amount").alias("invoice_gross_amount"), "receipt_record",
            F.array(
                outcome_counter("closing_liability_or_accrual", closing, F.lit("closing records linked to the transaction")),
                outcome_counter("reversal_credit_or_cancellation", found(c("adjustment_records") > 0), F.lit("linked adjustments")),
                outcome_counter("return_dispute_or_policy_exception", found(c("cleared") & refuted), F.lit("linked counter-evidence"))).alias("counter_tests"),
            "uncertainty", "evidence_id")
