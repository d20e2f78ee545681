"""Vendor integrity over typed records: twelve signals, eight counter-tests, one outcome per vendor."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.money import CENTS
from tallymark.functions.text import normalize_identifier
from tallymark.operators import aggregates, checks, joins
from tallymark.operators.ordering import first_per_key
from tallymark.plans.base import outcome_counter, parameter_map, review_reasons
from tallymark.session import materialize

SUPPORT_KINDS = ("contract", "deliverable", "service_acceptance", "goods_receipt", "legitimate_four_eyes")


@dataclass(frozen=True)
class VendorParameters:
    analysis_date: date
    new_vendor_window_days: int = 365
    rapid_first_invoice_days: int = 7
    rapid_first_payment_days: int = 14
    rapid_invoice_payment_days: int = 3
    review_score_threshold: Decimal = Decimal("1")
    weight: Mapping[str, Decimal] = field(default_factory=lambda: {s: Decimal("1") for s in V.VENDOR_SIGNALS})

    def __post_init__(self) -> None:
        if min(self.new_vendor_window_days, self.rapid_first_invoice_days, self.rapid_first_payment_days, self.rapid_invoice_payment_days) < 0:
            raise ValueError("day windows must not be negative")
        if set(self.weight) != set(V.VENDOR_SIGNALS):
            raise ValueError("every signal needs exactly one weight")


class VendorIntegrity:
    """Tables: lifecycle, permissions, invoices, payments, approvals, history, support.

    Each fact table is reduced to one row per vendor, or per vendor and user, before anything is
    joined, so a vendor with a large share of all rows is combined on the map side.
    """

    control_id = "vendor_integrity_and_segregation_of_duties"
    version = "1.0.0"

    def evaluate(self, tables: Mapping[str, DataFrame], params: VendorParameters, strict: bool = False) -> DataFrame:
        t = {name: df.dropDuplicates().withColumn("vendor_id", normalize_identifier(F.col("vendor_id")))
             for name, df in tables.items() if name != "permissions"}
        if strict:
            for name, df in tables.items():
                checks.require_none(checks.duplicate_keys(df.dropDuplicates(), ["record_id"]), f"conflicting record_id in {name}")
            for name, key in (("invoices", "invoice_id"), ("payments", "payment_id")):
                keyed = t[name].select(normalize_identifier(F.col(key)).alias(key))
                checks.require_none(checks.duplicate_keys(keyed, [key]), f"duplicate {key}")
        ident = lambda df, *cols: df.withColumns({c: normalize_identifier(F.col(c)) for c in cols})
        lifecycle = ident(t["lifecycle"], "user_id")
        # The two large tables feed several aggregates each; deduplicate and normalise them once.
        invoices = materialize(ident(t["invoices"], "invoice_id", "posting_user_id"))
        payments = materialize(ident(t["payments"], "payment_id", "invoice_id", "execution_user_id", "reversal_of"))
        approvals = ident(t["approvals"], "approver_user_id")

        creation = first_per_key(lifecycle.where("kind = 'created'"), ["vendor_id"], ["event_date", "record_id"], ["event_date", "user_id", "evidence_id"])
        creation = materialize(creation.select("vendor_id", F.col("event_date").alias("created_on"), F.col("user_id").alias("creator"), F.col("evidence_id").alias("creation_evidence")))

        # Reversals: the first one naming a payment takes it back.
        as_pay = payments.select("payment_id", F.col("vendor_id").alias("payee"), "payment_date", F.col("gross_amount").alias("amount"), "reversal_of")
        resolved = joins.explicit_reversals(as_pay)
        cancelled = resolved.select(F.col("target_id").alias("payment_id"), F.lit(True).alias("cancelled"))
        settled = resolved.select(F.col("reversal_id").alias("payment_id"), F.lit(True).alias("settles"))
        flagged = materialize(payments.join(cancelled, "payment_id", "left").join(settled, "payment_id", "left"))
        open_reversal = (F.col("gross_amount") < 0) & F.col("settles").isNull()
        active_row = (F.col("gross_amount") > 0) & F.col("cancelled").isNull()
        active = flagged.where(active_row)

        # One row per vendor from every input; the outer joins below make up the set of all vendors.
        by_vendor: list[DataFrame] = [lifecycle.groupBy("vendor_id").agg(F.count(F.when(F.col("kind") == "approved", F.lit(1))).alias("approval_events"))]
        derived: list[DataFrame] = [creation]
        by_vendor.append(invoices.groupBy("vendor_id").agg(
            F.count(F.lit(1)).alias("invoice_count"), F.sum("net_amount").cast(CENTS).alias("invoice_net_amount"), F.sum("tax_amount").cast(CENTS).alias("invoice_tax_amount"),
            F.min("posting_date").alias("first_invoice"), *[F.max((F.col("purchase_kind") == k).cast("int")).alias(f"buys_{k}") for k in ("service", "goods", "unknown")],
            F.min("evidence_id").alias("invoice_evidence")))
        by_vendor.append(flagged.groupBy("vendor_id").agg(
            F.coalesce(F.sum(F.when(active_row, F.col("gross_amount"))), F.lit(0)).cast(CENTS).alias("gross_cash_paid"),
            F.min(F.when(active_row, F.col("payment_date"))).alias("first_payment"), F.count(F.when(open_reversal, F.lit(1))).alias("open_reversals"),
            F.count(F.when(F.col("cancelled"), F.lit(1))).alias("resolved_reversals"), F.min("evidence_id").alias("payment_evidence")))
        quick = joins.quickly_paid(active, invoices.select("vendor_id", "invoice_id", "posting_date"), params.rapid_invoice_payment_days)
        derived.append(quick.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("quick_pairs")))

        posting_users = invoices.select("vendor_id", F.col("posting_user_id").alias("user_id")).distinct()
        paying_users = active.select("vendor_id", F.col("execution_user_id").alias("user_id")).distinct()
        derived.append(self.user_flags(creation, lifecycle, approvals, posting_users, paying_users))
        derived.append(self.permission_conflicts(creation, tables["permissions"], posting_users, paying_users))
        by_vendor.append(approvals.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("log_records"), F.min("evidence_id").alias("approval_evidence")))
        by_vendor.append(aggregates.prior_activity(t["history"]))
        kind_is = lambda k: F.col("kind") == k
        by_vendor.append(t["support"].groupBy("vendor_id").agg(
            *[F.count(F.when(kind_is(k), F.lit(1))).alias(f"n_{k}") for k in SUPPORT_KINDS],
            *[F.max(F.when(kind_is(k), F.col("present").cast("int"))).alias(f"has_{k}") for k in SUPPORT_KINDS]))

        wide = reduce(lambda left, right: left.join(right, "vendor_id", "full_outer"), by_vendor)
        wide = reduce(lambda left, right: left.join(right, "vendor_id", "left"), derived, wide)
        counts = ("invoice_count", "open_reversals", "resolved_reversals", "quick_pairs", "log_records", "approval_events", "history_records", "prior_count",
                  "gross_cash_paid", "buys_service", "buys_goods", "buys_unknown", "conflicting_users", *[f"n_{k}" for k in SUPPORT_KINDS], *[f"has_{k}" for k in SUPPORT_KINDS])
        flags = ("creator_approves", "independent", "creator_posts", "creator_pays")
        wide = wide.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, **{c: F.coalesce(c, F.lit(False)) for c in flags}})
        return self.judge(wide, params)

    @staticmethod
    def user_flags(creation: DataFrame, lifecycle: DataFrame, approvals: DataFrame, posting: DataFrame, paying: DataFrame) -> DataFrame:
        """How the creator compares with the users who approved, posted and paid."""
        approvers = lifecycle.where("kind = 'approved'").select("vendor_id", "user_id").unionByName(
            approvals.select("vendor_id", F.col("approver_user_id").alias("user_id"))).distinct()
        role = lambda df, name: df.withColumn("role", F.lit(name))
        users = role(approvers, "approve").unionByName(role(posting, "post")).unionByName(role(paying, "pay"))
        same = F.col("user_id") == F.col("creator")
        did = lambda name, test: F.max(((F.col("role") == name) & test).cast("int")) == 1
        return users.join(creation.select("vendor_id", "creator"), "vendor_id").groupBy("vendor_id").agg(
            did("approve", same).alias("creator_approves"), did("approve", ~same).alias("independent"),
            did("post", same).alias("creator_posts"), did("pay", same).alias("creator_pays"))

    @staticmethod
    def permission_conflicts(creation: DataFrame, permissions: DataFrame, posting: DataFrame, paying: DataFrame) -> DataFrame:
        involved = creation.select("vendor_id", F.col("creator").alias("user_id")).unionByName(posting).unionByName(paying).distinct()
        return involved.join(joins.conflicting_users(permissions), "user_id", "left_semi").groupBy("vendor_id").agg(
            F.count(F.lit(1)).alias("conflicting_users"))

    def judge(self, wide: DataFrame, params: VendorParameters) -> DataFrame:
        c = F.col
        known = c("created_on").isNotNull()
        age = F.datediff(F.lit(params.analysis_date), c("created_on"))
        gap = lambda later: F.datediff(c(later), c("created_on"))
        support = {k: F.when(c(f"has_{k}") == 1, "accounted_for").when(c(f"n_{k}") > 0, "not_found").otherwise("unresolved") for k in SUPPORT_KINDS}
        ok = lambda k: c(f"has_{k}") == 1
        service_ok, goods_ok = ok("deliverable") | ok("service_acceptance"), ok("goods_receipt")
        service, goods, unknown = c("buys_service") == 1, c("buys_goods") == 1, c("buys_unknown") == 1
        missing_performance = (service & ~service_ok) | (goods & ~goods_ok) | (unknown & ~(service_ok | goods_ok))
        between = lambda value, limit: F.coalesce(value.between(0, limit), F.lit(False))
        fired: dict[str, Column] = {
            "missing_vendor_creation_event": ~known,
            "new_vendor": known & between(age, params.new_vendor_window_days),
            "creator_equals_approver": known & c("creator_approves"),
            "create_and_pay_permission": known & (c("conflicting_users") > 0),
            "same_user_creates_posts_pays": known & c("creator_posts") & c("creator_pays"),
            "rapid_first_invoice": known & between(gap("first_invoice"), params.rapid_first_invoice_days),
            "rapid_first_payment": known & between(gap("first_payment"), params.rapid_first_payment_days),
            "invoice_paid_unusually_quickly": known & (c("quick_pairs") > 0),
            "missing_independent_approval": known & ~c("independent"),
            "missing_approval_log": known & (c("log_records") == 0),
            "no_prior_vendor_history": known & (c("history_records") > 0) & (c("prior_count") == 0),
            "missing_service_or_delivery_evidence": known & (c("invoice_count") > 0) & missing_performance,
        }
        independent_test = F.when(~known, "unresolved").when(c("independent"), "accounted_for").when(
            (c("approval_events") > 0) | (c("log_records") > 0), "not_found").otherwise("unresolved")
        four_eyes_test = F.when(~known, "unresolved").when(c("independent") & (c("log_records") > 0), "accounted_for").otherwise(support["legitimate_four_eyes"])
        prior_test = F.when(c("prior_count") > 0, "accounted_for").when(c("history_records") > 0, "not_found").otherwise("unresolved")
        reversal_test = F.when(c("open_reversals") > 0, "unresolved").when(c("resolved_reversals") > 0, "accounted_for").otherwise("not_found")
        tests = {
            "independent_approval": independent_test, "contract": support["contract"], "deliverables": support["deliverable"],
            "service_acceptance": support["service_acceptance"], "prior_activity": prior_test, "goods_receipt": support["goods_receipt"],
            "reversal": reversal_test, "legitimate_four_eyes_setup": four_eyes_test,
        }
        rows = wide.withColumns({f"t_{n}": s for n, s in tests.items()}).withColumn(
            "signals", F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in sorted(fired.items())])))
        rows = rows.where(F.size("signals") > 0).withColumn("severity_score", aggregates.severity_score(fired, params.weight))
        is_open = lambda n: c(f"t_{n}") == "unresolved"
        core = F.arrays_overlap(c("signals"), F.array(*[F.lit(s) for s in V.CORE_CONFLICTS]))
        legitimate = (
            (c("t_independent_approval") == "accounted_for") & (c("t_legitimate_four_eyes_setup") == "accounted_for")
            & (~service | service_ok) & (~goods | goods_ok) & (~unknown | service_ok | goods_ok))
        only_missing = (F.size("signals") == 1) & (c("signals")[0] == "missing_service_or_delivery_evidence")
        # The reasons for review, compared by fixtures.
        doubts = review_reasons(
            F.when(is_open("reversal"), "one or more reversal records could not be matched deterministically"),
            F.when(is_open("prior_activity"), "no prior-history evidence was supplied"),
            F.when(is_open("independent_approval"), "no approval evidence was supplied"),
            F.when(is_open("legitimate_four_eyes_setup"), "no legitimate_four_eyes evidence or documented search was supplied"),
            F.when(service & is_open("contract"), "no contract evidence or documented search was supplied"),
            F.when(service & ~service_ok & is_open("deliverables") & is_open("service_acceptance"), "no service deliverable or acceptance evidence/search was supplied"),
            F.when(goods & is_open("goods_receipt"), "no goods_receipt evidence or documented search was supplied"),
            F.when(unknown & ~(service_ok | goods_ok), "purchase type is unknown and no performance or delivery evidence was supplied"),
            F.when(legitimate & core, "legitimate approval or delivery evidence mitigates but does not resolve direct segregation-of-duties conflicts"),
            F.when(only_missing, "missing service or delivery evidence alone is not proof of misconduct"))
        no_creator = F.array(F.lit("vendor creation evidence is missing; creator and approval segregation cannot be assessed"))
        rows = rows.withColumn("uncertainty", F.when(~known, no_creator).otherwise(doubts))
        status = (
            F.when(~known, "review_needed").when(legitimate & ~core, "dismissed").when(F.size("uncertainty") > 0, "review_needed")
            .when(c("severity_score") < F.lit(params.review_score_threshold), "dismissed").otherwise("confirmed_candidate"))
        return rows.select(
            F.lit(self.control_id).alias("control_id"), F.lit(self.version).alias("control_version"), status.alias("status"),
            "vendor_id", c("vendor_id").alias("subject"), F.create_map(F.lit("vendor_id"), c("vendor_id")).alias("group_key"),
            parameter_map(params).alias("rule_parameters"), c("gross_cash_paid").cast(CENTS).alias("exposure"), "severity_score", "signals",
            F.array(*[outcome_counter(n, c(f"t_{n}"), F.concat(F.lit(f"{n} "), c(f"t_{n}"))) for n in tests]).alias("counter_tests"),
            "uncertainty", c("gross_cash_paid").cast(CENTS).alias("gross_cash_paid"), "invoice_net_amount", "invoice_tax_amount",
            F.coalesce("creation_evidence", "payment_evidence", "invoice_evidence", "approval_evidence").alias("evidence_id"))
