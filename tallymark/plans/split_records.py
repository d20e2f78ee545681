"""Split payments over typed payment records, with reversal accounting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import normalize_identifier
from tallymark.operators import aggregates, checks, filters
from tallymark.operators.allocation import resolve_reversals
from tallymark.operators.ordering import SLICE, slice_ordered
from tallymark.plans.base import outcome_counter, parameter_map, review_reasons
from tallymark.session import materialize

GROUP = ["payee", "payment_date", "reference"]


@dataclass(frozen=True)
class SplitParameters:
    threshold: Decimal
    minimum_payment_count: int = 2

    def __post_init__(self) -> None:
        if not self.threshold.is_finite() or self.threshold <= 0:
            raise ValueError("threshold must be positive and finite")
        if self.minimum_payment_count < 2:
            raise ValueError("minimum_payment_count must be at least two")


def payment_violations() -> F.Column:  # type: ignore[name-defined]
    return checks.violations(
        ids={c: F.col(c) for c in ("payment_id", "payee", "payment_reference")}, dates={"payment_date": F.col("payment_date")},
        signed={"amount": F.col("amount")}, reversal=(F.col("reversal_of"), F.col("amount")))


class SplitPayments:
    """Table ``payments``: payment_id, payee, payment_date, payment_reference, amount, reversal_of,
    obligation_id, installment_plan_id, second_approval (boolean), evidence_id."""

    control_id = "split_payment_below_threshold"
    version = "1.0.0"
    #: Payments of a group that one task sorts for its sum expression; larger groups are sorted in slices.
    piece = 10_000

    def evaluate(self, tables: Mapping[str, DataFrame], params: SplitParameters, strict: bool = False) -> DataFrame:
        raw = tables["payments"]
        if strict:
            checks.require_none(checks.duplicate_keys(raw, ["payment_id"]), "duplicate payment_id")
            checks.require_none(checks.split_rejects(raw, payment_violations())[1], "invalid payment record")
        # Groups, members and reversals read the records several times, so they are normalised once.
        payments = materialize(raw.withColumns({
            "payee": normalize_identifier(F.col("payee")), "reference": normalize_identifier(F.col("payment_reference")),
            "obligation_id": normalize_identifier(F.col("obligation_id")),
            "installment_plan_id": normalize_identifier(F.col("installment_plan_id"))}))
        threshold = F.lit(params.threshold)
        qualifies = lambda n, lo, hi, total: filters.qualifies_as_split(
            F.col(n), F.col(lo), F.col(hi), F.col(total), threshold, params.minimum_payment_count)

        # Only members of groups that qualify on their raw payments matter from here on.
        positives = payments.where("amount > 0")
        raw_groups = positives.groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("n"), F.min("amount").alias("lo"), F.max("amount").alias("hi"),
            aggregates.cents_sum(F.col("amount")).alias("raw_total")).where(qualifies("n", "lo", "hi", "raw_total"))
        members = positives.join(raw_groups.select(*GROUP), GROUP, "left_semi")

        resolutions = resolve_reversals(payments)
        taken = resolutions.where("target_id is not null").select(F.col("target_id").alias("payment_id"), F.col("reason").alias("taken_reason"))
        open_ones = resolutions.where("target_id is null")
        marked = materialize(members.join(taken, "payment_id", "left").withColumn("cancelled", F.col("taken_reason").isNotNull()))
        alive = lambda c: F.when(~F.col("cancelled"), c)
        groups = marked.groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("payments"), aggregates.cents_sum(F.col("amount")).alias("raw_total"), F.max("amount").alias("largest"),
            F.count(alive(F.lit(1))).alias("active"), F.coalesce(F.sum(alive(F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("active_total"),
            F.min(alive(F.col("amount"))).alias("active_lo"), F.max(alive(F.col("amount"))).alias("active_hi"),
            aggregates.all_distinct(F.col("obligation_id")).alias("all_obligations"), (F.count("obligation_id") > 0).alias("any_obligation"),
            aggregates.all_one_value(F.col("installment_plan_id")).alias("one_plan"), (F.count("installment_plan_id") > 0).alias("any_plan"),
            F.coalesce(F.max(F.col("second_approval").cast("int")), F.lit(0)).alias("approved"),
            F.collect_set("taken_reason").alias("taken_reasons"),  # at most two fixed texts
            F.min("evidence_id").alias("evidence_id"))

        reasons = self.open_reasons(groups, marked, open_ones)
        rows = groups.join(reasons, GROUP, "left").withColumn("open_reasons", F.coalesce("open_reasons", F.array().cast("array<string>")))
        rows = rows.join(self.expressions(marked), GROUP, "left")

        unresolved = F.size("open_reasons") > 0
        state = lambda good, partly: F.when(good, "accounted_for").when(partly, "unresolved").otherwise("not_found")
        reversal = F.when(unresolved, "unresolved").when(F.size("taken_reasons") > 0, "accounted_for").otherwise("not_found")
        obligation, plan = state(F.col("all_obligations"), F.col("any_obligation")), state(F.col("one_plan"), F.col("any_plan"))
        approval = F.when(F.col("approved") == 1, "accounted_for").otherwise("not_found")
        rows = rows.withColumns({"reversal": reversal, "obligation": obligation, "plan": plan, "approval": approval})
        rows = rows.withColumn("uncertainty", review_reasons(
            F.when(unresolved, F.array_join(F.array_sort("open_reasons"), "; ")),
            F.when(F.col("obligation") == "unresolved", "contractual-obligation identifiers are incomplete or duplicated"),
            F.when(F.col("plan") == "unresolved", "installment-plan identifiers are incomplete or inconsistent")))
        innocent = (F.col("obligation") == "accounted_for") | (F.col("plan") == "accounted_for") | (F.col("approval") == "accounted_for")
        still = qualifies("active", "active_lo", "active_hi", "active_total")
        status = (F.when(F.size("uncertainty") > 0, "review_needed").when(innocent, "dismissed")
                  .when(F.coalesce(still, F.lit(False)), "confirmed_candidate").otherwise("dismissed"))
        told = lambda c: F.concat(F.lit("status "), F.col(c))
        calc = lambda i, label, expression, result: F.struct(
            F.lit(i).alias("sequence"), F.lit(label).alias("label"), expression.alias("expression"), result.cast("string").alias("result"))
        limit_text = F.lit(str(params.threshold))
        return rows.select(
            F.lit(self.control_id).alias("control_id"), F.lit(self.version).alias("control_version"), status.alias("status"),
            F.concat_ws("/", "payee", F.col("payment_date").cast("string"), "reference").alias("subject"),
            *GROUP, F.create_map(F.lit("payee"), F.col("payee"), F.lit("date"), F.col("payment_date").cast("string"),
                                 F.lit("payment_reference"), F.col("reference")).alias("group_key"),
            parameter_map(params).alias("rule_parameters"), F.col("active_total").alias("exposure"), "payments", "raw_total", "active",
            F.array(
                outcome_counter("reversal_search", F.col("reversal"), F.array_join(
                    F.array_sort(F.when(unresolved, F.col("open_reasons")).otherwise(F.col("taken_reasons"))), "; ")),
                outcome_counter("distinct_contractual_obligations", F.col("obligation"), told("obligation")),
                outcome_counter("valid_installment_plan", F.col("plan"), told("plan")),
                outcome_counter("second_approval", F.col("approval"), told("approval"))).alias("counter_tests"),
            "uncertainty",
            F.array(
                calc(1, "candidate aggregate", F.concat_ws(" = ", "raw_expression", F.col("raw_total").cast("string")), F.col("raw_total")),
                calc(2, "individual threshold test", F.concat(F.lit("max("), F.col("largest").cast("string"), F.lit(") < "), limit_text), F.col("largest") < threshold),
                calc(3, "reversal-adjusted aggregate", F.concat_ws(" = ", "active_expression", F.col("active_total").cast("string")), F.col("active_total")),
                calc(4, "aggregate threshold test", F.concat(F.col("active_total").cast("string"), F.lit(" >= "), limit_text), F.col("active_total") >= threshold),
            ).alias("calculation_steps"), "evidence_id")

    def open_reasons(self, groups: DataFrame, members: DataFrame, open_ones: DataFrame) -> DataFrame:
        """Reasons of unresolved reversals that touch a group: by a named member, or by payee and
        reference on or after the group's day. The reasons are a handful of fixed texts."""
        by_name = open_ones.where("reversal_of is not null").select(F.col("reversal_of").alias("payment_id"), "payee", "reason").join(
            members.select("payment_id", *GROUP), ["payment_id", "payee"]).select(*GROUP, "reason")
        latest = open_ones.groupBy("payee", "reference", "reason").agg(F.max("reversal_date").alias("last_day"))
        by_reference = groups.select(*GROUP).join(latest, ["payee", "reference"]).where("last_day >= payment_date").select(*GROUP, "reason")
        return by_name.unionByName(by_reference).groupBy(*GROUP).agg(F.collect_set("reason").alias("open_reasons"))

    def expressions(self, members: DataFrame) -> DataFrame:
        """Sum expressions in payment order, every payment written out whatever the size of its group."""
        order = ["payment_id", "amount", "cancelled"]
        rows = members.select(*GROUP, *order)
        crowded = materialize(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.piece).drop("n"))
        if crowded.isEmpty():
            placed = rows.withColumn(SLICE, F.lit(0))
        else:
            placed = rows.join(crowded, GROUP, "left_anti").withColumn(SLICE, F.lit(0)).unionByName(slice_ordered(rows.join(crowded, GROUP, "left_semi"), GROUP, order))
        written = lambda ms: F.array_join(F.transform(ms, lambda m: m["amount"].cast("string")), " + ")
        is_open = lambda m: ~m["cancelled"]
        pieces = placed.groupBy(*GROUP, SLICE).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("ms")).select(
            *GROUP, SLICE, written(F.col("ms")).alias("raw"), F.when(F.exists("ms", is_open), written(F.filter("ms", is_open))).alias("active"))
        packed = pieces.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct(SLICE, "raw", "active"))).alias("ps"))  # at most one for every slice
        return packed.select(
            *GROUP, F.array_join("ps.raw", " + ").alias("raw_expression"),
            F.when(F.exists("ps", lambda x: x["active"].isNotNull()), F.array_join("ps.active", " + ")).otherwise("0").alias("active_expression"))
