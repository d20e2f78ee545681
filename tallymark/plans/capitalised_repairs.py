"""Repair costs booked as asset additions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.money import CENTS
from tallymark.functions.text import contains_any
from tallymark.operators import filters
from tallymark.operators.joins import co_occurrence, in_chart, with_first_description
from tallymark.operators.ordering import sample_per_key
from tallymark.plans.base import Findings, Wording, counter, finish, single_row, step
from tallymark.session import materialize

WORDS = Wording(
    title="Repairs capitalised as fixed assets", assertion="Classification / capitalisation",
    severity="high", exposure_label="net", action="Reclassify the repairs to maintenance expense.",
)


class CapitalisedRepairs:
    """Tables: ``additions`` (asset_no, amount, posting_kind, asset_group, posting_text, evidence_id),
    ``descriptions`` (asset_no, asset_desc, table_no, row_no), ``chart`` (account, account_type),
    ``texts`` (text_id, text)."""

    id = "capitalisation"
    version = "1.0.0"

    def __init__(self, repair_words: Iterable[str] = V.REPAIR_WORDS, addition_words: Iterable[str] = V.ADDITION_WORDS,
                 investment_words: Iterable[str] = V.INVESTMENT_WORDS):
        self.repair_words, self.addition_words = tuple(repair_words), tuple(addition_words)
        self.investment_words = tuple(investment_words)

    def repairs(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        described = with_first_description(tables["additions"], tables["descriptions"])
        both = F.concat_ws(" ", F.col("description"), F.coalesce("posting_text", F.lit("")))
        hits = described.where(filters.asset_addition(
            F.col("posting_kind"), F.col("amount"), both, self.repair_words, self.addition_words))
        balance = tables["chart"].where(contains_any(F.col("account_type"), V.BALANCE_SHEET_WORDS))
        return in_chart(hits, balance.select(F.col("account").alias("asset_group")), "asset_group")

    def run(self, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> Findings:
        hits = materialize(self.repairs(tables))  # read by the existence test, the sample, the totals and the inputs
        # Existence test: one matching text is enough.
        requested = not co_occurrence(
            tables["texts"].withColumn("text", F.lower("text")), "text", "text_id", self.investment_words,
            hits.select("asset_no"), "asset_no").isEmpty()
        sample = sample_per_key(hits.withColumn("one", F.lit(1)), ["one"], ["evidence_id"], "evidence_id", 8)
        steps = sample.agg(F.sort_array(F.collect_list("evidence_id")).alias("sample"))
        totals = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(CENTS).alias("total"))
        rows = single_row(totals, steps).where("n > 0")
        findings = finish(
            rows, self.id, self.version, WORDS, finding_id=F.lit(self.id), subject=F.lit("capitalised-repairs"),
            narrative=F.format_string("%d additions read like repairs", "n"), exposure=F.col("total"),
            expression=F.lit("sum of repair-like additions"), input_count=F.col("n"),
            chain=F.array(step("repair-like additions", F.col("sample"))),
            counter_tests=F.array(
                counter("investment_request", "present" if requested else "absent", "texts searched for an investment request"),
                counter("capacity_or_useful_life", "absent", "texts speak of restoration"),
                counter("separable_new_asset", "absent", "texts name existing equipment"),
            ),
        )
        inputs = hits.select(F.lit(self.id).alias("finding_id"), F.left("description", F.lit(48)).alias("label"),
                             F.col("amount").cast(CENTS).alias("value"), "evidence_id")
        return Findings(findings, inputs)
