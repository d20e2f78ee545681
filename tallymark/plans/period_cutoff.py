"""Prior-period service invoiced in the next period."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.dates import as_date
from tallymark.functions.money import CENTS
from tallymark.functions.policy import balance_sheet_date
from tallymark.operators import filters
from tallymark.operators.ordering import sample_per_key
from tallymark.plans.base import Findings, Wording, counter, finish, single_row, step

WORDS = Wording(
    title="Prior-period costs booked in the next period", assertion="Cut-off / completeness of liabilities",
    severity="high", exposure_label="net", action="Reconcile each invoice with the record control.",
    uncertainty="Accruals are not cleared here, so each hit needs review.",
)


class PeriodCutoff:
    """Table ``lines``: service_date, invoice_date, amount, document_no, evidence_id, unioned over every
    table that has all three roles in different columns. Optional ``narratives`` state the year end."""

    id = "cutoff"
    version = "1.0.0"

    def period_end(self, tables: Mapping[str, DataFrame], params: Mapping[str, object]) -> date | None:
        configured = params.get("fiscal_year_end")
        if isinstance(configured, date):
            return configured
        if isinstance(configured, str):
            spark = next(iter(tables.values())).sparkSession
            parsed = spark.range(1).select(as_date(F.lit(configured))).first()[0]
            if parsed is not None:
                return parsed
        if "narratives" in tables:
            stated = balance_sheet_date(tables["narratives"]).select("period_end").collect()
            if stated:
                return stated[0][0]
        return None

    def lines(self, tables: Mapping[str, DataFrame], params: Mapping[str, object]) -> DataFrame:
        end = self.period_end(tables, params)
        rows = tables["lines"]
        if end is None:
            return rows.where(F.lit(False))
        return rows.where(filters.crosses_period_end(F.col("service_date"), F.col("invoice_date"), F.lit(end), F.col("amount")))

    def run(self, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> Findings:
        hits = self.lines(tables, params or {})
        sample = sample_per_key(hits.withColumn("one", F.lit(1)), ["one"], ["document_no", "evidence_id"], "evidence_id", 8)
        steps = sample.agg(F.sort_array(F.collect_list("evidence_id")).alias("sample"))
        totals = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(CENTS).alias("total"))
        rows = single_row(totals, steps).where("n > 0")
        findings = finish(
            rows, self.id, self.version, WORDS, finding_id=F.lit(self.id), subject=F.lit("cutoff-subsequent-invoices"),
            narrative=F.format_string("%d later invoices relate to prior-period service", "n"), exposure=F.col("total"),
            expression=F.lit("sum of the invoices"), input_count=F.col("n"),
            chain=F.array(step("later invoice for prior-period service", F.col("sample"))),
            counter_tests=F.array(counter("strong_record_reconciliation", "absent", "reconcile at transaction level")),
        )
        inputs = hits.select(F.lit(self.id).alias("finding_id"), F.col("document_no").cast("string").alias("label"),
                             F.col("amount").cast(CENTS).alias("value"), "evidence_id")
        return Findings(findings, inputs)
