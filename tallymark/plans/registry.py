"""The ordered control library and the engine that unions its findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.plans.anomalies import AnomalyDiscovery
from tallymark.plans.base import DossierControl, Findings, union_findings
from tallymark.plans.capitalised_repairs import CapitalisedRepairs
from tallymark.plans.payment_split import PaymentSplit
from tallymark.plans.period_cutoff import PeriodCutoff
from tallymark.plans.vendor_sod import VendorSegregation


def default_controls() -> list[DossierControl]:
    return [VendorSegregation(), PaymentSplit(), CapitalisedRepairs(), PeriodCutoff(), AnomalyDiscovery()]


def run_controls(tables: Mapping[str, Mapping[str, DataFrame]], params: Mapping[str, object],
                 controls: Sequence[DossierControl] | None = None) -> Findings:
    """Run every control that has its tables; keys of ``tables`` are control ids."""
    chosen = [c for c in (controls or default_controls()) if c.id in tables]
    return union_findings([c.run(tables[c.id], params) for c in chosen])


def in_run_order(findings: DataFrame) -> DataFrame:
    """Stable order: the library's order, then the finding's own content."""
    rank = F.array_position(F.array(*[F.lit(c) for c in V.CONTROL_ORDER]), F.col("control_id"))
    return findings.withColumn("run_order", F.when(rank > 0, rank).otherwise(len(V.CONTROL_ORDER) + 1).cast("long")).orderBy("run_order", "subject", "title", "finding_id")
