"""Case records, bundles, lookups, decisions and the case board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.identity import case_id, deterministic_json
from tallymark.operators.ordering import latest_per_key


def case_records(admitted: DataFrame, engagement_id: str, run_id: str) -> DataFrame:
    """One case row per admitted finding; lists inside are sorted so the row is order-independent."""
    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    by_step = lambda a, b: F.when(a["step"] < b["step"], -1).when(a["step"] > b["step"], 1).otherwise(0)
    return admitted.select(
        case_id(F.lit(engagement_id), F.lit(run_id), F.col("control_id"), F.col("subject")).alias("case_id"),
        F.lit(engagement_id).alias("engagement_id"), F.lit(run_id).alias("run_id"), "finding_id", "title", "control_id",
        "control_version", "subject", "verdict", F.col("reason_text").alias("verdict_reason"), "reasons", "severity",
        "assertion", "narrative",
        F.struct(F.col("exposure").cast("string").alias("amount"), F.lit("EUR").alias("currency"),
                 F.col("exposure_label").alias("label")).alias("financial_exposure"),
        F.array_sort("chain", by_step).alias("evidence_chain"),
        F.struct("expression", F.col("result").cast("string").alias("result"), "input_count").alias("calculation"),
        F.array_sort("counter_tests", by_name).alias("counter_tests"), "uncertainty", "recommended_action", "exposure",
    )


def bundle_json(cases: DataFrame) -> DataFrame:
    """One JSON text per case; calculation inputs are published beside it as their own rows."""
    names = ("case_id", "engagement_id", "run_id", "title", "control_id", "control_version", "subject", "verdict",
             "verdict_reason", "severity", "assertion", "narrative", "financial_exposure", "evidence_chain",
             "calculation", "counter_tests", "uncertainty", "recommended_action")
    return cases.select("case_id", deterministic_json(**{n: F.col(n) for n in names}).alias("case_json"))


def write_bundle(cases: DataFrame, inputs: DataFrame, path: str) -> None:
    bundle_json(cases).select(F.col("case_json").alias("value")).write.mode("overwrite").text(f"{path}/cases")
    inputs.write.mode("overwrite").json(f"{path}/calculation_inputs")


def evidence_pool(cases: DataFrame, inputs: DataFrame) -> DataFrame:
    """Evidence of a case from its chain, its counter-tests and its calculation inputs.

    ``inputs`` has a row per finding and evidence (finding_id, evidence_id), or per subject (subject,
    evidence_id) where all findings of a subject share theirs; then no row is repeated for every finding.
    """
    key = "finding_id" if "finding_id" in inputs.columns else "subject"
    chain = cases.select("case_id", F.explode(F.flatten("evidence_chain.evidence_ids")).alias("evidence_id"))
    tests = cases.select("case_id", F.explode(F.flatten("counter_tests.evidence_ids")).alias("evidence_id"))
    cited = inputs.join(cases.select(key, "case_id").distinct(), key).select("case_id", "evidence_id")
    return chain.unionByName(tests).unionByName(cited).distinct()


def citing_findings(cases: DataFrame, inputs: DataFrame) -> DataFrame:
    """(finding_id, subject) of findings with an input in their case's pool; ``inputs`` per subject, see ``evidence_pool``."""
    owners = cases.select("case_id", "subject").distinct()
    cited = inputs.join(owners, "subject").join(evidence_pool(cases, inputs), ["case_id", "evidence_id"], "left_semi").select("case_id").distinct()
    return cases.select("finding_id", "case_id", "subject").join(cited, "case_id", "left_semi").select("finding_id", "subject").distinct()


def with_decision(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach the latest reviewer decision, if any."""
    latest = latest_per_key(decisions, ["case_id"], ["decided_at", "decision"], ["decision", "decided_at"])
    return cases.join(latest, "case_id", "left")


def board(cases: DataFrame) -> DataFrame:
    """Cases per verdict in board order."""
    place = F.array_position(F.array(*[F.lit(v) for v in V.VERDICTS]), F.col("verdict"))
    return cases.groupBy("verdict").agg(F.count(F.lit(1)).alias("cases")).withColumn("place", place).orderBy("place")


def engagement_counts(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """One summary row: verdict tallies beside source totals."""
    tallies = cases.agg(F.count(F.lit(1)).alias("cases"), *[
        F.count(F.when(F.col("verdict") == v, F.lit(1))).alias(v.lower()) for v in V.VERDICTS])
    totals = sources.agg(F.count(F.lit(1)).alias("source_files"), F.sum("rows").cast("long").alias("events"))
    both = tallies.unionByName(totals, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
