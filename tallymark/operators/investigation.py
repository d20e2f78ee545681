"""The investigation as a batch report: every hypothesis advances through its plan in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.operators.ordering import top_n


def tool_plan(spark: SparkSession) -> DataFrame:
    """(category, step, tool): the fixed plan of each category."""
    rows = [(c, i + 1, tool) for c, tools in V.CATEGORY_PLAN.items() for i, tool in enumerate(tools)]
    return spark.createDataFrame(rows, "category string, step int, tool string")


def rank_hypotheses(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """One hypothesis per category that has findings, by fixed priority."""
    pairs = [F.lit(x) for c, p in V.CATEGORY_PRIORITY.items() for x in (c, p)]
    grouped = findings.groupBy(F.col("control_id").alias("category")).agg(
        F.count(F.lit(1)).alias("findings"), F.sum("exposure").cast("decimal(18,2)").alias("exposure"))
    ranked = grouped.withColumn("priority", F.coalesce(F.create_map(*pairs)[F.col("category")], F.lit(50)))
    return ranked if limit is None else top_n(ranked, [F.desc("priority"), "category"], limit)


def timeline(hypotheses: DataFrame, results: DataFrame) -> DataFrame:
    """One row per hypothesis and step; a step whose tool gave no row is marked not ok.

    ``hypotheses``: hypothesis_id, category, subject. ``results``: tool, subject, evidence_count, result.
    """
    plan = F.broadcast(tool_plan(hypotheses.sparkSession))  # a fixed handful of rows
    steps = hypotheses.join(plan, "category")
    joined = steps.join(results, ["tool", "subject"], "left")
    return joined.select(
        "hypothesis_id", "category", "subject", "step", "tool", F.col("result").isNotNull().alias("ok"),
        F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"), "result")


def verdict_status(cases: DataFrame) -> DataFrame:
    pair = lambda i: F.create_map(*[F.lit(x) for v, s in V.VERDICT_STATUS.items() for x in (v, s[i])])
    verdict = F.coalesce("verdict", F.lit("REJECTED"))
    return cases.withColumn("status", pair(0)[verdict]).withColumn("recommendation", pair(1)[verdict])


def counter_evidence(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("tool").isin(*V.REFUTER_TOOLS))


def grounded_summary(hypotheses: DataFrame) -> DataFrame:
    """The leading hypothesis of each investigation as plain text made of its own figures.

    ``hypotheses``: investigation_id, category, status, priority, supporting, contradicting, exposure, recommendation.
    """
    from tallymark.operators.ordering import latest_per_key
    columns = ["category", "status", "supporting", "contradicting", "exposure", "recommendation"]
    leading = latest_per_key(hypotheses.withColumn("_tie", F.col("category")), ["investigation_id"], ["priority", "_tie"], ["priority", *columns])
    text = F.concat_ws(
        " ", F.format_string("The leading hypothesis (%s, status %s) has %d supporting and %d contradicting evidence items.",
                             "category", "status", "supporting", "contradicting"),
        F.when(F.col("exposure").isNotNull(), F.concat(F.lit("Candidate exposure "), F.col("exposure").cast("string"), F.lit("."))),
        F.when(F.col("recommendation") != "undecided", F.concat(F.lit("Admission recommends "), "recommendation", F.lit("."))),
    )
    return leading.withColumn("summary", text)


def investigation_list(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("hypotheses"), F.max("updated_at").alias("updated_at"))
