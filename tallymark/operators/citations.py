"""Evidence ids cited in free text: keep the known ones, replace the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = "ev_[0-9a-f]{16}"
MARKER = "[unverified evidence id removed]"


def redact_citations(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per text (text_id, text): the cleaned text, and how many distinct cited ids were kept or removed."""
    found = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), 0))).alias("evidence_id"))
    known = evidence.select("evidence_id").distinct().withColumn("known", F.lit(True))
    judged = found.join(known, "evidence_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # One text's own distinct citations, so the list is bounded by the text itself.
    per_text = judged.groupBy("text_id").agg(
        F.collect_list(F.when(~F.col("known"), F.col("evidence_id"))).alias("bad"),
        F.count(F.when(F.col("known"), F.lit(1))).alias("allowed"), F.count(F.when(~F.col("known"), F.lit(1))).alias("rejected"))
    joined = texts.join(per_text, "text_id", "left")
    clean = F.aggregate(F.array_sort(F.coalesce("bad", F.array().cast("array<string>"))), F.col("text"),
                        lambda text, bad: F.replace(text, bad, F.lit(MARKER)))
    return joined.select("text_id", clean.alias("clean"), F.coalesce("allowed", F.lit(0)).cast("long").alias("allowed"),
                         F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def split_citations(df: DataFrame, cited: str, allowed: str) -> DataFrame:
    """Distinct cited ids split into allowed and rejected ones."""
    distinct = F.array_distinct(F.col(cited))
    return df.withColumns({
        "kept": F.array_intersect(distinct, F.col(allowed)), "removed": F.array_except(distinct, F.col(allowed))})
