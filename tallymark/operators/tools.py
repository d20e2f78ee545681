"""Forensic queries. Each answers for every subject in one job; a filter on the result narrows it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.identity import registry_id
from tallymark.functions.money import money, quantize_cents
from tallymark.functions.text import contains_any
from tallymark.operators import aggregates, filters
from tallymark.operators.joins import co_occurrence, receipts_per_vendor
from tallymark.operators.ordering import top_n


def unpivot_cells(df: DataFrame, source: str, row: str, columns: Sequence[str]) -> DataFrame:
    """Long cells: (source_path, row, column_no, column, value, evidence_id)."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("column_no"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(columns)])
    long = df.select(F.lit(source).alias("source_path"), F.col(row).cast("long").alias("row"), F.explode(parts).alias("c"))
    cells = long.select("source_path", "row", "c.*").where("value is not null")
    return cells.withColumn("evidence_id", registry_id(F.col("source_path"), F.col("value"), row=F.col("row")))


def search_evidence(cells: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """All hits with their whole values; with a limit the first ones in (source, row, column) order,
    and whether more exist."""
    if limit is None:
        return cells.where(filters.holds_text(F.col("value"), query)).withColumn("truncated", F.lit(False))
    hits = top_n(cells.where(filters.holds_text(F.col("value"), query)), ["source_path", "row", "column_no"], limit + 1)
    numbered = hits.withColumn("truncated", F.lit(False))
    from pyspark.sql import Window
    order = Window.partitionBy(F.lit(0)).orderBy("source_path", "row", "column_no")  # at most limit + 1 rows
    counted = numbered.withColumn("_n", F.row_number().over(order)).withColumn(
        "truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit)
    return counted.where(F.col("_n") <= limit).drop("_n")


def vendor_history(ledger: DataFrame) -> DataFrame:
    return aggregates.vendor_net_total(ledger)


def vendor_postings(ledger: DataFrame, vendor: str | int) -> DataFrame:
    """The postings of one vendor; the filter reaches the scan."""
    return ledger.where(F.col("account") == F.lit(vendor))


def creation_and_approval(findings: DataFrame) -> DataFrame:
    """Vendors created, and whether their creator approved them."""
    test = F.filter("counter_tests", lambda t: t["name"] == "independent_approval")[0]
    return findings.select(
        F.col("subject").alias("vendor_id"), (test["outcome"] == "absent").alias("self_approved"),
        (test["outcome"] == "present").alias("independent_approval"), "exposure", "finding_id")


def user_permissions(users: DataFrame, toxic: DataFrame, user: str = "user_id") -> DataFrame:
    return users.join(toxic.select(user, F.lit(True).alias("toxic_combination")), user, "left").withColumn(
        "toxic_combination", F.coalesce("toxic_combination", F.lit(False)))


def receipt_matches(vendors: DataFrame, receipts: DataFrame, vendor: str = "vendor") -> DataFrame:
    matched = receipts_per_vendor(vendors, receipts, vendor)
    return matched.select(vendor, (F.col("receipt_count") > 0).alias("matched"), F.col("receipt_count").alias("match_count"))


def receipt_total(receipts: DataFrame, cite: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one-row count, the cited rows: all, or the first ``cite`` of them)."""
    usable = receipts.where(F.coalesce(F.trim(F.col("vendor").cast("string")), F.lit("")) != "")
    cited = usable if cite is None else top_n(usable, ["goods_receipt_no"], cite)
    return usable.agg(F.count(F.lit(1)).alias("match_count")), cited


def payment_clusters_total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("exposure"), F.lit(0)).cast("decimal(18,2)").alias("total"))


def search_posting_text(postings: DataFrame, words: Iterable[str], reference: str | None = None) -> DataFrame:
    hits = postings.where(contains_any(F.col("posting_text"), words))
    if reference is None:
        return hits
    low = F.contains(F.lower("posting_text"), F.lit(reference.lower()))
    return hits.where((F.col("document_no") == reference) | (F.col("payment_reference") == reference) | low)


def find_reversals(postings: DataFrame, reference: str | None = None) -> DataFrame:
    return search_posting_text(postings, V.REVERSAL_WORDS, reference)


def find_credit_notes(postings: DataFrame, reference: str | None = None) -> DataFrame:
    return search_posting_text(postings, V.CREDIT_NOTE_WORDS, reference)


def contract_or_service_evidence(vendors: DataFrame, receipts: DataFrame, texts: DataFrame,
                                 words: Iterable[str] = V.CONTRACT_WORDS) -> DataFrame:
    """Receipts of each vendor and texts that name the vendor beside a contract word."""
    folded = texts.withColumn("text", F.lower("text"))
    low = vendors.withColumn("_low", F.lower(F.col("vendor").cast("string")))
    mentions = co_occurrence(folded, "text", "text_id", words, low, "_low").groupBy("_low").agg(
        F.count(F.lit(1)).alias("contract_mentions"))
    joined = receipts_per_vendor(low, receipts).join(mentions, "_low", "left").drop("_low", "first_receipts")
    joined = joined.withColumn("contract_mentions", F.coalesce("contract_mentions", F.lit(0)))
    return joined.withColumn("found", (F.col("receipt_count") > 0) | (F.col("contract_mentions") > 0))


def citations(rows: DataFrame, subject: str, evidence: str = "evidence_id") -> DataFrame:
    """(subject, evidence_id): every row that an answer about a subject rests on, each once."""
    return rows.where(F.col(evidence).isNotNull()).select(F.col(subject).alias("subject"), F.col(evidence).alias("evidence_id")).distinct()


def leg_citations(ledger: DataFrame) -> DataFrame:
    """Rows behind the reconciled legs: (subject, leg, evidence_id)."""
    legs = ledger.where("amount <> 0").withColumn("leg", F.when(F.col("amount") < 0, "invoice").otherwise("payment"))
    return legs.select(F.col("account").alias("subject"), "leg", "evidence_id").distinct()


def receipt_citations(vendors: DataFrame, receipts: DataFrame, vendor: str = "vendor") -> DataFrame:
    return citations(receipts.join(vendors.select(vendor).distinct(), vendor, "left_semi"), vendor)


def permission_citations(rights: DataFrame, user: str, row: str, source: str) -> DataFrame:
    """Rows of the rights table that speak of each user."""
    return citations(rights.withColumn("evidence_id", registry_id(F.lit(source), F.col(user), row=F.col(row))), user)


def peer_citations(postings: DataFrame) -> DataFrame:
    """Charged postings behind each account's exposure."""
    return citations(postings.where(filters.invoice_leg(F.col("posting_text"), F.col("amount"))), "account")


def contract_citations(vendors: DataFrame, receipts: DataFrame, texts: DataFrame, words: Iterable[str] = V.CONTRACT_WORDS) -> DataFrame:
    """Receipts of each vendor, and texts that name the vendor beside a contract word: (subject, kind, evidence_id)."""
    folded = texts.withColumn("text", F.lower("text"))
    low = vendors.select("vendor", F.lower(F.col("vendor").cast("string")).alias("_low")).distinct()
    named = co_occurrence(folded, "text", "text_id", words, low, "_low").join(low, "_low")
    found = named.select(F.col("vendor").alias("subject"), F.lit("text").alias("kind"), F.col("text_id").cast("string").alias("evidence_id")).distinct()
    return receipt_citations(vendors, receipts).select("subject", F.lit("receipt").alias("kind"), "evidence_id").unionByName(found)


def compare_peers(postings: DataFrame) -> DataFrame:
    return aggregates.peer_comparison(aggregates.vendor_exposure(postings))


def trace_amounts(cells: DataFrame, amounts: Iterable[Decimal]) -> DataFrame:
    """Amount cells that read as one of the targets, after rounding to cents."""
    value = quantize_cents(money(F.col("value")))
    wanted = [F.lit(a).cast("decimal(18,2)") for a in amounts]
    return cells.withColumn("amount", value).where(F.col("amount").isin(*wanted))


def submit_to_admission(admitted: DataFrame, subject: Column | None = None, category: str | None = None) -> DataFrame:
    rows = admitted if category is None else admitted.where(F.col("control_id") == category)
    return rows if subject is None else rows.where(F.col("subject") == subject)


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    return aggregates.table_summary(tables)
