"""Aggregates of the controls. Every one has a map-side partial form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.money import CENTS, first_digit
from tallymark.operators import filters
from tallymark.operators.ordering import top_n, value_places, with_places


def cents_sum(value: Column) -> Column:
    return F.sum(value).cast(CENTS)


def round_posting_total(ledger: DataFrame, minimum: Decimal, multiple: Decimal) -> DataFrame:
    hit = filters.round_number(F.col("amount"), F.lit(minimum), F.lit(multiple))
    return ledger.where(hit).agg(
        F.count(F.lit(1)).alias("postings"),
        F.coalesce(F.sum(F.abs("amount")), F.lit(0)).cast(CENTS).alias("exposure"),
    )


def duplicate_references(ledger: DataFrame, minimum_count: int = 2, limit: int | None = None) -> DataFrame:
    """Same document and signed amount booked repeatedly; the excess bookings are the exposure.

    All groups unless a report asks for the first ``limit`` of them.
    """
    groups = (
        ledger.where(F.trim("document_no") != "")
        .groupBy(F.trim("document_no").alias("document_no"), "amount")
        .agg(F.count(F.lit(1)).alias("postings"))
        .where(F.col("postings") >= minimum_count)
        .withColumn("exposure", ((F.col("postings") - 1) * F.abs("amount")).cast(CENTS))
    )
    return groups if limit is None else top_n(groups, [F.desc("exposure"), "document_no", "amount"], limit)


def vendor_exposure(postings: DataFrame) -> DataFrame:
    """Total charged per account; accounts without a charge have 0.00."""
    charge = F.when(filters.invoice_leg(F.col("posting_text"), F.col("amount")), -F.col("amount"))
    return postings.groupBy("account").agg(
        F.coalesce(F.sum(charge), F.lit(0)).cast(CENTS).alias("exposure"),
        F.count(charge).alias("charges"),
    )


def split_groups(payments: DataFrame, keys: Sequence[str], threshold: Decimal, minimum_count: int = 2) -> DataFrame:
    """Payments under the limit one by one that reach it together."""
    grouped = payments.where("amount > 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("payments"), cents_sum(F.col("amount")).alias("total"),
        F.min("amount").alias("smallest"), F.max("amount").alias("largest"),
    )
    return grouped.where(filters.qualifies_as_split(
        F.col("payments"), F.col("smallest"), F.col("largest"), F.col("total"), F.lit(threshold), minimum_count))


def adjusted_total(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw and reversal-adjusted totals; ``cancelled`` marks rows a reversal took out."""
    return rows.groupBy(*keys).agg(
        cents_sum(F.col("amount")).alias("raw_total"),
        F.coalesce(F.sum(F.when(~F.col("cancelled"), F.col("amount"))), F.lit(0)).cast(CENTS).alias("adjusted_total"),
    )


def vendor_net_total(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account").agg(
        F.count(F.lit(1)).alias("postings"), F.coalesce(F.sum("amount"), F.lit(0)).cast(CENTS).alias("net_total"))


def reconcile_legs(ledger: DataFrame) -> DataFrame:
    """Negative legs are invoices, positive legs are payments."""
    amount = F.col("amount")
    return ledger.groupBy("account").agg(
        F.sum(F.when(amount < 0, -amount).otherwise(0)).cast(CENTS).alias("invoices_total"),
        F.sum(F.when(amount > 0, amount).otherwise(0)).cast(CENTS).alias("payments_total"),
    ).withColumn("unreconciled", (F.col("invoices_total") - F.col("payments_total")).cast(CENTS))


def benford_histogram(ledger: DataFrame) -> DataFrame:
    """Nine rows: observed count, observed share and expected share of each first digit."""
    spark = ledger.sparkSession
    expected = spark.createDataFrame(list(V.BENFORD.items()), "digit int, expected decimal(18,6)")
    counted = ledger.groupBy(first_digit(F.col("amount")).alias("digit")).agg(F.count(F.lit(1)).alias("n")).where("digit is not null")
    whole = Window.partitionBy(F.lit(0))  # nine rows
    rows = F.broadcast(expected).join(counted, "digit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("population", F.sum("n").over(whole))
    share = F.bround(F.try_divide(F.col("n").cast("decimal(18,0)"), F.col("population").cast("decimal(18,0)")), 6)
    return rows.withColumn("observed", share.cast("decimal(18,6)")).withColumn(
        "deviation", F.abs(F.col("observed") - F.col("expected")).cast("decimal(18,6)"))


def benford_deviations(ledger: DataFrame, minimum_sample: int = 200, maximum: Decimal = Decimal("0.05")) -> DataFrame:
    """Digits beyond the allowed deviation, worst first; none below the minimum sample."""
    flagged = benford_histogram(ledger).where((F.col("population") >= minimum_sample) & (F.col("deviation") > F.lit(maximum)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("deviation"), "digit")  # at most nine rows
    return flagged.withColumn("worst_rank", F.row_number().over(order))


def severity_score(signals: Mapping[str, Column], weights: Mapping[str, Decimal]) -> Column:
    score = F.lit(Decimal("0")).cast(CENTS)
    for name, fired in signals.items():
        score = score + F.when(fired, F.lit(weights[name])).otherwise(F.lit(Decimal("0")))
    return score.cast(CENTS)


def total(df: DataFrame, value: str = "amount") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value), F.lit(0)).cast(CENTS).alias("total"))


def prior_activity(history: DataFrame) -> DataFrame:
    """Supplied-but-zero differs from not supplied, so the record count is kept."""
    return history.groupBy("vendor_id").agg(
        F.coalesce(F.sum("activity_count"), F.lit(0)).cast("long").alias("prior_count"),
        F.count(F.lit(1)).alias("history_records"))


def all_distinct(value: Column) -> Column:
    """Every row has a value and no value repeats."""
    return (F.count(value) == F.count(F.lit(1))) & (F.count_distinct(value) == F.count(F.lit(1)))


def all_one_value(value: Column) -> Column:
    """Every row has the same value. min = max replaces a distinct count."""
    return (F.count(value) == F.count(F.lit(1))) & (F.min(value) == F.max(value))


def more_than_one(value: Column) -> Column:
    return F.coalesce(F.min(value) != F.max(value), F.lit(False))


def merged_ids(ids: Column) -> Column:
    """Union of id arrays without repeats, in stable order. For groups with bounded membership."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids))))


def expression_text(amount: Column, order: Column) -> Column:
    """Operands joined with ' + ' in order, '0' when there are none. For one case's own rows."""
    operands = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), amount.cast("string").alias("a")))), lambda s: s["a"])
    return F.when(F.size(operands) == 0, F.lit("0")).otherwise(F.array_join(operands, " + "))


def entity_catalog(views: Sequence[tuple[DataFrame, str, str]], longest_user: int | None = None) -> DataFrame:
    """Distinct entity ids; each view is (table, column, kind). Longer user ids go only if a limit is given."""
    parts = [
        df.select(F.lit(kind).alias("kind"), F.trim(F.col(column).cast("string")).alias("entity_id"))
        for df, column, kind in views
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    usable = F.col("entity_id") != ""
    if longest_user is not None:
        usable = usable & ((F.col("kind") != "user") | (F.length("entity_id") <= longest_user))
    return whole.where(usable).distinct()


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table, one aggregate job for all of them."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
        for name, df in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def verdict_counts(cases: DataFrame) -> DataFrame:
    """One row with a tally per verdict."""
    return cases.agg(*[
        F.count(F.when(F.col("verdict") == v, F.lit(1))).alias(v.lower()) for v in V.VERDICTS
    ])


def compile_status(sources: DataFrame) -> DataFrame:
    """Row totals and the roll-up: success, partial when some source failed, else failed."""
    failed, fine = F.sum(F.col("errors").cast("long")), F.count(F.when(F.col("status") == "success", F.lit(1)))
    return sources.agg(
        F.sum("source_rows").cast("long").alias("source_rows"), F.sum("parsed_rows").cast("long").alias("parsed_rows"),
        F.when(F.coalesce(failed, F.lit(0)) == 0, "success").when(fine > 0, "partial").otherwise("failed").alias("status"))


def peer_comparison(exposures: DataFrame, id_column: str = "account", value: str = "exposure") -> DataFrame:
    """Rank of every subject by exposure and the exact median of its peers' positive exposures.

    The median of all others only ever needs the few middle values of the sorted population, so
    those are looked up once by position and each row picks from them. Only distinct exposures are
    ordered; all rows of one exposure share its place.
    """
    places = value_places(exposures, value)
    n = places.where(F.col("value") > 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # places count from the largest; the k-th smallest positive value sits at n - 1 - k
    middle = sorted({i for i in ((n - 1) // 2 - 1, (n - 1) // 2, (n - 1) // 2 + 1, n // 2 - 1, n // 2) if 0 <= i < n})
    last = F.lit(n - 1) - F.col("before")
    holds = [(last >= k) & (last - F.col("n") < k) for k in middle]
    looked_up = places.where(reduce(or_, holds)).select(last.alias("last"), "n", "value").collect() if middle else []  # at most five rows
    at = {k: r["value"] for k in middle for r in looked_up if r["last"] - r["n"] < k <= r["last"]}
    placed, position = with_places(exposures, value, places), last

    def median_without(own: int | None) -> Decimal:
        size = n if own is None else n - 1
        if size <= 0:
            return Decimal("0.00")
        original = lambda i: i if own is None or i < own else i + 1
        if size % 2 == 1:
            return at[original(size // 2)]
        return (at[original(size // 2 - 1)] + at[original(size // 2)]) / 2

    # Away from the middle the answer is the same for every position on one side.
    shape = "decimal(20,3)"
    median = F.lit(median_without(n - 1 if n else None)).cast(shape)
    for m in reversed(middle):
        median = F.when(position <= m, F.lit(median_without(m)).cast(shape)).otherwise(median)
    charged = F.col(value) > 0
    return placed.select(
        id_column, value, F.when(charged, F.lit(n - 1)).otherwise(F.lit(n)).cast("long").alias("peer_count"),
        F.when(charged, median).otherwise(F.lit(median_without(None)).cast(shape)).alias("peer_median_exposure"), (F.col("before") + 1).cast("long").alias("rank"))
