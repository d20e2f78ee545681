"""Joins between role tables. Equi joins throughout; Catalyst and AQE choose how."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import contains_any, normalize_identifier
from tallymark.operators.ordering import first_per_key, sample_per_key


def receipts_per_vendor(vendors: DataFrame, receipts: DataFrame, vendor: str = "vendor", sample: int = 3) -> DataFrame:
    """Goods-receipt count of every vendor and its first few receipt references."""
    counts = receipts.groupBy(vendor).agg(F.count(F.lit(1)).alias("receipt_count"))
    firsts = sample_per_key(receipts, [vendor], ["goods_receipt_no"], "goods_receipt_no", sample).groupBy(vendor).agg(
        F.array_sort(F.collect_list("goods_receipt_no")).alias("first_receipts"))  # at most `sample` each
    return (
        vendors.join(counts, vendor, "left").join(firsts, vendor, "left")
        .withColumn("receipt_count", F.coalesce("receipt_count", F.lit(0)))
    )


def with_first_description(additions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Description of the first master row per asset, else the posting text."""
    first = first_per_key(descriptions, ["asset_no"], ["table_no", "row_no"], ["asset_desc"])
    return additions.join(first, "asset_no", "left").withColumn(
        "description", F.coalesce("asset_desc", F.coalesce("posting_text", F.lit("")))).drop("asset_desc")


def in_chart(rows: DataFrame, chart: DataFrame, column: str = "account") -> DataFrame:
    """Keep rows whose account is in the chart; an empty chart keeps everything."""
    if chart.isEmpty():
        return rows
    return rows.join(chart.select(column).distinct(), column, "left_semi")


def toxic_rights(columns: Sequence[str], create: Iterable[str], post: Iterable[str], pay: Iterable[str]) -> dict[str, str] | None:
    """Which columns of a permission table grant create, post and pay; a column serves one right."""
    wanted = {"create": tuple(create), "post": tuple(post), "pay": tuple(pay)}
    found: dict[str, str] = {}
    for column in columns:
        for right, words in wanted.items():
            if right not in found and any(w in column.lower() for w in words):
                found[right] = column
                break
    return found if len(found) == len(wanted) else None


def users_with_all_rights(permissions: DataFrame, user: str, rights: dict[str, str]) -> DataFrame:
    """Users with one permission row on which all three rights are filled."""
    filled = None
    for column in rights.values():
        term = F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))) != ""
        filled = term if filled is None else filled & term
    return permissions.where(filled).select(F.col(user).alias("user_id")).distinct()


def conflicting_users(permissions: DataFrame) -> DataFrame:
    """Users who actively hold both the create-vendor and the execute-payment right."""
    held = permissions.where("active").groupBy(normalize_identifier(F.col("user_id")).alias("user_id"))
    return held.agg(
        F.max((F.col("permission") == "create_vendor").cast("int")).alias("_create"),
        F.max((F.col("permission") == "execute_payment").cast("int")).alias("_pay"),
    ).where("_create = 1 and _pay = 1").select("user_id")


def quickly_paid(payments: DataFrame, invoices: DataFrame, limit: int) -> DataFrame:
    """Payments executed within the window after their own invoice of the same vendor."""
    right = invoices.select("vendor_id", "invoice_id", "posting_date")
    pairs = payments.where("invoice_id is not null").join(right, ["vendor_id", "invoice_id"])
    return pairs.withColumn("days", F.datediff("payment_date", "posting_date")).where(F.col("days").between(0, limit))


def explicit_reversals(payments: DataFrame) -> DataFrame:
    """(reversal_id, target_id): the first reversal in (date, id) order takes its named payment.

    The named payment must be positive, of equal size, of the same payee and not dated later.
    """
    reversal = payments.where("amount < 0 and reversal_of is not null").select(
        F.col("payment_id").alias("reversal_id"), F.col("reversal_of").alias("target_id"),
        F.col("payee"), (-F.col("amount")).alias("size"), F.col("payment_date").alias("reversal_date"))
    target = payments.where("amount > 0").select(
        F.col("payment_id").alias("target_id"), F.col("payee"), F.col("amount").alias("size"), "payment_date")
    pairs = reversal.join(target, ["target_id", "payee", "size"]).where("payment_date <= reversal_date")
    return first_per_key(pairs, ["target_id"], ["reversal_date", "reversal_id"], ["reversal_id", "reversal_date"])


def substring_pairs(texts: DataFrame, text: str, text_id: str, subjects: DataFrame, subject: str) -> DataFrame:
    """Exact pairs (text id, subject) where the subject occurs anywhere in the text.

    A substring test is no equi join, so it is turned into one over the texts' space-separated
    tokens. A subject with an inner word is looked up by it: that word has a space on both sides, so
    it must be a whole token. Any other subject is looked up by its longest part, which must lie
    inside one token; those parts are matched once against the distinct tokens of all texts, by the
    tokens' own substrings of the parts' lengths. Subjects that hold a space are verified at the end.
    """
    keyed = subjects.select(F.col(subject).alias("_subject")).where(F.length(subject) > 0).distinct()
    keyed = keyed.withColumn("_word", _longest_inner_word(F.col("_subject")))
    tokens = texts.select(F.col(text_id), F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("_token"))
    found = tokens.join(keyed.where("_word is not null").select(F.col("_word").alias("_token"), "_subject"), "_token").select(text_id, "_subject")

    parts = keyed.where("_word is null").select("_subject", _longest_part(F.col("_subject")).alias("_part")).where(F.length("_part") > 0)
    # The longest of a few fixed lengths that fits, so a token lists its substrings of those lengths only.
    fitting = F.lit(_GRAMS[0])
    for n in _GRAMS[1:]:
        fitting = F.when(F.length("_part") >= n, n).otherwise(fitting)
    parts = parts.withColumn("_len", fitting)
    lengths = sorted(r["_len"] for r in parts.select("_len").distinct().collect())  # at most as many numbers as _GRAMS
    if lengths:
        token = F.col("_token")
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, F.lit(n)))
        grams = F.flatten(F.array(*[F.when(F.length(token) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in lengths]))
        vocabulary = tokens.select("_token").distinct()
        pieces = vocabulary.select("_token", F.explode(F.array_distinct(grams)).alias("_gram"))
        within = pieces.join(parts.withColumn("_gram", F.left("_part", F.col("_len"))), "_gram").where(F.contains(token, F.col("_part")))
        found = found.unionByName(tokens.join(within.select("_token", "_subject"), "_token").select(text_id, "_subject"))
    found = found.distinct()
    spaced = F.contains(F.col("_subject"), F.lit(" "))
    verified = texts.select(text_id, text).join(found.where(spaced), text_id).where(F.contains(F.col(text), F.col("_subject")))
    return found.where(~spaced).unionByName(verified.select(text_id, "_subject")).withColumnRenamed("_subject", subject)


_GRAMS = (1, 2, 4, 8, 16)


def _longest_part(subject: Column) -> Column:
    """Longest space-separated part of the subject."""
    return F.array_max(F.transform(F.split(subject, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def _longest_inner_word(subject: Column) -> Column:
    """Longest word that has a space on both sides inside the subject, NULL when there is none."""
    words = F.split(subject, " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    return F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def co_occurrence(texts: DataFrame, text: str, text_id: str, words: Iterable[str], subjects: DataFrame, subject: str) -> DataFrame:
    """Texts that hold one of the words and one of the subjects."""
    return substring_pairs(texts.where(contains_any(F.col(text), words)), text, text_id, subjects, subject)


def lineage(fields: DataFrame, records: DataFrame, sheets: DataFrame) -> DataFrame:
    """Every field with the record and the sheet it comes from.

    ``fields``: record_id and the field's columns; ``records``: record_id, sheet_id, row; ``sheets``:
    sheet_id, source_path, sheet. A field whose record or sheet is missing stays, with nulls there.
    """
    return fields.join(records, "record_id", "left").join(sheets, "sheet_id", "left")


def resolve_evidence(ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """Look up cited ids; an unknown id stays as a row with ok = false."""
    marked = evidence.withColumn("_known", F.lit(True))
    return ids.join(marked, "evidence_id", "left").withColumn("ok", F.coalesce("_known", F.lit(False))).drop("_known")


def source_status(manifest: DataFrame, counts: DataFrame, warnings: DataFrame) -> DataFrame:
    """Parsing status of every inventoried file."""
    warned = warnings.groupBy("path").agg(F.count(F.lit(1)).alias("warnings"))
    status = (
        F.when(F.col("file_type").isin("xml", "unknown") | F.col("path").endswith(".dtd"), "skipped")
        .when(F.col("warnings").isNotNull(), "warning").when(F.col("rows").isNotNull(), "parsed").otherwise("skipped")
    )
    return manifest.join(counts, "path", "left").join(warned, "path", "left").select(
        "path", "file_type", status.alias("status"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"))
