"""Row predicates and checks over the role views."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallymark.bindings import with_views
from tallymark.operators import checks, filters
from tallymark.operators.ordering import top_n
from tallymark.plans.split_records import payment_violations
from tallymark.queries import registry

query = registry.query
CENTS = "decimal(18,2)"


def _total(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(CENTS).alias("total"))


_TOTAL = "count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total"


@query("flt_01_payment_leg", with_views("ledger", tail=f"""SELECT account, {_TOTAL} FROM ledger WHERE posting_kind = 'Zahlung' AND NOT regexp_matches(lower(posting_kind || ' ' || posting_text), 'gutschrift|eingang|receipt')
    AND amount > 0 GROUP BY 1"""))
def _(t):
    return _total(t.ledger.where(filters.payment_leg(F.col("posting_kind"), F.col("posting_text"), F.col("amount"), F.col("payment_reference"))), "account")


@query("flt_02_vendor_creation", with_views("masters", tail="SELECT account, changed_by, approved_by, posting_date FROM masters WHERE field_changed = 'Kreditor'"))
def _(t):
    return t.masters.where(filters.vendor_creation(F.col("change_type"), F.col("field_changed"))).select("account", "changed_by", "approved_by", "posting_date")


@query("flt_03_carry_forward", with_views("ledger", tail=f"SELECT account, {_TOTAL} FROM ledger WHERE amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' GROUP BY 1"))
def _(t):
    return _total(t.ledger.where(filters.invoice_leg(F.col("posting_text"), F.col("amount"))), "account")


@query("flt_04_asset_addition", with_views("additions", "descriptions", "chart", tail=f"""SELECT asset_no, {_TOTAL} FROM additions JOIN descriptions USING (asset_no)
    WHERE posting_kind = 'Zugang' AND amount > 0 AND regexp_matches(lower(asset_desc), 'old|hot') AND asset_group IN (SELECT account FROM chart WHERE account_type = 'Bilanzkonto') GROUP BY 1"""))
def _(t):
    from tallymark.plans.capitalised_repairs import CapitalisedRepairs
    tables = {"additions": t.additions, "descriptions": t.descriptions, "chart": t.chart}
    return _total(CapitalisedRepairs(repair_words=("old", "hot")).repairs(tables), "asset_no")


@query("flt_05_crosses_period_end", with_views("cutoff_lines", tail=f"SELECT service_date, {_TOTAL} FROM cutoff_lines WHERE service_date <= DATE '1998-12-31' AND invoice_date > DATE '1998-12-31' AND amount <> 0 GROUP BY 1"))
def _(t):
    return _total(t.cutoff_lines.where(filters.crosses_period_end(
        F.col("service_date"), F.col("invoice_date"), F.lit(date(1998, 12, 31)), F.col("amount"))), "service_date")


@query("flt_06_round_number", with_views("ledger", tail="SELECT account, document_no, amount FROM ledger WHERE abs(amount) >= 1000 AND abs(amount) % 10 = 0"))
def _(t):
    return t.ledger.where(filters.round_number(F.col("amount"), F.lit(Decimal(1000)), F.lit(Decimal(10)))).select("account", "document_no", "amount")


@query("flt_07_group_qualifies", with_views("order_payments", tail="""SELECT payee, payment_date, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM order_payments WHERE amount > 0 GROUP BY 1, 2
    HAVING count(*) >= 2 AND min(amount) > 0 AND max(amount) < 400000 AND sum(amount) >= 400000"""))
def _(t):
    grouped = t.order_payments.where("amount > 0").groupBy("payee", "payment_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast(CENTS).alias("total"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    return grouped.where(filters.qualifies_as_split(F.col("n"), F.col("lo"), F.col("hi"), F.col("total"), F.lit(Decimal(400000)))).select("payee", "payment_date", "n", "total")


@query("flt_08_closing_period", with_views("ledger", tail=f"SELECT account, {_TOTAL} FROM ledger WHERE posting_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1"))
def _(t):
    return _total(t.ledger.where(filters.in_period(F.col("posting_date"), F.lit(date(1998, 1, 1)), F.lit(date(1998, 12, 31)))), "account")


@query("flt_09_subsequent_invoice", with_views("cutoff_lines", tail="""SELECT document_no, count(*) AS n FROM cutoff_lines WHERE invoice_date > DATE '1999-12-31'
    AND (CASE WHEN amount > 50000 THEN NULL ELSE service_date END IS NULL OR service_date > DATE '1999-12-31') GROUP BY 1"""))
def _(t):
    posting = F.when(F.col("amount") > 50000, F.lit(None)).otherwise(F.col("service_date"))
    hits = t.cutoff_lines.where(filters.subsequent_invoice(F.col("invoice_date"), posting, F.lit(date(1999, 12, 31))))
    return hits.groupBy("document_no").agg(F.count(F.lit(1)).alias("n"))


@query("flt_10_accepted_receipt", with_views("deliveries", tail="SELECT receipt_id, invoice_id, receipt_date, net_amount FROM deliveries WHERE status = 'accepted'"))
def _(t):
    return t.deliveries.where(filters.accepted(F.col("status"))).select("receipt_id", "invoice_id", "receipt_date", "net_amount")


@query("flt_11_source_type", "SELECT doc_id, source FROM documents WHERE source = 'src7'")
def _(t):
    typed = t.documents.select("doc_id", "source", F.col("source").alias("source_type"))
    return filters.of_source_type(typed, "src7", [f"src{i}" for i in range(20)]).select("doc_id", "source")


@query("flt_12_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'eau')")
def _(t):
    return t.documents.where(filters.holds_text(F.col("text"), "EAU")).select("doc_id")


_VERDICT = "CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'F' THEN 'DISMISSED' ELSE 'HUMAN_REVIEW' END"


def verdict_of_order():
    status = F.col("o_orderstatus")
    return F.when(status == "O", "CONFIRMED").when(status == "F", "DISMISSED").otherwise("HUMAN_REVIEW")


@query("flt_13_verdict", f"SELECT o_orderkey, {_VERDICT} AS verdict FROM orders WHERE {_VERDICT} = 'DISMISSED'")
def _(t):
    return filters.has_verdict(t.orders.select("o_orderkey", verdict_of_order().alias("verdict")), "DISMISSED")


@query("flt_14_covers_columns", """WITH c AS (SELECT user_id, list_distinct(list(event_type)) AS kinds FROM events GROUP BY 1)
    SELECT user_id FROM c WHERE list_contains(kinds, 'purchase') AND list_contains(kinds, 'view')""")
def _(t):
    seen = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return seen.where(filters.covers_columns(F.col("kinds"), ["purchase", "view"])).select("user_id")


@query("flt_15_rapid_window", with_views("cutoff_lines", tail="SELECT document_no, count(*) AS n FROM cutoff_lines WHERE date_diff('day', service_date, invoice_date) BETWEEN 0 AND 7 GROUP BY 1"))
def _(t):
    return t.cutoff_lines.where(filters.within_days(F.col("invoice_date"), F.col("service_date"), 7)).groupBy("document_no").agg(F.count(F.lit(1)).alias("n"))


@query("chk_01_required_fields", """SELECT CAST(event_id AS VARCHAR) AS payment_id, concat_ws('; ', CASE WHEN event_id % 11 = 0 THEN 'payee is required' END,
    CASE WHEN event_id % 13 = 0 THEN 'an explicit reversal must have a negative amount' END) AS violations FROM events WHERE event_type = 'purchase' AND (event_id % 11 = 0 OR event_id % 13 = 0)""")
def _(t):
    key = F.col("payment_id").cast("long")
    rows = t.payments.withColumns({"payee": F.when(key % 11 == 0, " ").otherwise(F.col("payee")), "payment_reference": F.lit("r"),
                                   "reversal_of": F.when(key % 13 == 0, F.lit("p0"))})
    rejected = checks.split_rejects(rows, payment_violations())[1]
    return rejected.select("payment_id", F.array_join("violations", "; ").alias("violations"))


@query("chk_02_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("chk_02_conflicting_records", """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1""")
def _(t):
    return checks.conflicting_records(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])


@query("chk_03_reconcile_counts", """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, CASE WHEN source = 'src3' THEN n + 1 ELSE n END AS source_rows FROM s
    UNION ALL SELECT 'missing', 5) SELECT e.source AS source_path, source_rows, coalesce(n, 0) AS parsed_rows, source_rows = coalesce(n, 0) AS reconciled FROM e LEFT JOIN s USING (source)""")
def _(t):
    found = t.documents.select(F.col("source").alias("source_path"))
    counted = found.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    expected = counted.select("source_path", F.when(F.col("source_path") == "src3", F.col("n") + 1).otherwise(F.col("n")).alias("source_rows")).union(
        t.region.where("r_regionkey = 0").select(F.lit("missing"), F.lit(5).cast("long")))
    return checks.reconcile_counts(expected, found)


@query("chk_04_unsafe_evidence", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '../' || page_id WHEN page_id % 5 = 0 THEN '/abs/' || page_id ELSE 'safe/' || page_id END AS path, page_id % 3 = 0 AS tampered
    FROM pages WHERE page_id % 7 = 0 OR page_id % 5 = 0 OR page_id % 3 = 0""")
def _(t):
    key = F.col("page_id")
    rows = t.pages.select(key, F.when(key % 7 == 0, F.concat(F.lit("../"), key)).when(key % 5 == 0, F.concat(F.lit("/abs/"), key)).otherwise(F.concat(F.lit("safe/"), key)).alias("path"),
                          "html", F.sha2(F.when(key % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("stored"))
    rows = rows.withColumn("tampered", checks.tampered(F.col("html"), F.col("stored")))
    return rows.where(checks.unsafe_path(F.col("path")) | F.col("tampered")).select("page_id", "path", "tampered")


@query("chk_05_unknown_citations", "SELECT o_orderkey AS owner, 'c' || o_custkey AS evidence_id FROM orders WHERE o_custkey % 10 = 0 UNION SELECT o_orderkey, 'x' || o_orderkey FROM orders WHERE o_orderkey % 50 = 0")
def _(t):
    cited = t.orders.select(F.col("o_orderkey").alias("owner"), F.array_compact(F.array(
        F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("c"), "o_custkey"), F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("x"), "o_orderkey")))).alias("evidence_ids"))
    known = t.customer.where("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("evidence_id"))
    return checks.unknown_citations(cited, known, "owner")


@query("chk_06_unsupported_inputs", """SELECT l_orderkey AS case_id, 's' || l_suppkey AS evidence_id, count(*) AS inputs FROM lineitem l WHERE l_quantity > 40
    AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_suppkey = l.l_suppkey AND p.l_returnflag = 'N') GROUP BY 1, 2""")
def _(t):
    shown = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("s"), "l_suppkey").alias("evidence_id"), "l_quantity", "l_returnflag")
    missing = checks.unsupported_inputs(shown.where("l_quantity > 40"), shown.where("l_returnflag = 'N'"), "case_id")
    return missing.groupBy("case_id", "evidence_id").agg(F.count(F.lit(1)).alias("inputs"))


@query("srt_02_top_duplicates", with_views("ledger", tail="""SELECT part_no, amount, count(*) AS n FROM ledger GROUP BY 1, 2 ORDER BY n DESC, amount DESC, part_no LIMIT 25"""))
def _(t):
    groups = t.ledger.groupBy("part_no", "amount").agg(F.count(F.lit(1)).alias("n"))
    return top_n(groups, [F.desc("n"), F.desc("amount"), "part_no"], 25)


@query("srt_07_board_order", f"""SELECT {_VERDICT} AS verdict, count(*) AS cases, CAST(CASE {_VERDICT} WHEN 'CONFIRMED' THEN 1 WHEN 'HUMAN_REVIEW' THEN 2 ELSE 3 END AS BIGINT) AS place FROM orders GROUP BY 1, 3""")
def _(t):
    from tallymark.operators.cases import board
    return board(t.orders.select(verdict_of_order().alias("verdict"))).withColumn("place", F.col("place").cast("long"))


