"""Aggregates, ranks, windows and set operations over the role views."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.bindings import SQL, with_views
from tallymark.operators import aggregates, filters, ordering
from tallymark.queries import registry

query = registry.query
CENTS = "decimal(18,2)"


@query("agg_01_round_total", with_views("ledger", tail="SELECT count(*) AS postings, CAST(coalesce(sum(abs(amount)), 0) AS DECIMAL(18,2)) AS exposure FROM ledger WHERE abs(amount) >= 1000 AND abs(amount) % 10 = 0"))
def _(t):
    return aggregates.round_posting_total(t.ledger, Decimal(1000), Decimal(10))


_DUP = "SELECT event_type AS document_no, CAST(value AS DECIMAL(18,2)) AS amount FROM events"


@query("agg_02_duplicate_references", f"""WITH d AS ({_DUP}) SELECT document_no, amount, count(*) AS postings, CAST((count(*) - 1) * abs(amount) AS DECIMAL(18,2)) AS exposure FROM d GROUP BY 1, 2
    HAVING count(*) >= 2""")
def _(t):
    rows = t.events.select(F.col("event_type").alias("document_no"), F.col("value").cast(CENTS).alias("amount"))
    return aggregates.duplicate_references(rows)


@query("agg_03_vendor_exposure", with_views("ledger", tail="""SELECT account, CAST(coalesce(sum(CASE WHEN amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' THEN -amount END), 0) AS DECIMAL(18,2)) AS exposure,
    count(CASE WHEN amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' THEN 1 END) AS charges FROM ledger GROUP BY 1"""))
def _(t):
    return aggregates.vendor_exposure(t.ledger)


@query("agg_04_split_payments", with_views("payments", tail="""SELECT payee, payment_date, count(*) AS payments, CAST(sum(amount) AS DECIMAL(18,2)) AS total, min(amount) AS smallest, max(amount) AS largest FROM payments
    WHERE amount > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(amount) >= 100 AND max(amount) < 100"""))
def _(t):
    return aggregates.split_groups(t.payments, ["payee", "payment_date"], Decimal(100))


@query("agg_05_split_order_payments", with_views("order_payments", tail="""SELECT payee, payment_date, count(*) AS payments, CAST(sum(amount) AS DECIMAL(18,2)) AS total, min(amount) AS smallest, max(amount) AS largest
    FROM order_payments WHERE amount > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(amount) >= 400000 AND max(amount) < 400000"""))
def _(t):
    return aggregates.split_groups(t.order_payments, ["payee", "payment_date"], Decimal(400000))


@query("agg_06_adjusted_total", with_views("ledger", tail="""SELECT account, CAST(sum(amount) AS DECIMAL(18,2)) AS raw_total,
    CAST(coalesce(sum(CASE WHEN posting_text <> 'Storno Rechnung' THEN amount END), 0) AS DECIMAL(18,2)) AS adjusted_total FROM ledger GROUP BY 1"""))
def _(t):
    return aggregates.adjusted_total(t.ledger.withColumn("cancelled", F.col("posting_text") == "Storno Rechnung"), ["account"])


@query("agg_07_vendor_net_total", with_views("ledger", tail="SELECT account, count(*) AS postings, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS net_total FROM ledger GROUP BY 1"))
def _(t):
    return aggregates.vendor_net_total(t.ledger)


@query("agg_08_reconcile_legs", with_views("ledger", tail="""SELECT account, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DECIMAL(18,2)) AS invoices_total,
    CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS payments_total,
    CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) - sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS unreconciled FROM ledger GROUP BY 1"""))
def _(t):
    return aggregates.reconcile_legs(t.ledger)


_BENFORD = ", ".join(f"({d}, {p})" for d, p in V.BENFORD.items())
_HISTOGRAM = f"""WITH ledger AS ({SQL["ledger"]}), e(digit, expected) AS (VALUES {_BENFORD}), c AS (SELECT CAST(substr(regexp_replace(CAST(abs(amount) AS VARCHAR), '[^1-9]', '', 'g'), 1, 1) AS INTEGER) AS digit,
    count(*) AS n FROM ledger GROUP BY 1), h AS (SELECT e.digit, CAST(expected AS DECIMAL(18,6)) AS expected, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS population FROM e LEFT JOIN c USING (digit)),
    o AS (SELECT *, CAST(round_even(n / population, 6) AS DECIMAL(18,6)) AS observed FROM h), r AS (SELECT *, CAST(abs(observed - expected) AS DECIMAL(18,6)) AS deviation FROM o)"""


@query("agg_09_benford_histogram", _HISTOGRAM + " SELECT digit, expected, n, population, observed, deviation FROM r")
def _(t):
    return aggregates.benford_histogram(t.ledger)


@query("win_10_worst_digit", _HISTOGRAM + " SELECT digit, deviation, row_number() OVER (ORDER BY deviation DESC, digit) AS worst_rank FROM r WHERE deviation > 0.05")
def _(t):
    return aggregates.benford_deviations(t.ledger).select("digit", "deviation", F.col("worst_rank").cast("long").alias("worst_rank"))


@query("agg_10_severity_score", """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 2.5 ELSE 0 END AS DECIMAL(18,2)) AS score FROM orders""")
def _(t):
    fired = {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 200000}
    return t.orders.select("o_orderkey", aggregates.severity_score(fired, {"open": Decimal("1"), "large": Decimal("2.5")}).alias("score"))


@query("agg_11_addition_total", with_views("additions", tail="SELECT count(*) AS rows, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS total FROM additions"))
def _(t):
    return aggregates.total(t.additions)


@query("agg_12_cutoff_total", with_views("cutoff_lines", tail="SELECT count(*) AS rows, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS total FROM cutoff_lines WHERE service_date <= DATE '1998-12-31' AND invoice_date > DATE '1998-12-31'"))
def _(t):
    from datetime import date
    return aggregates.total(t.cutoff_lines.where(filters.crosses_period_end(F.col("service_date"), F.col("invoice_date"), F.lit(date(1998, 12, 31)), F.col("amount"))))


@query("agg_13_representations", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS asset_amount, CAST(coalesce(gl, 0) AS DECIMAL(18,2)) AS gl_total, CAST(coalesce(inv, 0) AS DECIMAL(18,2)) AS invoice_total FROM orders LEFT JOIN
    (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS gl, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS inv FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(t):
    from tallymark.plans.capex import representations
    lines = t.lineitem.select(F.col("l_orderkey").alias("addition_id"), "l_returnflag", F.col("l_extendedprice").cast(CENTS).alias("amount"))
    posted, invoiced = representations(lines.where("l_returnflag = 'R'").withColumn("account_classification", F.lit("asset")), lines.where("l_returnflag <> 'R'").withColumnRenamed("amount", "net_amount"))
    rows = t.orders.select(F.col("o_orderkey").alias("addition_id"), F.col("o_totalprice").cast(CENTS).alias("asset_amount"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(CENTS)
    return rows.join(posted, "addition_id", "left").join(invoiced, "addition_id", "left").select(
        F.col("addition_id").alias("o_orderkey"), "asset_amount", zero("gl_total").alias("gl_total"), zero("invoice_total").alias("invoice_total"))


@query("agg_14_prior_activity", "SELECT CAST(user_id AS VARCHAR) AS vendor_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS prior_count, count(*) AS history_records FROM events GROUP BY 1")
def _(t):
    return aggregates.prior_activity(t.events.select(F.col("user_id").cast("string").alias("vendor_id"), (F.col("event_type") == "error").cast("int").alias("activity_count")))


@query("agg_15_distinct_obligations", """SELECT o_custkey, count(ob) = count(*) AND count(DISTINCT ob) = count(*) AS all_distinct, count(ob) > 0 AS any_given FROM
    (SELECT o_custkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS ob FROM orders) GROUP BY 1""")
def _(t):
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("ob"))
    return rows.groupBy("o_custkey").agg(aggregates.all_distinct(F.col("ob")).alias("all_distinct"), (F.count("ob") > 0).alias("any_given"))


@query("agg_16_single_plan", "SELECT o_custkey, o_orderpriority, count(o_orderstatus) = count(*) AND count(DISTINCT o_orderstatus) = 1 AS one_plan FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(aggregates.all_one_value(F.col("o_orderstatus")).alias("one_plan"))


@query("agg_17_documents_differ", with_views("ledger", tail="SELECT account, posting_date, count(DISTINCT document_no) > 1 AS documents_differ FROM ledger GROUP BY 1, 2"))
def _(t):
    return t.ledger.groupBy("account", "posting_date").agg(aggregates.more_than_one(F.col("document_no")).alias("documents_differ"))


@query("agg_18_merged_evidence", with_views("ledger", tail="SELECT document_no, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM ledger GROUP BY 1"))
def _(t):
    return t.ledger.groupBy("document_no").agg(F.array_join(aggregates.merged_ids(F.array("evidence_id")), ",").alias("evidence_ids"))


@query("agg_23_entity_catalog", """SELECT 'vendor' AS kind, CAST(s_suppkey AS VARCHAR) AS entity_id FROM supplier UNION SELECT 'account', CAST(c_custkey AS VARCHAR) FROM customer
    UNION SELECT 'user', c_mktsegment FROM customer WHERE length(c_mktsegment) <= 9 UNION SELECT 'vendor', CAST(l_suppkey AS VARCHAR) FROM lineitem""")
def _(t):
    return aggregates.entity_catalog([(t.supplier, "s_suppkey", "vendor"), (t.lineitem, "l_suppkey", "vendor"), (t.customer, "c_custkey", "account"), (t.customer, "c_mktsegment", "user")], longest_user=9)


@query("agg_24_table_summary", """SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS rows, 6::BIGINT AS columns UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 11
    UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), 4 UNION ALL SELECT 'documents', (SELECT count(*) FROM documents), 5""")
def _(t):
    return aggregates.table_summary({n: getattr(t, n) for n in ("orders", "lineitem", "supplier", "documents")})


@query("agg_26_compile_status", """SELECT CAST(sum(n_chars) AS BIGINT) AS source_rows, CAST(sum(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END) AS BIGINT) AS parsed_rows, 'partial' AS status FROM documents""")
def _(t):
    broken = F.col("doc_id") % 17 == 0
    return aggregates.compile_status(t.documents.select(
        F.col("n_chars").alias("source_rows"), F.when(broken, 0).otherwise(F.col("n_chars")).alias("parsed_rows"),
        F.when(broken, "failed").otherwise("success").alias("status"), broken.cast("int").alias("errors")))


_EXPOSURE = """exposure AS (SELECT account, CAST(coalesce(sum(CASE WHEN amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' THEN -amount END), 0) AS DECIMAL(18,2)) AS exposure FROM ledger GROUP BY 1)"""
PEERS_SQL = f"""WITH ledger AS ({SQL["ledger"]}), {_EXPOSURE} SELECT account, exposure, (SELECT count(*) FROM exposure p WHERE p.account <> v.account AND p.exposure > 0) AS peer_count,
    CAST((SELECT median(CAST(p.exposure AS DOUBLE)) FROM exposure p WHERE p.account <> v.account AND p.exposure > 0) AS DECIMAL(20,3)) AS peer_median_exposure,
    1 + (SELECT count(*) FROM exposure p WHERE p.account <> v.account AND p.exposure > v.exposure) AS rank FROM exposure v"""


@query("agg_27_peer_median", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS account, CAST(sum(CASE WHEN event_type = 'purchase' AND user_id % 6 <> 0 THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS exposure FROM events GROUP BY 1)
    SELECT account, exposure, (SELECT count(*) FROM e p WHERE p.account <> v.account AND p.exposure > 0) AS peer_count,
    CAST((SELECT median(CAST(p.exposure AS DOUBLE)) FROM e p WHERE p.account <> v.account AND p.exposure > 0) AS DECIMAL(20,3)) AS peer_median_exposure FROM e v""")
def _(t):
    charged = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 6 != 0), F.col("value").cast(CENTS)).otherwise(0)
    exposure = t.events.groupBy(F.col("user_id").cast("string").alias("account")).agg(F.sum(charged).cast(CENTS).alias("exposure"))
    return aggregates.peer_comparison(exposure).drop("rank")


@query("agg_29_cluster_total", with_views("payments", tail="""SELECT count(*) AS rows, CAST(coalesce(sum(total), 0) AS DECIMAL(18,2)) AS total FROM (SELECT sum(amount) AS total FROM payments WHERE amount > 0 GROUP BY payee, payment_date
    HAVING count(*) >= 2 AND sum(amount) >= 100 AND max(amount) < 100)"""))
def _(t):
    return aggregates.total(aggregates.split_groups(t.payments, ["payee", "payment_date"], Decimal(100)), "total")


@query("win_02_first_payment", with_views("payments", tail="SELECT payee, arg_min(payment_id, (payment_date, payment_id)) AS payment_id, min(payment_date) AS payment_date FROM payments GROUP BY 1"))
def _(t):
    return ordering.first_per_key(t.payments, ["payee"], ["payment_date", "payment_id"], ["payment_id", "payment_date"])


@query("win_03_first_creation", with_views("masters", tail="SELECT account, arg_min(changed_by, (posting_date, evidence_id)) AS creator, min(posting_date) AS created_on FROM masters WHERE field_changed = 'Kreditor' GROUP BY 1"))
def _(t):
    created = t.masters.where(filters.vendor_creation(F.col("change_type"), F.col("field_changed")))
    first = ordering.first_per_key(created, ["account"], ["posting_date", "evidence_id"], ["posting_date", "changed_by"])
    return first.select("account", F.col("changed_by").alias("creator"), F.col("posting_date").alias("created_on"))


_CLUSTER = """WITH a AS (SELECT l_partkey AS asset, l_suppkey AS vendor, CAST(l_shipdate AS DATE) AS d, l_linestatus = 'F' AS repair FROM lineitem)
    SELECT x.asset, x.vendor, x.d AS day, max(n.c) AS cluster_size FROM (SELECT DISTINCT asset, vendor, d FROM a) x,
    LATERAL (SELECT count(*) AS c FROM a y WHERE y.asset = x.asset AND y.vendor = x.vendor AND y.repair AND abs(date_diff('day', y.d, x.d)) <= 30) n GROUP BY 1, 2, 3"""


@query("win_04_repair_cluster", _CLUSTER)
def _(t):
    from tallymark.plans.capex import CapexParameters, CapitalExpenditure
    wide = t.lineitem.select(F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("vendor_id"), F.to_date("l_shipdate").alias("addition_date"), (F.col("l_linestatus") == "F").alias("repair_like"))
    near = CapitalExpenditure.with_clusters(wide, CapexParameters(cluster_window_days=30))
    return near.select(F.col("asset_id").alias("asset"), F.col("vendor_id").alias("vendor"), F.col("addition_date").alias("day"), "cluster_size").distinct()


@query("win_05_peer_rank", with_views("ledger", tail="SELECT account, total, rank() OVER (ORDER BY total DESC) AS rank FROM (SELECT account, CAST(sum(abs(amount)) AS DECIMAL(18,2)) AS total FROM ledger GROUP BY 1)"))
def _(t):
    totals = t.ledger.groupBy("account").agg(F.sum(F.abs("amount")).cast(CENTS).alias("total"))
    return ordering.global_rank(totals, "total")


@query("win_06_best_receipt", with_views("invoices", "deliveries", tail="""SELECT invoice_id, arg_min(receipt_id, (dist, gap, receipt_id)) AS receipt_id, min(dist) AS days FROM (SELECT i.invoice_id, receipt_id, abs(date_diff('day', invoice_date, receipt_date)) AS dist,
    abs(i.net_amount - d.net_amount) AS gap FROM invoices i JOIN deliveries d ON d.invoice_id = i.invoice_id WHERE status = 'accepted') GROUP BY 1"""))
def _(t):
    received = t.deliveries.where(filters.accepted(F.col("status"))).withColumnRenamed("net_amount", "delivered")
    pairs = t.invoices.join(received, "invoice_id").withColumns({
        "days": F.abs(F.datediff("invoice_date", "receipt_date")).cast("long"), "gap": F.abs(F.col("net_amount") - F.col("delivered"))})
    return ordering.first_per_key(pairs, ["invoice_id"], ["days", "gap", "receipt_id"], ["receipt_id", "days"])


@query("win_07_latest_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def _(t):
    return ordering.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "ts"])


@query("win_08_first_description", "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def _(t):
    return ordering.first_per_key(t.part, ["p_name"], ["p_partkey"], ["p_partkey", "p_brand"])


@query("win_09_cumulative_bounds", with_views("order_payments", tail="""SELECT payee, payment_id, amount, CAST(coalesce(sum(amount) OVER (PARTITION BY payee ORDER BY payment_date, payment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) AS before_amount
    FROM order_payments"""))
def _(t):
    order = ["payment_date", "payment_id"]
    sliced = ordering.slice_ordered(t.order_payments, ["payee"], order)
    out = ordering.running_totals(sliced, ["payee"], order, {"before_amount": F.col("amount")})
    return out.select("payee", "payment_id", "amount", F.col("before_amount").cast(CENTS).alias("before_amount"))


@query("win_11_evidence_sample", with_views("payments", tail="SELECT payee, payment_id, CAST(rn AS INTEGER) AS sample_no FROM (SELECT payee, payment_id, row_number() OVER (PARTITION BY payee ORDER BY payment_id) AS rn FROM payments) WHERE rn <= 8"))
def _(t):
    return ordering.sample_per_key(t.payments, ["payee"], ["payment_id"], "payment_id", 8)


@query("win_12_global_position", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def _(t):
    return ordering.global_position(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@query("set_02_all_vendor_ids", "SELECT CAST(user_id AS VARCHAR) AS vendor_id FROM events UNION SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def _(t):
    ids = [(t.events, "user_id"), (t.lineitem, "l_suppkey"), (t.orders, "o_custkey")]
    parts = [df.select(F.col(c).cast("string").alias("vendor_id")).distinct() for df, c in ids]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("set_03_subset_test", """WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS k FROM events GROUP BY 1) SELECT user_id, len(list_filter(k, lambda x: x NOT IN ('view', 'click', 'purchase'))) = 0 AS inside FROM a""")
def _(t):
    from tallymark.operators.admission import subset
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", subset(F.col("k"), F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))).alias("inside"))


@query("set_04_core_conflicts", """WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS k FROM events GROUP BY 1) SELECT user_id, list_has_any(k, ['error', 'signup']) AS conflict FROM a""")
def _(t):
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", F.arrays_overlap("k", F.array(F.lit("error"), F.lit("signup"))).alias("conflict"))


@query("set_05_split_citations", """WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS k FROM events GROUP BY 1)
    SELECT user_id, array_to_string(list_filter(k, lambda x: x IN ('view', 'click')), ',') AS kept, array_to_string(list_filter(k, lambda x: x NOT IN ('view', 'click')), ',') AS removed FROM a""")
def _(t):
    from tallymark.operators.citations import split_citations
    kinds = t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("k"))
    out = split_citations(kinds.withColumn("ok", F.array(F.lit("view"), F.lit("click"))), "k", "ok")
    return out.select("user_id", F.array_join("kept", ",").alias("kept"), F.array_join("removed", ",").alias("removed"))


@query("set_07_canonical_ids", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_set("o_orderpriority"))), ",").alias("priorities"))
