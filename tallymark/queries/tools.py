"""Forensic tools over the given tables, every subject in one job."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallymark.bindings import SQL, with_views
from tallymark.operators import tools
from tallymark.operators.admission import admit_findings
from tallymark.plans.capitalised_repairs import CapitalisedRepairs
from tallymark.plans.payment_split import PaymentSplit
from tallymark.plans.period_cutoff import PeriodCutoff
from tallymark.plans.vendor_sod import VendorSegregation
from tallymark.queries import registry
from tallymark.queries.aggregates import PEERS_SQL

query = registry.query
CENTS = "decimal(18,2)"


@query("tool_01_inventory", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS rows, 6::BIGINT AS columns UNION ALL SELECT 'events', (SELECT count(*) FROM events), 6 UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 3")
def _(t):
    return tools.inventory({"orders": t.orders, "events": t.events, "nation": t.nation})


_HITS = """WITH c AS (SELECT 'customer' AS source_path, c_custkey AS row, 0 AS column_no, 'c_name' AS "column", c_name AS value FROM customer UNION ALL SELECT 'customer', c_custkey, 1, 'c_mktsegment', c_mktsegment FROM customer
    UNION ALL SELECT 'part', p_partkey, 0, 'p_name', p_name FROM part UNION ALL SELECT 'part', p_partkey, 1, 'p_type', p_type FROM part),
    h AS (SELECT * FROM c WHERE contains(lower(value), 'build') OR contains(lower(value), 'zzz'))
    SELECT source_path, row, column_no, "column", value, 'ev_' || substr(sha256(source_path || '|r' || row || '|sNone|cNone|pNone|' || value), 1, 16) AS evidence_id, FALSE AS truncated FROM h"""


@query("tool_02_search_evidence", _HITS)
def _(t):
    cells = tools.unpivot_cells(t.customer, "customer", "c_custkey", ["c_name", "c_mktsegment"]).unionByName(tools.unpivot_cells(t.part, "part", "p_partkey", ["p_name", "p_type"]))
    return tools.search_evidence(cells, "Build")


@query("tool_03_open_evidence", """SELECT 'ev_' || substr(sha256('part|r' || p_partkey || '|sNone|cNone|pNone|' || p_name), 1, 16) AS evidence_id, p_partkey % 4 <> 0 AS ok, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS value FROM part""")
def _(t):
    from tallymark.operators.joins import resolve_evidence
    cells = tools.unpivot_cells(t.part, "part", "p_partkey", ["p_name"])
    return resolve_evidence(cells.select("evidence_id"), cells.where("row % 4 <> 0").select("evidence_id", "value")).select("evidence_id", "ok", "value")


@query("tool_04_vendor_history", with_views("ledger", tail="SELECT account, count(*) AS postings, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS net_total FROM ledger GROUP BY 1"))
def _(t):
    return tools.vendor_history(t.ledger)


@query("tool_04_vendor_postings", with_views("ledger", tail="SELECT document_no, posting_date, amount, posting_text, evidence_id FROM ledger WHERE account = '17'"))
def _(t):
    return tools.vendor_postings(t.ledger, "17").select("document_no", "posting_date", "amount", "posting_text", "evidence_id")


def sod_tables(t):
    return {"masters": t.masters, "postings": t.ledger.select("account", "amount", "posting_text", "evidence_id"), "receipts": t.receipts, "toxic_users": t.toxic_users}


_SOD = f"""WITH ledger AS ({SQL["ledger"]}), masters AS ({SQL["masters"]}), receipts AS ({SQL["receipts"]}), p AS (SELECT account, CAST(sum(CASE WHEN amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' THEN -amount END) AS DECIMAL(18,2)) AS exposure,
    bool_or(posting_text = 'Saldenvortrag Vorjahr') AS opening, count(CASE WHEN amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' THEN 1 END) AS charges FROM ledger GROUP BY 1),
    f AS (SELECT m.account AS vendor_id, m.changed_by, m.approved_by, m.evidence_id AS finding_id, m.changed_by = m.approved_by AS self_approved, coalesce(exposure, 0)::DECIMAL(18,2) AS exposure, coalesce(charges, 0) AS charges, coalesce(opening, FALSE) AS opening,
    m.account IN (SELECT vendor FROM receipts) AS received FROM masters m LEFT JOIN p USING (account) WHERE field_changed = 'Kreditor')"""


@query("tool_05_creation_and_approval", _SOD + " SELECT vendor_id, self_approved, NOT self_approved AS independent_approval, exposure, finding_id FROM f")
def _(t):
    return tools.creation_and_approval(VendorSegregation().run(sod_tables(t)).findings)


@query("tool_06_user_permissions", with_views("rights", tail="SELECT benutzer AS user_id, bool_or(stammdaten_anlegen <> '' AND journal_buchen <> '' AND zahlungslauf <> '') AS toxic_combination FROM rights GROUP BY 1"))
def _(t):
    users = t.rights.select(F.col("benutzer").alias("user_id")).distinct()
    return tools.user_permissions(users, t.toxic_users)


@query("tool_07_reconcile_legs", with_views("ledger", tail="""SELECT account, CAST(sum(greatest(-amount, 0)) AS DECIMAL(18,2)) AS invoices_total, CAST(sum(greatest(amount, 0)) AS DECIMAL(18,2)) AS payments_total, CAST(-sum(amount) AS DECIMAL(18,2)) AS unreconciled FROM ledger GROUP BY 1"""))
def _(t):
    from tallymark.operators.aggregates import reconcile_legs
    return reconcile_legs(t.ledger)


@query("tool_08_receipt_matches", with_views("receipts", "masters", tail="SELECT vendor, coalesce(n, 0) > 0 AS matched, coalesce(n, 0) AS match_count FROM (SELECT DISTINCT account AS vendor FROM masters) LEFT JOIN (SELECT vendor, count(*) AS n FROM receipts GROUP BY 1) USING (vendor)"))
def _(t):
    return tools.receipt_matches(t.masters.select(F.col("account").alias("vendor")).distinct(), t.receipts)


@query("agg_28_receipt_total", with_views("receipts", tail="SELECT count(*) AS match_count FROM receipts WHERE vendor <> ''"))
def _(t):
    return tools.receipt_total(t.receipts)[0]


@query("srt_03_first_receipts", with_views("receipts", tail="SELECT goods_receipt_no, vendor FROM receipts ORDER BY goods_receipt_no LIMIT 50"))
def _(t):
    return tools.receipt_total(t.receipts, cite=50)[1].select("goods_receipt_no", "vendor")


@query("tool_04_history_citations", with_views("ledger", tail="SELECT DISTINCT account AS subject, evidence_id FROM ledger"))
def _(t):
    return tools.citations(t.ledger, "account")


@query("tool_06_permission_citations", "SELECT DISTINCT 'U' || (n_nationkey % 7) AS subject, 'ev_' || substr(sha256('nation|r' || n_nationkey || '|sNone|cNone|pNone|' || 'U' || (n_nationkey % 7)), 1, 16) AS evidence_id FROM nation")
def _(t):
    rights = t.nation.select("n_nationkey", F.concat(F.lit("U"), F.col("n_nationkey") % 7).alias("user"))
    return tools.permission_citations(rights, "user", "n_nationkey", "nation")


@query("tool_07_leg_citations", with_views("ledger", tail="SELECT DISTINCT account AS subject, CASE WHEN amount < 0 THEN 'invoice' ELSE 'payment' END AS leg, evidence_id FROM ledger WHERE amount <> 0"))
def _(t):
    return tools.leg_citations(t.ledger)


@query("tool_08_receipt_citations", with_views("receipts", "masters", tail="SELECT DISTINCT vendor AS subject, evidence_id FROM receipts WHERE vendor IN (SELECT account FROM masters)"))
def _(t):
    return tools.receipt_citations(t.masters.select(F.col("account").alias("vendor")), t.receipts)


@query("tool_15_contract_citations", with_views("receipts", tail="""SELECT w.word AS subject, 'text' AS kind, CAST(d.doc_id AS VARCHAR) AS evidence_id FROM documents d JOIN (SELECT DISTINCT split_part(text, ' ', 3) AS word FROM benchmark) w ON contains(lower(d.text), lower(w.word)) WHERE contains(lower(d.text), 'tion')
    UNION ALL SELECT DISTINCT vendor, 'receipt', evidence_id FROM receipts WHERE vendor IN (SELECT split_part(text, ' ', 3) FROM benchmark)"""))
def _(t):
    vendors = t.benchmark.select(F.split_part("text", F.lit(" "), F.lit(3)).alias("vendor")).distinct()
    return tools.contract_citations(vendors, t.receipts, t.texts, words=("tion",))


@query("tool_16_peer_citations", with_views("ledger", tail="SELECT DISTINCT account AS subject, evidence_id FROM ledger WHERE amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr'"))
def _(t):
    return tools.peer_citations(t.ledger)


def split_postings(t):
    return {"postings": t.ledger.withColumn("posting_date", F.col("posting_date").cast("string"))}


@query("tool_09_cluster_payments", with_views("ledger", tail="""SELECT count(*) AS groups, CAST(coalesce(sum(total), 0) AS DECIMAL(18,2)) AS total FROM (SELECT sum(amount) AS total FROM ledger WHERE posting_kind = 'Zahlung' AND posting_text <> 'Gutschrift Lieferant' AND amount > 0
    GROUP BY account, posting_date HAVING count(*) >= 2 AND sum(amount) >= 100000 AND max(amount) < 100000)"""))
def _(t):
    return tools.payment_clusters_total(PaymentSplit().run(split_postings(t), {"approval_threshold": "100000"}).findings)


REPAIRS = dict(repair_words=("old", "hot"), investment_words=("eau", "tion"))


def repair_tables(t):
    return {"additions": t.additions, "descriptions": t.descriptions, "chart": t.chart, "texts": t.texts}


_REPAIRS = f"""WITH additions AS ({SQL["additions"]}), descriptions AS ({SQL["descriptions"]}), chart AS ({SQL["chart"]}), h AS (SELECT * FROM additions JOIN descriptions USING (asset_no) WHERE posting_kind = 'Zugang' AND regexp_matches(asset_desc, 'old|hot')
    AND asset_group IN (SELECT account FROM chart WHERE account_type = 'Bilanzkonto'))"""


@query("tool_10_asset_additions", _REPAIRS + " SELECT count(*) AS input_count, CAST(sum(amount) AS DECIMAL(18,2)) AS exposure FROM h")
def _(t):
    return CapitalisedRepairs(**REPAIRS).run(repair_tables(t)).findings.select("input_count", "exposure")


@query("tool_11_period_cutoff", with_views("cutoff_lines", tail="SELECT count(*) AS input_count, CAST(sum(amount) AS DECIMAL(18,2)) AS exposure FROM cutoff_lines WHERE service_date <= DATE '1998-12-31' AND invoice_date > DATE '1998-12-31' AND amount <> 0"))
def _(t):
    return PeriodCutoff().run({"lines": t.cutoff_lines}, {"fiscal_year_end": "31.12.1998"}).findings.select("input_count", "exposure")


@query("tool_12_find_reversals", with_views("ledger", tail="SELECT account, document_no, amount, evidence_id FROM ledger WHERE contains(lower(posting_text), 'storno')"))
def _(t):
    return tools.find_reversals(t.ledger).select("account", "document_no", "amount", "evidence_id")


@query("tool_12_reversals_of_reference", with_views("ledger", tail="SELECT account, document_no, amount, evidence_id FROM ledger WHERE contains(lower(posting_text), 'storno') AND (document_no = '42' OR payment_reference = '42')"))
def _(t):
    return tools.find_reversals(t.ledger, "42").select("account", "document_no", "amount", "evidence_id")


@query("tool_13_find_credit_notes", with_views("ledger", tail="SELECT account, count(*) AS notes, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM ledger WHERE contains(lower(posting_text), 'gutschrift') GROUP BY 1"))
def _(t):
    return tools.find_credit_notes(t.ledger).groupBy("account").agg(F.count(F.lit(1)).alias("notes"), F.sum("amount").cast(CENTS).alias("total"))


@query("tool_14_independent_approval", _SOD + " SELECT vendor_id, bool_or(NOT self_approved) AS independent_approval FROM f GROUP BY 1")
def _(t):
    out = tools.creation_and_approval(VendorSegregation().run(sod_tables(t)).findings)
    return out.groupBy("vendor_id").agg(F.max(F.col("independent_approval").cast("int")).alias("n")).select("vendor_id", (F.col("n") == 1).alias("independent_approval"))


@query("tool_15_contract_or_service", with_views("receipts", tail="""SELECT v.vendor, coalesce(n, 0) AS receipt_count, coalesce(m, 0) AS contract_mentions, coalesce(n, 0) > 0 OR coalesce(m, 0) > 0 AS found FROM (SELECT DISTINCT split_part(text, ' ', 3) AS vendor FROM benchmark) v
    LEFT JOIN (SELECT vendor, count(*) AS n FROM receipts GROUP BY 1) r USING (vendor) LEFT JOIN (SELECT w.word, count(*) AS m FROM documents d JOIN (SELECT DISTINCT split_part(text, ' ', 3) AS word FROM benchmark) w ON contains(lower(d.text), lower(w.word))
    WHERE contains(lower(d.text), 'tion') GROUP BY 1) c ON c.word = v.vendor"""))
def _(t):
    vendors = t.benchmark.select(F.split_part("text", F.lit(" "), F.lit(3)).alias("vendor")).distinct()
    return tools.contract_or_service_evidence(vendors, t.receipts, t.texts, words=("tion",)).select("vendor", "receipt_count", "contract_mentions", "found")


@query("tool_16_compare_peers", PEERS_SQL)
def _(t):
    return tools.compare_peers(t.ledger)


@query("tool_17_trace_amounts", """SELECT 'orders' AS source_path, o_orderkey AS row, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) IN (SELECT CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_orderkey IN (3, 5, 7))
    UNION ALL SELECT 'customer', c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) IN (SELECT CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_orderkey IN (3, 5, 7))""")
def _(t):
    def cells(df, name, key, column):
        german = F.translate(F.format_number(column, 2), ",.", ".,")
        return tools.unpivot_cells(df.select(key, german.alias("amount")), name, key, ["amount"])

    targets = [r[0] for r in t.orders.where("o_orderkey in (3, 5, 7)").select(F.col("o_totalprice").cast(CENTS)).collect()]  # the amounts asked for
    both = cells(t.orders, "orders", "o_orderkey", "o_totalprice").unionByName(cells(t.customer, "customer", "c_custkey", "c_acctbal"))
    return tools.trace_amounts(both, targets).select("source_path", "row", "amount")


@query("tool_18_submit_to_admission", _SOD + """ SELECT finding_id, vendor_id AS subject, CASE WHEN NOT self_approved OR received OR opening THEN 'DISMISSED' ELSE 'HUMAN_REVIEW' END AS verdict, CASE WHEN NOT received AND self_approved AND NOT opening THEN
    'One or more required counter-tests are incomplete or unsupported. Material uncertainty remains.' ELSE 'Supported counter-evidence resolves the allegation.' END AS reason_text, exposure FROM f""")
def _(t):
    admitted = admit_findings(VendorSegregation().run(sod_tables(t)).findings)
    return tools.submit_to_admission(admitted, category="vendor_sod").select("finding_id", "subject", "verdict", "reason_text", "exposure")


