"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymark.bindings import with_views
from tallymark.functions import dates, identity, money, policy, roles, text
from tallymark.operators import admission, aggregates
from tallymark.queries import registry

CENTS = money.CENTS
query = registry.query
_EN = "format('{:,.2f}', o_totalprice)"


def _german(column: str) -> F.Column:  # type: ignore[name-defined]
    return F.translate(F.format_number(column, 2), ",.", ".,")


@query("fn_01_canonical_header", "SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]', '', 'g') AS canon FROM part")
def _(t):
    return t.part.select("p_partkey", text.canonical_header_column(F.concat_ws(" ", "p_brand", "p_name")).alias("canon"))


@query("fn_02_resolve_column", """SELECT CAST(l_suppkey AS VARCHAR) AS account, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total,
    count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1""")
def _(t):
    export = t.lineitem.select(F.col("l_suppkey").cast("string").alias("Kreditor-Nr. (alt)"), F.col("l_suppkey").cast("string").alias("Sachkonto-Nummer"),
                               F.col("l_extendedprice").cast(CENTS).alias("Betrag_EUR"), F.col("l_orderkey").alias("Beleg Nummer"))
    view = roles.role_view(export, ["account", "amount", "document_no"])
    return view.groupBy("account").agg(aggregates.cents_sum(F.col("amount")).alias("total"), F.count_distinct("document_no").alias("documents"))


@query("fn_03_parse_decimal", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS german, CAST(o_totalprice AS DECIMAL(18,2)) AS english,
    CAST(-o_totalprice AS DECIMAL(18,2)) AS negative, (strpos(format('{:,.2f}', o_totalprice), ',') > 0) AS wrong_locale_is_null FROM orders""")
def _(t):
    de, en = _german("o_totalprice"), F.format_number("o_totalprice", 2)
    return t.orders.select(
        "o_orderkey", money.parse_decimal(F.concat(de, F.lit(" EUR")), "de").cast(CENTS).alias("german"),
        money.parse_decimal(F.concat(F.lit("€ "), en), "en").cast(CENTS).alias("english"),
        money.parse_decimal(F.concat(F.lit("("), en, F.lit(")")), "en").cast(CENTS).alias("negative"),
        money.parse_decimal(de, "en").isNull().alias("wrong_locale_is_null"))


@query("fn_04_money", """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS from_german, CAST(o_totalprice AS DECIMAL(18,2)) AS from_english,
    CAST(o_orderkey % 1000 AS DECIMAL(18,2)) AS from_integer, CAST((o_orderkey % 9 + 1) * 1000 + 234 AS DECIMAL(18,2)) AS dot_groups,
    CAST((o_orderkey % 9 + 1) + 0.234 AS DECIMAL(18,3)) AS comma_decimals FROM orders""")
def _(t):
    digit = (F.col("o_orderkey") % 9 + 1).cast("string")
    return t.orders.select(
        "o_orderkey", money.money(_german("o_totalprice")).cast(CENTS).alias("from_german"), money.money(F.format_number("o_totalprice", 2)).cast(CENTS).alias("from_english"),
        money.money((F.col("o_orderkey") % 1000).cast("string")).cast(CENTS).alias("from_integer"),
        money.money(F.concat(digit, F.lit(".234"))).cast(CENTS).alias("dot_groups"), money.money(F.concat(digit, F.lit(",234"))).cast("decimal(18,3)").alias("comma_decimals"))


@query("fn_05_parse_date", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS german, CAST(o_orderdate AS DATE) AS two_digit,
    CAST(o_orderdate AS DATE) AS english, (day(o_orderdate) > 12) AS wrong_order_is_null FROM orders""")
def _(t):
    shown = lambda pattern: F.date_format("o_orderdate", pattern)
    return t.orders.select(
        "o_orderkey", dates.parse_date(shown("yyyy-MM-dd"), "de").alias("iso"), dates.parse_date(shown("d.M.yyyy"), "de").alias("german"),
        dates.parse_date(shown("dd.MM.yy"), "de").alias("two_digit"), dates.parse_date(shown("MM/dd/yyyy"), "en").alias("english"),
        dates.parse_date(shown("dd/MM/yyyy"), "en").isNull().alias("wrong_order_is_null"))


@query("fn_06_as_date", """SELECT l_orderkey, l_linenumber, count(*) AS lines, min(CAST(l_shipdate AS DATE)) AS first_day FROM lineitem GROUP BY 1, 2""")
def _(t):
    mixed = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "dd.MM.yyyy")).otherwise(F.date_format("l_shipdate", "MM/dd/yy"))
    return t.lineitem.withColumn("day", dates.as_date(mixed)).groupBy("l_orderkey", "l_linenumber").agg(
        F.count("day").alias("lines"), F.min("day").alias("first_day"))


@query("fn_07_normalize_identifier", "SELECT c_custkey, upper(c_name) || ' ' || c_mktsegment AS ident, TRUE AS blank_is_null FROM customer")
def _(t):
    padded = F.concat(F.lit("  "), F.lower("c_name"), F.lit(" \t  "), F.col("c_mktsegment"), F.lit("\n"))
    return t.customer.select("c_custkey", text.normalize_identifier(padded).alias("ident"), text.normalize_identifier(F.lit("   ")).isNull().alias("blank_is_null"))


@query("fn_08_fold", """SELECT doc_id, sha256(replace(lower(text || ' Straße'), 'ß', 'ss')) AS folded_hash FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(text.fold(F.concat("text", F.lit(" Straße"))), 256).alias("folded_hash"))


_TERMS = ("old", "hot", "bolt", "gear", "ring", "old bolt")


@query("fn_09_matching_terms", """SELECT p_partkey, concat_ws(',',
    CASE WHEN regexp_matches(lower(p_name), '\\bbolt\\b') THEN 'bolt' END, CASE WHEN regexp_matches(lower(p_name), '\\bgear\\b') THEN 'gear' END,
    CASE WHEN regexp_matches(lower(p_name), '\\bhot\\b') THEN 'hot' END, CASE WHEN regexp_matches(lower(p_name), '\\bold\\b') THEN 'old' END,
    CASE WHEN regexp_matches(lower(p_name), '\\bold bolt\\b') THEN 'old bolt' END, CASE WHEN regexp_matches(lower(p_name), '\\bring\\b') THEN 'ring' END) AS terms FROM part""")
def _(t):
    return t.part.select("p_partkey", F.array_join(text.matching_terms(F.col("p_name"), _TERMS), ",").alias("terms"))


@query("fn_10_keyword_any", """SELECT doc_id, regexp_matches(lower(text), 'eau|tion|ung') AS hit FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.contains_any(F.col("text"), ("eau", "tion", "ung")).alias("hit"))


@query("fn_11_blob", "SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS blob FROM part")
def _(t):
    return t.part.select("p_partkey", text.blob(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("blob"))


@query("fn_12_raw_hash", "SELECT doc_id, sha256(text) AS raw_hash, FALSE AS tampered FROM documents")
def _(t):
    from tallymark.operators.checks import tampered
    hashed = t.documents.withColumn("raw_hash", identity.raw_hash(F.col("text")))
    return hashed.select("doc_id", "raw_hash", tampered(F.col("text"), F.col("raw_hash")).alias("tampered"))


_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
    || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query("fn_13_evidence_uuid", f"""WITH d AS (SELECT doc_id, sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode('evidence/documents|' || doc_id || '||||' || left(text, 200) || '|' || sha256(text))) AS h FROM documents)
    SELECT doc_id, {_UUID} AS evidence_id FROM d""")
def _(t):
    return t.documents.select("doc_id", identity.evidence_uuid(
        F.lit("documents"), F.col("text"), row=F.col("doc_id"), passage=text.passage(F.col("text"))).alias("evidence_id"))


@query("fn_14_registry_id", """SELECT o_orderkey, 'ev_' || substr(sha256('orders|r' || o_orderkey || '|sNone|cNone|pNone|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)), 1, 16) AS evidence_id,
    'ev_' || substr(sha256('orders|rNone|sSheet1|cA' || (o_orderkey + 1) || '|p3|' || o_orderpriority), 1, 16) AS cell_id FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", identity.registry_id(F.lit("orders"), F.col("o_totalprice").cast(CENTS), row=F.col("o_orderkey")).alias("evidence_id"),
        identity.registry_id(F.lit("orders"), F.col("o_orderpriority"), sheet=F.lit("Sheet1"), cell=F.concat(F.lit("A"), F.col("o_orderkey") + 1), page=F.lit(3)).alias("cell_id"))


@query("fn_15_case_id", f"""WITH d AS (SELECT s_suppkey, sha1(unhex('{uuid.uuid5(uuid.NAMESPACE_URL, "case").hex}') || encode('eng:run-1:vendor_sod:' || s_name)) AS h FROM supplier)
    SELECT s_suppkey, {_UUID} AS case_id FROM d""")
def _(t):
    return t.supplier.select("s_suppkey", identity.case_id(F.lit("eng"), F.lit("run-1"), F.lit("vendor_sod"), F.col("s_name")).alias("case_id"))


@query("fn_16_cell_coordinate", """SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER))
    WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
    ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + ((n - 703) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) END || CAST(p_size AS VARCHAR) AS coordinate
    FROM (SELECT p_partkey, p_size, p_partkey * 7 % 16384 + 1 AS n FROM part)""")
def _(t):
    return t.part.select("p_partkey", identity.cell_coordinate(F.col("p_partkey") * 7 % 16384 + 1, F.col("p_size")).alias("coordinate"))


@query("fn_17_passage", "SELECT doc_id, left(text, 200) AS passage FROM documents")
def _(t):
    return t.documents.select("doc_id", text.passage(F.col("text")).alias("passage"))


_CELL_SQL = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') WHEN 1 THEN CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END
    WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE o_orderpriority END AS value,
    CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'boolean' WHEN 2 THEN 'decimal' WHEN 3 THEN 'decimal' ELSE 'identifier' END AS kind FROM orders"""


@query("fn_18_typed_cell", _CELL_SQL)
def _(t):
    from tallymark.sources.workbook import normalize_cell
    pick = F.col("o_orderkey") % 5
    cells = t.orders.select(
        "o_orderkey", F.when(pick == 1, "b").when(pick == 2, "n").otherwise("s").alias("value_type"),
        F.when(pick == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(pick == 1, F.when(F.col("o_orderstatus") == "O", "true").otherwise("false"))
        .when(pick == 2, F.col("o_totalprice").cast(CENTS).cast("string")).when(pick == 3, F.concat(_german("o_totalprice"), F.lit(" EUR")))
        .otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("raw"))
    return cells.select("o_orderkey", normalize_cell(F.col("value_type"), F.col("raw")).alias("c")).select("o_orderkey", "c.value", "c.kind")


@query("fn_19_quantize", """SELECT l_orderkey, l_linenumber, CAST(sum(round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2)) AS DECIMAL(18,2)) AS discount,
    CAST(sum(round_even(CAST(l_quantity AS DECIMAL(18,3)) + 0.345, 2)) AS DECIMAL(18,2)) AS shifted FROM lineitem GROUP BY 1, 2""")
def _(t):
    exact = F.col("l_extendedprice").cast(CENTS) * F.col("l_discount").cast(CENTS)
    shifted = F.col("l_quantity").cast("decimal(18,3)") + F.lit("0.345").cast("decimal(4,3)")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(money.quantize_cents(exact)).cast(CENTS).alias("discount"), F.sum(money.quantize_cents(shifted)).cast(CENTS).alias("shifted"))


@query("fn_20_first_digit", with_views("ledger", tail="""SELECT CAST(substr(regexp_replace(CAST(abs(amount) AS VARCHAR), '[^1-9]', '', 'g'), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM ledger GROUP BY 1"""))
def _(t):
    return t.ledger.groupBy(money.first_digit(F.col("amount")).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_21_policy_threshold", """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DECIMAL(18,2)) END AS threshold FROM supplier""")
def _(t):
    sentence = F.concat(F.lit("From 0 EUR; second approval above "), F.when(F.col("s_acctbal") > 0, F.format_number(F.abs("s_acctbal"), 2)).otherwise("0"), F.lit(" EUR is required."))
    sentence = F.translate(sentence, ",", "")
    return t.supplier.select("s_suppkey", F.get(policy.threshold_amounts(sentence), F.lit(0)).cast(CENTS).alias("threshold"))


@query("fn_21_stated_threshold", """SELECT CAST(arg_min(floor(s_acctbal), s_suppkey) AS DECIMAL(18,2)) AS threshold FROM supplier WHERE s_acctbal >= 1""")
def _(t):
    sentence = F.concat(F.lit("Zweite Freigabe ab "), F.translate(F.format_number(F.floor("s_acctbal"), 0), ",", "."), F.lit(" EUR."))
    texts = t.supplier.select(F.lit(0).alias("table_no"), F.col("s_suppkey").alias("row"), sentence.alias("text")).where("s_acctbal >= 1")
    return policy.approval_threshold(texts).select(F.col("threshold").cast(CENTS).alias("threshold"))


@query("fn_22_period_end", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS period_end FROM orders")
def _(t):
    sentence = F.concat(F.lit("Bilanz zum Stichtag: "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" aufgestellt."))
    return t.orders.select("o_orderkey", policy.period_end_date(sentence).alias("period_end"))


@query("fn_22_stated_period_end", "SELECT arg_min(CAST(o_orderdate AS DATE), o_orderkey) AS period_end FROM orders")
def _(t):
    texts = t.orders.select(F.lit(0).alias("table_no"), F.col("o_orderkey").alias("row"), F.concat(F.lit("Year-end "), F.date_format("o_orderdate", "dd.MM.yy")).alias("text"))
    return policy.balance_sheet_date(texts).select("period_end")


@query("fn_23_deterministic_json", """SELECT o_orderkey, to_json({'amount': CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'customer': o_custkey, 'missing': NULL::VARCHAR, 'status': o_orderstatus})::VARCHAR AS json FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", identity.deterministic_json(
        status=F.col("o_orderstatus"), amount=F.col("o_totalprice").cast(CENTS).cast("string"), missing=F.lit(None).cast("string"), customer=F.col("o_custkey")).alias("json"))


@query("fn_24_human_source", """SELECT doc_id, concat_ws(' · ', source, CASE WHEN doc_id % 2 = 0 THEN 'sheet ''' || lang || '''' END, 'row ' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cell A' || doc_id END,
    'passage ' || left(text, 200)) AS source_text FROM documents""")
def _(t):
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    return t.documents.select("doc_id", identity.human_source(
        F.col("source"), sheet=F.when(even, F.col("lang")), row=F.col("doc_id"), cell=F.when(third, F.concat(F.lit("A"), "doc_id")),
        page=F.lit(None), passage=text.passage(F.col("text"))).alias("source_text"))


@query("fn_25_expression_text", """SELECT l_orderkey, string_agg(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ' + ' ORDER BY l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2))) AS expression
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem) GROUP BY 1""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(CENTS).alias("amount")).distinct()
    return lines.groupBy("l_orderkey").agg(aggregates.expression_text(F.col("amount"), F.struct("l_linenumber", "amount")).alias("expression"))


@query("fn_26_day_gap", with_views("cutoff_lines", tail="""SELECT document_no, count(*) AS lines, min(date_diff('day', service_date, invoice_date)) AS least_gap, max(abs(date_diff('day', service_date, invoice_date))) AS widest FROM cutoff_lines GROUP BY 1"""))
def _(t):
    gap = dates.day_gap(F.col("invoice_date"), F.col("service_date"))
    return t.cutoff_lines.groupBy("document_no").agg(
        F.count(F.lit(1)).alias("lines"), F.min(gap).cast("long").alias("least_gap"), F.max(F.abs(gap)).cast("long").alias("widest"))


@query("fn_27_positive_difference", """SELECT o_orderkey, CASE WHEN d <= 50000 THEN 0 ELSE d END::DECIMAL(18,2) AS difference FROM (
    SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) - coalesce((SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2))) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS d FROM orders)""")
def _(t):
    billed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast(CENTS)).cast(CENTS).alias("lines"))
    joined = t.orders.select("o_orderkey", F.col("o_totalprice").cast(CENTS).alias("total")).join(billed, "o_orderkey", "left")
    return joined.select("o_orderkey", money.positive_difference(F.col("total"), F.coalesce("lines", F.lit(0).cast(CENTS)), F.lit(50000)).alias("difference"))


@query("fn_28_optional_sum", """SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' AND user_id % 4 <> 0 THEN CAST(value AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS total FROM events GROUP BY 1""")
def _(t):
    value = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 4 != 0), F.col("value").cast(CENTS))
    return t.events.groupBy("user_id").agg(aggregates.cents_sum(value).alias("total"))


@query("fn_29_redact_citations", """WITH e AS (SELECT o_custkey, 'ev_' || substr(sha256('orders|r' || o_orderkey || '|sNone|cNone|pNone|x'), 1, 16) AS id, o_orderkey FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'See ' || id || ' for proof.' ELSE 'See [unverified evidence id removed] for proof.' END AS clean,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS allowed, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS rejected FROM e""")
def _(t):
    from tallymark.operators.citations import redact_citations
    ids = t.orders.select("o_orderkey", identity.registry_id(F.lit("orders"), F.lit("x"), row=F.col("o_orderkey")).alias("evidence_id"))
    texts = ids.select(F.col("o_orderkey").alias("text_id"), F.concat(F.lit("See "), "evidence_id", F.lit(" for proof.")).alias("text"))
    out = redact_citations(texts, ids.where("o_orderkey % 3 = 0").select("evidence_id"))
    return out.select(F.col("text_id").alias("o_orderkey"), "clean", "allowed", "rejected")


@query("fn_30_reason_text", """SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 2 = 0 THEN 'Evidence is conflicting.' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Material uncertainty remains.' END,
    'Accounting judgement is required.') AS reason FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    reasons = admission.ordered_reasons(admission.reason_list(
        (F.lit(True), admission.reason("accounting_judgement")), (key % 3 == 0, admission.reason("material_uncertainty")),
        (key % 2 == 0, admission.reason("counter_evidence_conflicting"))))
    return t.orders.select("o_orderkey", admission.reason_text(reasons).alias("reason"))


