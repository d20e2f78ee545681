"""Dossier controls, admission, cases and the batch investigation."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.bindings import CENTS, with_views
from tallymark.operators import admission, cases, investigation
from tallymark.plans import registry as library
from tallymark.plans.anomalies import AnomalyDiscovery
from tallymark.plans.capitalised_repairs import CapitalisedRepairs
from tallymark.plans.payment_split import PaymentSplit
from tallymark.plans.period_cutoff import PeriodCutoff
from tallymark.plans.vendor_sod import VendorSegregation
from tallymark.queries import registry
from tallymark.queries.records import VENDOR_GATE_SQL
from tallymark.queries.tools import _REPAIRS, _SOD, REPAIRS, repair_tables, sod_tables, split_postings

query = registry.query
PARAMS = {"approval_threshold": "100000", "fiscal_year_end": "1998-12-31", "anomaly_round_multiple": "10"}


def _tests(findings):
    listed = F.array_join(F.transform("counter_tests", lambda c: F.concat_ws("=", c["name"], c["outcome"])), ",")
    return findings.withColumn("tests", listed)


@query("ctl_01_vendor_sod", _SOD + """ SELECT finding_id, vendor_id AS subject, exposure, charges AS input_count, 'independent_approval=' || CASE WHEN self_approved THEN 'absent' ELSE 'present' END || ',goods_receipt=' || CASE WHEN received THEN 'present' ELSE 'absent' END
    || ',prior_year_history=' || CASE WHEN opening THEN 'present' ELSE 'absent' END AS tests FROM f""")
def _(t):
    return _tests(VendorSegregation().run(sod_tables(t)).findings).select("finding_id", "subject", "exposure", "input_count", "tests")


@query("ctl_01_vendor_sod_inputs", _SOD + """ SELECT f.finding_id, count(*) AS inputs, CAST(sum(-amount) AS DECIMAL(18,2)) AS total FROM f JOIN ledger ON account = vendor_id WHERE amount < 0 AND posting_text <> 'Saldenvortrag Vorjahr' GROUP BY 1""")
def _(t):
    inputs = VendorSegregation().run(sod_tables(t)).inputs
    return inputs.groupBy("finding_id").agg(F.count(F.lit(1)).alias("inputs"), F.sum("value").cast(CENTS).alias("total"))


_SPLIT = with_views("ledger", tail="""SELECT account AS subject, CAST(posting_date AS VARCHAR) AS day, CAST(sum(amount) AS DECIMAL(18,2)) AS exposure, count(*) AS input_count, 'separate_invoices=' || CASE WHEN count(DISTINCT document_no) > 1 THEN 'present' ELSE 'absent' END || ',instalment_plan='
    || CASE WHEN bool_or(posting_text = 'Teilzahlung Rate') THEN 'present' ELSE 'absent' END || ',reversal_present=' || CASE WHEN bool_or(posting_text = 'Storno Rechnung') THEN 'present' ELSE 'absent' END || ',second_approval=absent' AS tests FROM ledger
    WHERE posting_kind = 'Zahlung' AND posting_text <> 'Gutschrift Lieferant' AND amount > 0 GROUP BY account, posting_date HAVING count(*) >= 2 AND sum(amount) >= 100000 AND max(amount) < 100000""")


@query("ctl_02_payment_split", _SPLIT)
def _(t):
    out = _tests(PaymentSplit().run(split_postings(t), PARAMS).findings)
    return out.select("subject", F.split_part("finding_id", F.lit("|"), F.lit(3)).alias("day"), "exposure", "input_count", "tests")


@query("ctl_03_capitalised_repairs", _REPAIRS + """ SELECT 'capitalised-repairs' AS subject, count(*) AS input_count, CAST(sum(amount) AS DECIMAL(18,2)) AS exposure, 'investment_request=' || CASE WHEN (SELECT count(*) FROM documents d JOIN (SELECT DISTINCT asset_no FROM h) a ON contains(d.text, a.asset_no)
    WHERE regexp_matches(lower(d.text), 'eau|tion')) > 0 THEN 'present' ELSE 'absent' END || ',capacity_or_useful_life=absent,separable_new_asset=absent' AS tests FROM h""")
def _(t):
    return _tests(CapitalisedRepairs(**REPAIRS).run(repair_tables(t)).findings).select("subject", "input_count", "exposure", "tests")


@query("ctl_04_cutoff", with_views("cutoff_lines", tail="""SELECT 'cutoff-subsequent-invoices' AS subject, count(*) AS input_count, CAST(sum(amount) AS DECIMAL(18,2)) AS exposure, 'strong_record_reconciliation=absent' AS tests FROM cutoff_lines
    WHERE service_date <= DATE '1998-12-31' AND invoice_date > DATE '1998-12-31' AND amount <> 0"""))
def _(t):
    return _tests(PeriodCutoff().run({"lines": t.cutoff_lines}, PARAMS).findings).select("subject", "input_count", "exposure", "tests")


_ANOMALY = f"""WITH l AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN floor(value) * 1000 ELSE value END AS v FROM events), ledger AS (SELECT event_type AS document_no, CAST(v AS DECIMAL(18,2)) AS amount FROM l),
    r AS (SELECT count(*) AS n, CAST(sum(abs(amount)) AS DECIMAL(18,2)) AS e FROM ledger WHERE abs(amount) >= 1000 AND amount % 10 = 0), d AS (SELECT document_no, amount, count(*) AS n, CAST((count(*) - 1) * abs(amount) AS DECIMAL(18,2)) AS e FROM ledger GROUP BY 1, 2 HAVING count(*) >= 2),
    b AS (SELECT CAST(substr(regexp_replace(CAST(abs(amount) AS VARCHAR), '[^1-9]', '', 'g'), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM ledger WHERE amount <> 0 GROUP BY 1), x(digit, p) AS (VALUES {", ".join(f"({k}, {p})" for k, p in V.BENFORD.items())}),
    w AS (SELECT * FROM (SELECT x.digit, coalesce(b.n, 0) AS n, abs(coalesce(b.n, 0) / (SELECT sum(n) FROM b) - p) AS gap FROM x LEFT JOIN b USING (digit)) WHERE gap > 0.05)
    SELECT 'anomaly:round-number-postings' AS subject, n AS input_count, e AS exposure, 'HUMAN_REVIEW' AS verdict FROM r WHERE n > 0 UNION ALL SELECT 'anomaly:duplicate-reference:' || document_no || ':' || CAST(abs(amount) AS VARCHAR), n, e, 'HUMAN_REVIEW' FROM d
    UNION ALL SELECT 'anomaly:benford-first-digit', (SELECT n FROM w ORDER BY gap DESC, digit LIMIT 1), 0, 'HUMAN_REVIEW' WHERE (SELECT count(*) FROM w) > 0"""


def anomaly_ledger(t):
    value = F.when(F.col("event_id") % 4 == 0, F.floor("value") * 1000).otherwise(F.col("value"))
    return t.events.select(F.col("event_type").alias("document_no"), F.col("user_id").cast("string").alias("account"), value.cast(CENTS).alias("amount"), t._event_id.alias("evidence_id"))


@query("ctl_05_benford_inputs", _ANOMALY.split("    SELECT 'anomaly:round-number-postings' AS subject")[0].replace("gap > 0.05", "gap > 0.005") + """, worst AS (SELECT digit FROM w ORDER BY gap DESC, digit LIMIT 1)
    SELECT CAST(abs(amount) AS DECIMAL(18,2)) AS value, count(*) AS postings FROM ledger WHERE amount <> 0 AND CAST(substr(regexp_replace(CAST(abs(amount) AS VARCHAR), '[^1-9]', '', 'g'), 1, 1) AS INTEGER) = (SELECT digit FROM worst) GROUP BY 1""")
def _(t):
    """Every posting of the worst digit is an input of its signal, here at a narrow limit."""
    inputs = AnomalyDiscovery().run({"ledger": anomaly_ledger(t)}, PARAMS | {"anomaly_benford_max_abs_deviation": "0.005"}).inputs.where("finding_id = 'anomaly:benford-first-digit'")
    return inputs.groupBy("value").agg(F.count(F.lit(1)).alias("postings"))


@query("ctl_05_anomalies", _ANOMALY)
def _(t):
    found = AnomalyDiscovery().run({"ledger": anomaly_ledger(t)}, PARAMS).findings
    return admission.admit_findings(found).select("subject", F.col("input_count").cast("long").alias("input_count"), "exposure", "verdict")


def all_findings(t):
    tables = {"vendor_sod": sod_tables(t), "split_payment": split_postings(t), "cutoff": {"lines": t.cutoff_lines}, "anomaly_discovery": {"ledger": anomaly_ledger(t)}, "capitalisation": repair_tables(t)}
    controls = [VendorSegregation(), PaymentSplit(), CapitalisedRepairs(**REPAIRS), PeriodCutoff(), AnomalyDiscovery()]
    return library.run_controls(tables, PARAMS, controls)


_PARTS = ("vendor_sod", _SOD + " SELECT exposure FROM f"), ("split_payment", _SPLIT), ("capitalisation", registry.oracles["ctl_03_capitalised_repairs"]), ("cutoff", registry.oracles["ctl_04_cutoff"]), ("anomaly_discovery", _ANOMALY)


@query("set_06_union_of_findings", " UNION ALL ".join(
    f"SELECT {V.CONTROL_ORDER.index(name) + 1}::BIGINT AS run_order, '{name}' AS control_id, count(*) AS findings, CAST(sum(exposure) AS DECIMAL(18,2)) AS exposure FROM ({sql}) GROUP BY ALL HAVING count(*) > 0" for name, sql in _PARTS))
def _(t):
    out = library.in_run_order(all_findings(t).findings)
    return out.groupBy("run_order", "control_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("exposure").cast(CENTS).alias("exposure"))


@query("srt_09_run_order", _SOD + """ SELECT 1::BIGINT AS run_order, 'vendor_sod' AS control_id, vendor_id AS subject, count(*) AS findings FROM f GROUP BY 3""")
def _(t):
    out = library.in_run_order(VendorSegregation().run(sod_tables(t)).findings)
    return out.groupBy("run_order", "control_id", "subject").agg(F.count(F.lit(1)).alias("findings"))


@query("srt_04_canonical_order", _SOD + " SELECT vendor_id AS subject, exposure, finding_id FROM f")
def _(t):
    return VendorSegregation().run(sod_tables(t)).findings.orderBy("subject", "title", "finding_id").select("subject", "exposure", "finding_id")


# --- admission -----------------------------------------------------------------------------------

def candidates(t):
    """One candidate per order with one defect by its key, so every branch of the gate is taken."""
    k = F.col("o_orderkey")
    ids = lambda *cols: F.array(*cols).cast("array<string>")
    none = F.array().cast("array<string>")
    e1, e2 = F.concat(F.lit("e"), k), F.concat(F.lit("f"), k)
    net = F.col("o_totalprice").cast(CENTS)
    search = F.when(k % 16 != 4, F.struct(F.lit("ledger").alias("scope"), F.lit("exact").alias("method"), F.array(F.lit("orders")).alias("searched_sources"), ids(e2).alias("evidence_ids")))
    outcome = F.when(k % 16 == 5, "present").when(k % 16 == 6, "conflicting").when(k % 16 == 7, "unknown").when(k % 16 == 8, "not_applicable").otherwise("searched_absent")
    test_ids = F.when(k % 16 == 9, ids(F.lit("missing"))).when(k % 16 == 14, none).otherwise(ids(e2))
    ref = lambda e, content: F.struct(e.alias("evidence_id"), F.lit(content).alias("content"))
    tests = F.array(F.struct(F.lit("counter").alias("name"), outcome.alias("outcome"), F.lit("looked").alias("detail"), (k % 16 != 10).alias("required"), test_ids.alias("evidence_ids"), search.alias("search")))
    return t.orders.select(
        k.alias("o_orderkey"), F.lit("eng").alias("engagement_id"), F.lit("run").alias("run_id"), F.when(k % 16 == 1, "legacy").otherwise("ctl").alias("control_id"), F.lit("1").alias("control_version"), k.cast("string").alias("subject"), net.alias("exposure"),
        F.struct(F.lit("x").alias("expression"), F.array(F.struct(F.lit("i").alias("label"), net.alias("value"), e1.alias("evidence_id"))).alias("inputs"), F.when(k % 16 == 2, net + 1).otherwise(net).cast(CENTS).alias("result"), F.lit("").alias("sql")).alias("calculation"),
        F.when(k % 16 == 3, F.array(ref(e1, "a"), ref(e1, "b"), ref(e2, "c"))).otherwise(F.array(ref(e1, "a"), ref(e2, "c"))).alias("evidence_refs"),
        tests.alias("counter_tests"), F.struct((k % 16 == 11).alias("conflicting_evidence"), (k % 16 == 12).alias("material_uncertainty"), (k % 16 == 12).alias("accounting_judgement"), F.lit(False).alias("incomplete_supporting_evidence")).alias("signals"),
        F.when(k % 16 == 13, "open").alias("uncertainty"),
        F.struct(F.lit("eng").alias("engagement_id"), F.when(k % 16 == 15, "other").otherwise("run").alias("run_id"), F.when(k % 16 == 1, "legacy").otherwise("ctl").alias("control_id"), F.lit("1").alias("control_version"), F.lit("v").alias("runtime_version"),
                 F.array(F.struct(F.lit("n").alias("name"), F.lit("1").alias("value"))).alias("inputs"), ids(e1).alias("evidence_ids"), F.array(F.struct(F.lit("n").alias("name"), e1.alias("evidence_id"))).alias("bindings")).alias("replay"))


_ADMIT = """CASE o_orderkey % 16 WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'HUMAN_REVIEW' WHEN 5 THEN 'DISMISSED' WHEN 6 THEN 'HUMAN_REVIEW' WHEN 7 THEN 'HUMAN_REVIEW' WHEN 9 THEN 'REJECTED' WHEN 10 THEN 'HUMAN_REVIEW'
    WHEN 11 THEN 'HUMAN_REVIEW' WHEN 12 THEN 'HUMAN_REVIEW' WHEN 13 THEN 'HUMAN_REVIEW' WHEN 14 THEN 'HUMAN_REVIEW' WHEN 15 THEN 'REJECTED' ELSE 'CONFIRMED' END"""
_CODES = """CASE o_orderkey % 16 WHEN 1 THEN 'control_support_missing' WHEN 2 THEN 'calculation_support_missing' WHEN 3 THEN 'evidence_chain_missing' WHEN 4 THEN 'counter_test_incomplete' WHEN 5 THEN 'counter_evidence_present' WHEN 6 THEN 'counter_evidence_conflicting'
    WHEN 7 THEN 'counter_test_incomplete' WHEN 9 THEN 'evidence_chain_missing' WHEN 10 THEN 'counter_test_incomplete' WHEN 11 THEN 'counter_evidence_conflicting' WHEN 12 THEN 'material_uncertainty,accounting_judgement' WHEN 13 THEN 'material_uncertainty'
    WHEN 14 THEN 'counter_test_incomplete' WHEN 15 THEN 'calculation_support_missing' ELSE 'evidence_and_controls_support' END"""


@query("adm_01_admit_candidates", f"SELECT o_orderkey, {_ADMIT} AS verdict, {_CODES} AS codes FROM orders")
def _(t):
    return admission.admit_candidates(candidates(t)).select("o_orderkey", "verdict", F.array_join("reasons.code", ",").alias("codes"))


@query("adm_02_rejection_reasons", f"SELECT o_orderkey, CASE WHEN {_ADMIT} = 'REJECTED' THEN {_CODES} ELSE '' END AS codes FROM orders")
def _(t):
    return candidates(t).select("o_orderkey", F.array_join(admission.ordered_reasons(admission.rejection_reasons())["code"], ",").alias("codes"))


@query("adm_03_counter_test_reasons", """SELECT o_orderkey, CASE WHEN o_orderkey % 16 = 5 THEN 'counter_evidence_present' ELSE '' END AS dismiss, CASE o_orderkey % 16 WHEN 4 THEN 'counter_test_incomplete' WHEN 6 THEN 'counter_evidence_conflicting' WHEN 7 THEN 'counter_test_incomplete'
    WHEN 9 THEN 'counter_test_incomplete' WHEN 14 THEN 'counter_test_incomplete' ELSE '' END AS review FROM orders""")
def _(t):
    tests, available = F.col("counter_tests"), F.col("evidence_refs.evidence_id")
    return candidates(t).select("o_orderkey", F.array_join(admission.dismissal_reasons(tests, available)["code"], ",").alias("dismiss"), F.array_join(admission.review_reasons(tests, available)["code"], ",").alias("review"))


@query("adm_04_search_validity", "SELECT o_orderkey, o_orderkey % 16 NOT IN (4, 9, 14) AS valid FROM orders")
def _(t):
    return candidates(t).select("o_orderkey", admission.valid_search(F.col("counter_tests")[0], F.col("evidence_refs.evidence_id")).alias("valid"))


@query("adm_05_signal_reasons", """SELECT o_orderkey, CASE o_orderkey % 16 WHEN 10 THEN 'counter_test_incomplete' WHEN 11 THEN 'counter_evidence_conflicting' WHEN 12 THEN 'material_uncertainty,accounting_judgement' WHEN 13 THEN 'material_uncertainty' ELSE '' END AS codes FROM orders""")
def _(t):
    return candidates(t).select("o_orderkey", F.array_join(admission.ordered_reasons(admission.signal_reasons())["code"], ",").alias("codes"))


@query("adm_06_admit_findings", _SPLIT.replace("SELECT account AS subject", "SELECT 'HUMAN_REVIEW' AS verdict, 'counter_test_incomplete' AS codes, account AS subject"))
def _(t):
    out = admission.admit_findings(_tests(PaymentSplit().run(split_postings(t), PARAMS).findings))
    return out.select("verdict", F.array_join("reasons.code", ",").alias("codes"), "subject", F.split_part("finding_id", F.lit("|"), F.lit(3)).alias("day"), "exposure", "input_count", "tests")


@query("adm_07_inconsistent_evidence", "SELECT o_orderkey, o_orderkey % 16 = 3 AS inconsistent FROM orders")
def _(t):
    return candidates(t).select("o_orderkey", admission.inconsistent_evidence(F.col("evidence_refs")).alias("inconsistent"))


@query("adm_08_reason_text", f"SELECT {_ADMIT} AS verdict, {_CODES} AS codes, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    out = admission.admit_candidates(candidates(t))
    codes = {text: code for code, text in V.REASON_TEXT.items()}
    back = F.col("reason_text")
    for text, code in codes.items():
        back = F.replace(back, F.lit(text), F.lit(code))
    return out.select("verdict", F.replace(back, F.lit(" "), F.lit(",")).alias("codes")).groupBy("verdict", "codes").agg(F.count(F.lit(1)).alias("n"))


@query("adm_09_record_candidates", f"""SELECT vendor_id AS subject, CASE status WHEN 'dismissed' THEN 'DISMISSED' WHEN 'review_needed' THEN 'HUMAN_REVIEW' ELSE CASE WHEN still_open THEN 'HUMAN_REVIEW' ELSE 'CONFIRMED' END END AS verdict, exposure FROM ({VENDOR_GATE_SQL})""")
def _(t):
    from tallymark.plans.vendor_integrity import VendorIntegrity
    from tallymark.queries.records import VENDOR_PARAMETERS, vendor_tables
    outcomes = VendorIntegrity().evaluate(vendor_tables(t), VENDOR_PARAMETERS)
    return admission.admit_candidates(admission.candidates_from_outcomes(outcomes, "eng", "run")).select("subject", "verdict", "exposure")


# --- cases ---------------------------------------------------------------------------------------

def vendor_cases(t):
    found = VendorSegregation().run(sod_tables(t))
    return cases.case_records(admission.admit_findings(found.findings), "eng", "run"), found.inputs


_VERDICT = "CASE WHEN NOT self_approved OR received OR opening THEN 'DISMISSED' ELSE 'HUMAN_REVIEW' END"


@query("adm_09_case_records", _SOD + f" SELECT finding_id, vendor_id AS subject, {_VERDICT} AS verdict, CAST(exposure AS VARCHAR) AS amount, 'EUR' AS currency, 'gross' AS label FROM f")
def _(t):
    return vendor_cases(t)[0].select("finding_id", "subject", "verdict", "financial_exposure.amount", "financial_exposure.currency", "financial_exposure.label")


@query("snk_07_case_bundle", _SOD + f" SELECT vendor_id AS subject, {_VERDICT} AS verdict, CAST(exposure AS VARCHAR) AS amount, count(*) AS n FROM f GROUP BY 1, 2, 3")
def _(t):
    texts = cases.bundle_json(vendor_cases(t)[0])
    read = lambda path: F.get_json_object("case_json", path)
    return texts.groupBy(read("$.subject").alias("subject"), read("$.verdict").alias("verdict"), read("$.financial_exposure.amount").alias("amount")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_25_engagement_counts", _SOD + f""" SELECT count(*) AS cases, count(CASE WHEN {_VERDICT} = 'CONFIRMED' THEN 1 END) AS confirmed, count(CASE WHEN {_VERDICT} = 'HUMAN_REVIEW' THEN 1 END) AS human_review, count(CASE WHEN {_VERDICT} = 'DISMISSED' THEN 1 END) AS dismissed,
    count(CASE WHEN {_VERDICT} = 'REJECTED' THEN 1 END) AS rejected, 2::BIGINT AS source_files, ((SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events))::BIGINT AS events FROM f""")
def _(t):
    from tallymark.operators.aggregates import table_summary
    return cases.engagement_counts(vendor_cases(t)[0], table_summary({"lineitem": t.lineitem, "events": t.events}))


@query("adm_10_compile_summary", f"SELECT count(CASE WHEN {_ADMIT} = 'CONFIRMED' THEN 1 END) AS confirmed, count(CASE WHEN {_ADMIT} = 'HUMAN_REVIEW' THEN 1 END) AS human_review, count(CASE WHEN {_ADMIT} = 'DISMISSED' THEN 1 END) AS dismissed, count(CASE WHEN {_ADMIT} = 'REJECTED' THEN 1 END) AS rejected FROM orders")
def _(t):
    from tallymark.operators.aggregates import verdict_counts
    return verdict_counts(admission.admit_candidates(candidates(t)))


@query("adm_11_evidence_pool", _SOD + " SELECT finding_id, vendor_id AS subject FROM f WHERE charges > 0")
def _(t):
    charges = VendorSegregation().charges(sod_tables(t)).withColumnRenamed("account", "subject")
    return cases.citing_findings(vendor_cases(t)[0], charges)


@query("adm_12_reviewer_decision", f"""WITH d AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS decision, max(o_orderdate) AS decided_at FROM orders GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_name, decision, decided_at FROM customer LEFT JOIN d ON c_custkey = o_custkey""")
def _(t):
    decisions = t.orders.select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderpriority").alias("decision"), F.col("o_orderdate").alias("decided_at"))
    return cases.with_decision(t.customer.select(F.col("c_custkey").cast("string").alias("case_id"), "c_name"), decisions)


@query("adm_13_case_board", f"SELECT {_ADMIT} AS verdict, count(*) AS cases, CAST(CASE {_ADMIT} WHEN 'CONFIRMED' THEN 1 WHEN 'HUMAN_REVIEW' THEN 2 WHEN 'DISMISSED' THEN 3 ELSE 4 END AS BIGINT) AS place FROM orders GROUP BY 1, 3")
def _(t):
    return cases.board(admission.admit_candidates(candidates(t))).withColumn("place", F.col("place").cast("long"))


# --- investigation -------------------------------------------------------------------------------

_PLAN = ", ".join(f"('{c}', {i + 1}, '{tool}')" for c, ts in V.CATEGORY_PLAN.items() for i, tool in enumerate(ts))
_CATEGORY = "list_extract(['vendor_sod', 'split_payment', 'capitalisation', 'cutoff', 'anomaly_discovery'], o_orderkey % 5 + 1)"


def hypotheses(t):
    category = F.element_at(F.array(*[F.lit(c) for c in ("vendor_sod", "split_payment", "capitalisation", "cutoff", "anomaly_discovery")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").cast("string").alias("hypothesis_id"), category.alias("category"), F.col("o_custkey").cast("string").alias("subject"), F.col("o_custkey").cast("string").alias("investigation_id"), F.col("o_orderkey"), F.col("o_totalprice").cast(CENTS).alias("exposure"), F.col("o_orderdate").alias("updated_at"))


def tool_results(t):
    spend = t.orders.groupBy(F.col("o_custkey").cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("evidence_count"), F.max("o_orderkey").cast("string").alias("result"))
    return spend.where("evidence_count > 8").withColumn("tool", F.explode(F.array(*[F.lit(x) for x in ("compare_peer_vendors", "find_reversal", "test_period_cutoff")])))


_STEPS = f"""WITH plan(category, step, tool) AS (VALUES {_PLAN}), r AS (SELECT o_custkey, count(*) AS n, CAST(max(o_orderkey) AS VARCHAR) AS result FROM orders GROUP BY 1 HAVING count(*) > 8), s AS (SELECT CAST(o_orderkey AS VARCHAR) AS hypothesis_id, p.category, CAST(o.o_custkey AS VARCHAR) AS subject, step, tool,
    tool IN ('compare_peer_vendors', 'find_reversal', 'test_period_cutoff') AND r.n IS NOT NULL AS ok, CASE WHEN tool IN ('compare_peer_vendors', 'find_reversal', 'test_period_cutoff') THEN coalesce(r.n, 0) ELSE 0 END AS evidence_count,
    CASE WHEN tool IN ('compare_peer_vendors', 'find_reversal', 'test_period_cutoff') THEN r.result END AS result FROM orders o JOIN plan p ON p.category = {_CATEGORY} LEFT JOIN r ON r.o_custkey = o.o_custkey)"""


@query("inv_01_tool_plan", f"WITH plan(category, step, tool) AS (VALUES {_PLAN}) SELECT {_CATEGORY} AS category, step, tool, count(*) AS hypotheses FROM orders JOIN plan ON plan.category = {_CATEGORY} GROUP BY 1, 2, 3")
def _(t):
    planned = hypotheses(t).join(F.broadcast(investigation.tool_plan(t.spark)), "category")
    return planned.groupBy("category", "step", "tool").agg(F.count(F.lit(1)).alias("hypotheses"))


@query("inv_02_rank_hypotheses", f"""SELECT {_CATEGORY} AS category, count(*) AS findings, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS exposure, CASE o_orderkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 60 WHEN 2 THEN 70 WHEN 3 THEN 80 ELSE 50 END AS priority FROM orders GROUP BY 1, 4""")
def _(t):
    return investigation.rank_hypotheses(hypotheses(t).withColumnRenamed("category", "control_id"))


@query("srt_08_top_hypotheses", f"""SELECT {_CATEGORY} AS category, CASE o_orderkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 60 WHEN 2 THEN 70 WHEN 3 THEN 80 ELSE 50 END AS priority FROM orders GROUP BY 1, 2 ORDER BY priority DESC LIMIT 2""")
def _(t):
    return investigation.rank_hypotheses(hypotheses(t).withColumnRenamed("category", "control_id"), limit=2).select("category", "priority")


@query("inv_03_timeline", _STEPS + " SELECT hypothesis_id, category, subject, step, tool, ok, evidence_count, result FROM s")
def _(t):
    return investigation.timeline(hypotheses(t), tool_results(t))


@query("inv_04_verdict_status", f"""SELECT o_orderkey, {_ADMIT} AS verdict, CASE {_ADMIT} WHEN 'CONFIRMED' THEN 'submitted' WHEN 'DISMISSED' THEN 'dismissed' WHEN 'HUMAN_REVIEW' THEN 'awaiting_auditor' ELSE 'insufficient_evidence' END AS status,
    CASE {_ADMIT} WHEN 'CONFIRMED' THEN 'confirm' WHEN 'DISMISSED' THEN 'dismiss' WHEN 'HUMAN_REVIEW' THEN 'human_review' ELSE 'reject' END AS recommendation FROM orders""")
def _(t):
    return investigation.verdict_status(admission.admit_candidates(candidates(t)).select("o_orderkey", "verdict"))


@query("inv_05_counter_evidence", _STEPS + " SELECT hypothesis_id, step, tool, ok FROM s WHERE tool IN ('find_reversal', 'find_credit_note', 'find_independent_approval', 'find_contract_or_service_evidence', 'compare_peer_vendors')")
def _(t):
    return investigation.counter_evidence(investigation.timeline(hypotheses(t), tool_results(t))).select("hypothesis_id", "step", "tool", "ok")


@query("inv_06_grounded_summary", f"""WITH h AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 7, {_CATEGORY}, o_orderstatus, o_orderkey)) AS k FROM orders GROUP BY 1)
    SELECT CAST(h.o_custkey AS VARCHAR) AS investigation_id, 'The leading hypothesis (' || {_CATEGORY} || ', status ' || o_orderstatus || ') has ' || (o_orderkey % 4) || ' supporting and ' || (o_orderkey % 3) || ' contradicting evidence items. Candidate exposure ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    || '.' || CASE WHEN o_orderkey % 2 = 0 THEN ' Admission recommends dismiss.' ELSE '' END AS summary FROM h JOIN orders o ON o.o_orderkey = h.k""")
def _(t):
    k = F.col("o_orderkey")
    # The order key breaks ties inside the category text so that one hypothesis leads.
    rows = hypotheses(t).join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey").select(
        "investigation_id", "category", F.col("o_orderstatus").alias("status"), F.struct((k % 7).alias("a"), F.col("category").alias("b"), F.col("o_orderstatus").alias("c"), k.alias("d")).alias("priority"),
        (k % 4).alias("supporting"), (k % 3).alias("contradicting"), "exposure", F.when(k % 2 == 0, "dismiss").otherwise("undecided").alias("recommendation"))
    return investigation.grounded_summary(rows).select("investigation_id", "summary")


@query("inv_07_investigation_list", "SELECT CAST(o_custkey AS VARCHAR) AS investigation_id, count(*) AS hypotheses, max(o_orderdate) AS updated_at FROM orders GROUP BY 1")
def _(t):
    return investigation.investigation_list(hypotheses(t))


