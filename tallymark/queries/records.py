"""Record controls and allocation over the given tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallymark.bindings import CENTS, with_views
from tallymark.operators import aggregates, allocation, bands
from tallymark.plans.capex import CapexParameters, CapitalExpenditure, collapse_business_records
from tallymark.plans.purchase_match import ThreeWayMatch, collapse_repeats
from tallymark.plans.split_records import SplitParameters, SplitPayments
from tallymark.plans.vendor_integrity import VendorIntegrity, VendorParameters
from tallymark.plans.yearend import CutoffParameters, YearEndCutoff, collapse_receipts
from tallymark.queries import registry
from tallymark.queries.joins import payments_with_reversals
from tallymark.session import materialize

query = registry.query


# --- split payments ------------------------------------------------------------------------------

def split_tables(t):
    rows = payments_with_reversals(t)
    number = F.regexp_replace("payment_id", "[RS]", "").cast("long")
    return {"payments": rows.select(
        "payment_id", "payee", "payment_date", F.when(F.length("payee") > 1, "batch a").otherwise("Batch  B").alias("payment_reference"), "amount",
        F.when(number % 12 != 0, F.col("reversal_of")).alias("reversal_of"),
        F.when(number % 7 == 0, F.concat(F.lit("o"), number)).alias("obligation_id"), F.lit(None).cast("string").alias("installment_plan_id"),
        (number % 31 == 0).alias("second_approval"), F.col("payment_id").alias("evidence_id"))}


def _as_normalised(t):
    from tallymark.functions.text import normalize_identifier
    return materialize(split_tables(t)["payments"].withColumns({"payee": normalize_identifier(F.col("payee")), "reference": normalize_identifier(F.col("payment_reference"))}))


# One recursion per payee and size: reversals in order, each seeing what earlier ones have taken.
_RESOLVED = """WITH RECURSIVE p AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS payee, CAST(ts AS DATE) AS d, CAST(value AS DECIMAL(18,2)) AS a, NULL::VARCHAR AS rev FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'R' || event_id, CAST(user_id AS VARCHAR), CAST(ts AS DATE) + CAST(event_id % 3 - 1 AS INTEGER), CAST(-value AS DECIMAL(18,2)), CASE WHEN event_id % 12 <> 0 THEN CAST(event_id AS VARCHAR) END FROM events WHERE event_type = 'purchase' AND event_id % 4 = 0
    UNION ALL SELECT 'S' || event_id, CAST(user_id AS VARCHAR), CAST(ts AS DATE) + 2, CAST(-value AS DECIMAL(18,2)), CASE WHEN event_id % 12 <> 0 THEN CAST(event_id AS VARCHAR) END FROM events WHERE event_type = 'purchase' AND event_id % 6 = 0),
    pay AS (SELECT payee, a AS size, list({'d': d, 'id': id}) AS ps FROM p WHERE a > 0 GROUP BY 1, 2),
    rev AS (SELECT payee, -a AS size, id, d, rev, row_number() OVER (PARTITION BY payee, a ORDER BY d, id) AS k FROM p WHERE a < 0),
    step AS (SELECT DISTINCT payee, size, 0::BIGINT AS k, NULL::VARCHAR AS reversal_id, NULL::VARCHAR AS reversal_of, NULL::DATE AS reversal_date, NULL::VARCHAR AS target_id, NULL::VARCHAR AS reason, []::VARCHAR[] AS used FROM rev
      UNION ALL
      SELECT payee, size, k, id, rev, d, target, why, CASE WHEN target IS NULL THEN used ELSE list_append(used, target) END FROM (
        SELECT payee, size, k, id, rev, d, used,
          CASE WHEN rev IS NOT NULL THEN CASE WHEN due <= d AND NOT list_contains(used, rev) THEN rev END WHEN len(open) = 1 THEN open[1] END AS target,
          CASE WHEN rev IS NOT NULL THEN CASE WHEN due IS NULL OR list_contains(used, rev) THEN 'explicit reversal target is missing, incompatible, or already reversed' WHEN due > d THEN 'explicit reversal predates its referenced payment' ELSE 'explicit reversal matched its referenced payment' END
            WHEN len(open) = 1 THEN 'unique equal-and-opposite payment matched by payee and reference' WHEN len(open) = 0 THEN 'no equal-and-opposite payment matched the reversal' ELSE 'multiple payments could match the reversal' END AS why
        FROM (SELECT rev.*, step.used, list_filter(ps, lambda x: x.id = rev.rev)[1].d AS due, list_transform(list_filter(coalesce(ps, []), lambda x: x.d <= rev.d AND NOT list_contains(step.used, x.id)), lambda x: x.id) AS open
              FROM step JOIN rev ON rev.payee = step.payee AND rev.size = step.size AND rev.k = step.k + 1 LEFT JOIN pay ON pay.payee = rev.payee AND pay.size = rev.size)))"""


@query("alloc_01_resolve_reversals", _RESOLVED + " SELECT reversal_id, target_id, reason FROM step WHERE k > 0")
def _(t):
    return allocation.resolve_reversals(_as_normalised(t)).select("reversal_id", "target_id", "reason")


# With explicit links only, the first reversal in order takes its target, which SQL can say.
@query("alloc_01_explicit_only", """WITH p AS (SELECT CAST(event_id AS VARCHAR) AS id, user_id, CAST(ts AS DATE) AS d, CAST(value AS DECIMAL(18,2)) AS a, NULL::VARCHAR AS rev FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'R' || event_id, user_id, CAST(ts AS DATE) + CAST(event_id % 3 - 1 AS INTEGER), CAST(-value AS DECIMAL(18,2)), CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND event_id % 4 = 0
    UNION ALL SELECT 'S' || event_id, user_id, CAST(ts AS DATE) + 2, CAST(-value AS DECIMAL(18,2)), CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND event_id % 6 = 0),
    r AS (SELECT r.id AS reversal_id, t.id AS target, r.d <= t.d - 1 AS early, row_number() OVER (PARTITION BY t.id, r.d >= t.d ORDER BY r.d, r.id) AS rn, count(*) FILTER (WHERE r.d >= t.d) OVER (PARTITION BY t.id ORDER BY r.d, r.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM p r JOIN p t ON r.rev = t.id WHERE r.a < 0)
    SELECT reversal_id, CASE WHEN NOT early AND rn = 1 THEN target END AS target_id, CASE WHEN before > 0 THEN 'explicit reversal target is missing, incompatible, or already reversed'
        WHEN early THEN 'explicit reversal predates its referenced payment' ELSE 'explicit reversal matched its referenced payment' END AS reason FROM r""")
def _(t):
    rows = materialize(payments_with_reversals(t).withColumn("reference", F.lit("R")))
    return allocation.resolve_reversals(rows).select("reversal_id", "target_id", "reason")


_OPEN = _RESOLVED + """, open_ones AS (SELECT * FROM step WHERE k > 0 AND target_id IS NULL), g AS (SELECT DISTINCT payee, d FROM p WHERE a > 0),
    r AS (SELECT DISTINCT p.payee, p.d, o.reason FROM open_ones o JOIN p ON p.id = o.reversal_of AND p.payee = o.payee WHERE p.a > 0
      UNION SELECT g.payee, g.d, o.reason FROM g JOIN open_ones o ON o.payee = g.payee AND o.reversal_date >= g.d)"""


@query("alloc_02_unresolved_reversals", _OPEN + """ SELECT payee, d AS payment_date, CASE WHEN length(payee) > 1 THEN 'BATCH A' ELSE 'BATCH B' END AS reference, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM r GROUP BY payee, d""")
def _(t):
    control = SplitPayments()
    payments = _as_normalised(t)
    groups = payments.where("amount > 0").groupBy("payee", "payment_date", "reference").agg(F.count(F.lit(1)).alias("n"))
    open_ones = allocation.resolve_reversals(payments).where("target_id is null")
    out = control.open_reasons(groups, payments.where("amount > 0"), open_ones)
    return out.select("payee", "payment_date", "reference", F.array_join(F.array_sort("open_reasons"), "; ").alias("reasons"))


@query("ctl_06_split_records", _OPEN + """, m AS (SELECT p.payee, p.d, p.id, p.a, s.target_id IS NOT NULL AS gone, CAST(p.id AS BIGINT) % 7 = 0 AS ob, CAST(p.id AS BIGINT) % 31 = 0 AS ap FROM p LEFT JOIN (SELECT DISTINCT target_id FROM step) s ON s.target_id = p.id WHERE p.a > 0),
    w AS (SELECT payee, d, count(*) AS payments, CAST(sum(a) AS DECIMAL(18,2)) AS raw_total, count(*) FILTER (WHERE NOT gone) AS active, CAST(coalesce(sum(a) FILTER (WHERE NOT gone), 0) AS DECIMAL(18,2)) AS exposure, max(a) FILTER (WHERE NOT gone) AS hi,
        bool_and(ob) AS all_ob, bool_or(ob) AS any_ob, bool_or(ap) AS ap, bool_or(gone) AS any_gone, string_agg(CAST(a AS VARCHAR), ' + ' ORDER BY id) AS terms FROM m GROUP BY payee, d HAVING count(*) >= 2 AND max(a) < 100 AND sum(a) >= 100),
    o AS (SELECT payee, d, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM r GROUP BY payee, d),
    x AS (SELECT w.*, reasons, any_ob AND NOT all_ob AS part FROM w LEFT JOIN o USING (payee, d))
    SELECT payee || '/' || d || '/' || CASE WHEN length(payee) > 1 THEN 'BATCH A' ELSE 'BATCH B' END AS subject,
        CASE WHEN reasons IS NOT NULL OR part THEN 'review_needed' WHEN all_ob OR ap THEN 'dismissed' WHEN active >= 2 AND hi < 100 AND exposure >= 100 THEN 'confirmed_candidate' ELSE 'dismissed' END AS status,
        exposure, payments, raw_total, active, concat_ws('; ', CASE WHEN part THEN 'contractual-obligation identifiers are incomplete or duplicated' END, reasons) AS uncertainty,
        CASE WHEN reasons IS NOT NULL THEN 'unresolved' WHEN any_gone THEN 'accounted_for' ELSE 'not_found' END || ',' || CASE WHEN all_ob THEN 'accounted_for' WHEN any_ob THEN 'unresolved' ELSE 'not_found' END || ',not_found,' || CASE WHEN ap THEN 'accounted_for' ELSE 'not_found' END AS tests,
        terms || ' = ' || raw_total AS expression FROM x""")
def _(t):
    out = SplitPayments().evaluate(split_tables(t), SplitParameters(Decimal(100)))
    return out.select("subject", "status", "exposure", "payments", "raw_total", "active", F.array_join("uncertainty", "; ").alias("uncertainty"),
                      F.array_join(F.transform("counter_tests", lambda c: c["status"]), ",").alias("tests"), F.col("calculation_steps")[0]["expression"].alias("expression"))


@query("ctl_06_split_without_reversals", """WITH g AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, max(CAST(value AS DECIMAL(18,2))) AS hi, min(CAST(value AS DECIMAL(18,2))) AS lo,
    count(CASE WHEN event_id % 7 = 0 THEN 1 END) AS ob, count(DISTINCT CASE WHEN event_id % 7 = 0 THEN event_id END) AS obd, bool_or(event_id % 31 = 0) AS ap FROM events WHERE event_type = 'purchase' AND value > 0 GROUP BY 1, 2)
    SELECT user_id || '/' || d || '/' || CASE WHEN user_id > 9 THEN 'BATCH A' ELSE 'BATCH B' END AS subject, CASE WHEN ob > 0 AND NOT (ob = n AND obd = n) THEN 'review_needed' WHEN ob = n OR ap THEN 'dismissed' ELSE 'confirmed_candidate' END AS status,
    total AS exposure, n AS payments FROM g WHERE n >= 2 AND lo > 0 AND hi < 100 AND total >= 100""")
def _(t):
    tables = {"payments": split_tables(t)["payments"].where("amount > 0")}
    return SplitPayments().evaluate(tables, SplitParameters(Decimal(100))).select("subject", "status", "exposure", "payments")


# --- vendor integrity ----------------------------------------------------------------------------

_VENDOR_VIEWS = """lifecycle AS (SELECT CAST(user_id AS VARCHAR) AS vendor_id, CASE event_type WHEN 'signup' THEN 'created' ELSE 'approved' END AS kind, 'U' || (event_id % 40) AS user_id, CAST(ts AS DATE) AS event_date, event_id AS record_id FROM events
        WHERE event_type IN ('signup', 'click') AND user_id % 9 <> 0 AND (event_type <> 'click' OR user_id % 4 <> 0)),
    permissions AS (SELECT 'U' || (event_id % 40) AS user_id, CASE event_id % 3 WHEN 0 THEN 'create_vendor' WHEN 1 THEN 'execute_payment' ELSE 'post_supplier_invoice' END AS permission FROM events WHERE event_id % 50 = 0),
    invoices AS (SELECT CAST(user_id AS VARCHAR) AS vendor_id, user_id || '-' || CAST(ts AS DATE) AS invoice_id, min(event_id) AS record_id, 'U' || (min(event_id) % 40) AS posting_user_id, CAST(ts AS DATE) AS posting_date,
        CASE WHEN user_id % 5 = 0 THEN 'goods' WHEN user_id % 5 = 1 THEN 'unknown' ELSE 'service' END AS purchase_kind, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS net_amount,
        CASE WHEN user_id % 2 = 0 THEN CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) END AS tax_amount FROM events WHERE event_type = 'view' AND user_id % 8 <> 0 GROUP BY user_id, CAST(ts AS DATE)),
    payments AS (SELECT CAST(user_id AS VARCHAR) AS vendor_id, CAST(event_id AS VARCHAR) AS payment_id, user_id || '-' || CAST(ts AS DATE) AS invoice_id, 'U' || (event_id % 40) AS execution_user_id, CAST(ts AS DATE) AS payment_date,
        CAST(value AS DECIMAL(18,2)) AS gross_amount, NULL::VARCHAR AS reversal_of FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT CAST(user_id AS VARCHAR), 'R' || event_id, NULL, 'U1', CAST(ts AS DATE) + 1, CAST(CASE WHEN event_id % 90 = 0 THEN -value - 1 ELSE -value END AS DECIMAL(18,2)), CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0),
    approvals AS (SELECT CAST(user_id AS VARCHAR) AS vendor_id, 'U' || (event_id % 40) AS approver_user_id, event_id AS record_id FROM events WHERE event_type = 'click' AND event_id % 3 = 0 AND user_id % 4 <> 0),
    history AS (SELECT CAST(user_id AS VARCHAR) AS vendor_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 0 END AS activity_count, event_id AS record_id FROM events WHERE event_type = 'error' AND user_id % 7 <> 0),
    support AS (SELECT CAST(user_id AS VARCHAR) AS vendor_id, CASE event_id % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'deliverable' WHEN 2 THEN 'service_acceptance' WHEN 3 THEN 'goods_receipt' ELSE 'legitimate_four_eyes' END AS kind,
        event_id % 4 = 0 AS present, event_id AS record_id FROM events WHERE event_type = 'error' AND user_id % 6 <> 0)"""

_VENDOR_SQL = f"""WITH {_VENDOR_VIEWS},
    creation AS (SELECT vendor_id, arg_min(user_id, (event_date, record_id)) AS creator, min(event_date) AS created FROM lifecycle WHERE kind = 'created' GROUP BY 1),
    resolved AS (SELECT t.payment_id AS target, min((r.payment_date, r.payment_id)) AS f FROM payments r JOIN payments t ON r.reversal_of = t.payment_id AND r.vendor_id = t.vendor_id AND t.gross_amount = -r.gross_amount AND t.payment_date <= r.payment_date
        WHERE r.gross_amount < 0 AND t.gross_amount > 0 GROUP BY 1),
    active AS (SELECT * FROM payments WHERE gross_amount > 0 AND payment_id NOT IN (SELECT target FROM resolved)),
    openrev AS (SELECT vendor_id, count(*) AS n FROM payments WHERE gross_amount < 0 AND payment_id NOT IN (SELECT f[2] FROM resolved) GROUP BY 1),
    conflicted AS (SELECT user_id FROM permissions GROUP BY 1 HAVING bool_or(permission = 'create_vendor') AND bool_or(permission = 'execute_payment')),
    v AS (SELECT vendor_id FROM lifecycle UNION SELECT vendor_id FROM invoices UNION SELECT vendor_id FROM payments UNION SELECT vendor_id FROM approvals UNION SELECT vendor_id FROM history UNION SELECT vendor_id FROM support),
    f AS (SELECT v.vendor_id, c.creator, c.created, c.created IS NOT NULL AS known,
        (SELECT count(*) FROM invoices i WHERE i.vendor_id = v.vendor_id) AS ninv, (SELECT CAST(sum(net_amount) AS DECIMAL(18,2)) FROM invoices i WHERE i.vendor_id = v.vendor_id) AS net, (SELECT CAST(sum(tax_amount) AS DECIMAL(18,2)) FROM invoices i WHERE i.vendor_id = v.vendor_id) AS tax,
        (SELECT min(posting_date) FROM invoices i WHERE i.vendor_id = v.vendor_id) AS finv, (SELECT min(payment_date) FROM active p WHERE p.vendor_id = v.vendor_id) AS fpay,
        coalesce((SELECT CAST(sum(gross_amount) AS DECIMAL(18,2)) FROM active p WHERE p.vendor_id = v.vendor_id), 0) AS cash, coalesce((SELECT n FROM openrev o WHERE o.vendor_id = v.vendor_id), 0) AS norev,
        (SELECT count(*) FROM active p JOIN resolved ON FALSE) AS zero, (SELECT count(*) FROM resolved JOIN payments p ON p.payment_id = target WHERE p.vendor_id = v.vendor_id) AS nres,
        (SELECT count(*) FROM active p JOIN invoices i ON p.vendor_id = i.vendor_id AND p.invoice_id = i.invoice_id WHERE p.vendor_id = v.vendor_id AND date_diff('day', i.posting_date, p.payment_date) BETWEEN 0 AND 3) AS quick,
        coalesce((SELECT bool_or(u = c.creator) FROM (SELECT user_id AS u FROM lifecycle l WHERE l.vendor_id = v.vendor_id AND kind = 'approved' UNION ALL SELECT approver_user_id FROM approvals a WHERE a.vendor_id = v.vendor_id)), FALSE) AS selfapp,
        coalesce((SELECT bool_or(u <> c.creator) FROM (SELECT user_id AS u FROM lifecycle l WHERE l.vendor_id = v.vendor_id AND kind = 'approved' UNION ALL SELECT approver_user_id FROM approvals a WHERE a.vendor_id = v.vendor_id)), FALSE) AS indep,
        coalesce((SELECT bool_or(posting_user_id = c.creator) FROM invoices i WHERE i.vendor_id = v.vendor_id), FALSE) AS posts, coalesce((SELECT bool_or(execution_user_id = c.creator) FROM active p WHERE p.vendor_id = v.vendor_id), FALSE) AS pays,
        (c.creator IN (SELECT user_id FROM conflicted)) OR EXISTS (SELECT 1 FROM invoices i WHERE i.vendor_id = v.vendor_id AND posting_user_id IN (SELECT user_id FROM conflicted))
            OR EXISTS (SELECT 1 FROM active p WHERE p.vendor_id = v.vendor_id AND execution_user_id IN (SELECT user_id FROM conflicted)) AS toxic,
        (SELECT count(*) FROM approvals a WHERE a.vendor_id = v.vendor_id) AS nlog, (SELECT count(*) FROM lifecycle l WHERE l.vendor_id = v.vendor_id AND kind = 'approved') AS nappr,
        (SELECT count(*) FROM history h WHERE h.vendor_id = v.vendor_id) AS nhist, coalesce((SELECT sum(activity_count) FROM history h WHERE h.vendor_id = v.vendor_id), 0) AS prior,
        coalesce((SELECT bool_or(purchase_kind = 'service') FROM invoices i WHERE i.vendor_id = v.vendor_id), FALSE) AS svc, coalesce((SELECT bool_or(purchase_kind = 'goods') FROM invoices i WHERE i.vendor_id = v.vendor_id), FALSE) AS gds,
        coalesce((SELECT bool_or(purchase_kind = 'unknown') FROM invoices i WHERE i.vendor_id = v.vendor_id), FALSE) AS unk,
        (SELECT count(*) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'contract') AS n_con, coalesce((SELECT bool_or(present) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'contract'), FALSE) AS h_con,
        (SELECT count(*) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'deliverable') AS n_del, coalesce((SELECT bool_or(present) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'deliverable'), FALSE) AS h_del,
        (SELECT count(*) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'service_acceptance') AS n_acc, coalesce((SELECT bool_or(present) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'service_acceptance'), FALSE) AS h_acc,
        (SELECT count(*) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'goods_receipt') AS n_gr, coalesce((SELECT bool_or(present) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'goods_receipt'), FALSE) AS h_gr,
        (SELECT count(*) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'legitimate_four_eyes') AS n_fe, coalesce((SELECT bool_or(present) FROM support s WHERE s.vendor_id = v.vendor_id AND kind = 'legitimate_four_eyes'), FALSE) AS h_fe
        FROM v LEFT JOIN creation c USING (vendor_id)),
    g AS (SELECT *, (h_del OR h_acc) AS sok, (svc AND NOT (h_del OR h_acc)) OR (gds AND NOT h_gr) OR (unk AND NOT (h_del OR h_acc OR h_gr)) AS lacking,
        CASE WHEN NOT known THEN 'u' WHEN indep THEN 'a' WHEN nappr + nlog > 0 THEN 'n' ELSE 'u' END AS t_ind, CASE WHEN NOT known THEN 'u' WHEN indep AND nlog > 0 THEN 'a' WHEN h_fe THEN 'a' WHEN n_fe > 0 THEN 'n' ELSE 'u' END AS t_fe FROM f),
    s AS (SELECT *, list_filter([CASE WHEN known AND toxic THEN 'create_and_pay_permission' END, CASE WHEN known AND selfapp THEN 'creator_equals_approver' END, CASE WHEN known AND quick > 0 THEN 'invoice_paid_unusually_quickly' END,
        CASE WHEN known AND nlog = 0 THEN 'missing_approval_log' END, CASE WHEN known AND NOT indep THEN 'missing_independent_approval' END, CASE WHEN known AND ninv > 0 AND lacking THEN 'missing_service_or_delivery_evidence' END,
        CASE WHEN NOT known THEN 'missing_vendor_creation_event' END, CASE WHEN known AND date_diff('day', created, DATE '2024-01-31') BETWEEN 0 AND 20 THEN 'new_vendor' END, CASE WHEN known AND nhist > 0 AND prior = 0 THEN 'no_prior_vendor_history' END,
        CASE WHEN known AND date_diff('day', created, finv) BETWEEN 0 AND 7 THEN 'rapid_first_invoice' END, CASE WHEN known AND date_diff('day', created, fpay) BETWEEN 0 AND 14 THEN 'rapid_first_payment' END,
        CASE WHEN known AND posts AND pays THEN 'same_user_creates_posts_pays' END], lambda x: x IS NOT NULL) AS sig FROM g),
    j AS (SELECT *, t_ind = 'a' AND t_fe = 'a' AND (NOT svc OR sok) AND (NOT gds OR h_gr) AND (NOT unk OR sok OR h_gr) AS legit, list_has_any(sig, ['creator_equals_approver', 'create_and_pay_permission', 'same_user_creates_posts_pays']) AS core FROM s WHERE len(sig) > 0)
    SELECT vendor_id, CASE WHEN NOT known THEN 'review_needed' WHEN legit AND NOT core THEN 'dismissed' WHEN norev > 0 OR (prior = 0 AND nhist = 0) OR t_ind = 'u' OR t_fe = 'u' OR (svc AND n_con = 0) OR (svc AND NOT sok AND n_del = 0 AND n_acc = 0)
        OR (gds AND n_gr = 0) OR (unk AND NOT (sok OR h_gr)) OR (legit AND core) OR sig = ['missing_service_or_delivery_evidence'] THEN 'review_needed' WHEN len(sig) < 1 THEN 'dismissed' ELSE 'confirmed_candidate' END AS status,
        array_to_string(sig, ',') AS signals, CAST(len(sig) AS DECIMAL(18,2)) AS severity_score, cash AS exposure, net AS invoice_net_amount, tax AS invoice_tax_amount FROM j"""
# What the admission gate makes of it: a confirmed outcome with an open counter-test goes to a person.
VENDOR_GATE_SQL = _VENDOR_SQL.replace("array_to_string(sig, ',') AS signals,", "norev > 0 OR (prior = 0 AND nhist = 0) OR t_ind = 'u' OR t_fe = 'u' OR n_con = 0 OR n_del = 0 OR n_acc = 0 OR n_gr = 0 AS still_open, array_to_string(sig, ',') AS signals,")


def vendor_tables(t):
    e = t.events
    key, user, day, value = F.col("event_id"), F.col("user_id"), F.to_date("ts"), F.col("value").cast(CENTS)
    vendor, who, ev = user.cast("string").alias("vendor_id"), F.concat(F.lit("U"), key % 40), F.concat(F.lit("e"), key).alias("evidence_id")
    is_ = lambda kind: F.col("event_type") == kind
    record = key.cast("string").alias("record_id")
    buys = e.where(is_("purchase"))
    invoice_no = F.concat_ws("-", user.cast("string"), day.cast("string"))
    return {
        "lifecycle": e.where((is_("signup") | is_("click")) & (user % 9 != 0) & (~is_("click") | (user % 4 != 0))).select(
            F.format_string("%012d", key).alias("record_id"), vendor, F.when(is_("signup"), "created").otherwise("approved").alias("kind"), who.alias("user_id"), day.alias("event_date"), ev),
        "permissions": e.select(record, who.alias("user_id"), F.when(key % 3 == 0, "create_vendor").when(key % 3 == 1, "execute_payment").otherwise("post_supplier_invoice").alias("permission"), (key % 50 == 0).alias("active")),
        "invoices": e.where(is_("view") & (user % 8 != 0)).groupBy(user.alias("user_id"), day.alias("posting_date")).agg(F.min(key).alias("event_id"), F.sum(value).cast(CENTS).alias("net_amount")).select(
            record, vendor, F.concat_ws("-", user.cast("string"), F.col("posting_date").cast("string")).alias("invoice_id"), who.alias("posting_user_id"), "posting_date",
            F.when(user % 5 == 0, "goods").when(user % 5 == 1, "unknown").otherwise("service").alias("purchase_kind"), "net_amount", F.when(user % 2 == 0, F.col("net_amount")).alias("tax_amount"), ev),
        "payments": buys.select(record, vendor, key.cast("string").alias("payment_id"), invoice_no.alias("invoice_id"), who.alias("execution_user_id"), day.alias("payment_date"), value.alias("gross_amount"), F.lit(None).cast("string").alias("reversal_of"), ev).unionByName(
            buys.where(key % 10 == 0).select(F.concat(F.lit("R"), key).alias("record_id"), vendor, F.concat(F.lit("R"), key).alias("payment_id"), F.lit(None).cast("string").alias("invoice_id"), F.lit("U1").alias("execution_user_id"), F.date_add(day, 1).alias("payment_date"),
                                             F.when(key % 90 == 0, -value - 1).otherwise(-value).cast(CENTS).alias("gross_amount"), key.cast("string").alias("reversal_of"), ev)),
        "approvals": e.where(is_("click") & (key % 3 == 0) & (user % 4 != 0)).select(record, vendor, who.alias("approver_user_id"), day.alias("approval_date"), ev),
        "history": e.where(is_("error") & (user % 7 != 0)).select(record, vendor, F.when(user % 3 == 0, 2).otherwise(0).alias("activity_count"), ev),
        "support": e.where(is_("error") & (user % 6 != 0)).select(record, vendor, F.element_at(F.array(*[F.lit(k) for k in ("contract", "deliverable", "service_acceptance", "goods_receipt", "legitimate_four_eyes")]), (key % 5 + 1).cast("int")).alias("kind"),
                                                                (key % 4 == 0).alias("present"), ev),
    }


VENDOR_PARAMETERS = VendorParameters(date(2024, 1, 31), new_vendor_window_days=20)


@query("ctl_07_vendor_integrity", _VENDOR_SQL)
def _(t):
    out = VendorIntegrity().evaluate(vendor_tables(t), VENDOR_PARAMETERS)
    return out.select("vendor_id", "status", F.array_join("signals", ",").alias("signals"), "severity_score", "exposure", "invoice_net_amount", "invoice_tax_amount")


# --- capital expenditure -------------------------------------------------------------------------

def capex_tables(t):
    o, price = F.col("o_orderkey"), F.col("l_extendedprice").cast(CENTS)
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(price).cast(CENTS).alias("net"), F.to_date(F.max("l_shipdate")).alias("day"))
    addition = F.col("l_orderkey").cast("string")
    posting = lambda suffix, amount, day, account, target, moved: lines.select(
        F.concat(addition, F.lit(suffix)).alias("record_id"), F.concat(addition, F.lit(suffix)).alias("posting_id"), addition.alias("addition_id"), F.lit("0400").alias("account_id"), account.alias("account_classification"), day.alias("posting_date"),
        amount.alias("amount"), F.lit("booking").alias("description"), target.cast("string").alias("reversal_of_posting_id"), moved.alias("is_reclassification"), F.concat(F.lit("p"), addition).alias("evidence_id"), F.col("l_orderkey"))
    k = F.col("l_orderkey")
    debit = posting("-D", F.col("net"), F.col("day"), F.when(k % 3 == 0, "maintenance_expense").otherwise("asset"), F.lit(None), F.lit(False))
    credit = posting("-C", F.when(k % 10 == 0, -F.col("net") + 1).otherwise(-F.col("net")).cast(CENTS), F.date_add("day", 1), F.lit("asset"), F.concat(addition, F.lit("-D")), F.lit(False)).where("l_orderkey % 4 = 0")
    return {
        "additions": t.orders.select(o.cast("string").alias("record_id"), o.cast("string").alias("addition_id"), (F.col("o_custkey") % 400).cast("string").alias("asset_id"), (F.col("o_custkey") % 40).cast("string").alias("vendor_id"),
                                     F.to_date("o_orderdate").alias("addition_date"), F.col("o_totalprice").cast(CENTS).alias("net_amount"), F.col("o_orderpriority").alias("description"), F.lit(None).cast("string").alias("category"), F.concat(F.lit("a"), o).alias("evidence_id")),
        "postings": debit.unionByName(credit).drop("l_orderkey"),
        "invoices": t.lineitem.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min(price).alias("net_amount"), F.to_date(F.min("l_shipdate")).alias("invoice_date")).select(
            F.concat(F.lit("i"), "l_orderkey").alias("record_id"), F.concat(F.lit("i"), "l_orderkey").alias("invoice_id"), addition.alias("addition_id"), "invoice_date", "net_amount", F.when(k % 6 == 0, "Overhaul of plant").otherwise("goods").alias("description"), F.concat(F.lit("i"), "l_orderkey").alias("evidence_id")),
        "assets": t.part.where("p_partkey < 400").select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_partkey").cast("string").alias("asset_id"), F.col("p_name").alias("description"), F.lit(None).cast("string").alias("category"),
                                                        F.when(F.col("p_partkey") % 3 == 0, F.lit(True)).when(F.col("p_partkey") % 3 == 1, F.lit(False)).alias("distinct_new_asset"), F.concat(F.lit("m"), "p_partkey").alias("evidence_id")),
        "support": t.events.select(F.col("event_id").cast("string").alias("record_id"), (F.col("event_id") % 3000).cast("string").alias("addition_id"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("user_id") % 8 + 1).cast("int")).alias("kind"),
                                   (F.col("event_id") % 3 != 0).alias("present"), F.concat(F.lit("s"), "event_id").alias("evidence_id")),
    }


_KINDS = ("distinct_new_asset", "project_reference", "investment_approval", "separable_major_component", "useful_life_extension", "capacity_or_quality_improvement", "required_for_new_asset_operation", "reversal_or_reclassification")
CAPEX_PARAMETERS = CapexParameters(repair_maintenance_triggers=("urgent", "old"), replacement_overhaul_triggers=("medium", "overhaul"), cluster_window_days=10)


def _kind_flag(kind: str, value: str) -> str:
    return f"coalesce(bool_or(kind = '{kind}' AND present = {value}), FALSE)"


_SUPPORT_SQL = ", ".join(f"{_kind_flag(k, 'TRUE')} AS y{i}, {_kind_flag(k, 'FALSE')} AS n{i}" for i, k in enumerate(_KINDS))
_STATES = ", ".join(f"CASE WHEN coalesce(y{i}, FALSE) AND coalesce(n{i}, FALSE) THEN 'u' WHEN coalesce(y{i}, FALSE) THEN 'a' WHEN coalesce(n{i}, FALSE) THEN 'n' ELSE 'u' END AS q{i}" for i in range(8))
_CAPEX_SQL = f"""WITH sup AS (SELECT event_id % 3000 AS id, list_extract([{", ".join(repr(k) for k in _KINDS)}], user_id % 8 + 1) AS kind, event_id % 3 <> 0 AS present FROM events), sflag AS (SELECT id, {_SUPPORT_SQL} FROM sup GROUP BY 1),
    lines AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS net, CAST(max(l_shipdate) AS DATE) AS day, bool_or(l_linenumber = 1) AS billed FROM lineitem GROUP BY 1),
    a AS (SELECT o_orderkey AS id, o_custkey % 400 AS asset, o_custkey % 40 AS vendor, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS net, lower(o_orderpriority) AS txt FROM orders),
    b AS (SELECT a.*, l.net AS posted, l.day, coalesce(l.billed, FALSE) AND a.id % 6 = 0 AS overhaul, p_name, CASE WHEN p_partkey % 3 = 0 THEN TRUE WHEN p_partkey % 3 = 1 THEN FALSE END AS newflag FROM a LEFT JOIN lines l ON l.id = a.id LEFT JOIN part ON p_partkey = asset AND p_partkey < 400),
    c AS (SELECT *, list_filter([CASE WHEN contains(txt, 'medium') THEN 'medium' END, CASE WHEN regexp_matches(p_name, '\\bold\\b') THEN 'old' END, CASE WHEN overhaul THEN 'overhaul' END, CASE WHEN contains(txt, 'urgent') THEN 'urgent' END], lambda x: x IS NOT NULL) AS terms,
        posted IS NOT NULL AND id % 4 = 0 AS has_credit, posted IS NOT NULL AND id % 4 = 0 AND id % 10 <> 0 AND id % 3 <> 0 AND day >= d AS mirrored FROM b),
    s AS (SELECT c.*, {_STATES} FROM c LEFT JOIN sflag ON sflag.id = c.id),
    u AS (SELECT *, CASE WHEN newflag THEN 'a' WHEN NOT newflag THEN 'n' ELSE q0 END AS r0, CASE WHEN has_credit AND NOT mirrored THEN 'u' WHEN mirrored THEN 'a' ELSE q7 END AS r7, has_credit AND NOT mirrored AS open, net + CASE WHEN mirrored THEN -posted ELSE 0 END AS rest,
        (SELECT count(*) FROM s y WHERE y.asset = s.asset AND y.vendor = s.vendor AND len(y.terms) > 0 AND abs(date_diff('day', y.d, s.d)) <= 10) AS cluster FROM s),
    w AS (SELECT *, list_filter([CASE WHEN cluster >= 2 THEN 'multiple_repair_like_additions' END, CASE WHEN r0 = 'n' AND q1 = 'n' THEN 'no_distinct_asset_or_project_reference' END, CASE WHEN q2 = 'n' THEN 'no_investment_approval' END,
        CASE WHEN q4 = 'n' AND q5 = 'n' THEN 'no_useful_life_or_capacity_improvement' END, CASE WHEN posted > 0 AND id % 3 <> 0 THEN 'posted_to_asset_account' WHEN has_credit AND id % 10 = 0 AND posted < 1 THEN 'posted_to_asset_account' END,
        CASE WHEN list_has_any(terms, ['urgent', 'old']) THEN 'repair_or_maintenance_language' END, CASE WHEN list_has_any(terms, ['medium', 'overhaul']) THEN 'replacement_overhaul_service_language' END], lambda x: x IS NOT NULL) AS sig,
        NOT open AND ((r7 = 'a' AND rest = 0) OR (r0 = 'a' AND (q1 = 'a' OR q2 = 'a')) OR (q3 = 'a' AND (q4 = 'a' OR q5 = 'a')) OR (q6 = 'a' AND (r0 = 'a' OR q1 = 'a'))) AS cleared FROM u)
    SELECT CAST(id AS VARCHAR) AS addition_id, CASE WHEN cleared THEN 'dismissed' ELSE 'review_needed' END AS status, CAST(greatest(0, rest) AS DECIMAL(18,2)) AS exposure, CAST(len(sig) AS DECIMAL(18,2)) AS severity_score, array_to_string(sig, ',') AS signals,
        array_to_string(terms, ',') AS terms, cluster AS cluster_size FROM w"""


@query("ctl_08_capital_expenditure", _CAPEX_SQL)
def _(t):
    out = CapitalExpenditure().evaluate(capex_tables(t), CAPEX_PARAMETERS)
    return out.select("addition_id", "status", "exposure", "severity_score", F.array_join("signals", ",").alias("signals"), F.array_join("matched_trigger_terms", ",").alias("terms"), "cluster_size")


# --- year-end cut-off ----------------------------------------------------------------------------

CUTOFF_PARAMETERS = CutoffParameters(date(1998, 1, 1), date(1998, 12, 31), Decimal("0.01"))


def cutoff_tables(t):
    o, net = F.col("o_orderkey"), F.col("o_totalprice").cast(CENTS)
    no = o.cast("string")
    base = t.orders
    return {
        "invoices": base.select(F.concat(F.lit("I"), no).alias("record_id"), no.alias("invoice_id"), F.col("o_custkey").cast("string").alias("vendor_id"), F.concat(F.lit("D"), no).alias("document_id"), F.lit(None).cast("string").alias("receipt_id"),
                                F.to_date("o_orderdate").alias("invoice_date"), F.lit(None).cast("date").alias("posting_date"), net.alias("net_amount"), F.lit(0).cast(CENTS).alias("vat_amount"), net.alias("gross_amount"), (o % 45 != 0).alias("accounting_period_known"), F.concat(F.lit("ev"), no).alias("evidence_id")),
        "receipts": t.lineitem.groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("occurrence_date"), F.max((F.col("l_returnflag") == "N").cast("int")).alias("ok")).select(
            F.concat(F.lit("G"), "l_orderkey").alias("record_id"), F.col("l_orderkey").cast("string").alias("invoice_id"), F.lit(None).cast("string").alias("vendor_id"), F.lit(None).cast("string").alias("document_id"), F.concat(F.lit("G"), "l_orderkey").alias("receipt_id"),
            "occurrence_date", F.when(F.col("ok") == 1, "accepted").otherwise("returned").alias("status"), F.lit(None).cast(CENTS).alias("net_amount")),
        "closing": base.where(o % 3 == 0).select(F.concat(F.lit("C"), no).alias("record_id"), F.lit("accrual").alias("kind"), F.to_date(F.lit("1998-12-15")).alias("posting_date"), F.when(o % 2 == 0, net).otherwise(net * F.lit(Decimal("0.5"))).cast(CENTS).alias("net_amount"), no.alias("invoice_id"),
                                                F.lit(None).cast("string").alias("vendor_id"), F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("string").alias("receipt_id"), (o % 30 == 0).alias("generic"), (o % 33 != 0).alias("accounting_period_known")),
        "adjustments": base.where(o % 25 == 0).select(F.concat(F.lit("K"), no).alias("record_id"), F.lit("credit_note").alias("kind"), F.to_date("o_orderdate").alias("effective_date"), F.when(o % 50 == 0, net).otherwise(net * F.lit(Decimal("0.25"))).cast(CENTS).alias("net_amount"), no.alias("invoice_id"),
                                                     F.lit(None).cast("string").alias("vendor_id"), F.lit(None).cast("string").alias("document_id")),
        "exceptions": base.where(o % 40 == 0).select(F.concat(F.lit("X"), no).alias("record_id"), F.lit("policy").alias("reason"), F.lit(None).cast("string").alias("invoice_id"), F.concat(F.lit("D"), no).alias("document_id")),
    }


_CUTOFF_SQL = """WITH r AS (SELECT l_orderkey AS id, CAST(min(l_shipdate) AS DATE) AS occ, bool_or(l_returnflag = 'N') AS ok FROM lineitem GROUP BY 1),
    i AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS net, r.occ, coalesce(NOT r.ok, FALSE) AS refused FROM orders LEFT JOIN r ON r.id = o_orderkey WHERE CAST(o_orderdate AS DATE) > DATE '1998-12-31' AND (r.occ IS NULL OR r.occ <= DATE '1998-12-31')),
    c AS (SELECT *, CAST(CASE WHEN id % 3 = 0 AND id % 30 <> 0 AND id % 33 <> 0 THEN CASE WHEN id % 2 = 0 THEN net ELSE CAST(net * 0.5 AS DECIMAL(18,2)) END ELSE 0 END AS DECIMAL(18,2)) AS cov, CAST(CASE WHEN id % 50 = 0 THEN net WHEN id % 25 = 0 THEN CAST(net * 0.25 AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,2)) AS adj FROM i),
    e AS (SELECT *, least(net - adj, cov) AS cover, CASE WHEN net - adj - least(net - adj, cov) <= 0.01 THEN 0 ELSE net - adj - least(net - adj, cov) END AS exposure FROM c)
    SELECT CAST(id AS VARCHAR) AS invoice_id, CASE WHEN id % 45 = 0 OR occ IS NULL OR occ < DATE '1998-01-01' OR id % 30 = 0 OR (id % 33 = 0 AND id % 3 = 0 AND id % 30 <> 0) THEN 'review_needed' WHEN refused OR id % 40 = 0 OR adj >= net - 0.01 OR exposure = 0 THEN 'dismissed' ELSE 'confirmed_candidate' END AS status,
    CAST(exposure AS DECIMAL(18,2)) AS exposure, CAST(cover AS DECIMAL(18,2)) AS closing_coverage_net, adj AS adjustment_net FROM e"""


@query("ctl_09_yearend_cutoff", _CUTOFF_SQL)
def _(t):
    out = YearEndCutoff().evaluate(cutoff_tables(t), CutoffParameters(date(1998, 1, 1), date(1998, 12, 31), Decimal("0.01"), ("invoice_id", "document_id", "receipt_id")))
    return out.select("invoice_id", "status", "exposure", "closing_coverage_net", "adjustment_net")


def _vendor_rows(t):
    """Same vendor and nearly the same amount: records in whose bands many invoices compete."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("vendor_id"), F.col("o_totalprice").cast(CENTS).alias("net_amount"), F.col("o_orderstatus").alias("s"))
    left = rows.where("s <> 'F'").select(F.col("id").alias("consumer"), F.col("id").alias("seq"), "vendor_id", "net_amount")
    right = rows.where("s = 'F'").select(F.col("id").alias("resource"), "vendor_id", "net_amount")
    return left, right, Decimal(2000)


# One recursion per vendor: consumers in order, each seeing what earlier ones have used.
_LISTS = """WITH RECURSIVE links AS (SELECT i.o_custkey % 100 AS vendor, i.o_orderkey AS consumer, CAST(i.o_totalprice AS DECIMAL(18,2)) AS net, r.o_orderkey AS resource, CAST(r.o_totalprice AS DECIMAL(18,2)) AS covers FROM orders i JOIN orders r ON i.o_custkey % 100 = r.o_custkey % 100
      AND abs(CAST(i.o_totalprice AS DECIMAL(18,2)) - CAST(r.o_totalprice AS DECIMAL(18,2))) <= 2000 WHERE i.o_orderstatus <> 'F' AND r.o_orderstatus = 'F'),
    lists AS (SELECT vendor, consumer, net, list({'r': resource, 'c': covers} ORDER BY resource) AS rs, row_number() OVER (PARTITION BY vendor ORDER BY consumer) AS k FROM links GROUP BY vendor, consumer, net),
    begin AS (SELECT DISTINCT vendor, 0::BIGINT AS k, NULL::BIGINT AS consumer, []::STRUCT(r BIGINT, c DECIMAL(18,2))[] AS taken, []::BIGINT[] AS used FROM lists),
    """


@query("alloc_08_single_use_receipts", _LISTS + """step AS (SELECT * FROM begin UNION ALL
      SELECT l.vendor, l.k, l.consumer, list_filter(l.rs, lambda x: NOT list_contains(s.used, x.r))[:1], s.used || list_transform(list_filter(l.rs, lambda x: NOT list_contains(s.used, x.r))[:1], lambda x: x.r) FROM step s JOIN lists l ON l.vendor = s.vendor AND l.k = s.k + 1)
    SELECT consumer, taken[1].r AS resource FROM step WHERE len(taken) > 0""")
def _(t):
    return bands.band_takes(*_vendor_rows(t)).select("consumer", "resource")


@query("alloc_09_closing_coverage", _LISTS + """step AS (SELECT * FROM begin UNION ALL
      SELECT vendor, k, consumer, taken, used || list_transform(taken, lambda x: x.r) FROM (
        SELECT vendor, k, consumer, used, list_filter(open, lambda x, i: net - coalesce(list_sum(list_transform(open[:i - 1], lambda y: y.c)), 0) > 0.01) AS taken FROM (
          SELECT l.vendor, l.k, l.consumer, l.net, s.used, list_filter(l.rs, lambda x: NOT list_contains(s.used, x.r)) AS open FROM step s JOIN lists l ON l.vendor = s.vendor AND l.k = s.k + 1)))
    SELECT consumer, t.r AS resource, t.c AS covers FROM (SELECT consumer, unnest(taken) AS t FROM step)""")
def _(t):
    return bands.band_takes(*_vendor_rows(t), CUTOFF_PARAMETERS.amount_tolerance).select("consumer", "resource", "covers")


@query("alloc_10_single_use_adjustments", """SELECT r.o_orderkey AS resource, min(i.o_orderkey) AS consumer FROM orders i JOIN orders r ON i.o_custkey % 100 = r.o_custkey % 100 AND abs(CAST(i.o_totalprice AS DECIMAL(18,2)) - CAST(r.o_totalprice AS DECIMAL(18,2))) <= 2000
    WHERE i.o_orderstatus <> 'F' AND r.o_orderstatus = 'F' GROUP BY 1""")
def _(t):
    return bands.first_in_band(*_vendor_rows(t)).select("resource", "consumer")


# --- three-way match -----------------------------------------------------------------------------

def match_tables(t, shared=True):
    """Records of the three-way match; without ``shared`` every reference belongs to one order and no invoice is repeated."""
    o = F.col("o_orderkey")
    no, net = o.cast("string"), F.col("o_totalprice").cast(CENTS)
    vat = lambda c: (c * F.lit(Decimal("0.19"))).cast(CENTS)
    none = lambda kind: F.lit(None).cast(kind)
    cust = F.col("o_custkey").cast("string").alias("vendor_id")
    money = lambda c: [c.alias("net_amount"), vat(c).alias("vat_amount"), (c + vat(c)).cast(CENTS).alias("gross_amount")]
    base = t.orders
    # A quarter of a customer's orders share one blanket reference, so invoices compete for orders and receipts.
    agreed = F.when(F.lit(shared) & (o % 4 == 3), F.concat(F.lit("BL-"), "o_custkey")).otherwise(F.concat(F.lit("PO-"), no))
    share = F.when(o % 7 == 0, net * F.lit(Decimal("0.95"))).otherwise(net).cast(CENTS)
    credit = F.when(o % 60 == 20, net).otherwise(net * F.lit(Decimal("0.5"))).cast(CENTS)
    # Lines are dealt out by their order once, for the sums and for the join with the orders, which are too many to be sent to every task.
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_shipdate", "l_extendedprice").repartition("l_orderkey").groupBy("l_orderkey", "l_returnflag").agg(F.to_date(F.max("l_shipdate")).alias("receipt_date"), F.sum(F.col("l_extendedprice").cast(CENTS)).cast(CENTS).alias("net"), F.count(F.lit(1)).alias("n")).join(
        base.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", agreed.alias("agreed")).hint("merge"), "l_orderkey")
    flag, key = F.col("l_returnflag"), F.col("l_orderkey").cast("string")
    receipt = lambda df, record, reference, day, amount, invoice, order, status, variance, again: df.select(
        record.alias("record_id"), reference.alias("receipt_reference"), cust, day.alias("receipt_date"), *money(amount), invoice.alias("invoice_reference"), order.alias("purchase_order_reference"), none("decimal(18,4)").alias("quantity"),
        F.lit("goods").alias("classification"), status.alias("status"), variance.cast(CENTS).alias("approved_price_variance"), again.alias("reusable"), record.alias("evidence_id"))
    g = F.concat_ws("-", F.concat(F.lit("G"), key), flag)
    receipts = receipt(lines, g, g, F.col("receipt_date"), F.col("net"), F.when(flag != "N", F.concat(F.lit("INV-"), key)), F.when(flag != "A", F.col("agreed")), F.when(flag == "R", "returned").otherwise("accepted"),
                       F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(0), (flag == "N") & (F.col("l_orderkey") % 13 == 0))
    loose = base.where(o % 15 == 0)
    f = F.concat(F.lit("F"), no)
    receipts = receipts.unionByName(receipt(loose, f, f, F.to_date("o_orderdate"), net, none("string"), none("string"), F.lit("accepted"), F.lit(0), F.lit(False)))
    copies = base.withColumn("again", F.explode(F.when(F.lit(shared) & (o % 50 == 10), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return {
        "invoices": copies.select(F.concat(F.lit("I"), no, F.when(F.col("again") == 1, "b").otherwise("")).alias("record_id"), F.concat(F.lit("INV-"), no).alias("invoice_reference"), cust, F.date_add(F.to_date("o_orderdate"), F.col("again")).alias("invoice_date"), *money(net),
                                F.when(F.col("o_orderpriority") == "5-LOW", "service").when(F.col("o_orderpriority") == "1-URGENT", "unknown").otherwise("goods").alias("classification"), agreed.alias("purchase_order_reference"),
                                none("string").alias("goods_receipt_reference"), none("decimal(18,4)").alias("quantity"), (o % 90 == 0).alias("cancelled"), F.concat(F.lit("I"), no).alias("evidence_id")),
        "orders": base.select(F.concat(F.lit("P"), no).alias("record_id"), agreed.alias("order_reference"), cust, F.to_date("o_orderdate").alias("order_date"), *money(share), none("string").alias("invoice_reference"), none("string").alias("receipt_reference"),
                              none("decimal(18,4)").alias("quantity"), F.when(o % 9 == 0, 2).otherwise(0).cast(CENTS).alias("approved_price_variance"), F.lit(False).alias("reusable"), F.lit(False).alias("cancelled"), F.concat(F.lit("P"), no).alias("evidence_id")),
        "receipts": receipts,
        "adjustments": base.where(o % 20 == 0).select(F.concat(F.lit("A"), no).alias("record_id"), F.when(o % 60 == 20, "cancellation").when(o % 60 == 40, "return").otherwise("credit_note").alias("kind"), cust, F.to_date("o_orderdate").alias("effective_date"), *money(credit),
                                                     F.concat(F.lit("INV-"), no).alias("invoice_reference"), none("string").alias("purchase_order_reference"), none("string").alias("goods_receipt_reference"), none("decimal(18,4)").alias("quantity"), F.concat(F.lit("A"), no).alias("evidence_id")),
    }


_MATCH_ROWS = """base AS (
      SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS vendor, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS net, o_orderpriority AS priority,
             CASE WHEN o_orderkey % 4 = 3 THEN 'BL-' || o_custkey ELSE 'PO-' || o_orderkey END AS po FROM orders),
    inv AS (
      SELECT 'I' || k || CASE WHEN again = 1 THEN 'b' ELSE '' END AS id, k, vendor, day + CAST(again AS INTEGER) AS day, po, net AS a_n, CAST(net * 0.19 AS DECIMAL(18,2)) AS a_v, CAST(net + CAST(net * 0.19 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS a_g, again = 1 AS duplicate,
             CASE priority WHEN '5-LOW' THEN 'service' WHEN '1-URGENT' THEN 'unknown' ELSE 'goods' END AS class, k % 90 = 0 AS cancelled FROM base, unnest(range(CASE WHEN k % 50 = 10 THEN 2 ELSE 1 END)) AS u(again)),
    lines AS (SELECT l_orderkey AS k, l_returnflag AS flag, CAST(max(l_shipdate) AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS net FROM lineitem GROUP BY ALL),
    rec0 AS (
      SELECT 'G' || k || '-' || flag AS r, k, vendor, lines.day, lines.net, CASE WHEN flag <> 'N' THEN k END AS names, CASE WHEN flag <> 'A' THEN po END AS po, flag <> 'R' AS ok, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS variance, flag = 'N' AND k % 13 = 0 AS again
      FROM lines JOIN base USING (k)
      UNION ALL SELECT 'F' || k, k, vendor, day, net, NULL, NULL, TRUE, 0, FALSE FROM base WHERE k % 15 = 0),
    rec AS (SELECT *, net AS h_n, CAST(net * 0.19 AS DECIMAL(18,2)) AS h_v, CAST(net + CAST(net * 0.19 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS h_g FROM rec0)"""
# Without credits the whole invoice is open.
_OPEN = "target AS (SELECT *, a_n AS t_n, a_v AS t_v, a_g AS t_g FROM inv)"
_CREDITED = """adj AS (
      SELECT k, k % 60 = 20 AS undoes, c AS c_n, CAST(c * 0.19 AS DECIMAL(18,2)) AS c_v, CAST(c + CAST(c * 0.19 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS c_g FROM (SELECT k, CAST(CASE WHEN k % 60 = 20 THEN net ELSE net * 0.5 END AS DECIMAL(18,2)) AS c FROM base WHERE k % 20 = 0)),
    cred AS (
      SELECT inv.*, coalesce(undoes, FALSE) AS undoes, """ + ", ".join(f"CASE WHEN c_{d} IS NULL THEN 0 ELSE greatest(0, least(a_{d}, c_{d} - coalesce(sum(a_{d}) OVER earlier, 0))) END AS u_{d}" for d in "nvg") + """
      FROM inv LEFT JOIN adj USING (k) WINDOW earlier AS (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    target AS (
      SELECT *, CAST(u_n > 0 OR u_v > 0 OR u_g > 0 AS INTEGER) AS adjustments, """ + ", ".join(f"CAST(CASE WHEN gone THEN 0 ELSE greatest(0, a_{d} - u_{d}) END AS DECIMAL(18,2)) AS t_{d}" for d in "nvg") + """
      FROM (SELECT *, cancelled OR (undoes AND (u_n > 0 OR u_v > 0 OR u_g > 0) AND u_g + 0.01 >= a_g) AS gone FROM cred))"""
_CAND = "STRUCT(tier BIGINT, days BIGINT, gap DECIMAL(18,2), r VARCHAR, h_n DECIMAL(18,2), h_v DECIMAL(18,2), h_g DECIMAL(18,2), again BOOLEAN, w_n DECIMAL(18,2), w_v DECIMAL(18,2), w_g DECIMAL(18,2), met BOOLEAN, took STRUCT(r VARCHAR, tier BIGINT, n DECIMAL(18,2), v DECIMAL(18,2), g DECIMAL(18,2))[])"
_USE = "(NOT (a.met AND a.w_n <= 0.01) AND (c.tier <> 4 OR c.gap <= 0.01) AND (c.again OR c.h_n > 0.01) AND NOT (least(a.w_n, c.h_n) = 0 AND t_n <> 0))"
_TAKE = lambda d: f"CAST(CASE WHEN {_USE} THEN least(a.w_{d}, c.h_{d}) ELSE 0 END AS DECIMAL(18,2))"
# One recursion per vendor: invoices by id, each going through its receipts with what earlier ones have left.
_SERVED = f"""cand AS (
      SELECT i.vendor, i.id, min(CASE WHEN x.names = i.k THEN 1 WHEN x.names IS NULL AND x.po = i.po THEN 2 ELSE 4 END) AS tier, x.r, abs(date_diff('day', i.day, x.day)) AS days FROM inv i JOIN rec x ON x.vendor = i.vendor AND x.ok
      AND (x.names = i.k OR (x.names IS NULL AND x.po = i.po) OR (x.names IS NULL AND x.po IS NULL AND abs(date_diff('day', i.day, x.day)) <= 7)) GROUP BY ALL),
    queue AS (SELECT vendor, id, t_n, t_v, t_g, a_n, row_number() OVER (PARTITION BY vendor ORDER BY id) AS n, (SELECT list({{'tier': tier, 'days': days, 'r': r}}) FROM cand c WHERE c.id = target.id) AS cands FROM target),
    served AS (
      SELECT vendor, 0::BIGINT AS n, NULL::VARCHAR AS id, list({{'r': r, 'n': h_n, 'v': h_v, 'g': h_g, 'again': again}}) AS pool, []::STRUCT(r VARCHAR, tier BIGINT, n DECIMAL(18,2), v DECIMAL(18,2), g DECIMAL(18,2))[] AS took FROM rec WHERE ok GROUP BY vendor
      UNION ALL
      SELECT vendor, n, id, list_transform(pool, lambda p: CASE WHEN p.again OR len(list_filter(took, lambda x: x.r = p.r)) = 0 THEN p ELSE {{'r': p.r, {", ".join(f"'{d}': CAST(p.{d} - list_filter(took, lambda x: x.r = p.r)[1].{d} AS DECIMAL(18,2))" for d in "nvg")}, 'again': p.again}} END), took FROM (
        SELECT vendor, n, id, pool, list_reduce(list_prepend(CAST({{'tier': 0, 'days': 0, 'gap': 0, 'r': '', 'h_n': 0, 'h_v': 0, 'h_g': 0, 'again': FALSE, 'w_n': t_n, 'w_v': t_v, 'w_g': t_g, 'met': FALSE, 'took': []}} AS {_CAND}), lined),
          lambda a, c: CAST({{'tier': 0, 'days': 0, 'gap': 0, 'r': '', 'h_n': 0, 'h_v': 0, 'h_g': 0, 'again': FALSE, {", ".join(f"'w_{d}': a.w_{d} - {_TAKE(d)}" for d in "nvg")}, 'met': a.met OR {_USE},
            'took': CASE WHEN {_USE} THEN list_append(a.took, {{'r': c.r, 'tier': c.tier, {", ".join(f"'{d}': {_TAKE(d)}" for d in "nvg")}}}) ELSE a.took END}} AS {_CAND})).took AS took FROM (
          SELECT q.*, s.pool, list_sort(list_transform(coalesce(cands, []), lambda x: CAST({{'tier': x.tier, 'days': x.days, 'gap': abs(a_n - list_filter(pool, lambda p: p.r = x.r)[1].n), 'r': x.r,
            {", ".join(f"'h_{d}': list_filter(pool, lambda p: p.r = x.r)[1].{d}" for d in "nvg")}, 'again': list_filter(pool, lambda p: p.r = x.r)[1].again, 'w_n': 0, 'w_v': 0, 'w_g': 0, 'met': FALSE, 'took': []}} AS {_CAND}))) AS lined
          FROM served s JOIN queue q ON q.vendor = s.vendor AND q.n = s.n + 1))),
    used AS (SELECT id AS consumer, t.r AS resource, CAST(t.tier AS INTEGER) AS tier, t.n AS take_net, t.v AS take_vat, t.g AS take_gross FROM (SELECT id, unnest(took) AS t FROM served))"""
_LEFT = "left_over AS (SELECT rec.r AS subject, CAST(h_n - coalesce(sum(take_net) FILTER (WHERE NOT again), 0) AS DECIMAL(18,2)) AS rest FROM rec LEFT JOIN used ON resource = rec.r WHERE ok GROUP BY rec.r, h_n)"
_LAID = f"""supply AS (
      SELECT vendor, po, 'P' || k AS p, CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END AS variance, s AS s_n, CAST(s * 0.19 AS DECIMAL(18,2)) AS s_v, CAST(s + CAST(s * 0.19 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS s_g
      FROM (SELECT *, CAST(CASE WHEN k % 7 = 0 THEN net * 0.95 ELSE net END AS DECIMAL(18,2)) AS s FROM base)),
    laid AS (SELECT *, {", ".join(f"sum(s_{d}) OVER w AS e_{d}" for d in "nvg")} FROM supply WINDOW w AS (PARTITION BY vendor, po ORDER BY p)),
    asked AS (SELECT *, {", ".join(f"sum(t_{d}) OVER w AS f_{d}" for d in "nvg")} FROM target WINDOW w AS (PARTITION BY vendor, po ORDER BY id))"""
_TOUCH = " OR ".join(f"greatest(f_{d} - t_{d}, e_{d} - s_{d}) < least(f_{d}, e_{d})" for d in "nvg")
_GAP = lambda left, right, tol: f"CASE WHEN {left} - {right} <= {tol} THEN 0 ELSE {left} - {right} END"
_MATCH_SQL = f"""WITH RECURSIVE {_MATCH_ROWS}, {_CREDITED}, {_SERVED}, {_LEFT},
    got AS (SELECT consumer AS id, count(*) AS receipts, sum(take_net) AS g_n, sum(take_vat) AS g_v, sum(take_gross) AS g_g, max(tier) AS worst, sum(variance) AS variance FROM used JOIN rec ON rec.r = resource GROUP BY 1),
    {_LAID},
    cover AS (
      SELECT a.id, count(*) AS orders, {", ".join(f"sum(greatest(0, least(f_{d}, e_{d}) - greatest(f_{d} - t_{d}, e_{d} - s_{d}))) AS o_{d}" for d in "nvg")},
             count(*) FILTER (WHERE {_TOUCH}) AS in_use, coalesce(sum(variance) FILTER (WHERE {_TOUCH}), 0) AS variance
      FROM asked a JOIN laid l ON l.vendor = a.vendor AND l.po = a.po GROUP BY a.id),
    rows AS (
      SELECT t.*, coalesce(receipts, 0) AS receipts, worst, coalesce(orders, 0) AS orders, coalesce(in_use, 0) AS in_use, 0.01 + coalesce(got.variance, 0) + coalesce(cover.variance, 0) AS wide, {", ".join(f"coalesce(g_{d}, 0) AS g_{d}, coalesce(o_{d}, 0) AS o_{d}" for d in "nvg")}
      FROM target t LEFT JOIN got ON got.id = t.id LEFT JOIN cover ON cover.id = t.id),
    gaps AS (SELECT *, {", ".join(f"{_GAP(f't_{d}', f'g_{d}', tol)} AS x_{d}, CASE WHEN orders > 0 THEN {_GAP(f't_{d}', f'o_{d}', tol)} ELSE 0 END AS y_{d}" for d, tol in (("n", "wide"), ("v", "0.01"), ("g", "wide")))} FROM rows),
    diffs AS (SELECT *, {", ".join(f"greatest(x_{d}, y_{d}) AS d_{d}" for d in "nvg")} FROM gaps),
    judged AS (SELECT *, CASE WHEN duplicate THEN 'duplicate_invoice' WHEN gone OR (a_g > 0 AND d_g = 0 AND receipts = 0) THEN 'cancelled_or_reversed' WHEN class = 'unknown' THEN 'review_classification' WHEN receipts = 0 AND class = 'service' THEN 'service_without_receipt'
      WHEN receipts = 0 THEN 'unmatched_invoice' WHEN y_n > 0 OR y_v > 0 OR y_g > 0 THEN 'over_invoiced' WHEN d_n > 0 OR d_v > 0 OR d_g > 0 THEN 'amount_difference' WHEN worst = 4 THEN 'fallback_match' ELSE 'matched' END AS finding FROM diffs)
    SELECT id AS subject, finding, CASE WHEN finding IN ('matched', 'cancelled_or_reversed', 'service_without_receipt') THEN 'dismissed' ELSE 'review_needed' END AS status, CASE WHEN receipts = 0 THEN 'none' WHEN worst = 1 THEN 'exact' WHEN worst <= 3 THEN 'high' ELSE 'low' END AS confidence,
      CAST(CASE WHEN finding = 'duplicate_invoice' THEN t_g ELSE d_n END AS DECIMAL(18,2)) AS exposure, {", ".join(f"CAST(g_{d} AS DECIMAL(18,2)) AS matched_{n}, CAST(d_{d} AS DECIMAL(18,2)) AS {n}_difference" for d, n in (("n", "net"), ("v", "vat"), ("g", "gross")))},
      CAST(receipts + in_use + adjustments AS BIGINT) AS matched_records FROM judged
    UNION ALL SELECT subject, 'unmatched_receipt', 'review_needed', 'none', rest, 0, rest, 0, 0, 0, 0, 0 FROM left_over WHERE rest > 0.01"""


def _frames(t, *names):
    tables = match_tables(t)
    return ThreeWayMatch().prepare({n: tables[n] for n in names}, False)


@query("ctl_10_three_way_match", _MATCH_SQL)
def _(t):
    out = ThreeWayMatch().evaluate(match_tables(t))
    return out.select("subject", "finding", "status", "confidence", "exposure", "matched_net", "matched_vat", "matched_gross", "net_difference", "vat_difference", "gross_difference", "matched_records")


@query("alloc_03_receipt_consumption", f"WITH RECURSIVE {_MATCH_ROWS}, {_OPEN}, {_SERVED} SELECT * FROM used")
def _(t):
    from tallymark.plans.purchase_match import MatchParameters
    control, p = ThreeWayMatch(), MatchParameters()
    frames = _frames(t, "invoices", "receipts")
    invoices = frames["invoices"].withColumns({f"target_{d}": F.col(f"{d}_amount") for d in ("net", "vat", "gross")})
    used = control.match_receipts(invoices, frames["receipts"], p)
    return used.select("consumer", "resource", "tier", *[F.col(f"take_{d}").cast(CENTS).alias(f"take_{d}") for d in ("net", "vat", "gross")])


_FIFO = """WITH d AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS q FROM orders WHERE o_orderstatus <> 'F'), s AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS q FROM orders WHERE o_orderstatus = 'F'),
    dl AS (SELECT k, id, sum(q) OVER w - q AS lo, sum(q) OVER w AS hi FROM d WHERE q > 0 WINDOW w AS (PARTITION BY k ORDER BY id)), sl AS (SELECT k, id, sum(q) OVER w - q AS lo, sum(q) OVER w AS hi FROM s WHERE q > 0 WINDOW w AS (PARTITION BY k ORDER BY id))
    SELECT dl.k, dl.id AS invoice, sl.id AS receipt, CAST(least(dl.hi, sl.hi) - greatest(dl.lo, sl.lo) AS DECIMAL(18,2)) AS taken FROM dl JOIN sl ON dl.k = sl.k AND dl.lo < sl.hi AND sl.lo < dl.hi"""


@query("alloc_04_fifo_overlap", _FIFO)
def _(t):
    rows = t.orders.select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast(CENTS).alias("q"), "o_orderstatus")
    demand = rows.where("o_orderstatus <> 'F'").select("k", F.col("id").alias("invoice"), "q")
    supply = rows.where("o_orderstatus = 'F'").select("k", F.col("id").alias("receipt"), "q")
    return allocation.fifo_overlap(demand, supply, "k", "invoice", "q", "receipt", "q")


@query("alloc_05_order_coverage", f"""WITH {_MATCH_ROWS}, {_OPEN}, {_LAID} SELECT a.id AS consumer, p AS resource, CAST(greatest(0, least(f_n, e_n) - greatest(f_n - t_n, e_n - s_n)) AS DECIMAL(18,2)) AS covered
    FROM asked a JOIN laid l ON l.vendor = a.vendor AND l.po = a.po WHERE {_TOUCH}""")
def _(t):
    control = ThreeWayMatch()
    frames = _frames(t, "invoices", "orders")
    invoices = frames["invoices"].withColumns({f"target_{d}": F.col(f"{d}_amount") for d in ("net", "vat", "gross")})
    return control.cover_orders(invoices, frames["orders"]).select("consumer", "resource", F.col("take_net").cast(CENTS).alias("covered"))


@query("alloc_06_credit_consumption", f"WITH {_MATCH_ROWS}, {_CREDITED} SELECT id AS consumer, t_n AS target_net, gone AS is_cancelled FROM target")
def _(t):
    from tallymark.plans.purchase_match import MatchParameters
    control = ThreeWayMatch()
    frames = _frames(t, "invoices", "adjustments")
    return control.credits(frames["invoices"], frames["adjustments"], MatchParameters()).select("consumer", "target_net", "is_cancelled")


@query("alloc_07_unmatched_receipts", f"WITH RECURSIVE {_MATCH_ROWS}, {_OPEN}, {_SERVED}, {_LEFT} SELECT subject, rest AS exposure FROM left_over WHERE rest > 0.01")
def _(t):
    from tallymark.plans.purchase_match import MatchParameters
    control, p = ThreeWayMatch(), MatchParameters()
    frames = _frames(t, "invoices", "receipts")
    invoices = frames["invoices"].withColumns({f"target_{d}": F.col(f"{d}_amount") for d in ("net", "vat", "gross")})
    matched = control.match_receipts(invoices, frames["receipts"], p)
    return control.unmatched_receipts(frames["receipts"], matched, p).select("subject", "exposure")


@query("win_01_duplicate_invoices", """SELECT l_orderkey, l_linenumber, max(l_extendedprice)::DECIMAL(18,2) AS last_price, count(*) - 1 AS repeats FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(CENTS).alias("price"), F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax").alias("record"))
    firsts = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("record").alias("first"))
    repeats = rows.join(firsts, ["l_orderkey", "l_linenumber"]).where(F.col("record") > F.col("first"))
    return repeats.groupBy("l_orderkey", "l_linenumber").agg(F.max("price").alias("last_price"), F.count(F.lit(1)).alias("repeats"))


@query("agg_30_collapse_repeats", """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, min(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey, l_linenumber) AS lo, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber, arg_min((l_returnflag, l_linestatus), p) AS c, min(p) AS p FROM x GROUP BY 1, 2) SELECT x.l_orderkey, x.l_linenumber, count(*) AS lines FROM x JOIN f USING (l_orderkey, l_linenumber) WHERE x.p = f.p OR (x.l_returnflag, x.l_linestatus) <> f.c GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.select(F.format_string("%020.2f", "l_extendedprice").alias("record_id"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.lit("e").alias("evidence_id"))
    return collapse_repeats(rows, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("lines"))


@query("agg_30_collapse_business_records", "SELECT l_orderkey, l_returnflag, CAST(min(l_linenumber) AS VARCHAR) AS record_id FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("string").alias("record_id"), F.lit("e").alias("evidence_id"))
    return collapse_business_records(rows, ["l_orderkey"], ["l_returnflag"]).drop("evidence_id")


@query("agg_30_collapse_receipts", with_views("receipts", tail="SELECT vendor, count(*) AS receipts FROM (SELECT DISTINCT vendor, CAST(goods_receipt_no AS BIGINT) % 30 FROM receipts) GROUP BY 1"))
def _(t):
    rows = t.receipts.select(F.col("goods_receipt_no").alias("record_id"), F.lit(None).cast("string").alias("receipt_id"), F.col("vendor").alias("invoice_id"), "vendor",
                             F.date_add(F.lit(date(2024, 1, 1)), (F.col("goods_receipt_no").cast("long") % 30).cast("int")).alias("occurrence_date"), F.lit("accepted").alias("status"))
    return collapse_receipts(rows).groupBy("vendor").agg(F.count(F.lit(1)).alias("receipts"))


@query("ctl_status_totals", " UNION ALL ".join(f"SELECT '{name}' AS control_id, status, count(*) AS outcomes, CAST(sum(exposure) AS DECIMAL(18,2)) AS exposure FROM ({sql}) GROUP BY ALL" for name, sql in (("capital_expenditure_classification", _CAPEX_SQL), ("vendor_integrity_and_segregation_of_duties", _VENDOR_SQL))))
def _(t):
    """Statuses of two record controls side by side, as the admission input."""
    capex = CapitalExpenditure().evaluate(capex_tables(t), CAPEX_PARAMETERS).select("control_id", "status", "exposure")
    vendor = VendorIntegrity().evaluate(vendor_tables(t), VENDOR_PARAMETERS).select("control_id", "status", "exposure")
    return capex.unionByName(vendor).groupBy("control_id", "status").agg(F.count(F.lit(1)).alias("outcomes"), aggregates.cents_sum(F.col("exposure")).alias("exposure"))
