"""Fixtures of vendor integrity and capital expenditure; one vendor or addition per case."""

from decimal import Decimal

import pytest
from helpers import counted, d, frame, m

from tallymark.plans.capex import CapexParameters, CapitalExpenditure
from tallymark.plans.vendor_integrity import VendorIntegrity, VendorParameters

V = {
    "lifecycle": "record_id string, vendor_id string, kind string, user_id string, event_date date, evidence_id string",
    "permissions": "record_id string, user_id string, permission string, active boolean",
    "invoices": "record_id string, vendor_id string, invoice_id string, posting_user_id string, posting_date date, purchase_kind string, net_amount decimal(18,2), tax_amount decimal(18,2), evidence_id string",
    "payments": "record_id string, vendor_id string, payment_id string, invoice_id string, execution_user_id string, payment_date date, gross_amount decimal(18,2), reversal_of string, evidence_id string",
    "approvals": "record_id string, vendor_id string, approver_user_id string, approval_date date, evidence_id string",
    "history": "record_id string, vendor_id string, activity_count int, evidence_id string",
    "support": "record_id string, vendor_id string, kind string, present boolean, evidence_id string",
}


def vendor(v, creator="risk", approver="risk", poster=None, log=False, reverse=False, created=True, extra_support=(), history=0, rapid=0):
    rows = {name: [] for name in V}
    add = lambda name, **kw: rows[name].append({"record_id": f"{v}-{name}-{len(rows[name])}", "vendor_id": v, "evidence_id": v, **kw})
    if created:
        add("lifecycle", kind="created", user_id=creator, event_date=d("2026-01-01"))
        add("lifecycle", kind="approved", user_id=approver, event_date=d("2026-01-01"))
    add("invoices", invoice_id=f"{v}-i", posting_user_id=poster or creator, posting_date=d(f"2026-01-{2 + rapid:02d}"), purchase_kind="service", net_amount=m(100), tax_amount=m(19))
    add("payments", payment_id=f"{v}-p", invoice_id=f"{v}-i", execution_user_id=creator, payment_date=d(f"2026-01-{3 + rapid:02d}"), gross_amount=m(119))
    if reverse:
        add("payments", payment_id=f"{v}-r", execution_user_id=creator, payment_date=d("2026-01-25"), gross_amount=m(-119), reversal_of=f"{v}-p")
    if log:
        add("approvals", approver_user_id=approver, approval_date=d("2026-01-01"))
    if history is not None:
        add("history", activity_count=history)
    for kind in ("contract", "deliverable", "service_acceptance", "goods_receipt", "legitimate_four_eyes"):
        add("support", kind=kind, present=kind in extra_support)
    return rows


@pytest.fixture(scope="module")
def vendors(spark):
    parts = [vendor("risky"), vendor("honest", creator="clerk", approver="chief", poster="books", log=True, extra_support=("service_acceptance", "contract"), history=4),
             vendor("reversed", reverse=True), vendor("uncreated", created=False), vendor("edge", rapid=6), vendor("late", rapid=14)]
    rows = {n: [r for p in parts for r in p[n]] for n in V}
    rows["invoices"] += rows["invoices"][:1]  # an identical record twice changes nothing
    rows["permissions"] = [{"record_id": "1", "user_id": "risk", "permission": "create_vendor", "active": True}, {"record_id": "2", "user_id": "risk", "permission": "execute_payment", "active": True},
                           {"record_id": "3", "user_id": "clerk", "permission": "create_vendor", "active": True}, {"record_id": "4", "user_id": "clerk", "permission": "execute_payment", "active": False}]
    tables = {n: frame(spark, V[n], rows[n]).repartition(5) for n in V}
    return {r["vendor_id"]: r for r in VendorIntegrity().evaluate(tables, VendorParameters(d("2026-01-31"))).collect()}


def test_high_risk_vendor(vendors):
    r = vendors["RISKY"]
    assert r["status"] == "confirmed_candidate" and r["exposure"] == Decimal("119.00") and r["invoice_net_amount"] == Decimal("100.00")
    assert set(r["signals"]) == {"new_vendor", "creator_equals_approver", "create_and_pay_permission", "same_user_creates_posts_pays", "rapid_first_invoice", "rapid_first_payment",
                                 "invoice_paid_unusually_quickly", "missing_independent_approval", "missing_approval_log", "no_prior_vendor_history", "missing_service_or_delivery_evidence"}
    assert r["severity_score"] == Decimal("11.00")


def test_honest_twin_is_dismissed(vendors):
    r = vendors["HONEST"]
    assert r["status"] == "dismissed" and "missing_service_or_delivery_evidence" not in r["signals"]


def test_reversal_and_missing_creation(vendors):
    assert vendors["REVERSED"]["exposure"] == Decimal("0.00")
    tests = {t["name"]: t["status"] for t in vendors["REVERSED"]["counter_tests"]}
    assert tests["reversal"] == "accounted_for"
    assert vendors["UNCREATED"]["status"] == "review_needed" and vendors["UNCREATED"]["signals"] == ["missing_vendor_creation_event"]


def test_windows_include_their_ends(vendors):
    assert "rapid_first_invoice" in vendors["EDGE"]["signals"]
    assert {"rapid_first_invoice", "rapid_first_payment"} & set(vendors["LATE"]["signals"]) == set()


C = {
    "additions": "record_id string, addition_id string, asset_id string, vendor_id string, addition_date date, net_amount decimal(18,2), description string, category string, evidence_id string",
    "postings": "record_id string, posting_id string, addition_id string, account_id string, account_classification string, posting_date date, amount decimal(18,2), description string, reversal_of_posting_id string, is_reclassification boolean, evidence_id string",
    "invoices": "record_id string, invoice_id string, addition_id string, invoice_date date, net_amount decimal(18,2), description string, evidence_id string",
    "assets": "record_id string, asset_id string, description string, category string, distinct_new_asset boolean, evidence_id string",
    "support": "record_id string, addition_id string, kind string, present boolean, evidence_id string",
}


def addition(a, text="Repair of pump", support=None, new=None, back=None, day="2026-02-01", asset=None):
    rows = {n: [] for n in C}
    rows["additions"].append({"record_id": a, "addition_id": a, "asset_id": asset or f"{a}-asset", "vendor_id": "ven", "addition_date": d(day), "net_amount": m(1250), "description": text, "evidence_id": a})
    rows["postings"].append({"record_id": f"{a}-p", "posting_id": f"{a}-p", "addition_id": a, "account_id": "0400", "account_classification": "asset", "posting_date": d("2026-02-02"), "amount": m(1250), "description": "booking", "is_reclassification": False, "evidence_id": a})
    if back:
        rows["postings"].append({**rows["postings"][0], "record_id": f"{a}-r", "posting_id": f"{a}-r", "posting_date": d("2026-02-10"), "amount": m(-1250), **back})
    for kind, present in (support or {}).items():
        rows["support"].append({"record_id": f"{a}-{kind}", "addition_id": a, "kind": kind, "present": present, "evidence_id": a})
    if new is not None:
        rows["assets"].append({"record_id": f"{a}-m", "asset_id": f"{a}-asset", "description": "machine", "distinct_new_asset": new, "evidence_id": a})
    return rows


ALL_ABSENT = {k: False for k in ("distinct_new_asset", "project_reference", "investment_approval", "useful_life_extension", "capacity_or_quality_improvement", "separable_major_component", "required_for_new_asset_operation")}


@pytest.fixture(scope="module")
def capex(spark):
    parts = [addition("repair", support=ALL_ABSENT), addition("new", "New machine", {"project_reference": True}, new=True),
             addition("component", "Overhaul", {"separable_major_component": True, "useful_life_extension": True}),
             addition("cleared", back={"reversal_of_posting_id": "cleared-p"}), addition("moved", back={"is_reclassification": True}),
             addition("wrong", back={"reversal_of_posting_id": "wrong-p", "account_classification": "maintenance_expense"}),
             addition("german", "Überholung und Wartung"), addition("hint", "Project work"), addition("c1", asset="shared"), addition("c2", asset="shared", day="2026-02-20"), addition("c3", asset="shared", day="2026-06-20")]
    rows = {n: [r for p in parts for r in p[n]] for n in C}
    rows["additions"].append({**rows["additions"][0], "record_id": "again", "description": "REPAIR of pump"})  # same content
    rows["support"] += [{"record_id": "x1", "addition_id": "hint", "kind": "investment_approval", "present": p, "evidence_id": "x"} for p in (True, False)]
    tables = {n: frame(spark, C[n], rows[n]).repartition(3) for n in C}
    return {r["addition_id"]: r for r in CapitalExpenditure().evaluate(tables).collect()}


def test_capex_statuses(capex):
    assert len(capex) == 11
    want = {"REPAIR": ("review_needed", "1250.00"), "NEW": ("dismissed", "1250.00"), "COMPONENT": ("dismissed", "1250.00"), "CLEARED": ("dismissed", "0.00"), "MOVED": ("dismissed", "0.00"), "WRONG": ("review_needed", "1250.00")}
    assert {k: (capex[k]["status"], str(capex[k]["exposure"])) for k in want} == want


def test_capex_signals_and_doubts(capex):
    assert set(capex["REPAIR"]["signals"]) == {"repair_or_maintenance_language", "posted_to_asset_account", "no_distinct_asset_or_project_reference", "no_investment_approval", "no_useful_life_or_capacity_improvement"}
    assert capex["GERMAN"]["matched_trigger_terms"] == ["wartung", "überholung"]
    tests = {t["name"]: (t["status"], t["description"]) for t in capex["HINT"]["counter_tests"]}
    assert tests["project_reference"] == ("unresolved", "description suggests project_reference, but supporting evidence is required")
    assert tests["investment_approval"][0] == "unresolved" and "conflicting" in tests["investment_approval"][1]
    assert [k for k in ("C1", "C2", "C3") if "multiple_repair_like_additions" in capex[k]["signals"]] == ["C1", "C2"]


def test_capex_vocabulary_is_checked():
    with pytest.raises(ValueError):
        CapexParameters(repair_maintenance_triggers=("project",))
    with pytest.raises(ValueError):
        CapexParameters(cluster_minimum_count=1)


def test_records_of_an_addition_are_read_once_for_clusters_and_outcomes(spark):
    parts = [addition("repair", support=ALL_ABSENT), addition("new", "New machine", {"project_reference": True}, new=True)]
    rows = {n: [r for p in parts for r in p[n]] for n in C}
    support, reads = counted(spark, C["support"], rows["support"])
    out = CapitalExpenditure().evaluate({**{n: frame(spark, C[n], rows[n]) for n in C}, "support": support}).collect()
    assert len(out) == 2 and reads.value == len(rows["support"]) > 0
