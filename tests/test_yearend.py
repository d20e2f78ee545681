"""Fixtures of the year-end cut-off. Each case has its own ids, so one run evaluates all of them."""

from decimal import Decimal

import pytest
from helpers import counted, d, frame, m, shuffled

from tallymark.plans import yearend
from tallymark.plans.yearend import CutoffParameters, YearEndCutoff

IDS = "invoice_id string, vendor_id string, document_id string, receipt_id string"
SCHEMAS = {
    "invoices": f"record_id string, {IDS}, invoice_date date, posting_date date, net_amount decimal(18,2), vat_amount decimal(18,2), gross_amount decimal(18,2), accounting_period_known boolean, evidence_id string",
    "receipts": f"record_id string, {IDS}, occurrence_date date, net_amount decimal(18,2), status string",
    "closing": f"record_id string, {IDS}, kind string, posting_date date, net_amount decimal(18,2), generic boolean, accounting_period_known boolean",
    "adjustments": "record_id string, invoice_id string, vendor_id string, document_id string, kind string, effective_date date, net_amount decimal(18,2)",
    "exceptions": "record_id string, reason string, invoice_id string, document_id string",
}


def inv(i="inv", net=100, **kw):
    return "invoices", {"record_id": i, "invoice_id": "I", "vendor_id": "V", "document_id": "D", "invoice_date": d("2027-01-10"), "posting_date": d("2027-01-10"), "net_amount": m(net), "vat_amount": m(19), "gross_amount": m(119), "accounting_period_known": True, **kw}


def rec(i="rec", **kw):
    return "receipts", {"record_id": i, "invoice_id": "I", "occurrence_date": d("2026-12-20"), "status": "accepted", **kw}


def clo(i="clo", net=100, **kw):
    return "closing", {"record_id": i, "invoice_id": "I", "kind": "accrual", "posting_date": d("2026-12-31"), "net_amount": m(net), "generic": False, "accounting_period_known": True, **kw}


def adj(kind, **kw):
    return "adjustments", {"record_id": "adj", "invoice_id": "I", "kind": kind, "effective_date": d("2027-01-15"), "net_amount": m(100), **kw}


CASES = {
    "plain": ([inv(), rec()], ("confirmed_candidate", "100.00", "0.00", "0.00"), None),
    "accrual": ([inv(), rec(), clo()], ("dismissed", "0.00", "100.00", "0.00"), None),
    "liability": ([inv(), rec(), clo(kind="liability")], ("dismissed", "0.00", "100.00", "0.00"), None),
    "generic": ([inv(), rec(), clo(net=500, generic=True, invoice_id=None, vendor_id="V")], ("review_needed", "100.00", "0.00", "0.00"), "generic accrual"),
    "part": ([inv(), rec(), clo(net=40)], ("confirmed_candidate", "60.00", "40.00", "0.00"), None),
    "not later": ([inv(invoice_date=d("2026-12-30"), posting_date=d("2026-12-30")), rec()], None, None),
    "later service": ([inv(), rec(occurrence_date=d("2027-01-02"))], None, None),
    "credit note": ([inv(), rec(), adj("credit_note")], ("dismissed", "0.00", "0.00", "100.00"), None),
    "cancellation": ([inv(), rec(), adj("cancellation")], ("dismissed", "0.00", "0.00", "100.00"), None),
    "returned": ([inv(), rec(status="returned")], ("dismissed", "100.00", "0.00", "0.00"), None),
    "exception": ([inv(), rec(), ("exceptions", {"record_id": "x", "reason": "policy", "invoice_id": "I"})], ("dismissed", "100.00", "0.00", "0.00"), None),
    "within tolerance": ([inv(), rec(), clo(net=99.99)], ("dismissed", "0.00", "99.99", "0.00"), None),
    "beyond tolerance": ([inv(), rec(), clo(net=99.98)], ("confirmed_candidate", "0.02", "99.98", "0.00"), None),
    "no service date": ([inv(), rec(occurrence_date=None)], ("review_needed", "100.00", "0.00", "0.00"), "date is missing"),
    "unknown period": ([inv(accounting_period_known=False), rec()], ("review_needed", "100.00", "0.00", "0.00"), "uncertain"),
    "unknown closing period": ([inv(), rec(), clo(accounting_period_known=False)], ("review_needed", "100.00", "0.00", "0.00"), "closing record"),
    "before the period": ([inv(), rec(occurrence_date=d("2025-12-20"))], ("review_needed", "100.00", "0.00", "0.00"), "predates"),
}


@pytest.fixture(scope="module", params=["given", "spread"])
def outcomes(spark, request):
    rows = {name: [] for name in SCHEMAS}
    for n, (records, _, _) in enumerate(CASES.values()):
        for name, record in records:
            tagged = {k: (f"{n:02d}-{v}" if k in ("record_id", "invoice_id", "vendor_id", "document_id", "receipt_id") and v else v) for k, v in record.items()}
            rows[name].append(tagged)
    # two invoices that share a vendor and use their own accruals
    for i, net in (("2", 70), ("1", 30)):
        rows["invoices"].append({**inv(f"t{i}", net)[1], "invoice_id": f"T-{i}", "vendor_id": "T", "document_id": f"TD-{i}"})
        rows["receipts"].append({**rec(f"tr{i}")[1], "invoice_id": f"T-{i}"})
        rows["closing"].append({**clo(f"tc{i}", net)[1], "invoice_id": f"T-{i}"})
    tables = {name: shuffled(frame(spark, SCHEMAS[name], rows[name]), request.param) for name in SCHEMAS}
    out = YearEndCutoff().evaluate(tables, CutoffParameters(d("2026-01-01"), d("2026-12-31"), Decimal("0.01"))).collect()
    return {r["invoice_id"]: r for r in out}


@pytest.mark.parametrize("n", range(len(CASES)), ids=list(CASES))
def test_case(outcomes, n):
    _, expected, doubt = list(CASES.values())[n]
    row = outcomes.get(f"{n:02d}-I")
    if expected is None:
        assert row is None
        return
    assert (row["status"], str(row["exposure"]), str(row["closing_coverage_net"]), str(row["adjustment_net"])) == expected
    if doubt:
        assert any(doubt in text for text in row["uncertainty"])


def test_own_accruals(outcomes):
    assert [str(outcomes[f"T-{i}"]["closing_coverage_net"]) for i in ("1", "2")] == ["30.00", "70.00"]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        CutoffParameters(d("2026-12-31"), d("2026-01-01"))
    with pytest.raises(ValueError):
        CutoffParameters(d("2026-01-01"), d("2026-12-31"), matching_hierarchy=("invoice_id", "invoice_id"))


def test_receipts_are_read_once_and_references_nobody_has_are_not_looked_for(spark):
    tables = {n: [] for n in SCHEMAS}
    for name, row in (inv(), rec(), clo(document_id=None), adj("credit_note")):
        tables[name].append(row)
    frames = {n: frame(spark, SCHEMAS[n], rows) for n, rows in tables.items()}
    frames["receipts"], reads = counted(spark, SCHEMAS["receipts"], tables["receipts"])
    out = YearEndCutoff().evaluate(frames, CutoffParameters(d("2026-01-01"), d("2026-12-31"))).collect()
    assert [(r["status"], r["exposure"]) for r in out] == [("dismissed", Decimal("0.00"))] and reads.value == 1
    bare = yearend.written(frame(spark, SCHEMAS["receipts"], [rec()[1]]))
    assert "document_id" not in bare.columns and "invoice_id" in bare.columns
    nothing = frame(spark, "resource string, document_id string", [])
    links = yearend.ranked_links(frame(spark, "consumer string, seq long, invoice_id string", []), nothing, ("invoice_id", "document_id"), Decimal(0))
    assert links.columns == ["consumer", "seq", "resource", "rank"] and links.count() == 0
