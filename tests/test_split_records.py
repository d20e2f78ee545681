from decimal import Decimal

import pytest
from helpers import counted, d, frame, m, shuffled

from tallymark.operators.checks import RejectedRecords
from tallymark.plans.split_records import SplitParameters, SplitPayments

SCHEMA = ("payment_id string, payee string, payment_date date, payment_reference string, amount decimal(18,2), "
          "reversal_of string, obligation_id string, installment_plan_id string, second_approval boolean, evidence_id string")


def pay(i, amount, **kw):
    row = {"payment_id": i, "payee": "Example GmbH", "payment_date": d("2026-01-15"), "payment_reference": "Batch A",
           "amount": m(amount), "second_approval": False, "evidence_id": f"ev-{i}"}
    return {**row, **kw}


def run(spark, rows, way="given", strict=False):
    table = shuffled(frame(spark, SCHEMA, rows), way)
    return SplitPayments().evaluate({"payments": table}, SplitParameters(Decimal("10000")), strict).collect()


def test_candidate_with_normalised_keys(spark):
    rows = [pay("p-2", 4000, payee=" example   gmbh ", payment_reference="batch a"), pay("p-1", 6000)]
    for way in ("given", "reversed", "spread"):
        out = run(spark, rows, way)
        assert len(out) == 1
        assert out[0]["status"] == "confirmed_candidate" and out[0]["exposure"] == Decimal("10000.00")
        assert out[0]["subject"] == "EXAMPLE GMBH/2026-01-15/BATCH A"
        assert out[0]["calculation_steps"][0]["expression"] == "6000.00 + 4000.00 = 10000.00"


@pytest.mark.parametrize("rows", [
    [pay("a", 11000)], [pay("a", 10000), pay("b", 1)], [pay("a", 6000), pay("b", 6000, payment_reference="Other")],
    [pay("a", 4000), pay("b", 5000)], [pay("a", 11000), pay("b", 100)]])
def test_nothing(spark, rows):
    assert run(spark, rows) == []


CASES = {
    "obligations": ([pay("p-1", 6000, obligation_id="o1"), pay("p-2", 5000, obligation_id="o2")], "dismissed", "11000.00", None),
    "explicit": ([pay("p-1", 6000), pay("p-2", 5000), pay("r", -5000, payment_date=d("2026-01-16"), reversal_of="p-2")], "dismissed", "6000.00", None),
    "implicit": ([pay("p-1", 7000), pay("p-2", 4000), pay("r", -4000)], "dismissed", "7000.00", "unique equal-and-opposite"),
    "ambiguous": ([pay("p-1", 6000), pay("p-2", 6000), pay("r", -6000)], "review_needed", "12000.00", "multiple payments could match"),
    "predates": ([pay("p-1", 6000), pay("p-2", 5000), pay("r", -5000, payment_date=d("2026-01-14"), reversal_of="p-2")], "review_needed", "11000.00", "predates"),
    "plan": ([pay("p-1", 6000, installment_plan_id="x"), pay("p-2", 5000, installment_plan_id="x")], "dismissed", "11000.00", None),
    "approval": ([pay("p-1", 6000, second_approval=True), pay("p-2", 5000)], "dismissed", "11000.00", None),
}


@pytest.mark.parametrize("name", CASES)
def test_counter_tests(spark, name):
    rows, status, exposure, text = CASES[name]
    out = run(spark, rows, "spread")
    assert [(o["status"], str(o["exposure"])) for o in out] == [(status, exposure)]
    if text:
        assert text in out[0]["counter_tests"][0]["description"]


def test_duplicate_id_is_an_error(spark):
    with pytest.raises(RejectedRecords):
        run(spark, [pay("p", 6000), pay("p", 5000)], strict=True)


def test_payments_are_read_once_however_often_they_are_needed(spark):
    rows = [pay("p-1", 6000), pay("p-2", 4000), pay("r-1", -4000, reversal_of="p-2", payment_date=d("2026-01-16")), pay("r-2", -6000, payment_date=d("2026-01-17"))]
    table, reads = counted(spark, SCHEMA, rows)
    out = SplitPayments().evaluate({"payments": table}, SplitParameters(Decimal("10000"))).collect()
    assert [(r["status"], r["exposure"]) for r in out] == [("dismissed", Decimal("0.00"))] and reads.value == len(rows)


@pytest.mark.parametrize("piece", [10_000, 20])
def test_large_groups_write_every_payment_into_their_expressions(spark, monkeypatch, piece):
    monkeypatch.setattr(SplitPayments, "piece", piece)
    rows = [pay(f"p-{n:03}", 100 + n) for n in range(150)] + [pay(f"q-{n}", 6000 + n, payee="Other KG") for n in range(2)]
    rows += [pay(f"r-{n:03}", -(100 + n), reversal_of=f"p-{n:03}", payment_date=d("2026-01-16")) for n in range(0, 150, 3)]
    out = {r["payee"]: r["calculation_steps"] for r in run(spark, rows, "spread")}
    terms = [f"{100 + n}.00" for n in range(150)]
    assert out["EXAMPLE GMBH"][0]["expression"] == " + ".join(terms) + f" = {sum(range(100, 250))}.00"
    left = [n for n in range(150) if n % 3]
    assert out["EXAMPLE GMBH"][2]["expression"] == " + ".join(terms[n] for n in left) + f" = {sum(100 + n for n in left)}.00"
    assert out["OTHER KG"][0]["expression"] == "6000.00 + 6001.00 = 12001.00"
