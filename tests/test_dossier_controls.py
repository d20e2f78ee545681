"""Dossier controls, admission and graph on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.functions.money import money, quantize_cents
from tallymark.functions.roles import role_view
from tallymark.operators import cases, graph
from tallymark.operators.admission import admit_candidates, admit_findings
from tallymark.plans.anomalies import AnomalyDiscovery, AnomalyParameters
from tallymark.plans.capitalised_repairs import CapitalisedRepairs
from tallymark.plans.payment_split import PaymentSplit
from tallymark.plans.vendor_sod import VendorSegregation

SHARES = {1: 301, 2: 176, 3: 125, 4: 97, 5: 79, 6: 67, 7: 58, 8: 51, 9: 46}


def clean():
    return [(f"C-{digit}-{k}", f"{digit}{k}.{(7 * k) % 99 + 1:02d}", "400", "text") for digit, n in SHARES.items() for k in range(n)]


def run_anomalies(spark, rows, **params):
    raw = spark.createDataFrame(rows, "BELEGNUMMER string, BUCHUNGSBETRAG string, SACHKONTONUMMER string, BUCHUNGSTEXT string").repartition(6)
    view = role_view(raw, ["document_no", "amount", "account"])
    ledger = view.withColumn("amount", quantize_cents(money(F.col("amount")))).withColumn("evidence_id", F.concat_ws("|", "document_no", "amount", F.monotonically_increasing_id()))
    found = AnomalyDiscovery().run({"ledger": ledger}, params).findings
    return {r["subject"]: r for r in admit_findings(found).collect()}


def test_clean_population_gives_no_lead(spark):
    assert run_anomalies(spark, clean()) == {}


def test_leads(spark):
    out = run_anomalies(spark, clean() + [("R-1", "5000.00", "1", ""), ("R-2", "12000.00", "1", "")] + [("DUP-1", "250.00", "1", "")] * 3)
    assert out["anomaly:round-number-postings"]["exposure"] == Decimal("17000.00")
    assert out["anomaly:duplicate-reference:DUP-1:250.00"]["exposure"] == Decimal("500.00")
    assert set(out) == {"anomaly:round-number-postings", "anomaly:duplicate-reference:DUP-1:250.00"}
    assert {r["verdict"] for r in out.values()} == {"HUMAN_REVIEW"}


def test_first_digits_need_a_population(spark):
    rows = [(f"N-{i}", "900.00", "1", "") for i in range(300)]
    assert run_anomalies(spark, rows)["anomaly:benford-first-digit"]["exposure"] == Decimal("0.00")
    assert "anomaly:benford-first-digit" not in run_anomalies(spark, rows[:50])


def test_unreadable_parameters_fall_back():
    chosen = AnomalyParameters.from_params({"anomaly_round_multiple": "x", "anomaly_duplicate_min_count": "3", "anomaly_round_min_magnitude": "NaN"})
    assert (chosen.round_multiple, chosen.duplicate_min_count, chosen.round_min_magnitude) == (Decimal(1000), 3, Decimal(1000))
    with pytest.raises(ValueError):
        AnomalyParameters(duplicate_min_count=1)


def test_split_payment_limit_from_policy(spark):
    rows = [("Batch", f"D{i}", "01.02.2026", Decimal(a), "Zahlung", text, f"e{i}") for i, (a, text) in enumerate([(4000, "Miete"), (3000, "Miete Rate 2")])]
    rows += [("Batch", "D9", "01.02.2026", Decimal(-7000), "Zahlung", "Miete", "e9"), ("Other", "D5", "01.02.2026", Decimal(4000), "Rechnung", "", "e5"), ("Batch", "D7", "1.2.2026", Decimal(4000), "Zahlung", "", "e7")]
    postings = spark.createDataFrame(rows, "payment_reference string, document_no string, posting_date string, amount decimal(18,2), posting_kind string, posting_text string, evidence_id string")
    policy = spark.createDataFrame([(0, 1, "Allgemeines ab 5 EUR"), (0, 2, "Zweite Freigabe ab 5.000 EUR erforderlich")], "table_no int, row int, text string")
    found = PaymentSplit().run({"postings": postings, "narratives": policy})
    out = found.findings.collect()
    assert [(r["subject"], str(r["exposure"])) for r in out] == [("Batch", "7000.00")]
    tests = {t["name"]: t["outcome"] for t in out[0]["counter_tests"]}
    assert tests == {"separate_invoices": "present", "instalment_plan": "present", "reversal_present": "absent", "second_approval": "absent"}
    assert found.inputs.count() == 2
    assert admit_findings(found.findings).first()["verdict"] == "HUMAN_REVIEW"


def test_vendor_segregation(spark):
    masters = spark.createDataFrame([("70001", "Neuanlage", "Kreditor", "anna", "anna", "m1"), ("70002", "Neuanlage", "Kreditor", "anna", "bert", "m2"), ("70003", "Änderung", "Kreditor", "anna", "anna", "m3"), ("70004", "Neuanlage", "Kreditor", "", "", "m4")],
                                    "account string, change_type string, field_changed string, changed_by string, approved_by string, evidence_id string")
    postings = spark.createDataFrame([("70001", Decimal("-100.50"), "Rechnung", "p1"), ("70001", Decimal("-10"), "Saldenvortrag", "p2"), ("70001", Decimal("50"), "Zahlung", "p3"), ("70004", Decimal("-5"), "Rechnung", "p4")],
                                     "account string, amount decimal(18,2), posting_text string, evidence_id string")
    receipts = spark.createDataFrame([("70002", "GR1", "g1")], "vendor string, goods_receipt_no string, evidence_id string")
    toxic = spark.createDataFrame([("anna",)], "user_id string")
    found = VendorSegregation().run({"masters": masters, "postings": postings, "receipts": receipts, "toxic_users": toxic})
    out = {r["subject"]: r for r in admit_findings(found.findings).collect()}
    assert set(out) == {"70001", "70002", "70004"}
    assert out["70001"]["exposure"] == Decimal("100.50") and out["70001"]["verdict"] == "DISMISSED"  # opening balance seen
    assert out["70002"]["verdict"] == "DISMISSED" and out["70004"]["verdict"] == "HUMAN_REVIEW"
    assert len(out["70001"]["chain"]) == 3 and out["70004"]["reasons"][0]["detail"] == "legacy input"


def candidate(**changes):
    base = dict(engagement_id="'e'", run_id="'r'", control_id="'c'", control_version="'1'", subject="'s'", exposure="10.00", uncertainty="cast(null as string)", refs="array(named_struct('evidence_id','a','content','x'))", cited="'a'", result="10.00",
                outcome="'searched_absent'", required="true", ids="array('a')", search="named_struct('scope','all','method','exact','searched_sources',array('f'),'evidence_ids',array('a'))", conflict="false", judgement="false", replay_run="'r'")
    base.update(changes)
    return """select {engagement_id} engagement_id, {run_id} run_id, {control_id} control_id, {control_version} control_version, {subject} subject, cast({exposure} as decimal(18,2)) exposure,
        named_struct('expression','x','inputs',array(named_struct('label','l','value',cast(10 as decimal(18,2)),'evidence_id',{cited})),'result',cast({result} as decimal(18,2)),'sql','') calculation, {refs} evidence_refs,
        array(named_struct('name','n','outcome',{outcome},'detail','d','required',{required},'evidence_ids',{ids},'search',{search})) counter_tests,
        named_struct('conflicting_evidence',{conflict},'material_uncertainty',false,'accounting_judgement',{judgement},'incomplete_supporting_evidence',false) signals, {uncertainty} uncertainty,
        named_struct('engagement_id','e','run_id',{replay_run},'control_id','c','control_version','1','runtime_version','v','inputs',array(named_struct('name','i','value','1')),'evidence_ids',array('a'),'bindings',array(named_struct('name','i','evidence_id','a'))) replay""".format(**base)


@pytest.mark.parametrize(("changes", "verdict"), [
    ({}, "CONFIRMED"), ({"outcome": "'present'"}, "DISMISSED"), ({"outcome": "'conflicting'"}, "HUMAN_REVIEW"), ({"outcome": "'unknown'"}, "HUMAN_REVIEW"), ({"outcome": "'not_executed'"}, "HUMAN_REVIEW"),
    ({"outcome": "'not_applicable'"}, "CONFIRMED"), ({"outcome": "'not_applicable'", "ids": "cast(array() as array<string>)"}, "HUMAN_REVIEW"), ({"required": "false"}, "HUMAN_REVIEW"), ({"conflict": "true"}, "HUMAN_REVIEW"),
    ({"judgement": "true"}, "HUMAN_REVIEW"), ({"uncertainty": "'open'"}, "HUMAN_REVIEW"), ({"result": "11.00"}, "REJECTED"), ({"cited": "'zz'"}, "REJECTED"), ({"ids": "array('zz')"}, "REJECTED"), ({"replay_run": "'other'"}, "REJECTED"),
    ({"control_id": "'legacy'"}, "REJECTED"), ({"refs": "array(named_struct('evidence_id','a','content','x'),named_struct('evidence_id','a','content','y'))"}, "REJECTED")])
def test_admission_matrix(spark, changes, verdict):
    assert admit_candidates(spark.sql(candidate(**changes))).first()["verdict"] == verdict


def test_graph_hops(spark):
    nodes = spark.createDataFrame([("entity-1", "entity"), ("event-1", "financial_event"), ("evidence-1", "evidence_ref")], "id string, kind string")
    edges = spark.createDataFrame([("entity-1", "event-1", "created"), ("event-1", "evidence-1", "supported_by"), ("event-1", "evidence-2", "contradicted_by"), ("evidence-1", "entity-1", "derived_from")], "src string, dst string, relationship string")
    starts = spark.createDataFrame([("entity-1",), ("nobody",)], "start string")
    reach = lambda hops, kinds=None: {r["id"] for r in graph.neighbourhood(nodes, edges, starts, hops, kinds).collect()}
    assert reach(1) == {"entity-1", "event-1"}
    assert reach(2) == {"entity-1", "event-1", "evidence-1", "evidence-2"}
    assert reach(2, ["created", "supported_by"]) == {"entity-1", "event-1", "evidence-1"}
    assert {r["id"]: r["kind"] for r in graph.with_implicit_nodes(nodes, edges).collect()}["evidence-2"] == "entity"


def test_graph_hops_meet_every_node_once(spark):
    """Repeats and earlier nodes go in one aggregation, also where an edge has no end."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", None), ("b", None), ("b", "a"), ("b", "c"), ("z", "b")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("a",), ("c",), ("nobody",), (None,)], "start string")
    nodes = spark.createDataFrame([("a",), ("a",)], "id string")
    reached = graph.neighbourhood(nodes, edges, starts, 3)
    assert sorted(reached.collect(), key=str) == sorted([("a", "a", 0), ("c", "c", 0), ("a", "b", 1), ("a", None, 1), ("a", "c", 2)], key=str)
    assert "LeftAnti" not in reached._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("status", "tests", "uncertainty", "verdict"), [
    ("confirmed_candidate", ["accounted_for", "not_found"], [], "CONFIRMED"), ("confirmed_candidate", ["not_found", "unresolved"], [], "HUMAN_REVIEW"),
    ("review_needed", ["not_found"], [], "HUMAN_REVIEW"), ("confirmed_candidate", ["not_found"], ["open"], "HUMAN_REVIEW"),
    ("dismissed", ["accounted_for", "not_found"], [], "DISMISSED"), ("dismissed", ["not_found"], [], "DISMISSED")])
def test_record_outcomes_at_the_gate(spark, status, tests, uncertainty, verdict):
    from tallymark.operators.admission import admit_candidates, candidates_from_outcomes
    row = ("c1", "1", status, "v1", 10.0, "e1", [(f"t{i}", s, "searched") for i, s in enumerate(tests)], uncertainty)
    schema = "control_id string, control_version string, status string, subject string, exposure double, evidence_id string, counter_tests array<struct<name string, status string, description string>>, uncertainty array<string>"
    outcomes = spark.createDataFrame([row], schema)
    assert admit_candidates(candidates_from_outcomes(outcomes, "eng", "run")).first()["verdict"] == verdict
    evidence = spark.createDataFrame([("e1", "row text"), ("e2", "other")], "evidence_id string, content string")
    assert admit_candidates(candidates_from_outcomes(outcomes, "eng", "run", evidence)).first()["verdict"] == verdict
    assert admit_candidates(candidates_from_outcomes(outcomes, "eng", "run", evidence.where("evidence_id = 'e2'"))).first()["verdict"] == "REJECTED"


def test_evidence_pool_of_subjects_equals_that_of_findings(spark):
    step = "array<struct<step:string,evidence_ids:array<string>>>"
    rows = [("f1", "c1", "v1", [("s", ["m1"])], [("t", ["g1"])]), ("f2", "c1", "v1", [("s", ["m2"])], [("t", [])]), ("f3", "c2", "v2", [("s", ["m3", "e9"])], [("t", ["g1"])])]
    found = spark.createDataFrame(rows, f"finding_id string, case_id string, subject string, evidence_chain {step}, counter_tests {step}")
    shared = spark.createDataFrame([("v1", "e1"), ("v1", "e2"), ("v3", "e3")], "subject string, evidence_id string")
    each = found.select("finding_id", "subject").join(shared, "subject").drop("subject")
    pool = {tuple(r) for r in cases.evidence_pool(found, each).collect()}
    assert pool == {("c1", e) for e in ("m1", "m2", "g1", "e1", "e2")} | {("c2", e) for e in ("m3", "e9", "g1")}
    assert cases.evidence_pool(found, shared).count() == len(pool)
    assert {tuple(r) for r in cases.evidence_pool(found, shared).collect()} == pool
    assert {tuple(r) for r in cases.citing_findings(found, shared).collect()} == {("f1", "v1"), ("f2", "v1")}


def test_repairs_read_the_additions_once(spark):
    """Existence test, sample, totals and inputs share one pass over the additions."""
    seen = spark.sparkContext.accumulator(0)

    def told(row):
        seen.add(1)
        return row

    rows = [("7", Decimal("10.00"), "Zugang", "1", "", "e1"), ("7", Decimal("5.50"), "Zugang", "1", "", "e2"), ("8", Decimal("3.00"), "Zugang", "1", "", "e3"), ("7", Decimal("2.00"), "Zugang", "2", "", "e4")]
    additions = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(told), "asset_no string, amount decimal(18,2), posting_kind string, asset_group string, posting_text string, evidence_id string")
    tables = {"additions": additions, "descriptions": spark.createDataFrame([("7", "old ring", 0, 1), ("8", "new ring", 0, 2)], "asset_no string, asset_desc string, table_no int, row_no int"),
              "chart": spark.createDataFrame([("1", "Bilanzkonto"), ("2", "GuV")], "account string, account_type string"), "texts": spark.createDataFrame([("t", "the station of 7")], "text_id string, text string")}
    found = CapitalisedRepairs(repair_words=("old",), investment_words=("tion",)).run(tables)
    row = found.findings.first()
    assert (row["input_count"], row["exposure"], row["counter_tests"][0]["outcome"]) == (2, Decimal("15.50"), "present")
    assert sorted(r["evidence_id"] for r in found.inputs.collect()) == ["e1", "e2"]
    assert seen.value == len(rows)
