"""Admission: verdicts as column logic over candidates and findings.

Precedence is reject, dismiss, review, confirm. A control's own status is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import vocabulary as V

REASON = "struct<code_no:int,detail_key:string,evidence_ids:array<string>,code:string,detail:string>"
_NO_IDS = "array<string>"


def reason(code: str, detail: Column | None = None, ids: Column | None = None) -> Column:
    detail = detail if detail is not None else F.lit(None).cast("string")
    ids = ids if ids is not None else F.array().cast(_NO_IDS)
    return F.struct(
        F.lit(V.REASON_CODES.index(code)).alias("code_no"), F.coalesce(detail, F.lit("")).alias("detail_key"),
        F.array_sort(F.array_distinct(ids)).alias("evidence_ids"), F.lit(code).alias("code"), detail.alias("detail"),
    ).cast(REASON)


def reason_list(*conditions: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(fires, why) for fires, why in conditions]))


def ordered_reasons(reasons: Column) -> Column:
    """Distinct reasons in code, detail and id order."""
    return F.array_sort(F.array_distinct(reasons))


def reason_text(reasons: Column) -> Column:
    """One fixed sentence per reason, joined in order."""
    pairs = [F.lit(x) for code, text in V.REASON_TEXT.items() for x in (code, text)]
    return F.array_join(F.transform(reasons, lambda r: F.create_map(*pairs)[r["code"]]), " ")


def subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _empty(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) <= 0


def inconsistent_evidence(refs: Column) -> Column:
    """The same id with different content."""
    return F.size(F.array_distinct(refs)) != F.size(F.array_distinct(refs["evidence_id"]))


def valid_search(test: Column, available: Column) -> Column:
    search = test["search"]
    return F.coalesce(
        ~_blank(search["scope"]) & ~_blank(search["method"]) & ~_empty(search["searched_sources"])
        & ~_empty(search["evidence_ids"]) & subset(search["evidence_ids"], available)
        & subset(search["evidence_ids"], test["evidence_ids"]),
        F.lit(False))


def dismissal_reasons(tests: Column, available: Column) -> Column:
    cleared = F.filter(tests, lambda t: (t["outcome"] == "present") & ~_empty(t["evidence_ids"]) & subset(t["evidence_ids"], available))
    return F.transform(cleared, lambda t: reason("counter_evidence_present", t["name"], t["evidence_ids"]))


def review_reasons(tests: Column, available: Column) -> Column:
    """Why counter-tests leave a candidate open."""
    def one(t: Column) -> Column:
        cited = ~_empty(t["evidence_ids"]) & subset(t["evidence_ids"], available)
        incomplete = reason("counter_test_incomplete", t["name"])
        outcome, required = t["outcome"], t["required"]
        open_test = (
            ((outcome == "present") & ~cited)
            | ((outcome == "searched_absent") & ~valid_search(t, available))
            | outcome.isin("unknown", "not_executed", "absent")
            | ((outcome == "not_applicable") & (_blank(t["detail"]) | ~cited))
        )
        conflict_ids = F.when(cited, t["evidence_ids"]).otherwise(F.array().cast(_NO_IDS))
        return F.when(outcome == "conflicting", reason("counter_evidence_conflicting", t["name"], conflict_ids)).when(
            required & open_test, incomplete)

    return F.array_compact(F.transform(tests, one))


def _decide(df: DataFrame, reject: Column, dismiss: Column, review: Column) -> DataFrame:
    staged = df.withColumns({"_reject": reject, "_dismiss": dismiss, "_review": review})
    has = lambda c: F.size(c) > 0
    verdict = (F.when(has("_reject"), "REJECTED").when(has("_dismiss"), "DISMISSED")
               .when(has("_review"), "HUMAN_REVIEW").otherwise("CONFIRMED"))
    reasons = (F.when(has("_reject"), F.col("_reject")).when(has("_dismiss"), F.col("_dismiss"))
               .when(has("_review"), F.col("_review")).otherwise(F.array(reason("evidence_and_controls_support"))))
    decided = staged.withColumn("verdict", verdict).withColumn("reasons", ordered_reasons(reasons))
    return decided.withColumn("reason_text", reason_text(F.col("reasons"))).drop("_reject", "_dismiss", "_review")


def rejection_reasons() -> Column:
    available = F.col("evidence_refs.evidence_id")
    cited = F.col("calculation.inputs.evidence_id")
    replay, calc = F.col("replay"), F.col("calculation")
    replay_ids, binding_ids = F.col("replay.evidence_ids"), F.col("replay.bindings.evidence_id")
    same = lambda name: F.coalesce(replay[name] == F.col(name), F.lit(False))
    replay_ok = (
        replay.isNotNull() & same("engagement_id") & same("run_id") & same("control_id") & same("control_version")
        & (replay["engagement_id"] != "legacy") & (replay["run_id"] != "legacy") & ~_blank(replay["runtime_version"])
        & ~_empty(replay["inputs"]) & ~_empty(replay_ids) & ~_empty(replay["bindings"])
        & subset(replay_ids, available) & subset(binding_ids, replay_ids) & subset(cited, replay_ids)
        & subset(F.col("replay.inputs.name"), F.col("replay.bindings.name"))
    )
    calculation_ok = (
        ~_blank(calc["expression"]) & ~_empty(calc["inputs"]) & subset(cited, available)
        & (calc["result"] == F.col("exposure")) & replay_ok
    )
    test_ids = F.flatten(F.col("counter_tests.evidence_ids"))
    search_ids = F.flatten(F.transform("counter_tests", lambda t: F.coalesce(t["search"]["evidence_ids"], F.array().cast(_NO_IDS))))
    id_missing = lambda c: _blank(F.col(c)) | (F.col(c) == "legacy")
    return reason_list(
        (_empty(F.col("evidence_refs")) | inconsistent_evidence(F.col("evidence_refs")), reason("evidence_chain_missing")),
        (id_missing("control_id") | id_missing("control_version"), reason("control_support_missing")),
        (~F.coalesce(calculation_ok, F.lit(False)), reason("calculation_support_missing")),
        (~subset(test_ids, available) | ~subset(search_ids, available), reason("evidence_chain_missing")),
    )


def signal_reasons() -> Column:
    s = F.col("signals")
    tests = F.col("counter_tests")
    return reason_list(
        (s["conflicting_evidence"], reason("counter_evidence_conflicting")),
        (s["material_uncertainty"] | (F.coalesce(F.col("uncertainty"), F.lit("")) != ""), reason("material_uncertainty")),
        (s["accounting_judgement"], reason("accounting_judgement")),
        (s["incomplete_supporting_evidence"], reason("supporting_evidence_incomplete")),
        (_empty(tests) | ~F.exists(tests, lambda t: t["required"]), reason("counter_test_incomplete")),
    )


def admit_candidates(candidates: DataFrame) -> DataFrame:
    """Verdict, reasons and text for canonical candidates; the only path to CONFIRMED."""
    available = F.col("evidence_refs.evidence_id")
    tests = F.col("counter_tests")
    review = F.concat(review_reasons(tests, available), signal_reasons())
    return _decide(candidates, rejection_reasons(), dismissal_reasons(tests, available), review)


def admit_findings(findings: DataFrame) -> DataFrame:
    """Verdicts of dossier findings: never CONFIRMED.

    A present counter-test dismisses only when it is required and carries evidence.
    """
    bad_step = F.exists("chain", lambda s: (F.coalesce(s["step"], F.lit("")) == "") | _empty(s["evidence_ids"]))
    reject = reason_list(
        (_empty(F.col("chain")) | bad_step, reason("evidence_chain_missing")),
        (_blank(F.col("control_id")), reason("control_support_missing")),
        (((F.col("exposure") != 0) & (F.col("input_count") == 0)) | _blank(F.col("expression")), reason("calculation_support_missing")),
    )
    present = F.array_sort(
        F.filter("counter_tests", lambda t: t["required"] & (t["outcome"] == "present") & ~_empty(t["evidence_ids"])),
        lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    dismiss = F.transform(F.slice(present, 1, 1), lambda t: reason("counter_evidence_present", t["name"], t["evidence_ids"]))
    review = reason_list(
        (F.lit(True), reason("counter_test_incomplete", F.lit("legacy input"))),
        (F.coalesce(F.col("uncertainty"), F.lit("")) != "", reason("material_uncertainty")),
    )
    return _decide(findings, reject, dismiss, review)


def candidates_from_outcomes(outcomes: DataFrame, engagement_id: str, run_id: str, evidence: DataFrame | None = None) -> DataFrame:
    """Bring record-control outcomes to the admission gate.

    Needs ``status``, ``subject``, ``exposure``, ``evidence_id``, ``counter_tests`` (name, status,
    description) and ``uncertainty``. The control has weighed its counter-tests, so what they mean here
    follows its status: a dismissed outcome is dismissed by the tests that accounted for it, or by the
    control's own status if none did; an outcome that needs review stays uncertain; in a confirmed
    one, an explanation that did not suffice is noted and dismisses nothing. A test that found nothing
    was a search of the control's records. ``evidence`` (evidence_id, content) gives the content behind
    the ids; an id it does not know leaves the chain incomplete. Without it the id stands for itself.
    """
    no_ids, one_id = F.array().cast("array<string>"), F.array("evidence_id")
    dismissed = F.col("status") == "dismissed"
    search = F.struct(F.col("subject").cast("string").alias("scope"), F.col("control_id").alias("method"), F.array("control_id").alias("searched_sources"), one_id.alias("evidence_ids"))
    none = F.lit(None).cast("struct<scope:string,method:string,searched_sources:array<string>,evidence_ids:array<string>>")

    def test(t: Column) -> Column:
        explained, absent = t["status"] == "accounted_for", t["status"] == "not_found"
        return F.struct(
            t["name"].alias("name"), F.when(explained, "present").when(absent, "searched_absent").otherwise("unknown").alias("outcome"), t["description"].alias("detail"),
            (dismissed | ~explained).alias("required"), F.when(absent | (explained & dismissed), one_id).otherwise(no_ids).alias("evidence_ids"), F.when(absent, search).otherwise(none).alias("search"))

    own = F.struct(F.lit("control_status").alias("name"), F.lit("present").alias("outcome"), F.lit("the control dismissed the outcome").alias("detail"), F.lit(True).alias("required"), one_id.alias("evidence_ids"), none.alias("search"))
    tests = F.transform("counter_tests", test)
    tests = F.when(dismissed & ~F.exists("counter_tests", lambda t: t["status"] == "accounted_for"), F.concat(tests, F.array(own))).otherwise(tests)
    content = F.sha2("evidence_id", 256)
    if evidence is not None:
        outcomes = outcomes.join(evidence.select("evidence_id", F.col("content").alias("_content")), "evidence_id", "left")
        content = F.sha2("_content", 256)
    refs = F.filter(F.array(F.struct(F.col("evidence_id"), content.alias("content"))), lambda r: r["content"].isNotNull())
    cents = "decimal(18,2)"
    return outcomes.select(
        F.lit(engagement_id).alias("engagement_id"), F.lit(run_id).alias("run_id"), "control_id", "control_version",
        "subject", F.col("exposure").cast(cents).alias("exposure"),
        F.struct(
            F.lit("exposure of the last calculation step").alias("expression"),
            F.array(F.struct(F.col("subject").alias("label"), F.col("exposure").cast(cents).alias("value"), "evidence_id")).alias("inputs"),
            F.col("exposure").cast(cents).alias("result"), F.lit("").alias("sql")).alias("calculation"),
        refs.alias("evidence_refs"),
        tests.alias("counter_tests"),
        F.struct(*[(F.col("status") == "review_needed" if n == "material_uncertainty" else F.lit(False)).alias(n) for n in (
            "conflicting_evidence", "material_uncertainty", "accounting_judgement", "incomplete_supporting_evidence")]).alias("signals"),
        F.array_join("uncertainty", "; ").alias("uncertainty"),
        F.struct(
            F.lit(engagement_id).alias("engagement_id"), F.lit(run_id).alias("run_id"), "control_id", "control_version",
            F.lit("spark").alias("runtime_version"),
            F.array(F.struct(F.lit("exposure").alias("name"), F.col("exposure").cast("string").alias("value"))).alias("inputs"),
            one_id.alias("evidence_ids"),
            F.array(F.struct(F.lit("exposure").alias("name"), F.col("evidence_id"))).alias("bindings")).alias("replay"),
    )
