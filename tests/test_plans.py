"""Plans of registered queries: no cross joins, no Python in the path, pruned scans; same result for any partitioning."""

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ("agg_03_vendor_exposure", "agg_08_reconcile_legs", "ctl_01_vendor_sod", "ctl_02_payment_split", "ctl_04_cutoff", "ctl_07_vendor_integrity", "ctl_08_capital_expenditure", "join_07_quickly_paid",
         "join_16_ranked_links", "join_18_co_occurrence", "adm_01_admit_candidates", "tool_08_receipt_matches", "win_11_evidence_sample")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in text, node


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["agg_04_split_payments"](spark, FOLDER))
    assert "EqualTo(event_type,purchase)" in text and "PushedFilters: [IsNotNull(event_type)" in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in columns and "event_id" not in columns


def test_group_limits_trim_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["win_11_evidence_sample"](spark, FOLDER))


def test_every_query_has_one_callable_and_known_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["account", "exposure", "peer_count", "peer_median_exposure", "rank"] and df.count() > 0
