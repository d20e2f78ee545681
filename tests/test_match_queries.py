"""The link queries of the three-way match against their SQL, on a few orders."""

from datetime import date

import duckdb
import pytest
from helpers import frame

import __spark_entry__ as entry

ORDERS = [(n, n % 3, date(2024, 1, 1 + n % 20), float(100 + n % 4), "F", "5-LOW") for n in range(1, 121)]
LINES = [(n, line, "ANR"[(n + line) % 3], date(2024, 2, 1 + line), float(10 * n + line)) for n in range(1, 121) for line in range(1 + n % 4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("match")
    frame(spark, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string", [
        dict(zip(("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"), r)) for r in ORDERS]).write.parquet(f"{path}/orders.parquet")
    frame(spark, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate date, l_extendedprice double", [
        dict(zip(("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_extendedprice"), r)) for r in LINES]).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["join_11_receipt_candidates", "join_13_linked_orders", "join_14_linked_adjustments", "join_15_refused_receipts"])
def test_links_equal_their_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    wanted = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    got = entry.queries()[name](spark, folder)
    assert got.columns == columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows and rows == sorted(wanted.fetchall())


def test_records_are_never_sent_to_every_task(spark, folder):
    from tallymark.bindings import Tables
    from tallymark.queries.records import match_tables
    found = [match_tables(Tables(spark, folder), shared)["receipts"] for shared in (True, False)] + [entry.queries()[n](spark, folder) for n in ("join_11_receipt_candidates", "join_15_refused_receipts")]
    for df in found:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_receipts_are_written_once_and_repeated_ids_are_joined(spark, folder, monkeypatch):
    from tallymark.bindings import Tables
    from tallymark.plans import purchase_match
    from tallymark.queries.records import _frames
    frames = _frames(Tables(spark, folder), "invoices", "receipts")
    invoices = frames["invoices"].withColumns({f"target_{d}": frames["invoices"][f"{d}_amount"] for d in ("net", "vat", "gross")})
    written, way = [], purchase_match.materialize
    monkeypatch.setattr(purchase_match, "materialize", lambda df: written.append(df.columns) or way(df))
    match = lambda: purchase_match.ThreeWayMatch().match_receipts(invoices, frames["receipts"], purchase_match.MatchParameters())
    found = match()
    assert [c for c in written if "resource" in c] == [found.columns]
    monkeypatch.setattr(purchase_match, "no_repeats", lambda df, column: False)
    joined = match()
    rows = sorted(map(str, found.collect()))
    assert rows and found.columns == joined.columns and rows == sorted(map(str, joined.collect()))
