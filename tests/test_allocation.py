"""Distributed allocation against plain sequential passes over the same small data."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.operators.allocation import drain, fifo_overlap, resolve_reversals, single_use_picks
from tallymark.operators.ordering import global_position, global_rank, running_totals, slice_ordered


def sequential_reversals(rows):
    by_id = {r["payment_id"]: r for r in rows}
    gone, out = set(), {}
    for r in sorted((r for r in rows if r["amount"] < 0), key=lambda r: (r["payment_date"], r["payment_id"])):
        target = None
        if r["reversal_of"] is not None:
            c = by_id.get(r["reversal_of"])
            if c and c["amount"] > 0 and c["payment_id"] not in gone and c["amount"] == -r["amount"] and c["payee"] == r["payee"] and c["payment_date"] <= r["payment_date"]:
                target = c["payment_id"]
        else:
            open_ = [p["payment_id"] for p in rows if p["amount"] == -r["amount"] and p["payee"] == r["payee"] and p["reference"] == r["reference"]
                     and p["payment_date"] <= r["payment_date"] and p["payment_id"] not in gone]
            target = open_[0] if len(open_) == 1 else None
        if target:
            gone.add(target)
        out[r["payment_id"]] = target
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reversals_match_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        hot = rng.random() < 0.5
        negative = rng.random() < 0.45
        amount = Decimal("10.00") if hot else Decimal(rng.choice([10, 20, 30]))
        rows.append({"payment_id": f"p{i:03d}", "payee": "HOT" if hot else rng.choice("AB"), "reference": "R" if hot else rng.choice("RS"),
                     "payment_date": date(2026, 1, 1) + timedelta(days=rng.randrange(40)), "amount": -amount if negative else amount,
                     "reversal_of": f"p{rng.randrange(120):03d}" if negative and rng.random() < 0.5 else None})
    df = spark.createDataFrame([tuple(r.values()) for r in rows],
                               "payment_id string, payee string, reference string, payment_date date, amount decimal(18,2), reversal_of string")
    got = {r["reversal_id"]: r["target_id"] for r in resolve_reversals(df.repartition(5)).collect()}
    assert got == sequential_reversals(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_fifo_overlap_matches_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    demand = [(rng.choice(["k", "hot", "hot"]), f"d{i:02d}", Decimal(rng.randrange(0, 50))) for i in range(40)]
    supply = [(rng.choice(["k", "hot", "hot"]), f"s{i:02d}", Decimal(rng.randrange(0, 50))) for i in range(40)]
    want = {}
    for key in ("k", "hot"):
        pool = [[i, q] for k, i, q in sorted(supply) if k == key]
        for k, i, need in sorted(demand):
            if k != key:
                continue
            for p in pool:
                take = min(need, p[1])
                if take > 0:
                    want[(key, i, p[0])] = take
                    need -= take
                    p[1] -= take
    d = spark.createDataFrame(demand, "k string, d string, dq decimal(18,2)")
    s = spark.createDataFrame(supply, "k string, s string, sq decimal(18,2)")
    got = {(r["k"], r["d"], r["s"]): r["taken"] for r in fifo_overlap(d, s, "k", "d", "dq", "s", "sq").collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_single_use_picks_match_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    edges = {(f"i{rng.randrange(25):02d}", f"r{rng.randrange(15):02d}"): rng.randrange(3) for _ in range(120)}
    edges |= {(f"j{i:02d}", f"r{r:02d}"): 0 for i in range(12) for r in range(20, 28)}  # equal lists
    used, want = set(), {}
    for c in sorted({c for c, _ in edges}):
        options = sorted((rank, r) for (x, r), rank in edges.items() if x == c and r not in used)
        if options:
            want[c] = options[0][1]
            used.add(options[0][1])
    df = spark.createDataFrame([(c, int(c[1:]) + (100 if c[0] == "j" else 0), r, rank) for (c, r), rank in edges.items()],
                               "consumer string, seq long, resource string, rank int")
    got = {r["consumer"]: r["resource"] for r in single_use_picks(df).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drain_matches_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    want_of = {f"i{i:02d}": Decimal(rng.randrange(1, 60)) for i in range(20)}
    have_of = {f"r{i:02d}": Decimal(rng.randrange(1, 60)) for i in range(10)}
    edges = sorted({(rng.choice(list(want_of)), "r00" if rng.random() < 0.3 else rng.choice(list(have_of))) for _ in range(90)})
    rank = {e: rng.randrange(3) for e in edges}
    tol = Decimal("2")
    for gated in (False, True):
        pool, expected = dict(have_of), {}
        for c in sorted(want_of):
            need, matched = want_of[c], False
            for _, r in sorted((rank[(c, r)], r) for x, r in edges if x == c):
                if gated and pool[r] <= tol:
                    continue
                take = min(need, pool[r])
                if gated and take == 0:
                    continue
                if take > 0:
                    expected[(c, r)] = take
                need -= take
                pool[r] -= take
                if gated and need <= tol:
                    break
        df = spark.createDataFrame([(c, c, r, rank[(c, r)], False, False, want_of[c], have_of[r], want_of[c]) for c, r in edges],
                                   "consumer string, seq string, resource string, rank int, reusable boolean, loose boolean, want_net decimal(18,2), have_net decimal(18,2), loose_target decimal(18,2)")
        out = drain(df, ("net",), ["rank"], F.lit(tol) if gated else None).where("take_net > 0")
        assert {(r["consumer"], r["resource"]): r["take_net"] for r in out.collect()} == expected


def test_running_totals_cross_slices(spark):
    rows = [("hot" if i % 3 else "cold", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    out = running_totals(slice_ordered(df, ["k"], ["i"], 6), ["k"], ["i"], {"before": F.col("v")}).collect()
    sums = {}
    want = {}
    for k, i, v in rows:
        want[(k, i)] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert {(r["k"], r["i"]): r["before"] for r in out} == want
    assert sorted(r["position"] for r in global_position(df, ["k", "i"]).collect()) == list(range(300))
    ranked = {r["i"]: r["rank"] for r in global_rank(df, "v").collect()}
    assert ranked[6] == 1 and ranked[0] == 1 + sum(1 for _, _, v in rows if v > 0)


def test_tied_values_spread_over_slices(spark):
    from tallymark.operators.aggregates import peer_comparison
    rows = [(i, 0.0) for i in range(3000)] + [(5000 + i, float(i % 40 + 1)) for i in range(90)]
    df = spark.createDataFrame(rows, "account int, exposure double").withColumn("exposure", F.col("exposure").cast("decimal(18,2)"))
    found = {r["account"]: r for r in peer_comparison(df).collect()}
    values = sorted((v for _, v in rows), reverse=True)
    positive = sorted(v for v in values if v > 0)
    for account, v in rows[::97] + rows[-90:]:
        others = positive[:]
        if v > 0:
            others.remove(v)
        m = len(others) // 2
        median = others[m] if len(others) % 2 else (others[m - 1] + others[m]) / 2
        assert found[account]["rank"] == values.index(v) + 1 and float(found[account]["peer_median_exposure"]) == median and found[account]["peer_count"] == len(others)
