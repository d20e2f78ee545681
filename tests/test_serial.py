"""Serial allocation over shared keys: components against plain passes over pairs, and rows against records."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.operators.allocation import single_use_picks, whole_takes
from tallymark.operators.components import component_roots
from tallymark.operators.serial import Component, Serving, allocate, keys_of, split_components

CONSUMERS = "consumer string, seq string, vendor_id string, day date, target decimal(18,2), want_net decimal(18,2), want_quantity decimal(18,2), one string, two string"
RESOURCES = "resource string, vendor_id string, day date, have_net decimal(18,2), have_quantity decimal(18,2), reusable boolean, one string, two string"
KEYS = ((1, "1", "one"), (2, "2", "two"))


def frames(spark, consumers, resources):
    return (spark.createDataFrame(consumers, CONSUMERS).repartition(3).withColumn("keys", keys_of(*KEYS)), spark.createDataFrame(resources, RESOURCES).repartition(3).withColumn("keys", keys_of(*KEYS)))


def made(seed, n=40):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.1 else date(2026, 1, 1) + timedelta(days=r.randrange(6))
    amount = lambda: Decimal(r.choice([0, 10, 20, 25, 40]))
    ref = lambda some, share: r.choice(some) if r.random() < share else None
    consumers = [(f"c{i:03d}", f"c{i:03d}", r.choice("AB"), day(), *([amount()] * 2), r.choice([None, Decimal(3), Decimal(5)]), ref("xyz", 0.3), ref("pq", 0.6)) for i in range(n)]
    resources = [(f"r{i:03d}", r.choice("AB"), day(), amount(), r.choice([None, Decimal(4)]), r.random() < 0.1, ref("xyz", 0.3), ref("pq", 0.6)) for i in range(n)]
    return consumers, resources


def plain(consumers, resources, gate, nearest):
    pool, out = {r[0]: [r[3], r[4]] for r in resources}, {}
    for c, _, vendor, day, target, *want, one, two in sorted(consumers):
        options = []
        for r, other, when, *_, reusable, r1, r2 in resources:
            tier = 1 if one is not None and one == r1 else 2 if two is not None and two == r2 else None
            if vendor == other and tier:
                days = None if day is None or when is None else abs((day - when).days)
                gap = abs(target - pool[r][0])
                options.append(((tier, days is not None, days or 0, gap, r) if nearest else (tier, when is not None, when or date(1, 1, 1), 0, r), reusable))
        rest, matched = list(want), False
        for (*_, r), reusable in sorted(options):
            if gate is not None:
                if matched and rest[0] <= gate:
                    break
                if not reusable and pool[r][0] <= gate:
                    continue
            takes = [Decimal(0) if w is None or p is None else min(left or 0, p) for w, left, p in zip(want, rest, pool[r])]
            if (takes[0] == 0 and want[0] != 0) if gate is not None else not any(takes):
                continue
            matched = True
            out[(c, r)] = takes
            rest = [None if left is None else left - t for left, t in zip(rest, takes)]
            if not reusable:
                pool[r] = [None if p is None else p - t for p, t in zip(pool[r], takes)]
    return out


@pytest.mark.parametrize("most", [10_000, 0])
@pytest.mark.parametrize("gate,nearest", [(Decimal(1), True), (None, False)])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_the_plain_pass_over_pairs(spark, seed, gate, nearest, most):
    consumers, resources = made(seed)
    used = allocate(*frames(spark, consumers, resources), Serving(("net", "quantity"), gate, nearest), most=most).collect()
    assert {(r["consumer"], r["resource"]): [r["take_net"], r["take_quantity"]] for r in used} == plain(consumers, resources, gate, nearest)


def test_one_reference_shared_by_thousands_writes_rows_in_proportion(spark):
    n = 10_000
    consumers = [(f"c{i:05d}", f"c{i:05d}", "V", date(2026, 1, 1) + timedelta(days=i * 7919 % 365), Decimal(100), Decimal(100), None, None, "blanket") for i in range(n)]
    resources = [(f"r{i:05d}", "V", date(2026, 1, 1) + timedelta(days=i * 104729 % 365), Decimal(100), None, False, None, "blanket") for i in range(n)]
    c, r = frames(spark, consumers, resources)
    serving = Serving(("net", "quantity"), Decimal(1), True)
    assert split_components(c, r, None, serving).small.count() == 2 * n
    used = allocate(c, r, serving)
    assert used.agg(F.count(F.lit(1)), F.sum("take_net"), F.countDistinct("consumer"), F.countDistinct("resource")).first()[:] == (n, Decimal(100) * n, n, n)


def test_component_roots_of_stars_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(150)] + [(500, 500 + i) for i in range(1, 200)] + [(900, 900), (None, 3), (7, None)]
    roots = dict(map(tuple, component_roots(spark.createDataFrame(links, "a long, b long")).collect()))
    assert roots == {**dict.fromkeys(range(151), 0), **dict.fromkeys(range(500, 700), 500), 900: 900}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def taken(rows, tolerance):
    used, out = set(), set()
    lists = {}
    for c, seq, r, rank, need, covers in rows:
        lists.setdefault((seq, c), []).append((rank, r, need, covers))
    for (_, c), options in sorted(lists.items()):
        before = 0
        for _, r, need, covers in sorted(options):
            if r in used:
                continue
            if max(0, need - before) > tolerance:
                used.add(r)
                out.add((c, r))
            before += covers
    return out


@pytest.mark.parametrize("tail", [100_000, 30, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_whole_takes_equal_the_plain_pass_by_every_way(spark, seed, tail):
    r = random.Random(seed)
    need, covers = {f"c{i}": Decimal(r.choice([0, 30, 50])) for i in range(30)}, {f"r{i}": Decimal(r.choice([10, 20, 40])) for i in range(40)}
    rows = [(c, int(c[1:]), x, rank, need[c], covers[x]) for (c, x), rank in {(r.choice(list(need)), r.choice(list(covers))): r.randrange(3) for _ in range(160)}.items()]
    rows += [(f"d{i}", 100 + i, f"e{j}", 0, Decimal(1), Decimal(1)) for i in range(9) for j in range(9)]  # equal lists
    df = spark.createDataFrame(rows, "consumer string, seq long, resource string, rank int, need decimal(18,2), covers decimal(18,2)").repartition(4)
    assert {(x["consumer"], x["resource"]) for x in whole_takes(df, F.lit(Decimal(5)), tail=tail).collect()} == taken(rows, 5)
    single = [(c, s, x, rank, 1, 1) for c, s, x, rank, *_ in rows]
    assert {(x["consumer"], x["resource"]) for x in single_use_picks(df, tail=tail).collect()} == taken(single, 0)


def test_a_chain_of_displaced_consumers_moves_few_rows(spark):
    n = 1_000  # everyone's favourite is the next one's second choice, so each pick displaces the next
    edges = [(f"c{i:04d}", i, f"r{max(0, i - 1):04d}", 0) for i in range(n)] + [(f"c{i:04d}", i, f"r{i:04d}", 1) for i in range(n)]
    df = spark.createDataFrame(edges, "consumer string, seq long, resource string, rank int")
    before = _shuffled(spark)
    assert {(x["consumer"], x["resource"]) for x in single_use_picks(df).collect()} == {(f"c{i:04d}", f"r{i:04d}") for i in range(n)}
    assert _shuffled(spark) - before <= 3 * len(edges)


def _shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("seed", range(5))
def test_levels_reached_on_the_way_are_met_in_the_component(seed):
    r, gate, window = random.Random(seed), Decimal(1), 3
    serving = Serving(("net",), gate, nearest=True, window=window)
    component, keys = Component(serving), [(4, "v")]
    stock = [(f"r{i:02d}", r.randrange(6), Decimal(r.choice([20, 40, 60])), r.random() < 0.1) for i in range(30)]
    for ident, day, have, reusable in stock:
        component.add_resource(ident, day, reusable, [have], keys)
    pool = {ident: have for ident, _, have, _ in stock}
    for i in range(60):
        day, target, want = r.randrange(6), Decimal(r.choice([10, 20, 30, 40, 60])), Decimal(r.choice([0, 5, 10, 20, 30]))
        near = sorted((abs(day - at), abs(target - pool[x]), x) for x, at, _, again in stock if abs(day - at) <= window and abs(target - pool[x]) <= gate and (again or pool[x] > gate))
        expected, rest = [], want
        for _, _, x in near:
            if expected and rest <= gate:
                break
            take = min(rest, pool[x])
            if take == 0 and want != 0:
                continue
            expected.append((x, 4, [take], pool[x]))
            rest -= take
            if not next(s[3] for s in stock if s[0] == x):
                pool[x] -= take
        assert list(component.serve(f"c{i}", day, target, [want], keys)) == expected


def test_scopes_are_served_without_looking_for_components(spark, monkeypatch):
    """Only scopes with more records than a task serves are searched; what is used does not change."""
    from tallymark.operators import serial
    consumers, resources = made(3)
    gate, nearest = Decimal("0.01"), True
    serving = Serving(("net", "quantity"), gate, nearest)
    scoped = [df.withColumn("scope", F.col("vendor_id")) for df in frames(spark, consumers, resources)]
    counts = {v: sum(r[2] == v for r in consumers) + sum(r[1] == v for r in resources) for v in "AB"}
    expected = plain(consumers, resources, gate, nearest)
    searched = []
    monkeypatch.setattr(serial, "component_roots", lambda links: searched.append(links.count()) or component_roots(links))
    for most, looks in ((1000, 0), (min(counts.values()), 1), (0, 1)):
        searched.clear()
        used = allocate(*scoped, serving, most=most).collect()
        assert {(r["consumer"], r["resource"]): [r["take_net"], r["take_quantity"]] for r in used} == expected
        assert len(searched) == looks
