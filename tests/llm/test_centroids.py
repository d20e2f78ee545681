"""Centroid clustering against a plain loop over Python integers, and at its edges."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, clusters=16, rounds=3, dimensions=64):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, centroid)] of the kept rows."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    mark = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else mark(r[0]), r[1]))[:clusters]
    centres = [v for _, v in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        near = assigned()
        for k in range(len(centres)):
            mine = [v for (_, v), (_, j) in zip(kept, near) if j == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine)]
    near = assigned()
    per = {k: sum(d for d, j in near if j == k) for k in range(len(centres))}
    return [(i, k, d, per[k], sum(per.values()), centres[k]) for (i, _), (d, k) in zip(kept, near)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return [tuple(r) for r in centroids.cluster(frame, **more).collect()]


def vectors(seed, n, size=64, spread=3.0):
    r = random.Random(seed)
    heads = [[r.uniform(-spread, spread) for _ in range(size)] for _ in range(5)]
    return [(i, [c + r.gauss(0, 0.4) for c in r.choice(heads)]) for i in range(n)]


def test_clusters_follow_a_plain_loop(spark):
    rows = vectors(1, 300)
    rows += rows[:40] + [(7, rows[9][1])] * 3 + [(None, rows[3][1])]  # repeated rows, one id with several vectors, no id
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] * 64), (907, [-0.001] * 64)]
    assert ordered(found(spark, rows)) == ordered(plain(rows))


def test_ties_go_to_the_smaller_cluster_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 3)] * 4) for i in range(60)]  # only three different vectors for sixteen centroids
    assert ordered(found(spark, rows, dimensions=4)) == ordered(plain(rows, dimensions=4))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [float(i)] * 64) for i in range(5)]])
def test_few_or_no_vectors(spark, rows):
    assert ordered(found(spark, rows)) == ordered(plain(rows))


def test_large_components_stay_exact_and_distances_beyond_a_long_are_null(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * 2.0 ** r.choice([3, 15, 18]) for _ in range(64)]) for i in range(80)]
    assert ordered(found(spark, rows)) == ordered(plain(rows))
    rows = [(i, [r.uniform(-1, 1) * 2.0 ** 48] * 64) for i in range(40)]
    expected, limit = ordered(plain(rows)), (1 << 63) - 1
    null = lambda n: n if n <= limit else None
    assert ordered([(i, k, 0, *x[1:]) for i, k, *x in found(spark, rows)]) == [(i, k, 0, null(a), null(b), c) for i, k, _, a, b, c in expected]
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([(1, [1e300] * 64, 0)], SCHEMA))


def test_clashing_columns_and_one_hot_vector(spark):
    rows = vectors(2, 60) + [(1000 + i, [0.25] * 64) for i in range(120)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({n: F.lit("taken") for n in ("v", "x", "cluster", "distance", "near", "mark")})
    assert ordered([tuple(r) for r in centroids.cluster(frame).collect()]) == ordered(plain(rows))
    digest = centroids.cluster(frame).select(centroids.centroid_digest(F.col("centroid"))).first()[0]
    assert digest in {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for *_, c in plain(rows)}


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors(3, 30)], SCHEMA)
    plan = centroids.cluster(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
