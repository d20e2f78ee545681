"""Centroid clustering of integer vectors with native expressions only.

Distances to the centroids are ``zip_with`` and ``aggregate`` over literal arrays, the nearest one is
``array_min`` of (distance, number), and new centroids are column sums per cluster. A round reads the
vectors once and shuffles one row of sums per task and cluster; no vector is ever moved.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

CLUSTERS, ROUNDS, SEED = 16, 3, 1
DIMENSIONS, SCALE = 64, 64
#: Components up to this size are added up in longs: 2^40 of them fit, and so does every distance.
_SMALL = 1 << 23
#: Larger ones use decimals of 38 digits, which hold the distances of components up to this size.
_LARGE = 1 << 57
_LONG = 1 << 63


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly ``dimensions`` finite components, each floor(scale * component) as a double."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) == dimensions)).where(finite)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(embedding, lambda c: c.cast("double") * float(scale)).alias("x"))


def _literal(centroid: list[int], kind: str) -> Column:
    return F.expr(f"cast(array({', '.join(f'{c}BD' for c in centroid)}) as array<{kind}>)")  # folded to one literal when planned


def _nearest(v: Column, centroids: list[list[int]], kind: str) -> Column:
    """(distance, cluster) of the nearest centroid, ties to the smaller number."""
    gap = {"bigint": "bigint", "decimal(19,0)": "decimal(38,0)"}[kind]
    square = lambda a, b: ((a - b) * (a - b)).cast(gap)
    total = lambda c: F.aggregate(F.zip_with(v, _literal(c, kind), square), F.lit(0).cast(gap), lambda s, d: (s + d).cast(gap))
    return F.array_min(F.array(*[F.struct(total(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def _started(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; of one id the smaller vector, those without an id last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    return [[int(c) for c in r["v"]] for r in first]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding",
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite. Each of ``rounds``
    rounds assigns all vectors to the nearest centroid and replaces every non-empty centroid by the
    exact floor of its mean; then vectors are assigned once more. Repeated rows and ids count each and
    come back each; a null id is kept and starts a cluster only if there are too few others. With
    fewer vectors than clusters every vector starts one; without any the result is empty. Columns
    besides the two named are ignored, whatever they are called.

    Squared distances and their sums are exact; one beyond a long is null in the result. Components
    of 2^57 or more after scaling are an error, since no exact type holds their distances.
    """
    found = whole_vectors(vectors, vec_id, embedding, dimensions, scale)
    size = found.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0] or 0.0
    if size >= _LARGE:
        raise ValueError("components of 2^57 or more after scaling have no exact distances")
    kind = "bigint" if size < _SMALL else "decimal(19,0)"
    rows = found.select("vec_id", F.transform("x", lambda c: F.floor(c).cast("bigint").cast(kind)).alias("v"))
    centroids = _started(rows, clusters, seed)
    if not centroids:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid", "array<bigint>"))]
        return rows.where(F.lit(False)).select("vec_id", *empty)
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimensions)]
    for _ in range(rounds):
        near = rows.select("v", _nearest(F.col("v"), centroids, kind).alias("near"))
        for r in near.groupBy(F.col("near.cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # one row a cluster
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dimensions)]
    assigned = materialize(rows.select("vec_id", _nearest(F.col("v"), centroids, kind).alias("near")).select("vec_id", "near.cluster", "near.distance"))
    totals = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fit = lambda n: F.lit(n if n < _LONG else None).cast("bigint")
    per = F.array(*[fit(totals.get(i, 0)) for i in range(len(centroids))])
    final = F.array(*[_literal(c, "bigint") for c in centroids])
    return assigned.select("vec_id", "cluster", F.col("distance").try_cast("bigint").alias("distance"), per[F.col("cluster")].alias("cluster_inertia"),
                           fit(sum(totals.values())).alias("inertia"), final[F.col("cluster")].alias("centroid"))


def centroid_digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ",").cast("binary"), 256)


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The same clustering in DuckDB's SQL, one pair of expressions a round."""
    parts = [f"""kept AS (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c FROM kept
          QUALIFY cluster < {clusters})"""]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS (SELECT row, vec_id, v, cluster, distance FROM (
          SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(range(1, {dimensions} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance FROM kept CROSS JOIN c{turn})
          QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if turn < rounds:
            parts.append(f"""m{turn} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
          SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{turn} CROSS JOIN (SELECT unnest(range(1, {dimensions} + 1)) AS i) GROUP BY ALL) GROUP BY cluster)""")
            parts.append(f"c{turn + 1} AS (SELECT cluster, coalesce(m{turn}.c, c{turn}.c) AS c FROM c{turn} LEFT JOIN m{turn} USING (cluster))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = _sql()
