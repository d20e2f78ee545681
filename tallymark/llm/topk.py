"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialize

#: Queries of one block: a block's vectors are what is broadcast, and its thresholds what is collected.
BLOCK = 4096
#: Bins of one refinement, and scores held at once in a task.
BINS, SCORES = 256, 1_000_000
SCALE = 64


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as longs. Vectors that are null, empty or hold a null
    or non-finite component take no part; neither do those whose scores could leave a long."""
    x = F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fit = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(1 << 24)))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as a matrix, and that length for every row."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64 if kind is not np.float32 else np.int32)


class _Block:
    """Queries of one length in a matrix, with where each one's k-th score is known to lie."""

    def __init__(self, rows: list, k: int) -> None:
        self.k, self.ids = k, np.array([r[0] for r in rows], np.int64)
        self.q = np.array([r[1] for r in rows], np.int64)
        self.low = np.full(len(rows), -np.iinfo(np.int64).max)
        self.width = np.ones(len(rows), np.int64)
        self.need = np.full(len(rows), k)  # rows still to be taken from [low, low + width)

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        """Candidate ids, their scores by query, and the queries, in tiles; own rows are left out by the caller."""
        per = max(1, SCORES // max(1, len(self.ids)))
        for batch in batches:
            ids, (flat, lengths) = batch.column(0).to_numpy(), _matrix(batch.column(1))
            starts = np.r_[0, np.cumsum(lengths)]
            same = np.flatnonzero(lengths == self.q.shape[1])
            for at in range(0, len(same), per):
                some = same[at:at + per]
                rows = flat[(starts[some][:, None] + np.arange(self.q.shape[1])[None, :])]
                yield ids[some], _products(rows, self.q)


def _histogram(block: _Block):
    """Per task: the highest bins of every query's interval that hold as many rows as it still needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        step = -(-block.width // BINS)
        counts = np.zeros((n, BINS), np.int64)
        row = np.arange(n) * BINS
        for ids, scores in block.scores(batches):
            over = scores - block.low[:, None]
            own = block.ids[:, None] == ids[None, :]
            q, c = np.nonzero((over >= 0) & (over < block.width[:, None]) & ~own)
            counts += np.bincount(over[q, c] // step[q] + row[q], minlength=n * BINS).reshape(n, BINS)
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < block.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], names=["q", "bin", "n"])
    return run


def _refine(block: _Block, counts: DataFrame) -> None:
    """Move every query's interval to the bin that holds its k-th score."""
    merged = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    need = merged.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    found = need.select("q", "bin", "before", "n").where(F.col("before") < block.k).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("before", "bin", "n"))).alias("bins")).collect()
    step, bins = -(-block.width // BINS), {r["q"]: r["bins"] for r in found}
    for q in np.flatnonzero(block.width > 1).tolist():
        left = block.need[q]
        hit = next((b for b in bins.get(q, ()) if b["before"] < left <= b["before"] + b["n"]), None)
        if hit is not None:
            block.low[q] += hit["bin"] * step[q]
            block.need[q] = left - hit["before"]
            block.width[q] = step[q]
        else:  # fewer rows than asked for, or none: all of them are taken
            block.width[q], block.low[q] = 1, np.iinfo(np.int64).min // 2


def _selected(block: _Block):
    """Per task: rows above the k-th score, and of those equal to it the smallest ids that may be needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tied: dict[int, np.ndarray] = {}
        for ids, scores in block.scores(batches):
            own = block.ids[:, None] == ids[None, :]
            q, c = np.nonzero((scores > block.low[:, None]) & ~own)
            yield _rows(block.ids[q], ids[c], scores[q, c], q)
            q, c = np.nonzero((scores == block.low[:, None]) & ~own)
            for k, some in zip(*_split(q, ids[c])):
                tied[k] = np.sort(np.r_[tied.get(k, some[:0]), some])[:block.need[k]]
        for k, some in tied.items():
            yield _rows(np.full(len(some), block.ids[k]), some, np.full(len(some), block.low[k]), np.full(len(some), k))
    return run


def _split(q: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    keys, starts = np.unique(q, return_index=True)  # np.nonzero gives q in order
    return keys.tolist(), np.split(ids, starts[1:]) if len(keys) else []


def _rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (query, vec, score, q)], names=["query_id", "vec_id", "score", "q"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query row.

    Queries are taken in blocks of bounded size, each against all rows. Every round scores all pairs
    of a block anew and counts scores in BINS bins of each query's interval; a task sends only its
    highest bins that hold as many rows as are still needed, which is all that can matter. The
    interval shrinks to the bin with the k-th score until it is one score wide. A last pass filters
    rows above it and breaks ties by the smaller id. No candidate is ever sorted or dropped on the way.

    A query's own row, and any row of the same id, is no candidate; other repeated rows are ranked
    each. Vectors of another length than the query's have no inner product with it. With fewer than
    k candidates all are returned. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    mine = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = materialize(integer_vectors(vectors, vec_id, embedding))
    asked = materialize(integer_vectors(mine.where("_query"), vec_id, embedding))
    count = asked.count()
    blocks = max(1, -(-count // (block * 3 // 4)))  # a hash fills blocks unevenly
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0  # largest component
    found = []
    for at in range(blocks if count else 0):
        lengths: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == at).collect():
            lengths.setdefault(len(r["v"]), []).append(r)
        for some in lengths.values():
            for start in range(0, len(some), block):
                state = _Block(some[start:start + block], k)
                reach = np.abs(state.q).sum(1) * most + 1  # no score is larger in size
                state.low, state.width = -reach, 2 * reach
                while (state.width > 1).any():
                    _refine(state, rows.mapInArrow(_histogram(state), "q int, bin int, n long"))
                taken = rows.mapInArrow(_selected(state), "query_id long, vec_id long, score long, q long")
                found.append(taken.withColumn("block", F.lit(len(found))))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score long, q long, block int")
    place = Window.partitionBy("block", "q", "query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
