"""Connected components of a graph of any size, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that occurs in an edge; the root is the component's smallest node.

    Large-star and small-star steps alternate until the edges are stars, which takes a number of
    rounds logarithmic in the longest chain. Minima per node are combined before the shuffle and
    written, so that the join with them is a plain join whose hot nodes Spark can split.
    Null ends and loops are ignored; repeated edges count once.
    """
    step = materialize(edges.where(F.col(src) != F.col(dst))
                       .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    state = _state(step)
    while state[0]:
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = materialize(both.join(low, "u").where(F.col("v") > F.col("u"))
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(low, "u").select("u", "v", "m")
        step = materialize(linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(low.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(step)
        if state == before:
            break
    roots = step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return step.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
