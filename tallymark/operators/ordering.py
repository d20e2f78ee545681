"""Ordered computation that never sorts a whole key, or the whole table, in one task.

``slice_ordered`` range-partitions rows by (keys, order) so a heavy key is spread over several
slices, and records the slice. Running totals and ranks are then a window inside (key, slice)
plus one offset per slice boundary that a key crosses. At most one key crosses each boundary, so
the offset table holds fewer rows than there are slices and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialize

SLICE = "_slice"


def slice_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """Fix each row's slice; materialised so that every later read sees the same slices."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(
        df.repartitionByRange(count, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    )


def running_totals(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
    sums: Mapping[str, Column], inclusive: bool = False,
) -> DataFrame:
    """Add running sums per key in order; exclusive of the row itself unless asked."""
    temp = {name: f"_in_{name}" for name in sums}
    rows = sliced.withColumns({temp[n]: c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumns({n: F.coalesce(F.sum(temp[n]).over(inside), F.lit(0)) for n in sums})

    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, SLICE).agg(*[F.sum(temp[n]).alias(temp[n]) for n in sums])
        .select(*keys, SLICE, F.count(F.lit(1)).over(before).alias("_earlier"),
                *[F.coalesce(F.sum(temp[n]).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
        .where("_earlier > 0").drop("_earlier")
    )
    on = (F.col("l." + SLICE) == F.col("o." + SLICE))
    for key in keys:
        on = on & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = local.alias("l").join(F.broadcast(offsets.alias("o")), on, "left")
    kept = [c for c in local.columns if c not in sums and c not in temp.values()]
    return joined.select(
        *[F.col(f"l.{c}") for c in kept],
        *[(F.col(f"l.{n}") + F.coalesce(F.col(f"o._off_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def running_last(sliced: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 values: Mapping[str, Column]) -> DataFrame:
    """Add, per key in order, the latest non-null value up to and including each row."""
    rows = sliced.withColumns({f"_in_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.last(f"_in_{n}", ignorenulls=True).over(inside) for n in values})
    position = F.struct(*order)
    ends = rows.groupBy(*keys, SLICE).agg(*[
        F.max(F.when(F.col(f"_in_{n}").isNotNull(), F.struct(position.alias("p"), F.col(f"_in_{n}").alias("v"))))["v"].alias(f"_end_{n}")
        for n in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SLICE, F.count(F.lit(1)).over(before).alias("_earlier"), *[
        F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_off_{n}") for n in values]).where("_earlier > 0")
    on = F.col("l." + SLICE) == F.col("o." + SLICE)
    for key in keys:
        on = on & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = local.alias("l").join(F.broadcast(carried.alias("o")), on, "left")
    kept = [c for c in sliced.columns if c not in values]
    return joined.select(*[F.col(f"l.{c}") for c in kept],
                         *[F.coalesce(F.col(f"l.{n}"), F.col(f"o._off_{n}")).alias(n) for n in values])


def running_least(sliced: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  values: Mapping[str, Column]) -> DataFrame:
    """Add, per key in order, the least non-null value up to and including each row."""
    rows = sliced.withColumns({f"_in_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.min(f"_in_{n}").over(inside) for n in values})
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, SLICE).agg(*[F.min(f"_in_{n}").alias(f"_in_{n}") for n in values])
        .select(*keys, SLICE, F.count(F.lit(1)).over(before).alias("_earlier"), *[F.min(f"_in_{n}").over(before).alias(f"_off_{n}") for n in values])
        .where("_earlier > 0").drop("_earlier")
    )
    on = F.col("l." + SLICE) == F.col("o." + SLICE)
    for key in keys:
        on = on & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = local.alias("l").join(F.broadcast(carried.alias("o")), on, "left")
    kept = [c for c in sliced.columns if c not in values]
    return joined.select(*[F.col(f"l.{c}") for c in kept], *[F.least(F.col(f"l.{n}"), F.col(f"o._off_{n}")).alias(n) for n in values])


def value_places(df: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """(value, n, before): every distinct value, its rows, and how many rows have a larger one (null last).

    Only distinct values are ordered, so however many rows are tied, no slice holds more than its
    share. Written, so that a join with it can split the rows of a common value.
    """
    order = [F.col(value).desc_nulls_last()]
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(slice_ordered(counts, [], order, slices), [], order, {"before": F.col("n")})
    return materialize(placed.select(F.col(value).alias("value"), "n", "before"))


def with_places(df: DataFrame, value: str, places: DataFrame) -> DataFrame:
    """Rows with the places of their value."""
    return df.join(places, F.col(value).eqNullSafe(places["value"])).drop(places["value"]) if value != "value" else \
        df.join(places.withColumnRenamed("value", "_value"), F.col("value").eqNullSafe(F.col("_value"))).drop("_value")


def global_rank(df: DataFrame, value: str, name: str = "rank", slices: int | None = None) -> DataFrame:
    """SQL rank over the whole table, largest first."""
    placed = with_places(df, value, value_places(df, value, slices))
    return placed.select(*df.columns, (F.col("before") + 1).cast("long").alias(name))


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "position",
                    slices: int | None = None) -> DataFrame:
    """Zero-based position of each row in a total order over the whole table."""
    sliced = slice_ordered(df, [], order, slices)
    return running_totals(sliced, [], order, {name: F.lit(1).cast("long")}).drop(SLICE)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row per key in a total order, as a map-side combinable minimum of a struct.

    Unlike a row_number window this never moves all rows of a heavy key to one task.
    """
    packed = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_first")
    chosen = df.groupBy(*keys).agg(packed)
    return chosen.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last row per key in a total order (upsert semantics)."""
    packed = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_last")
    chosen = df.groupBy(*keys).agg(packed)
    return chosen.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def top_n(df: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    """A report's first rows; plans as TakeOrderedAndProject, not a full sort."""
    return df.orderBy(*order).limit(limit)


def sample_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: int) -> DataFrame:
    """The first few values per key in order.

    A row_number filter with a small limit is planned with a partial group limit, so a heavy key
    is trimmed to ``limit`` rows per input partition before the shuffle.
    """
    columns = list(dict.fromkeys([*keys, *order, value]))
    return (
        df.select(*columns)
        .withColumn("sample_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col("sample_no") <= limit)
    )
