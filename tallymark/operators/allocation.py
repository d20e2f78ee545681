"""Order-dependent allocation as distributed work.

A greedy pass over consumers in order is a triangular system: what a consumer takes depends only on
earlier consumers and on its own earlier candidates. Such a system has one solution, and it is the
fixed point of recomputing every take from the previous round's takes. Within one resource a round is
already exact, because "serve in order until empty" is a difference of running totals; so rounds are
needed only for chains that hop between resources. No consumer or resource is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.money import CENTS
from tallymark.functions.text import normalize_identifier
from tallymark.operators.ordering import SLICE, running_last, running_totals, slice_ordered
from tallymark.session import materialize

QUANTITIES = "decimal(28,4)"


def fifo_overlap(demand: DataFrame, supply: DataFrame, key: str, demand_id: str, demand_size: str,
                 supply_id: str, supply_size: str) -> DataFrame:
    """First-in-first-out matching per key in closed form: (key, demand id, supply id, taken).

    Demands and supplies are laid end to end on one axis per key. Every start of either kind opens
    the overlap of the current demand with the current supply, so the result has at most one row
    per start and no pair is formed that does not overlap.
    """
    def spans(df: DataFrame, ident: str, size: str, kind: int) -> DataFrame:
        rows = df.where(F.col(size) > 0).select(key, F.col(ident).alias("id"), F.col(size).cast(CENTS).alias("size"))
        placed = running_totals(slice_ordered(rows, [key], ["id"]), [key], ["id"], {"start": F.col("size")})
        return placed.select(key, F.col("start").cast(CENTS).alias("at"), F.lit(kind).alias("kind"), "id",
                             (F.col("start") + F.col("size")).cast(CENTS).alias("end"))

    events = spans(demand, demand_id, demand_size, 0).unionByName(spans(supply, supply_id, supply_size, 1))
    order = ["at", "kind", "id"]
    span = F.struct("id", "end")
    swept = running_last(slice_ordered(events, [key], order), [key], order, {
        "demand": F.when(F.col("kind") == 0, span), "supply": F.when(F.col("kind") == 1, span)})
    taken = F.least(F.col("demand.end"), F.col("supply.end")) - F.col("at")
    return swept.where("demand is not null and supply is not null").withColumn("taken", taken.cast(CENTS)).where("taken > 0").select(
        key, F.col("demand.id").alias(demand_id), F.col("supply.id").alias(supply_id), "taken")


def resolve_reversals(payments: DataFrame) -> DataFrame:
    """Which payment each reversal takes back, reversals in (date, id) order.

    ``payments``: payment_id, payee, reference (normalised), payment_date, amount, reversal_of. An
    explicit reversal takes the payment it names; any other takes the only open payment of equal
    size, payee and reference dated no later, and none when there are several. The one open payment
    is found from two running totals: how many are open, and the sum of their numbers. ``payments`` are
    read several times, so callers pass rows that are written down already.
    """
    group = ["payee", "reference", "size"]
    positive = payments.where("amount > 0").select(
        "payment_id", "payee", "reference", F.col("amount").alias("size"), "payment_date")
    negative = payments.where("amount < 0").select(
        F.col("payment_id").alias("reversal_id"), "payee", F.col("reference").alias("own_reference"),
        (-F.col("amount")).alias("size"), F.col("payment_date").alias("reversal_date"), "reversal_of")
    if negative.isEmpty():
        return negative.select("reversal_id", F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("reason"),
                               "payee", F.col("own_reference").alias("reference"), "reversal_date", "reversal_of")
    named = negative.where("reversal_of is not null").join(
        positive.select(F.col("payment_id").alias("reversal_of"), "payee", "size", "reference", F.col("payment_date").alias("target_date")),
        ["reversal_of", "payee", "size"], "left")
    linked = named.where("target_date is not null")
    unnamed = negative.where("reversal_of is null").withColumn("reference", F.col("own_reference"))
    empty = F.lit(None)
    reversals = linked.select(*group, F.col("reversal_date").alias("day"), F.lit(1).alias("kind"), F.col("reversal_id").alias("id"),
                              F.col("reversal_of").alias("named"), "target_date").unionByName(
        unnamed.select(*group, F.col("reversal_date").alias("day"), F.lit(1).alias("kind"), F.col("reversal_id").alias("id"),
                       empty.cast("string").alias("named"), empty.cast("date").alias("target_date")))
    touched = reversals.select(*group).distinct()
    arrivals = positive.join(touched, group, "left_semi").select(
        *group, F.col("payment_date").alias("day"), F.lit(0).alias("kind"), F.col("payment_id").alias("id"),
        empty.cast("string").alias("named"), empty.cast("date").alias("target_date"))
    order = ["day", "kind", "id"]
    sliced = slice_ordered(arrivals.unionByName(reversals), group, order)
    is_payment = F.col("kind") == 0
    numbered = running_totals(sliced, group, order, {
        "arrived": is_payment.cast("long"), "position": F.lit(1).cast("long")})
    # Payments are numbered 1, 2, ... as they arrive, so the sum of those before a row is known from their count.
    arrived = F.col("arrived").cast("decimal(18,0)")
    numbered = materialize(numbered.withColumns({"number": F.when(is_payment, F.col("arrived") + 1), "arrived_sum": (arrived * (arrived + 1) / 2).cast("decimal(38,0)")}))
    targets = numbered.where(is_payment).select(*group, F.col("id").alias("named"), F.col("number").alias("named_number"))
    state = numbered.join(targets, [*group, "named"], "left")
    inside = Window.partitionBy(*group, SLICE).orderBy(*order)
    follows_payment = F.lag("kind").over(inside) == 0
    guess = F.when(is_payment, None).when(F.col("named").isNotNull(), F.when(F.col("target_date") <= F.col("day"), F.col("named_number"))).when(
        follows_payment, F.lag("number").over(inside))
    state = materialize(state.withColumn("takes", guess))

    while True:
        counted = running_totals(state, group, order, {
            "gone": F.col("takes").isNotNull().cast("long"),
            "gone_sum": F.coalesce("takes", F.lit(0)).cast("decimal(38,0)")})
        takers = state.where("takes is not null").groupBy(*group, F.col("takes").alias("named_number")).agg(F.min("position").alias("first_taker"))
        joined = counted.join(takers, [*group, "named_number"], "left")
        left_open = F.col("arrived") - F.col("gone")
        gone_before = F.coalesce(F.col("first_taker") < F.col("position"), F.lit(False))
        new = (
            F.when(is_payment, None)
            .when(F.col("named").isNotNull(), F.when((F.col("target_date") <= F.col("day")) & ~gone_before, F.col("named_number")))
            .when(left_open == 1, (F.col("arrived_sum") - F.col("gone_sum")).cast("long"))
        )
        # The reasons of a resolution, compared by fixtures.
        reason = (
            F.when(F.col("named").isNotNull() & gone_before, "explicit reversal target is missing, incompatible, or already reversed")
            .when(F.col("named").isNotNull() & (F.col("target_date") > F.col("day")), "explicit reversal predates its referenced payment")
            .when(F.col("named").isNotNull(), "explicit reversal matched its referenced payment")
            .when(left_open == 1, "unique equal-and-opposite payment matched by payee and reference")
            .when(left_open <= 0, "no equal-and-opposite payment matched the reversal")
            .otherwise("multiple payments could match the reversal")
        )
        keep = [c for c in state.columns if c not in ("takes", "reason")]
        state = materialize(joined.select(*keep, new.alias("takes"), reason.alias("reason"), F.col("takes").alias("_old")))
        if state.where(~F.col("takes").eqNullSafe(F.col("_old"))).isEmpty():
            break
        state = state.drop("_old")

    chosen = state.where("kind = 1").join(
        targets.select(*group, F.col("named").alias("target_id"), F.col("named_number").alias("takes")), [*group, "takes"], "left")
    resolved = chosen.select(F.col("id").alias("reversal_id"), "target_id", "reason")
    missing = named.where("target_date is null").select(
        "reversal_id", empty.cast("string").alias("target_id"),
        F.lit("explicit reversal target is missing, incompatible, or already reversed").alias("reason"))
    facts = negative.select("reversal_id", "payee", F.col("own_reference").alias("reference"), "reversal_date", "reversal_of")
    return materialize(resolved.unionByName(missing).join(facts, "reversal_id"))


#: Links that one task settles in a row.
TAIL = 500_000


def single_use_picks(edges: DataFrame, consumer: str = "consumer", seq: str = "seq", resource: str = "resource",
                     order: Sequence[str] = ("rank", "resource"), tail: int = TAIL) -> DataFrame:
    """Each consumer, in ``seq`` order, picks its best resource nobody earlier picked."""
    links = edges.select(F.col(consumer).alias("consumer"), F.col(seq).alias("seq"), F.col(resource).alias("resource"), F.struct(*order).alias("place"),
                         F.lit(1).cast(CENTS).alias("need"), F.lit(1).cast(CENTS).alias("covers"))
    taken = _settle(links, F.lit(0).cast(CENTS), tail, single=True)
    return taken.select(F.col("consumer").alias(consumer), F.col("seq").alias(seq), F.col("resource").alias(resource))


def whole_takes(edges: DataFrame, tolerance: Column, order: Sequence[str] = ("rank", "resource"), tail: int = TAIL) -> DataFrame:
    """Each consumer, in ``seq`` order, takes whole free resources in ``order`` while more than ``tolerance`` of
    its ``need`` is not yet covered; a resource serves one consumer. ``edges``: consumer, seq, resource, need, covers."""
    links = edges.select("consumer", "seq", "resource", F.struct(*order).alias("place"), F.col("need").cast(CENTS).alias("need"), F.col("covers").cast(CENTS).alias("covers"))
    return _settle(links, tolerance.cast(CENTS), tail, single=False)


def _settle(links: DataFrame, tolerance: Column, tail: int, single: bool) -> DataFrame:
    """(consumer, seq, resource, covers) of all takes.

    A consumer is settled once it is the first of all that are left on every resource it would take: nobody
    before it can want them. It leaves with all its links, and what it takes leaves with all of theirs, so a
    round reads only what is still undecided. When no more than ``tail`` links are left, one task goes
    through them in order; when rounds stop shrinking them (consumers with equal lists, one settled a
    round), the rest is found as a fixed point.
    """
    left, done = materialize(links.distinct()), []
    count = left.count()
    while count > tail:
        first = left.groupBy("resource").agg(F.min(F.struct("seq", "consumer")).alias("first"))
        wanted = _wanted(left, tolerance, single)
        judged = wanted.join(first, "resource").groupBy("consumer").agg(F.min((F.col("first.consumer") == F.col("consumer")).cast("int")).alias("alone"))
        settled = judged.where("alone = 1").select("consumer")
        if not single:  # nothing to cover: the consumer takes nothing
            settled = settled.unionByName(left.where(F.col("need") <= tolerance).select("consumer").distinct())
        settled = materialize(settled.distinct())
        taken = materialize(wanted.join(settled, "consumer", "left_semi").select("consumer", "seq", "resource", "covers"))
        left = materialize(left.join(settled, "consumer", "left_anti").join(taken.select("resource"), "resource", "left_anti"))
        done.append(taken)
        before, count = count, left.count()
        if count > tail and count > 0.9 * before:
            done.append(_fixed_point(left, tolerance, single))
            count = 0
    if count:
        done.append(_in_a_row(left, tolerance, single))
    if not done:
        return left.select("consumer", "seq", "resource", "covers")
    return materialize(reduce(DataFrame.unionByName, done))


def _wanted(left: DataFrame, tolerance: Column, single: bool) -> DataFrame:
    """Links a consumer would take if all their resources were free."""
    if single:
        best = left.groupBy("consumer").agg(F.min(F.struct("place", "resource", "seq", "covers")).alias("b"))
        return best.select("consumer", "b.seq", "b.resource", "b.covers")
    placed = running_totals(slice_ordered(left, ["consumer"], ["place"]), ["consumer"], ["place"], {"before": F.col("covers")})
    return placed.where(F.greatest(F.lit(0), F.col("need") - F.col("before")) > tolerance).select("consumer", "seq", "resource", "covers")


def _in_a_row(left: DataFrame, tolerance: Column, single: bool) -> DataFrame:
    """Takes of a bounded number of links, in order, by one task that holds the resources taken so far."""
    fields = {f.name: f for f in left.schema.fields}
    schema = T.StructType([fields[c] for c in ("consumer", "seq", "resource", "covers")])
    ordered = left.withColumn("tolerance", tolerance).repartition(1).sortWithinPartitions("seq", "consumer", "place").select("consumer", "seq", "resource", "covers", "need", "tolerance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set = set()
        mine, before = None, 0
        for batch in batches:
            taken = []
            for i, (who, _, what, covers, need, least) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if who != mine:
                    mine, before = who, 0
                if what in used:
                    continue
                if max(0, need - before) > least:
                    used.add(what)
                    taken.append(i)
                before += covers
            yield batch.select([0, 1, 2, 3]).take(pa.array(taken, pa.int64()))

    return ordered.mapInArrow(run, schema)


def _fixed_point(left: DataFrame, tolerance: Column, single: bool) -> DataFrame:
    """Rounds that recompute every take from the takes of the round before, until nothing changes.

    For single picks the first guess gives the k-th consumer of a shared favourite its k-th choice, which
    is already the answer for consumers with equal lists.
    """
    numbered = running_totals(slice_ordered(left, ["consumer"], ["place"]), ["consumer"], ["place"], {"choice": F.lit(1).cast("long")})
    state = numbered.withColumn("taken", F.lit(False))
    if single:
        best = numbered.where("choice = 0").select(F.col("resource").alias("favourite"), "seq", "consumer")
        turn = running_totals(slice_ordered(best, ["favourite"], ["seq", "consumer"]), ["favourite"], ["seq", "consumer"], {"turn": F.lit(1).cast("long")})
        state = numbered.join(turn.select("consumer", "turn"), "consumer").withColumn("taken", F.col("choice") == F.col("turn")).drop("turn")
    state = materialize(state.drop("choice"))
    while True:
        takers = state.where("taken").groupBy("resource").agg(F.min("seq").alias("taken_at"))
        free = state.join(takers, "resource", "left").withColumn("free", F.col("taken_at").isNull() | (F.col("taken_at") >= F.col("seq"))).drop("taken_at", SLICE)
        placed = running_totals(slice_ordered(free, ["consumer"], ["place"]), ["consumer"], ["place"], {"before": F.when(F.col("free"), F.col("covers")).otherwise(F.lit(0).cast(CENTS))})
        new = F.col("free") & (F.greatest(F.lit(0), F.col("need") - F.col("before")) > tolerance)
        state = materialize(placed.withColumn("_old", F.col("taken")).withColumn("taken", new).drop("before", "free"))
        if state.where("taken <> _old").isEmpty():
            return state.where("taken").select("consumer", "seq", "resource", "covers")
        state = state.drop("_old")


def drain(edges: DataFrame, dims: Sequence[str], order: Sequence[Column | str], gate_tolerance: Column | None = None,
          dynamic_tolerance: Column | None = None) -> DataFrame:
    """Consumers drain resources in several quantities at once, each consumer in candidate order.

    ``edges``: consumer, resource, seq (consumer order), reusable, and per dimension d the columns
    ``want_d`` and ``have_d`` (NULL have means the resource lacks that quantity). Adds ``take_d`` and
    ``used``. Without a gate each quantity is drained on its own. With ``gate_tolerance`` the first
    dimension decides: a resource at or below the tolerance is skipped, a consumer stops once a match
    leaves it at or below the tolerance, and other quantities follow only where the first matched.
    With ``dynamic_tolerance`` a row with ``loose`` true counts as a candidate only while the
    resource's remaining first quantity is that close to ``loose_target``.
    """
    lead = dims[0]
    zero = F.lit(0).cast(QUANTITIES)
    typed = edges
    for d in dims:
        typed = typed.withColumn(f"want_{d}", F.col(f"want_{d}").cast(QUANTITIES)).withColumn(f"have_{d}", F.col(f"have_{d}").cast(QUANTITIES))
        typed = typed.withColumn(f"take_{d}", zero)
    typed = typed.withColumn("used", F.lit(False)).withColumn("pool_before", F.col(f"have_{lead}"))
    base = [c for c in typed.columns if not c.startswith("take_") and c not in ("used", "pool_before")]
    state = slice_ordered(typed, ["resource"], ["seq", "consumer"])
    line = ["seq", "consumer"]
    while True:
        mine = Window.partitionBy("consumer").orderBy(*order, "resource").rowsBetween(Window.unboundedPreceding, -1)
        active = F.lit(True)
        if dynamic_tolerance is not None:
            active = ~F.col("loose") | (F.abs(F.col("loose_target") - F.col("pool_before")) <= dynamic_tolerance)
        rows = state.withColumn("_active", active)
        rows = rows.withColumn("_own_order", F.lit(0))
        for d in dims:
            spent = F.coalesce(F.sum(F.when(F.col("_active"), F.col(f"take_{d}"))).over(mine), zero)
            rows = rows.withColumn(f"_rest_{d}", F.greatest(zero, F.col(f"want_{d}") - spent))
        if gate_tolerance is not None:
            matched = F.coalesce(F.sum(F.when(F.col("_active") & F.col("used"), 1)).over(mine), F.lit(0)) > 0
            rows = rows.withColumn("_open", F.col("_active") & ~(matched & (F.col(f"_rest_{lead}") <= gate_tolerance)))
        else:
            rows = rows.withColumn("_open", F.col("_active"))
        asks = {}
        for d in dims:
            counts = F.col("_open") & ~F.col("reusable")
            if gate_tolerance is not None and d != lead:
                counts = counts & F.col("used")
            asks[f"_ahead_{d}"] = F.when(counts, F.coalesce(F.col(f"_rest_{d}"), zero)).otherwise(zero)
        # what earlier consumers really took, for the remaining quantity they left behind
        asks["_took_ahead"] = F.when(F.col("reusable"), zero).otherwise(F.col(f"take_{lead}"))
        rows = running_totals(rows, ["resource"], line, asks)
        pool = lambda d: F.greatest(zero, F.col(f"have_{d}") - F.col(f"_ahead_{d}"))
        if gate_tolerance is not None:
            usable = F.col("_open") & (F.col("reusable") | (pool(lead) > gate_tolerance))
            first = F.when(usable, F.least(F.col(f"_rest_{lead}"), pool(lead))).otherwise(zero)
            used = usable & ~((first == 0) & (F.col(f"want_{lead}") != 0))
        else:
            first = F.least(F.col(f"_rest_{lead}"), pool(lead))
            used = None
        takes = {}
        for d in dims:
            take = first if d == lead else F.least(F.col(f"_rest_{d}"), pool(d))
            if used is not None and d != lead:
                take = F.when(used, take)
            takes[f"take_{d}"] = F.coalesce(F.when(F.col(f"have_{d}").isNull() | F.col(f"want_{d}").isNull(), zero).otherwise(take), zero).cast(QUANTITIES)
        if used is None:
            used = None
            for value in takes.values():
                used = (value > 0) if used is None else used | (value > 0)
        old = F.struct(*[F.col(f"take_{d}") for d in dims], "used", "pool_before")
        new_pool = (F.col(f"have_{lead}") - F.col("_took_ahead")).cast(QUANTITIES)
        new = {**takes, "used": F.coalesce(used, F.lit(False)), "pool_before": new_pool}
        fresh = rows.select(*base, SLICE, *[c.alias(n) for n, c in new.items()], old.alias("_old"))
        state = materialize(fresh)
        current = F.struct(*[F.col(f"take_{d}") for d in dims], "used", "pool_before")
        if state.where(~current.eqNullSafe(F.col("_old"))).isEmpty():
            return state.drop("_old", SLICE)
        state = state.drop("_old")


def normalized(df: DataFrame, *columns: str) -> DataFrame:
    """Identifiers compared by their normalised form; blank counts as absent."""
    return df.withColumns({c: normalize_identifier(F.col(c)) for c in columns})
