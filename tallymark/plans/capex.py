"""Capital-expenditure classification over typed records; one outcome per asset addition."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark import vocabulary as V
from tallymark.functions.money import CENTS
from tallymark.functions.text import any_term, fold, fold_literal, normalize_identifier
from tallymark.operators import aggregates, checks
from tallymark.plans.base import outcome_counter, parameter_map, review_reasons
from tallymark.session import materialize

KINDS = tuple(V.SUPPORT_TERMS)
# Fixed value: the reason that every open capitalisation carries.
JUDGEMENT = "capitalization classification requires accounting judgement; description matching alone is not proof of misstatement"


@dataclass(frozen=True)
class CapexParameters:
    repair_maintenance_triggers: tuple[str, ...] = V.REPAIR_TRIGGERS
    replacement_overhaul_triggers: tuple[str, ...] = V.REPLACEMENT_TRIGGERS
    counter_terms: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(V.SUPPORT_TERMS))
    cluster_window_days: int = 30
    cluster_minimum_count: int = 2
    weight: Mapping[str, Decimal] = field(default_factory=lambda: {s: Decimal("1") for s in V.CAPEX_SIGNALS})

    def __post_init__(self) -> None:
        if self.cluster_window_days < 0 or self.cluster_minimum_count < 2:
            raise ValueError("cluster window must not be negative and the minimum must be at least two")
        triggers = {fold_literal(x) for x in self.triggers}
        counters = {fold_literal(x) for terms in self.counter_terms.values() for x in terms}
        if not triggers or any(not x.strip() for x in triggers | counters):
            raise ValueError("vocabularies must hold non-empty terms")
        if set(self.counter_terms) != set(KINDS) or triggers & counters:
            raise ValueError("counter vocabulary must cover every kind and stay apart from the triggers")
        if set(self.weight) != set(V.CAPEX_SIGNALS):
            raise ValueError("every signal needs exactly one weight")

    @property
    def triggers(self) -> tuple[str, ...]:
        """All trigger terms, sorted by their folded form."""
        return tuple(sorted({*self.repair_maintenance_triggers, *self.replacement_overhaul_triggers}, key=fold_literal))


def collapse_business_records(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Same key and content: one row with the smallest record id."""
    return df.groupBy(*dict.fromkeys([*key, *content])).agg(F.min("record_id").alias("record_id"), F.min("evidence_id").alias("evidence_id"))


def representations(postings: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the ledger and the invoices say of each addition: (gl_total and asset_debit, invoice_total)."""
    posted = postings.groupBy("addition_id").agg(
        F.sum("amount").cast(CENTS).alias("gl_total"),
        F.max(((F.col("account_classification") == "asset") & (F.col("amount") > 0)).cast("int")).alias("asset_debit"))
    return posted, invoices.groupBy("addition_id").agg(F.sum("net_amount").cast(CENTS).alias("invoice_total"))


class CapitalExpenditure:
    """Tables: additions, postings, invoices, assets, support."""

    control_id = "capital_expenditure_classification"
    version = "1.0.0"

    CONTENT = {
        "additions": (["addition_id"], ["asset_id", "vendor_id", "addition_date", "net_amount", "description", "category"]),
        "postings": (["posting_id"], ["addition_id", "account_id", "account_classification", "posting_date", "amount", "description",
                                      "reversal_of_posting_id", "is_reclassification"]),
        "invoices": (["invoice_id"], ["addition_id", "invoice_date", "net_amount", "description"]),
        "assets": (["asset_id", "description", "category", "distinct_new_asset"], []),
        "support": (["addition_id", "kind", "present"], []),
    }
    IDENTIFIERS = ("addition_id", "asset_id", "vendor_id", "category", "posting_id", "account_id", "reversal_of_posting_id", "invoice_id")

    def prepare(self, tables: Mapping[str, DataFrame], strict: bool) -> dict[str, DataFrame]:
        ready = {}
        for name, (key, content) in self.CONTENT.items():
            df = tables[name]
            df = df.withColumns({c: normalize_identifier(F.col(c)) for c in df.columns if c in self.IDENTIFIERS})
            if "description" in df.columns:
                df = df.withColumn("description", fold(F.coalesce("description", F.lit(""))))
            if strict:
                checks.require_none(checks.conflicting_records(df, key, [*key, *content]), f"conflicting duplicate in {name}")
            ready[name] = collapse_business_records(df, key, content)
        # Additions and postings are read several times below, so they are collapsed once; nobody asks for a posting's record.
        return {**ready, "additions": materialize(ready["additions"]), "postings": materialize(ready["postings"].drop("record_id", "evidence_id"))}

    def evaluate(self, tables: Mapping[str, DataFrame], params: CapexParameters | None = None, strict: bool = False) -> DataFrame:
        params = params or CapexParameters()
        t = self.prepare(tables, strict)
        additions = t["additions"]
        terms = params.triggers
        text_of = lambda *cols: F.lower(F.concat_ws(" ", *cols))

        # One bit per trigger term and one per support kind hinted at; or-ing bits has a partial form.
        # Most texts hold no term at all, which one joint pattern finds out.
        every = [*terms, *[word for k in KINDS for word in params.counter_terms[k]]]

        def bits(text: Column) -> Column:
            # descriptions were folded when they were prepared
            tests = [any_term(text, [term], folded=True) for term in terms] + [any_term(text, params.counter_terms[k], folded=True) for k in KINDS]
            single = [F.when(test, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, test in enumerate(tests)]
            return F.when(any_term(text, every, folded=True), reduce(lambda a, b: a.bitwiseOR(b), single)).otherwise(F.lit(0).cast("long"))

        assets = t["assets"].groupBy("asset_id").agg(
            F.bit_or(bits(text_of("description", "category"))).alias("asset_bits"),
            F.max(F.col("distinct_new_asset").cast("int")).alias("asset_new"), F.min(F.col("distinct_new_asset").cast("int")).alias("asset_old"))
        wide = additions.drop("description", "category")
        for part in (materialize(self.facts(t, bits, text_of)), self.reversals(additions, t["postings"])):
            wide = wide.join(part, "addition_id", "left")
        wide = wide.join(assets, "asset_id", "left")
        numbers = ["gl_total", "invoice_total", "resolved", "unresolved", "adjustment", "asset_bits", "linked_bits", "marks"]
        wide = wide.withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers}).withColumn("bits", F.col("linked_bits").bitwiseOR(F.col("asset_bits")))
        trigger_mask = (1 << len(terms)) - 1
        wide = wide.withColumn("repair_like", F.col("bits").bitwiseAND(F.lit(trigger_mask)) != 0)
        flag = lambda i: (F.col("marks").bitwiseAND(F.lit(1 << i)) != 0).cast("int")
        marks = {f"{said}_{k}": flag(i) for i, (k, said) in enumerate((k, said) for k in KINDS for said in ("yes", "no"))}
        return self.judge(self.with_clusters(wide.withColumns({**marks, "asset_debit": flag(len(marks))}), params), params)

    @staticmethod
    def facts(t: Mapping[str, DataFrame], bits: Callable[[Column], Column], text_of: Callable[..., Column]) -> DataFrame:
        """What the records of an addition say together, in one aggregation over all of them: terms of their texts, totals,
        and as marks whether support is present (bit 2i for the i-th kind), searched in vain (2i + 1), or an asset account debited."""
        amounts = {"posted": t["postings"].schema["amount"].dataType, "invoiced": t["invoices"].schema["net_amount"].dataType}

        def rows(df: DataFrame, **given: Column) -> DataFrame:
            none = {"linked_bits": F.lit(0), "marks": F.lit(0), **{c: F.lit(None).cast(kind) for c, kind in amounts.items()}}
            return df.select("addition_id", *[(given.get(c, other).cast("long") if c not in amounts else given.get(c, other)).alias(c) for c, other in none.items()])

        mark = lambda i, test: F.when(test, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        present, kind = F.col("present"), F.col("kind")
        support = reduce(lambda a, b: a.bitwiseOR(b), [mark(2 * i + no, (kind == k) & (~present if no else present)) for i, k in enumerate(KINDS) for no in (0, 1)])
        debit = mark(2 * len(KINDS), (F.col("account_classification") == "asset") & (F.col("amount") > 0))
        parts = (
            rows(t["additions"], linked_bits=bits(text_of("description", "category"))),
            rows(t["postings"], linked_bits=bits(F.col("description")), marks=debit, posted=F.col("amount")),
            rows(t["invoices"], linked_bits=bits(F.col("description")), invoiced=F.col("net_amount")),
            rows(t["support"], marks=support))
        return reduce(DataFrame.unionByName, parts).groupBy("addition_id").agg(
            F.bit_or("linked_bits").alias("linked_bits"), F.bit_or("marks").alias("marks"), F.sum("posted").cast(CENTS).alias("gl_total"), F.sum("invoiced").cast(CENTS).alias("invoice_total"))

    @staticmethod
    def reversals(additions: DataFrame, postings: DataFrame) -> DataFrame:
        """Per addition: matched and unmatched reversals, and the negative amounts they bring."""
        p = postings.join(additions.select("addition_id", "addition_date"), "addition_id")
        target = postings.select("addition_id", F.col("posting_id").alias("reversal_of_posting_id"), F.col("amount").alias("t_amount"),
                                 F.col("posting_date").alias("t_date"), F.col("account_classification").alias("t_class"))
        pairs = p.where("reversal_of_posting_id is not null or is_reclassification").join(target, ["addition_id", "reversal_of_posting_id"], "left")
        is_asset = F.col("account_classification") == "asset"
        moved = F.col("is_reclassification") & is_asset & (F.col("posting_date") >= F.col("addition_date"))
        mirrored = (
            ~F.col("is_reclassification") & (F.col("amount") == -F.col("t_amount")) & (F.col("t_date") >= F.col("addition_date"))
            & (F.col("t_date") <= F.col("posting_date")) & (F.col("t_class") == "asset") & is_asset)
        judged = materialize(pairs.select("addition_id", "posting_id", "amount", "reversal_of_posting_id", "t_amount", moved.alias("moved"), F.coalesce(mirrored, F.lit(False)).alias("mirrored")))
        matched = judged.where("moved or mirrored")
        effects = matched.select("addition_id", "posting_id", "amount").unionByName(
            matched.where("mirrored").select("addition_id", F.col("reversal_of_posting_id").alias("posting_id"), F.col("t_amount").alias("amount"))).distinct()
        adjustment = effects.groupBy("addition_id").agg(F.sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(0)).cast(CENTS).alias("adjustment"))
        counts = judged.groupBy("addition_id").agg(
            F.count(F.when(F.col("moved") | F.col("mirrored"), F.lit(1))).alias("resolved"),
            F.count(F.when(~F.col("moved") & ~F.col("mirrored"), F.lit(1))).alias("unresolved"))
        return counts.join(adjustment, "addition_id", "left")

    @staticmethod
    def with_clusters(wide: DataFrame, params: CapexParameters) -> DataFrame:
        """Repair-like additions of the same asset and vendor within the window, counted by day first,
        so the window sees one row per day however many additions share it."""
        key = ["asset_id", "_vendor"]
        wide = wide.withColumn("_vendor", F.coalesce("vendor_id", F.lit(""))).withColumn("_day", F.unix_date("addition_date"))
        days = wide.groupBy(*key, "_day").agg(F.sum(F.col("repair_like").cast("long")).alias("_n"))
        span = Window.partitionBy(*key).orderBy("_day").rangeBetween(-params.cluster_window_days, params.cluster_window_days)
        near = days.withColumn("cluster_size", F.sum("_n").over(span)).select(*key, "_day", "cluster_size")
        return wide.join(near, [*key, "_day"]).drop("_vendor", "_day")

    def judge(self, wide: DataFrame, params: CapexParameters) -> DataFrame:
        c = F.col
        terms = params.triggers
        bit = lambda i: c("bits").bitwiseAND(F.lit(1 << i)) != 0
        any_of = lambda words: reduce(lambda a, b: a | b, [bit(i) for i, w in enumerate(terms) if w in words], F.lit(False))
        status: dict[str, Column] = {}
        hint = {k: bit(len(terms) + i) for i, k in enumerate(KINDS)}
        for k in KINDS:
            yes, no = c(f"yes_{k}") == 1, c(f"no_{k}") == 1
            status[k] = F.when(yes & no, "unresolved").when(yes, "accounted_for").when(no, "not_found").otherwise("unresolved")
        new_flag = F.when(c("asset_new") != c("asset_old"), "unresolved").when(c("asset_new") == 1, "accounted_for").when(c("asset_new") == 0, "not_found")
        status["distinct_new_asset"] = F.coalesce(new_flag, status["distinct_new_asset"])
        status["reversal_or_reclassification"] = F.when(c("unresolved") > 0, "unresolved").when(c("resolved") > 0, "accounted_for").otherwise(status["reversal_or_reclassification"])
        told: dict[str, Column] = {}
        for k in KINDS:
            conflict = (c(f"yes_{k}") == 1) & (c(f"no_{k}") == 1)
            told[k] = (F.when(conflict, f"conflicting {k} evidence was supplied").when(c(f"yes_{k}") == 1, f"{k} evidence is present")
                       .when(c(f"no_{k}") == 1, f"a documented search found no {k} evidence")
                       .when(hint[k], f"description suggests {k}, but supporting evidence is required")
                       .otherwise(f"no {k} evidence or documented search was supplied"))
        told["distinct_new_asset"] = F.coalesce(
            F.when(c("asset_new") != c("asset_old"), "asset records conflict on whether this is a distinct new asset")
            .when(c("asset_new") == 1, "asset records identify a distinct new asset").when(c("asset_new") == 0, "asset records do not identify a distinct new asset"),
            told["distinct_new_asset"])
        unmatched = "a reversal or reclassification could not be matched to an asset posting deterministically"
        told["reversal_or_reclassification"] = F.when(c("unresolved") > 0, unmatched).when(
            c("resolved") > 0, "a deterministic reversal or reclassification is present").otherwise(told["reversal_or_reclassification"])
        rows = wide.withColumns({**{f"s_{k}": v for k, v in status.items()}, **{f"d_{k}": v for k, v in told.items()}})
        is_ = lambda k, v: c(f"s_{k}") == v
        missing = lambda *ks: reduce(lambda a, b: a & b, [is_(k, "not_found") for k in ks])
        present = lambda *ks: reduce(lambda a, b: a | b, [is_(k, "accounted_for") for k in ks])
        fired = {
            "repair_or_maintenance_language": any_of(params.repair_maintenance_triggers),
            "replacement_overhaul_service_language": any_of(params.replacement_overhaul_triggers),
            "posted_to_asset_account": c("asset_debit") == 1,
            "no_distinct_asset_or_project_reference": missing("distinct_new_asset", "project_reference"),
            "no_investment_approval": missing("investment_approval"),
            "no_useful_life_or_capacity_improvement": missing("useful_life_extension", "capacity_or_quality_improvement"),
            "multiple_repair_like_additions": c("cluster_size") >= params.cluster_minimum_count,
        }
        remaining = c("net_amount") + c("adjustment")
        valid = (
            (present("distinct_new_asset") & present("project_reference", "investment_approval"))
            | (present("separable_major_component") & present("useful_life_extension", "capacity_or_quality_improvement"))
            | (present("required_for_new_asset_operation") & present("distinct_new_asset", "project_reference")))
        cleared = present("reversal_or_reclassification") & (remaining == 0)
        dismissed = (c("unresolved") == 0) & (cleared | valid)
        material = [k for k in KINDS if k != "reversal_or_reclassification"]
        # The reasons for review, compared by fixtures.
        doubts = review_reasons(
            *[F.when(is_(k, "unresolved"), c(f"d_{k}")) for k in material],
            F.when(c("unresolved") > 0, unmatched),
            F.when((c("unresolved") == 0) & ~dismissed & present("reversal_or_reclassification"),
                   "a reversal or reclassification exists but does not clear the entire capitalized net amount"),
            F.when(~dismissed, JUDGEMENT))
        matched_terms = F.array_compact(F.array(*[F.when(bit(i), F.lit(w)) for i, w in enumerate(terms)]))
        return rows.select(
            F.lit(self.control_id).alias("control_id"), F.lit(self.version).alias("control_version"),
            F.when(dismissed, "dismissed").otherwise("review_needed").alias("status"), "addition_id", "asset_id", c("addition_id").alias("subject"),
            F.create_map(F.lit("addition_id"), c("addition_id"), F.lit("asset_id"), c("asset_id")).alias("group_key"),
            parameter_map(params).alias("rule_parameters"), F.greatest(F.lit(0), remaining).cast(CENTS).alias("exposure"),
            aggregates.severity_score(fired, params.weight).alias("severity_score"),
            F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in sorted(fired.items())])).alias("signals"), matched_terms.alias("matched_trigger_terms"),
            F.array(*[outcome_counter(k, c(f"s_{k}"), c(f"d_{k}")) for k in KINDS]).alias("counter_tests"), doubts.alias("uncertainty"),
            c("gl_total").cast(CENTS).alias("gl_total"), c("invoice_total").cast(CENTS).alias("invoice_total"), "cluster_size", "evidence_id")
