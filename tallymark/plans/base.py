"""Shared shapes: findings of dossier controls, outcomes of record controls, the plug-in contracts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, is_dataclass
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.money import CENTS

STEP = "struct<step:string,evidence_ids:array<string>>"
COUNTER = "struct<name:string,outcome:string,detail:string,required:boolean,evidence_ids:array<string>>"
FINDING_COLUMNS = (
    "finding_id", "control_id", "control_version", "subject", "title", "assertion", "severity", "narrative",
    "exposure", "exposure_label", "expression", "input_count", "result", "chain", "counter_tests",
    "recommended_action", "uncertainty",
)
INPUT_COLUMNS = ("finding_id", "label", "value", "evidence_id")


class Findings(NamedTuple):
    """Findings carry bounded lists only; every calculation input is a row of ``inputs``."""

    findings: DataFrame
    inputs: DataFrame


class DossierControl(Protocol):
    """Plug-in over role tables that yields findings."""

    id: str
    version: str

    def run(self, tables: Mapping[str, DataFrame], params: Mapping[str, object]) -> Findings: ...


class RecordControl(Protocol):
    """Plug-in over typed record tables that yields one outcome row per subject."""

    control_id: str
    version: str

    def evaluate(self, tables: Mapping[str, DataFrame], params: object) -> DataFrame: ...


@dataclass(frozen=True)
class Wording:
    """Descriptive texts of a control."""

    title: str
    assertion: str
    severity: str
    exposure_label: str
    action: str
    uncertainty: str | None = None


def step(text: Column | str, evidence: Column) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(text.alias("step"), evidence.cast("array<string>").alias("evidence_ids"))


def counter(name: str, outcome: Column | str, detail: Column | str, required: bool = True,
            evidence: Column | None = None) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    ids = evidence if evidence is not None else F.array()
    return F.struct(
        F.lit(name).alias("name"), as_column(outcome).alias("outcome"), as_column(detail).alias("detail"),
        F.lit(required).alias("required"), ids.cast("array<string>").alias("evidence_ids"))


def finish(df: DataFrame, control_id: str, version: str, words: Wording, **columns: Column) -> DataFrame:
    """Lay out the finding columns; ``columns`` gives the ones that vary by row."""
    fixed = {
        "control_id": F.lit(control_id), "control_version": F.lit(version), "title": F.lit(words.title),
        "assertion": F.lit(words.assertion), "severity": F.lit(words.severity),
        "exposure_label": F.lit(words.exposure_label), "recommended_action": F.lit(words.action),
        "uncertainty": F.lit(words.uncertainty).cast("string"),
    }
    chosen = {**fixed, **columns}
    chosen.setdefault("result", chosen["exposure"])
    casts = {"exposure": CENTS, "result": CENTS, "input_count": "long",
             "chain": f"array<{STEP}>", "counter_tests": f"array<{COUNTER}>"}
    return df.select(*[
        (chosen[c].cast(casts[c]) if c in casts else chosen[c]).alias(c) for c in FINDING_COLUMNS])


def single_row(*parts: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def union_findings(parts: list[Findings]) -> Findings:
    return Findings(
        reduce(DataFrame.unionByName, [p.findings for p in parts]),
        reduce(DataFrame.unionByName, [p.inputs for p in parts]),
    )


def parameter_map(params: object) -> Column:
    """Rule parameters carried into every outcome as a literal map, sorted by name."""
    items = asdict(params) if is_dataclass(params) else dict(params)
    flat: dict[str, str] = {}
    for name, value in items.items():
        if isinstance(value, Mapping):
            flat.update({f"{name}.{k}": "|".join(v) if isinstance(v, tuple) else str(v) for k, v in value.items()})
        elif isinstance(value, (tuple, list)):
            flat[name] = "|".join(str(v) for v in value)
        else:
            flat[name] = str(value)
    pairs = [F.lit(x) for name in sorted(flat) for x in (name, flat[name])]
    return F.create_map(*pairs)


def outcome_counter(name: str, status: Column, description: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), status.alias("status"), description.alias("description"))


def review_reasons(*reasons: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
