"""A whole folder of exports as tables with source coordinates, plus warnings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.identity import cell_coordinate, evidence_uuid, raw_hash, registry_id
from tallymark.functions.roles import resolve_column, resolves_all
from tallymark.operators.aggregates import table_summary
from tallymark.session import materialize
from tallymark.sources import catalog, delimited, inventory, workbook

CELL_COLUMNS = ("table_name", "source_path", "source_type", "row", "sheet", "cell", "page", "column", "raw_value", "raw_value_sha256", "evidence_id", "evidence_uuid")


@dataclass(frozen=True)
class SourceTable:
    """One table: string columns plus ``source_path`` and ``row``; the headers are known metadata."""

    name: str
    source_type: str
    columns: tuple[str, ...]
    df: DataFrame
    sheet: str | None = None

    def cells(self) -> DataFrame:
        """Long cells with their coordinates and ids."""
        parts = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("raw_value")) for i, c in enumerate(self.columns)])
        long = self.df.select("source_path", "row", F.explode(parts).alias("c")).select("source_path", "row", "c.*")
        sheet = F.lit(self.sheet).cast("string")
        cell = cell_coordinate(F.col("no"), F.col("row")) if self.source_type == "xlsx_cell" else F.lit(None).cast("string")
        at = {"row": F.col("row"), "sheet": sheet, "cell": cell}
        return long.select(
            F.lit(self.name).alias("table_name"), "source_path", F.lit(self.source_type).alias("source_type"), F.col("row").cast("long").alias("row"),
            sheet.alias("sheet"), cell.alias("cell"), F.lit(None).cast("long").alias("page"), "column", "raw_value", raw_hash(F.col("raw_value")).alias("raw_value_sha256"),
            registry_id(F.col("source_path"), F.col("raw_value"), **at).alias("evidence_id"), evidence_uuid(F.col("source_path"), F.col("raw_value"), **at).alias("evidence_uuid"))


@dataclass(frozen=True)
class Dossier:
    manifest: DataFrame
    tables: tuple[SourceTable, ...]
    warnings: DataFrame

    def by_columns(self, required: Iterable[str]) -> list[SourceTable]:
        return [t for t in self.tables if set(required) <= set(t.columns)]

    def find_tables(self, concepts: Iterable[str]) -> list[SourceTable]:
        """Tables that resolve every concept, most rows first; ties keep load order."""
        fit = [t for t in self.tables if resolves_all(t.columns, list(concepts))]
        if len(fit) < 2:
            return fit
        counts = {r["table_name"]: r["rows"] for r in table_summary({str(i): t.df for i, t in enumerate(fit)}).collect()}  # one number per table
        return [fit[i] for i in sorted(range(len(fit)), key=lambda i: (-counts[str(i)], i))]

    def role(self, table: SourceTable, concept: str) -> str | None:
        return resolve_column(table.columns, concept)

    def cells(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.cells() for t in self.tables])


def _declared_tables(spark: SparkSession, root: str, encodings: Mapping[str, str]) -> tuple[list[SourceTable], list[tuple[str, str]], set[str]]:
    """Tables of all index files. Definitions are metadata: a row per declared column."""
    rows = catalog.table_definitions(spark, root).collect()
    warnings = [(r["index_path"], f"index failed: {r['error']}") for r in rows if r["error"]]
    grouped: dict[tuple[str, str], dict] = {}
    for r in sorted((r for r in rows if not r["error"]), key=lambda r: (r["index_path"], r["table_no"], r["position"])):
        folder = PurePosixPath(r["index_path"]).parent
        path = (folder / r["source_path"]).as_posix()
        entry = grouped.setdefault((r["index_path"], path, r["table_no"]), {"name": r["table_name"], "delimiter": r["delimiter"], "encoding": r["encoding"], "columns": []})
        entry["columns"].append(r["column"])
    by_path: dict[str, dict] = {}
    broken = set()
    for (index, path, _), entry in grouped.items():
        if path in by_path and by_path[path]["columns"] != entry["columns"]:
            warnings.append((index, f"index failed: conflicting columns for {path}"))
            broken.add(path)
        by_path[path] = entry
    tables, seen = [], set()
    for path, entry in by_path.items():
        if path in broken:
            continue
        if path not in encodings:
            warnings.append((path, "declared data file is missing"))
            continue
        kind = "csv_row" if path.lower().endswith(".csv") else "text_row"
        good, bad = delimited.read_declared(spark, f"{root}/{path}", root, entry["columns"], entry["delimiter"], entry["encoding"] or encodings[path])
        wrong = bad.limit(1).collect()
        seen.add(path)
        if wrong:  # strict arity: the file is reported, not half-loaded
            warnings.append((path, f"row {wrong[0]['row']} has another number of fields than declared"))
            continue
        tables.append(SourceTable(entry["name"], kind, tuple(entry["columns"]), good))
    return tables, warnings, seen


def load_dossier(spark: SparkSession, root: str) -> Dossier:
    """Declared files first, then the others by type; a faulty file becomes a warning."""
    manifest = materialize(inventory.inventory(spark, root))
    files = manifest.select("path", "file_type", "encoding").collect()  # one row per file
    encodings = {f["path"]: ("UTF-8" if f["encoding"] == "UTF-8-BOM" else f["encoding"]) for f in files}
    tables, warnings, declared = _declared_tables(spark, root, encodings)
    for f in files:
        if f["file_type"] != "csv" or f["path"] in declared:
            continue
        try:
            df = delimited.read_with_header(spark, f"{root}/{f['path']}", root, encodings[f["path"]])
        except ValueError as error:
            warnings.append((f["path"], f"parse failed: {error}"))
            continue
        tables.append(SourceTable(PurePosixPath(f["path"]).stem, "csv_row", tuple(c for c in df.columns if c not in ("source_path", "row")), df))
    warning_rows = spark.createDataFrame(warnings, "source_path string, message string")
    kinds = {f["file_type"] for f in files}
    if "xlsx" in kinds:
        cells = workbook.read_workbooks(spark, root)
        headers = workbook.detect_headers(cells.where("error is null"))
        names = workbook.header_names(cells.where("error is null"), headers)
        warning_rows = warning_rows.unionByName(workbook.workbook_warnings(cells, names, headers))
        rows = workbook.records(cells, names)
        for group in names.groupBy("source_path", "sheet").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("h")).orderBy("source_path", "sheet").collect():
            columns = tuple(h["header"] for h in group["h"])
            own = rows.where((F.col("source_path") == group["source_path"]) & (F.col("sheet") == group["sheet"]))
            df = own.select("source_path", "row", *[F.col("raw")[c].alias(c) for c in columns])
            tables.append(SourceTable(f"{PurePosixPath(group['source_path']).stem}:{group['sheet']}", "xlsx_cell", columns, df, group["sheet"]))
    if "docx" in kinds:
        paragraphs = workbook.read_documents(spark, root)
        warning_rows = warning_rows.unionByName(paragraphs.where("error is not null").select("source_path", F.concat(F.lit("parse failed: "), "error").alias("message")))
        for f in files:
            if f["file_type"] == "docx":
                df = paragraphs.where((F.col("error").isNull()) & (F.col("source_path") == f["path"])).select("source_path", "row", "paragraph")
                tables.append(SourceTable(PurePosixPath(f["path"]).stem, "docx_paragraph", ("paragraph",), df))
    return Dossier(manifest, tuple(tables), warning_rows)


def passages(pages: DataFrame, path: str, page: str, text: str) -> DataFrame:
    """Already extracted page text as evidence rows: one per non-empty page, first 200 characters as passage."""
    body = F.trim(F.col(text))
    rows = pages.where(body != "").select(F.col(path).alias("source_path"), F.col(page).cast("long").alias("page"), body.alias("raw_value"))
    return rows.withColumn("passage", F.left("raw_value", F.lit(200))).withColumns({
        "raw_value_sha256": raw_hash(F.col("raw_value")), "evidence_id": registry_id(F.col("source_path"), F.col("raw_value"), page=F.col("page")),
        "evidence_uuid": evidence_uuid(F.col("source_path"), F.col("raw_value"), page=F.col("page"), passage=F.col("passage"))})


def narratives(tables: Sequence[SourceTable]) -> DataFrame | None:
    """(table_no, row, text) of every table with a paragraph or text column."""
    parts = []
    for i, t in enumerate(tables):
        column = next((c for c in ("paragraph", "text") if c in t.columns), None)
        if column:
            parts.append(t.df.select(F.lit(i).alias("table_no"), F.col("row").cast("long").alias("row"), F.col(column).alias("text")))
    return reduce(DataFrame.unionByName, parts) if parts else None
