"""Workbooks and documents: cells and paragraphs as rows, headers and records as DataFrame work."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.functions.dates import parse_date
from tallymark.functions.identity import column_letter
from tallymark.functions.money import parse_decimal
from tallymark.functions.text import normalize_identifier
from tallymark.sources.inventory import binary_files

CELLS = "source_path string, file_sha256 string, sheet string, sheet_no int, row int, col int, raw_value string, value_type string, formula string, error string"
PARAGRAPHS = "source_path string, file_sha256 string, row int, paragraph string, error string"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Built-in date formats, and the forms in which typed cells are told from text.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_GERMAN_DATE = r"^\s*\d{1,2}\.\d{1,2}\.\d{2,4}\s*$"
_GERMAN_DECIMAL = r"(?i)^\s*(?:EUR|€)?\s*\(?[+-]?(?:\d{1,3}(?:\.\d{3})+|\d+),\d+\)?\s*(?:EUR|€)?\s*$"


def normalize_cell(value_type: Column, raw: Column) -> Column:
    """struct(value, kind): date, boolean, number, German date, German amount, else identifier."""
    def pair(value: Column, kind: str) -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("kind"))

    plain = lambda c: F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    trimmed = lambda c: F.regexp_replace(plain(c), r"\.$", "")
    german = parse_decimal(raw, "de")
    shown = F.when(F.length(F.regexp_extract(raw, r",(\d+)", 1)) == 2, german.cast("decimal(38,2)").cast("string")).otherwise(trimmed(german))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("struct<value:string,kind:string>"))
        .when(value_type == "d", pair(F.left(raw, F.lit(10)), "date")).when(value_type == "b", pair(raw, "boolean"))
        .when(value_type == "n", pair(raw, "decimal"))
        .when(raw.rlike(_GERMAN_DATE), pair(parse_date(raw, "de"), "date"))
        .when(raw.rlike(_GERMAN_DECIMAL), pair(shown, "decimal"))
        .otherwise(pair(normalize_identifier(raw, uppercase=False), "identifier"))
    )


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in archive.namelist():
        return set()
    styles = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {int(f.attrib["numFmtId"]): f.attrib["formatCode"] for f in styles.iter(f"{_S}numFmt")}
    is_date = lambda n: n in _DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(n, "")), re.I))
    formats = styles.find(f"{_S}cellXfs")
    return {i for i, xf in enumerate(formats if formats is not None else []) if is_date(int(xf.attrib.get("numFmtId", 0)))}


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits), column


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, sheet_no, row, col, raw, type, formula) for every cell of every sheet's used range."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        dates = _date_styles(archive)
        targets = {r.attrib["Id"]: r.attrib["Target"] for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet")):
            target = targets[sheet.attrib[_R]]
            tree = ElementTree.fromstring(archive.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            cells = {}
            for cell in tree.iter(f"{_S}c"):
                kind, value, formula = cell.attrib.get("t", "n"), cell.find(f"{_S}v"), cell.find(f"{_S}f")
                text = value.text if value is not None else None
                if kind == "s" and text is not None:
                    raw, shown = strings[int(text)], "s"
                elif kind == "inlineStr":
                    raw, shown = "".join(t.text or "" for t in cell.iter(f"{_S}t")), "s"
                elif kind == "b" and text is not None:
                    raw, shown = ("True" if text == "1" else "False"), "b"
                elif kind == "n" and text is not None and int(cell.attrib.get("s", 0)) in dates:
                    raw, shown = (datetime(1899, 12, 30) + timedelta(days=float(text))).isoformat(), "d"
                else:
                    raw, shown = text or "", ("n" if text is not None and kind == "n" else "s" if text is not None else "empty")
                cells[_place(cell.attrib["r"])] = (raw, "f" if formula is not None else shown, None if formula is None else formula.text or "")
            rows, columns = max((r for r, _ in cells), default=1), max((c for _, c in cells), default=1)
            for r in range(1, rows + 1):
                for c in range(1, columns + 1):
                    out.append((sheet.attrib["name"], number, r, c, *cells.get((r, c), ("", "empty", None))))
    return out


def document_paragraphs(content: bytes) -> list[tuple[int, str]]:
    """(index counting empty ones, text) of the non-empty body paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    texts = ["".join((n.text or "") if n.tag == f"{_W}t" else "\t" for n in p.iter() if n.tag in (f"{_W}t", f"{_W}tab")) for p in (body if body is not None else []) if p.tag == f"{_W}p"]
    return [(i, t.strip()) for i, t in enumerate(texts, start=1) if t.strip()]


def _scan(spark: SparkSession, root: str, pattern: str, schema: str, rows_of) -> DataFrame:  # noqa: ANN001
    names = [part.split(" ")[0] for part in schema.split(", ")]
    whole = {part.split(" ")[0]: "Int32" for part in schema.split(", ") if part.endswith(" int")}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, sha, content in zip(batch["source_path"], batch["file_sha256"], batch["content"], strict=True):
                try:
                    rows = [(path, sha, *r, None) for r in rows_of(bytes(content))]
                except Exception as error:  # noqa: BLE001 - a faulty file becomes a warning row
                    rows = [(path, sha, *[None] * (len(names) - 3), f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=names).astype(whole)

    files = binary_files(spark, root, pattern).select("source_path", F.sha2("content", 256).alias("file_sha256"), "content")
    return files.mapInPandas(parse, schema)


def read_workbooks(spark: SparkSession, root: str) -> DataFrame:
    """Long cells of every workbook below the root; one workbook per file task."""
    cells = _scan(spark, root, "*.xlsx", CELLS, workbook_cells)
    typed = F.when(F.col("value_type") == "f", F.when(F.col("raw_value").rlike(r"^[+-]?\d+(\.\d+)?$"), "n").otherwise("s")).otherwise(F.col("value_type"))
    raw = F.when(F.col("value_type") == "b", F.lower("raw_value")).otherwise(F.col("raw_value"))
    return cells.withColumn("cell", F.concat(column_letter(F.col("col")), F.col("row").cast("string"))).withColumn("normalized", normalize_cell(typed, raw))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    return _scan(spark, root, "*.docx", PARAGRAPHS, document_paragraphs)


SHEET = ["source_path", "sheet"]


def detect_headers(cells: DataFrame) -> DataFrame:
    """Header row per sheet: the first non-empty row, not the last one, that is wide and all text."""
    filled = F.col("raw_value") != ""
    rows = cells.groupBy(*SHEET, "row").agg(
        F.count(F.when(filled, F.lit(1))).alias("filled"), F.count(F.lit(1)).alias("width"),
        F.coalesce(F.min(F.when(filled, (F.col("value_type") == "s").cast("int"))), F.lit(0)).alias("all_text")).where("filled > 0")
    last = rows.groupBy(*SHEET).agg(F.max("row").alias("last_row"))
    needed = F.when(F.col("width") == 1, 1).otherwise(2)
    fit = rows.join(last, SHEET).where((F.col("row") < F.col("last_row")) & (F.col("filled") >= needed) & (F.col("filled") / F.col("width") >= 0.5) & (F.col("all_text") == 1))
    return fit.groupBy(*SHEET).agg(F.min("row").alias("header_row"))


def header_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, col, header, warning): blanks become column_<letter>, repeats get a running suffix."""
    row = cells.join(headers, SHEET).where("row = header_row")
    named = F.coalesce(normalize_identifier(F.col("raw_value"), uppercase=False), F.concat(F.lit("column_"), column_letter(F.col("col"))))
    order = Window.partitionBy(*SHEET, "base").orderBy("col")  # the repeats of one header in one sheet
    base = row.withColumn("base", named).withColumn("n", F.row_number().over(order))
    blank = F.when(F.col("raw_value") == "", F.concat(F.lit("missing header replaced with "), "base"))
    repeat = F.when(F.col("n") > 1, F.concat(F.lit("duplicate header renamed to "), F.col("base"), F.lit("__"), F.col("n")))
    return base.select(*SHEET, "header_row", "col", F.when(F.col("n") > 1, F.concat("base", F.lit("__"), "n")).otherwise(F.col("base")).alias("header"),
                       F.coalesce(blank, repeat).alias("warning"))


def records(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Rows below the header as maps of raw and normalised values; all-empty rows are dropped."""
    below = cells.join(names, [*SHEET, "col"]).where("row > header_row")
    entry = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("header"), value.alias("v")))))
    grouped = below.groupBy(*SHEET, "row").agg(
        entry(F.col("raw_value")).alias("raw"), entry(F.col("normalized.value")).alias("normalized"),
        F.max((F.col("raw_value") != "").cast("int")).alias("any_value"))
    return grouped.where("any_value = 1").drop("any_value")


def workbook_warnings(cells: DataFrame, names: DataFrame, headers: DataFrame) -> DataFrame:
    """(source_path, message) of faulty files, cacheless formulas, renamed headers and headerless sheets."""
    faulty = cells.where("error is not null").select("source_path", F.concat(F.lit("parse failed: "), "error").alias("message"))
    cacheless = cells.where("formula is not null and raw_value = ''").select("source_path", F.concat(F.lit("formula has no cached value: "), "sheet", F.lit("!"), "cell").alias("message"))
    renamed = names.where("warning is not null").select("source_path", F.col("warning").alias("message"))
    bare = cells.where("sheet is not null").select(*SHEET).distinct().join(headers, SHEET, "left_anti").select(
        "source_path", F.concat(F.lit("no conservative header row detected: "), "sheet").alias("message"))
    return faulty.unionByName(cacheless).unionByName(renamed).unionByName(bare)
