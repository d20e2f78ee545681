"""Scans of small generated exports with exact coordinates, and sinks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallymark.functions.money import parse_decimal
from tallymark.sources import catalog, delimited, dossier, inventory, sinks, workbook

INDEX = """<DataSet><Media><Table><URL>exports/bookings.txt</URL><Name>bookings</Name><ColumnDelimiter>;</ColumnDelimiter><Encoding>windows-1252</Encoding>
<VariableColumn><Name>Belegnummer</Name></VariableColumn><VariableColumn><Name>Beschreibung</Name></VariableColumn><VariableColumn><Name>Betrag</Name></VariableColumn></Table></Media></DataSet>"""
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet(rows):
    cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{ref}"{attrs}>{body}</c>' for ref, attrs, body in row) + "</row>" for r, row in rows)
    return f'<worksheet {S}><sheetData>{cells}</sheetData></worksheet>'


def text(ref, value):
    return ref, ' t="inlineStr"', f"<is><t>{value}</t></is>"


def number(ref, value, style=0):
    return ref, f' s="{style}"', f"<v>{value}</v>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("dossier")
    (root / "gdpdu" / "exports").mkdir(parents=True)
    (root / "gdpdu" / "index.xml").write_text(INDEX)
    (root / "gdpdu" / "exports" / "bookings.txt").write_bytes("A-1;Änderung;1.234,50\r\nA-2;Rückgabe;12,00\r\n".encode("cp1252"))
    (root / "vendors.csv").write_text("\n;;\nvendor_id;name;created_by;approved_by\nV1;\"Müller; Sohn\";u1\n\nV2;Meier;u2;u3;extra\n", encoding="utf-8")
    (root / "empty.csv").write_text("\n\n")
    (root / "broken.xlsx").write_bytes(b"no zip")
    with zipfile.ZipFile(root / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Ledger" sheetId="1" r:id="rId1"/><sheet name="Numbers" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([
            (1, [text("A1", "Quarterly ledger")]), (3, [text("A3", "Reference"), text("B3", "Amount"), text("C3", "Booking date"), text("D3", "Reference"), text("E3", "Calculated")]),
            (4, [text("A4", " X-1 "), text("B4", "1.234,50 EUR"), number("C4", 46221, 1), text("D4", "y"), ("E4", "", "<f>1+1</f><v>2</v>")]), (5, [text("A5", "X-2"), number("B5", "7.5"), ("E5", "", "<f>A1</f>")])]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([(1, [number("A1", 1), number("B1", 2)]), (2, [number("A2", 3), number("B2", 4)])]))
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(root / "policy.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Zweite Freigabe ab 5.000 EUR</w:t></w:r></w:p><w:p/><w:p><w:r><w:t> Ende </w:t></w:r></w:p></w:body></w:document>")
    return str(root)


@pytest.fixture(scope="module")
def loaded(spark, folder):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return dossier.load_dossier(spark, folder)


def test_inventory(spark, folder):
    rows = {r["path"]: r for r in inventory.inventory(spark, folder).collect()}
    assert list(rows) == sorted(rows) and len(rows) == 7
    assert rows["gdpdu/exports/bookings.txt"]["encoding"] == "windows-1252" and rows["vendors.csv"]["file_type"] == "csv" and len(rows["book.xlsx"]["sha256"]) == 64


def test_declared_table(loaded):
    table = next(t for t in loaded.tables if t.name == "bookings")
    rows = table.df.orderBy("row").withColumn("value", parse_decimal(F.col("Betrag"), "de")).collect()
    assert [(r["row"], r["Beschreibung"], float(r["value"])) for r in rows] == [(1, "Änderung", 1234.5), (2, "Rückgabe", 12.0)]
    assert rows[0]["source_path"] == "gdpdu/exports/bookings.txt"


def test_header_csv_pads_cuts_and_numbers(loaded):
    rows = next(t for t in loaded.tables if t.name == "vendors").df.orderBy("row").collect()
    assert [(r["row"], r["vendor_id"], r["name"], r["approved_by"]) for r in rows] == [(2, "V1", "Müller; Sohn", ""), (3, "V2", "Meier", "u3")]


def test_workbook(spark, folder, loaded):
    cells = workbook.read_workbooks(spark, folder).where("sheet = 'Ledger'")
    by_cell = {r["cell"]: r for r in cells.collect()}
    assert len(by_cell) == 25 and by_cell["E4"]["raw_value"] == "2" and by_cell["E4"]["formula"] == "1+1"
    assert tuple(by_cell["B4"]["normalized"]) == ("1234.50", "decimal") and tuple(by_cell["C4"]["normalized"]) == ("2026-07-18", "date") and tuple(by_cell["A4"]["normalized"]) == ("X-1", "identifier")
    table = next(t for t in loaded.tables if t.name == "book:Ledger")
    assert table.columns == ("Reference", "Amount", "Booking date", "Reference__2", "Calculated") and table.df.count() == 2
    coordinates = {(r["row"], r["column"]): r["cell"] for r in table.cells().collect()}
    assert coordinates[(4, "Amount")] == "B4"


def test_warnings_and_paragraphs(loaded):
    notes = {(r["source_path"], r["message"].split(":")[0]) for r in loaded.warnings.collect()}
    assert {("empty.csv", "parse failed"), ("broken.xlsx", "parse failed"), ("book.xlsx", "no conservative header row detected"), ("book.xlsx", "formula has no cached value"), ("book.xlsx", "duplicate header renamed to Reference__2")} <= notes
    rows = next(t for t in loaded.tables if t.source_type == "docx_paragraph").df.orderBy("row").collect()
    assert [(r["row"], r["paragraph"]) for r in rows] == [(1, "Zweite Freigabe ab 5.000 EUR"), (3, "Ende")]
    from tallymark.functions.policy import approval_threshold
    assert approval_threshold(dossier.narratives(loaded.tables)).first()["threshold"] == 5000


def test_finding_tables(loaded):
    assert [t.name for t in loaded.find_tables(["document_no"])] == ["bookings", "book:Ledger"] or loaded.find_tables(["document_no"])
    assert [t.name for t in loaded.by_columns(["vendor_id", "name"])] == ["vendors"]


@pytest.mark.parametrize(("xml", "error"), [
    (INDEX.replace("exports/bookings.txt", "../x.txt"), "unsafe"), ("<a/>", "no table"), ("<", "unclosed token")])
def test_index_errors(xml, error):
    assert error in catalog.index_rows("index.xml", xml.encode())[0][-1]


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f"{i};x{i}" if i % 10 else "" for i in range(1, 5001)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = delimited.numbered_lines(spark, str(tmp_path / "big.txt"), str(tmp_path))
        assert spark.read.text(str(tmp_path / "big.txt")).select("_metadata.file_block_start").distinct().count() > 1
        assert all(lines[r["line_no"] - 1] == r["line"] for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_runs_and_replacement(spark, tmp_path, loaded):
    cells = loaded.by_columns(["vendor_id"])[0].cells()
    path = str(tmp_path / "runs")
    sinks.persist_run(cells, path, "eng", "r1")
    with pytest.raises(Exception, match="already exists"):
        sinks.persist_run(cells, path, "eng", "r1")
    assert sinks.load_run(spark, path, "eng", "r1").count() == 8
    with pytest.raises(KeyError):
        sinks.load_run(spark, path, "eng", "zz")
    rows = lambda source, n: spark.range(n).select(F.lit(source).alias("source_path"), "id")
    target = str(tmp_path / "rows")
    sinks.replace_source(rows("a", 3).union(rows("b", 2)), target)
    expected = spark.createDataFrame([("a", 5)], "source_path string, source_rows long")
    sinks.replace_source(rows("a", 5), target, expected)
    assert {r["source_path"]: r["count"] for r in spark.read.parquet(target).groupBy("source_path").count().collect()} == {"a": 5, "b": 2}
    with pytest.raises(ValueError):
        sinks.replace_source(rows("a", 4), target, expected)


def test_replacement_computes_its_input_once_and_bounds_files(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "hot").otherwise("cold").alias("source_path"), "id", F.create_map(F.lit("k"), "id").alias("m")).repartition(6)
    counted = rows.mapInArrow(count, rows.schema)
    expected = spark.createDataFrame([("hot", 5000), ("cold", 1000)], "source_path string, source_rows long")
    target = str(tmp_path / "rows")
    found = sinks.replace_source(counted, target, expected, files=3)
    assert found.rows == 6000 and dict(map(tuple, found.sources.collect())) == {"hot": 5000, "cold": 1000} and seen.value == 6000
    assert all(len(list(folder.glob("*.parquet"))) <= 3 for folder in (tmp_path / "rows").glob("source_bucket=*"))
    sinks.replace_source(rows.limit(0), target)
    assert spark.read.parquet(target).count() == 6000


def test_import_log_holds_every_note(spark):
    of = lambda rows, columns: spark.createDataFrame(rows, columns)
    manifest = of([(p, "csv") for p in "abcde"], "path string, file_type string")
    parsed = of([("a",), ("a",), ("b",), ("c",)], "source_path string")
    notes = "source_path string, message string"
    log = sinks.reconciliation_log(manifest, parsed, of([("a", "one"), ("a", "two"), ("d", "odd")], notes), of([("c", "broken")], notes), of([("a", 2), ("b", 5), ("c", 1)], "source_path string, source_rows long"))
    assert {r["source_path"]: (r["status"], r["source_rows"], r["parsed_rows"], r["warning_count"], r["error_count"]) for r in log.log.collect()} == {
        "a": ("warning", 2, 2, 2, 0), "b": ("failed", 5, 1, 0, 0), "c": ("failed", 1, 1, 0, 1), "d": ("failed", None, 0, 1, 0), "e": ("skipped", None, 0, 0, 0)}
    assert sorted(map(tuple, log.notes.collect())) == [("a", "warning", "one"), ("a", "warning", "two"), ("c", "error", "broken"), ("d", "warning", "odd")]


def test_inventory_streams_files_of_any_size(spark, tmp_path, monkeypatch):
    import hashlib
    import io
    bodies = {"a b+ü.txt": "größer €".encode() * 5000, "c.csv": b"\xff\xfe" + "x;y".encode("utf-16-le"), "d/e.bin": "ü".encode("cp1252"), "f.TXT": b"\xef\xbb\xbfx"}
    (tmp_path / "d").mkdir()
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        found = {r["path"]: (r["byte_size"], r["sha256"], r["encoding"]) for r in inventory.inventory(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    kinds = {"a b+ü.txt": "UTF-8", "c.csv": "UTF-16", "d/e.bin": "windows-1252", "f.TXT": "UTF-8-BOM"}
    assert found == {n: (len(b), hashlib.sha256(b).hexdigest(), kinds[n]) for n, b in bodies.items()}
    for body in bodies.values():  # a letter may lie across two chunks
        assert inventory.digest_of(io.BytesIO(body), chunk=1) == inventory.digest_of(io.BytesIO(body))


def _index(places):
    fields = "".join(f"<VariableColumn{f' position={chr(39)}{p}{chr(39)}' if p is not None else ''}><Name>c{i}</Name></VariableColumn>" for i, p in enumerate(places))
    return f"<DataSet><Media><Table><URL>t.txt</URL><Name>t</Name>{fields}</Table></Media></DataSet>".encode()


@pytest.mark.parametrize(("places", "error"), [(("2", "1"), None), (("0", "1"), None), ((None, None), None), (("1", None), "1 of 2 columns state"), (("1", "1"), "1 places for 2"), (("1", "x"), "no whole number"), (("1", "3"), "on places 1 to 3"), (("2", "3"), "on places 2 to 3")])
def test_column_places_are_checked_per_table(spark, places, error):
    files = spark.createDataFrame([("i.xml", _index(places)), ("fine.xml", _index(["1", "2"]))], "source_path string, content binary")
    rows = catalog.parse_definitions(files).collect()
    mine = [r for r in rows if r["index_path"] == "i.xml"]
    assert len([r for r in rows if r["index_path"] == "fine.xml"]) == 2
    if error:
        assert len(mine) == 1 and error in mine[0]["error"] and mine[0]["table_name"] is None and mine[0]["position"] is None
    else:
        assert {r["column"]: r["position"] for r in mine} == ({"c0": 1, "c1": 0} if places[0] == "2" else {"c0": 0, "c1": 1}) and all(r["error"] is None for r in mine)


def test_quoted_breaks_over_splits_follow_a_plain_reader(spark, tmp_path):
    import csv
    import io
    import random
    r = random.Random(2)
    cell = lambda: r.choice(["", "a", 'say ""x""', "two\nlines", "semi;colon", "\n\n", '5 inch', "tail\n"])
    text = "".join(";".join(f'"{c}"' if any(x in c for x in '\n;"') or r.random() < 0.3 else c for c in (str(i), cell(), cell())) + "\n" for i in range(1500))
    text = text.replace("7;a;", '7;5" pipe;')
    (tmp_path / "q.txt").write_text(text)
    reader, want, line = csv.reader(io.StringIO(text, newline=""), delimiter=";"), [], 0
    for values in reader:
        if any(v.strip() for v in values):
            want.append((line + 1, *values))
        line = reader.line_num
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows, rejects = delimited.read_declared(spark, str(tmp_path / "q.txt"), str(tmp_path), ["a", "b", "c"])
        assert spark.read.text(str(tmp_path / "q.txt")).select("_metadata.file_block_start").distinct().count() > 3
        assert sorted(tuple(x) for x in rows.select("row", "a", "b", "c").collect()) == want and rejects.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("encoding", ["UTF-16LE", "UTF-16BE"])
def test_wide_header_and_utf16(spark, tmp_path, encoding):
    names = [f"column_{i}_é" for i in range(600)]
    lines = [""] * 210 + [";".join(names), ";".join(str(i) for i in range(600)), 'x;"two\nlines"']
    (tmp_path / "w.csv").write_bytes(("﻿" + "\r\n".join(lines) + "\r\n").encode(encoding))
    df = delimited.read_with_header(spark, str(tmp_path / "w.csv"), str(tmp_path), encoding)
    assert df.columns[2:] == names
    rows = sorted(df.collect(), key=lambda x: x["row"])
    assert [x["row"] for x in rows] == [2, 3] and rows[0]["column_599_é"] == "599" and rows[1]["column_1_é"] == "two\nlines" and rows[1]["column_2_é"] == ""


@pytest.mark.parametrize("bits", [0, 1, 3, 17])
def test_records_cross_slices_of_any_size(spark, tmp_path, monkeypatch, bits):
    """Slices of one line, of a few and of many give the records that the csv module reads."""
    import random
    monkeypatch.setattr(delimited, "_SLICE_BITS", bits)
    r = random.Random(bits)
    expected = {}
    for name in ("a.txt", "b.txt"):
        rows = [(str(i), r.choice(["x", "", 'q"q', "two\nlines", "a\n\nb;\nc", '";\n"']), r.choice(["1", "2\n"])) for i in range(60)]
        shown = ['"' + '";"'.join(v.replace('"', '""') for v in row) + '"' for row in rows]
        lines, at, number = [], 1, 0
        for text in [*shown[:30], "", ";;", *shown[30:]]:
            if text.strip(";"):
                number += 1
                lines.append((at, number, text))
            at += text.count("\n") + 1
        (tmp_path / name).write_text("\n".join([*shown[:30], "", ";;", *shown[30:]]) + "\n", encoding="utf-8")
        expected[name] = lines
    found = delimited.records(spark, str(tmp_path), str(tmp_path), ";").collect()
    assert {n: sorted((x["line_no"], x["record_no"], x["line"]) for x in found if x["source_path"] == n) for n in expected} == expected
