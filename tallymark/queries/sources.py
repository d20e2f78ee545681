"""Scan, parse and sink steps over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.bindings import CENTS, with_views
from tallymark.queries import registry
from tallymark.session import shared_folder
from tallymark.sources import catalog, delimited, dossier, inventory, sinks, workbook

query = registry.query


@query("src_01_inventory", """SELECT key, 'text' AS file_type, strlen(body) AS byte_size, sha256(body) AS sha256, 'UTF-8' AS encoding FROM (
    SELECT CAST(o_custkey % 50 AS INTEGER) AS key, string_agg(o_orderkey || ';ü;' || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS body FROM orders GROUP BY 1)""")
def _(t):
    """A written folder, one file per key."""
    folder = shared_folder(t.spark)
    rows = t.orders.select((F.col("o_custkey") % 50).alias("key"), "o_orderkey", F.concat_ws(";", F.col("o_orderkey").cast("string"), F.lit("ü"), "o_orderpriority").alias("value"))
    rows.repartition("key").sortWithinPartitions("key", "o_orderkey").select("key", "value").write.partitionBy("key").text(folder)
    return inventory.inventory(t.spark, folder).select(F.regexp_extract("path", "key=([0-9]+)/", 1).cast("int").alias("key"), "file_type", "byte_size", "sha256", "encoding")


@query("src_02_file_type", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'text' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'docx' WHEN 4 THEN 'pdf' ELSE 'unknown' END AS file_type FROM pages""")
def _(t):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".TXT", ".XlsX", ".docx", ".PDF", ".tar.gz")]), (F.col("page_id") % 6 + 1).cast("int"))
    return t.pages.select("page_id", inventory.file_type(F.concat("url", F.lit("/v1.2/file"), suffix)).alias("file_type"))


@query("src_03_table_definitions", """SELECT 'S' || s_suppkey || '/index.xml' AS index_path, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_name END AS table_name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'data/' || s_suppkey || '.txt' END AS source_path,
    CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE p END::INTEGER AS position, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN p = 0 THEN 'Beleg' WHEN p = 1 THEN 'Betrag' ELSE 'Text' END AS "column", s_suppkey % 10 = 0 AS failed
    FROM supplier, (VALUES (0), (1), (2)) v(p) WHERE s_suppkey % 10 <> 0 OR p = 0""")
def _(t):
    path = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("../"), "s_suppkey")).otherwise(F.concat(F.lit("data/"), "s_suppkey", F.lit(".txt")))
    xml = F.concat(F.lit("<DataSet><Media><Table><URL>"), path, F.lit("</URL><Name>"), "s_name", F.lit("</Name><VariableColumn position='2'><Name>Betrag</Name></VariableColumn><VariableColumn position='1'><Name>Beleg</Name></VariableColumn>"
                   "<VariableColumn position='3'><Name>Text</Name></VariableColumn></Table></Media></DataSet>"))
    files = t.supplier.select(F.concat(F.lit("S"), "s_suppkey", F.lit("/index.xml")).alias("source_path"), F.encode(xml, "UTF-8").alias("content"))
    return catalog.parse_definitions(files).select("index_path", "table_name", "source_path", "position", "column", F.col("error").isNotNull().alias("failed"))


@query("agg_19_catalog_conflicts", "SELECT 'n' || n_regionkey AS index_path, 'd.txt' AS source_path FROM nation GROUP BY n_regionkey HAVING min(n_nationkey % 2) <> max(n_nationkey % 2)")
def _(t):
    definitions = t.nation.select(F.concat(F.lit("n"), "n_regionkey").alias("index_path"), F.col("n_nationkey").alias("table_no"), F.lit("d.txt").alias("source_path"), F.lit(0).alias("position"),
                                  F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B").alias("column"), F.lit(None).cast("string").alias("error"))
    return catalog.catalog_conflicts(definitions)


def _lines(t):
    fields = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit(';x"')), F.col("o_totalprice").cast(CENTS).cast("string"))
    line = F.when(F.col("o_orderkey") % 100 == 0, F.concat(fields, F.lit(";extra"))).when(F.col("o_orderkey") % 100 == 1, F.col("o_orderkey").cast("string")).otherwise(fields)
    return t.orders.select(F.lit("orders.txt").alias("source_path"), (F.col("o_orderkey") + 1).alias("line_no"), line.alias("line"))


@query("src_04_declared_rows", "SELECT o_orderkey + 1 AS row, CAST(o_orderkey AS VARCHAR) AS beleg, o_orderpriority || ';x' AS text, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS betrag FROM orders WHERE o_orderkey % 100 NOT IN (0, 1)")
def _(t):
    return delimited.split_fields(_lines(t), ["beleg", "text", "betrag"], ";")[0].select("row", "beleg", "text", "betrag")


@query("src_04_rejected_rows", "SELECT o_orderkey + 1 AS row FROM orders WHERE o_orderkey % 100 IN (0, 1)")
def _(t):
    return delimited.split_fields(_lines(t), ["beleg", "text", "betrag"], ";")[1].select("row")


@query("src_05_header_rows", "SELECT o_orderkey + 1 AS row, CAST(o_orderkey AS VARCHAR) AS beleg, CASE WHEN o_orderkey % 100 = 1 THEN '' ELSE o_orderpriority || ';x' END AS text, CASE WHEN o_orderkey % 100 = 1 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS betrag FROM orders")
def _(t):
    return delimited.pad_fields(_lines(t), ["beleg", "text", "betrag"], ";").select("row", "beleg", "text", "betrag")


_QUOTED = """SELECT CAST(o_orderkey AS VARCHAR) AS beleg, o_orderpriority || chr(10) || '"x"; ' || o_orderstatus AS text, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS betrag FROM orders"""


def _written(t, header: bool) -> str:
    """Delimited files of all orders with quoted line breaks and quotes, in the shared folder."""
    field = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat("o_orderpriority", F.lit('\n"x"; '), "o_orderstatus")
    folder = shared_folder(t.spark)
    rows = t.orders.select(F.concat_ws(";", F.col("o_orderkey").cast("string"), field(text), F.col("o_totalprice").cast(CENTS).cast("string")).alias("value"))
    if header:  # one file whose first record is the header, which also holds a line break
        rows = t.spark.range(1).select(F.lit('Beleg;"Langer\nText";Betrag').alias("value")).unionByName(rows).coalesce(1)
    rows.write.text(folder)
    return folder


@query("src_04_quoted_scan", f"SELECT beleg, text, betrag FROM ({_QUOTED})")
def _(t):
    folder = _written(t, header=False)
    return delimited.read_declared(t.spark, folder, folder, ["beleg", "text", "betrag"])[0].select("beleg", "text", "betrag")


@query("src_05_quoted_scan", f"SELECT beleg, text, betrag FROM ({_QUOTED})")
def _(t):
    folder = _written(t, header=True)
    found = delimited.read_with_header(t.spark, folder, folder)
    return found.select(F.col("Beleg").alias("beleg"), F.col("`Langer\nText`").alias("text"), F.col("Betrag").alias("betrag"))


def _cells(t):
    """Sheets of orders: a title, a header with a blank and a repeat, then the records."""
    sheet = (F.col("o_orderkey") % 40).cast("string").alias("sheet")
    at = lambda df, row, col, raw, kind: df.select(F.lit("book.xlsx").alias("source_path"), "sheet", row.cast("int").alias("row"), F.lit(col).alias("col"), raw.cast("string").alias("raw_value"), kind.alias("value_type"))
    sheets = t.orders.select(sheet).distinct()
    text, empty, none = F.lit("s"), F.lit("empty"), F.lit("")
    parts = [at(sheets, F.lit(1), 1, F.lit("Ledger"), text), *[at(sheets, F.lit(1), c, none, empty) for c in (2, 3, 4)]]
    parts += [at(sheets, F.lit(2), c, F.lit(name), text if name else empty) for c, name in ((1, "Code"), (2, ""), (3, "Code"), (4, " Amount "))]
    rows = t.orders.select(sheet, (F.floor(F.col("o_orderkey") / 40) + 3).alias("r"), "*")
    parts += [at(rows, F.col("r"), 1, F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")), text), at(rows, F.col("r"), 2, none, empty),
              at(rows, F.col("r"), 3, F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus")), text), at(rows, F.col("r"), 4, F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_totalprice").cast(CENTS).cast("string")), F.lit("n"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("normalized", workbook.normalize_cell(F.col("value_type"), F.col("raw_value")))


@query("agg_20_header_row", "SELECT CAST(o_orderkey % 40 AS VARCHAR) AS sheet, 2 AS header_row FROM orders GROUP BY 1")
def _(t):
    return workbook.detect_headers(_cells(t)).select("sheet", "header_row")


@query("agg_21_header_names", "SELECT CAST(o_orderkey % 40 AS VARCHAR) AS sheet, c AS col, CASE c WHEN 1 THEN 'Code' WHEN 2 THEN 'column_B' WHEN 3 THEN 'Code__2' ELSE 'Amount' END AS header, c IN (2, 3) AS warned FROM orders, (VALUES (1), (2), (3), (4)) v(c) GROUP BY ALL")
def _(t):
    cells = _cells(t)
    return workbook.header_names(cells, workbook.detect_headers(cells)).select("sheet", "col", "header", F.col("warning").isNotNull().alias("warned"))


@query("agg_22_records", "SELECT CAST(o_orderkey % 40 AS VARCHAR) AS sheet, CAST(o_orderkey // 40 + 3 AS INTEGER) AS row, o_orderpriority AS code, o_orderstatus AS second, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders WHERE o_orderkey % 7 <> 0")
def _(t):
    cells = _cells(t)
    rows = workbook.records(cells, workbook.header_names(cells, workbook.detect_headers(cells)))
    return rows.select("sheet", "row", F.col("normalized")["Code"].alias("code"), F.col("raw")["Code__2"].alias("second"), F.col("normalized")["Amount"].alias("amount"))


@query("src_08_passages", """SELECT url AS source_path, page_id AS page, left(trim(html), 200) AS passage, sha256(trim(html)) AS raw_value_sha256, 'ev_' || substr(sha256(url || '|rNone|sNone|cNone|p' || page_id || '|' || trim(html)), 1, 16) AS evidence_id FROM pages WHERE trim(html) <> ''""")
def _(t):
    return dossier.passages(t.pages, "url", "page_id", "html").select("source_path", "page", "passage", "raw_value_sha256", "evidence_id")


@query("src_09_role_tables", with_views("ledger", tail="SELECT 'ledger' AS table_name, count(*) AS cells, count(DISTINCT evidence_id) > 0 AS cited FROM ledger"))
def _(t):
    """Long cells of one column of the ledger with their coordinates."""
    rows = t.ledger.select(F.lit("ledger.csv").alias("source_path"), F.col("document_no").cast("long").alias("row"), F.col("amount").cast("string").alias("Betrag"))
    cells = dossier.SourceTable("ledger", "csv_row", ("Betrag",), rows).cells()
    return cells.groupBy("table_name").agg(F.count(F.lit(1)).alias("cells"), (F.count("evidence_uuid") > 0).alias("cited"))


@query("src_10_encoding", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-8-BOM' ELSE 'windows-1252' END AS encoding FROM documents""")
def _(t):
    body, k = F.encode("text", "UTF-8"), F.col("doc_id") % 3
    content = F.when(k == 0, body).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), body)).otherwise(F.concat(F.unhex(F.lit("E4F6FC20")), body))
    return t.documents.select("doc_id", inventory.detected_encoding(content).alias("encoding"))


@query("snk_03_upsert", "SELECT user_id, arg_max(event_type, (ts, event_type, value)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def _(t):
    rows = t.events.select("user_id", "ts", "event_type", "value")
    return sinks.upsert(rows.where("value < 100"), rows.where("value >= 100"), ["user_id"], "ts").select("user_id", "event_type", "ts")


@query("snk_04_replace_source", """SELECT source AS source_path, count(*) AS rows, CAST(sum(CASE WHEN source = 'src1' THEN -doc_id ELSE doc_id END) AS BIGINT) AS ids FROM documents WHERE source <> 'src1' OR doc_id % 3 = 0 GROUP BY 1""")
def _(t):
    """All sources are written, then one is replaced by other rows; the others stay."""
    path = f"{shared_folder(t.spark)}/rows"
    rows = t.documents.select(F.col("source").alias("source_path"), "doc_id")
    sinks.replace_source(rows, path)
    newer = rows.where("source_path = 'src1' AND doc_id % 3 = 0").withColumn("doc_id", -F.col("doc_id"))
    sinks.replace_source(newer, path, newer.groupBy("source_path").agg(F.count(F.lit(1)).alias("source_rows")))
    return t.spark.read.parquet(path).groupBy("source_path").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"))


def _import_log(t):
    """Documents as sources: texts without a word fail, very short ones are warned about, one source lost rows."""
    manifest = t.documents.select(F.col("source").alias("path"), F.lit("text").alias("file_type")).distinct()
    rows = t.documents.select(F.col("source").alias("source_path"), "doc_id", "n_chars")
    note = lambda some, text: some.select("source_path", F.concat(F.lit(text), "doc_id").alias("message"))
    parsed = rows.where("source_path <> 'src3' OR doc_id % 10 <> 0")
    total = rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("source_rows"))
    return sinks.reconciliation_log(manifest, parsed, note(rows.where("n_chars < 300"), "short "), note(rows.where("n_chars < 10"), "empty "), total)


@query("snk_06_reconciliation_log", """SELECT *, CASE WHEN error_count > 0 OR source_rows <> parsed_rows THEN 'failed' WHEN warning_count > 0 THEN 'warning' ELSE 'parsed' END AS status FROM (
    SELECT source AS source_path, count(*) AS source_rows, count(*) FILTER (WHERE source <> 'src3' OR doc_id % 10 <> 0) AS parsed_rows, count(*) FILTER (WHERE n_chars < 300) AS warning_count, count(*) FILTER (WHERE n_chars < 10) AS error_count FROM documents GROUP BY 1)""")
def _(t):
    return _import_log(t).log.drop("file_type")


@query("snk_06_import_notes", """SELECT source AS source_path, 'warning' AS kind, 'short ' || doc_id AS message FROM documents WHERE n_chars < 300 UNION ALL SELECT source, 'error', 'empty ' || doc_id FROM documents WHERE n_chars < 10""")
def _(t):
    return _import_log(t).notes


@query("srt_01_tables_by_rows", """SELECT table_name, rows, row_number() OVER (ORDER BY rows DESC, ordinal) AS place FROM (SELECT 'orders' AS table_name, 0 AS ordinal, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 'lineitem', 1, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'part', 2, (SELECT count(*) FROM part))""")
def _(t):
    spark = t.spark
    tables = tuple(dossier.SourceTable(n, "csv_row", ("amount",), getattr(t, n)) for n in ("orders", "lineitem", "part"))
    found = dossier.Dossier(t.region, tables, t.region).find_tables(["amount"])
    places = spark.createDataFrame([(table.name, i + 1) for i, table in enumerate(found)], "table_name string, place long")
    from tallymark.operators.aggregates import table_summary
    return table_summary({x.name: x.df for x in found}).join(places, "table_name").select("table_name", "rows", "place")
