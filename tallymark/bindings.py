"""Bind the given tables to audit roles.

Every view is written twice: as a DataFrame select and as the SQL the oracle runs, so that both
sides read the same roles. Money is cast to cents before any arithmetic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CENTS = "DECIMAL(18,2)"

SQL = {
    "ledger": """SELECT CAST(l_suppkey AS VARCHAR) AS account, CAST(l_orderkey AS VARCHAR) AS document_no,
        CAST(l_shipdate AS DATE) AS posting_date,
        CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
        CASE WHEN l_linestatus = 'F' THEN 'Zahlung' ELSE 'Rechnung' END AS posting_kind,
        CASE WHEN l_linenumber = 7 THEN 'Saldenvortrag Vorjahr' WHEN l_linenumber = 6 THEN 'Storno Rechnung'
             WHEN l_linenumber = 5 THEN 'Gutschrift Lieferant' WHEN l_linenumber = 4 THEN 'Teilzahlung Rate'
             ELSE 'Rechnung Lieferant' END AS posting_text,
        CAST(l_suppkey AS VARCHAR) AS payment_reference, CAST(l_partkey AS VARCHAR) AS part_no,
        'ev_' || substr(sha256('lineitem|r' || l_orderkey || '|sNone|c' || l_linenumber || '|pNone|'
             || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)), 1, 16) AS evidence_id
        FROM lineitem""",
    "payments": """SELECT CAST(event_id AS VARCHAR) AS payment_id, CAST(user_id AS VARCHAR) AS payee, CAST(ts AS DATE) AS payment_date,
        CAST(value AS DECIMAL(18,2)) AS amount FROM events WHERE event_type = 'purchase'""",
    "order_payments": """SELECT CAST(o_orderkey AS VARCHAR) AS payment_id, CAST(o_custkey AS VARCHAR) AS payee,
        CAST(o_orderdate AS DATE) AS payment_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders""",
    "masters": """SELECT CAST(user_id AS VARCHAR) AS account, 'Neuanlage' AS change_type,
        CASE WHEN event_id % 5 = 0 THEN 'Kundenstamm' ELSE 'Kreditor' END AS field_changed,
        'U' || (user_id % 7) AS changed_by, 'U' || (event_id % 7) AS approved_by, CAST(ts AS DATE) AS posting_date,
        'ev_' || substr(sha256('events|r' || event_id || '|sNone|cNone|pNone|' || user_id), 1, 16) AS evidence_id
        FROM events WHERE event_type = 'signup'""",
    "receipts": """SELECT CAST(user_id AS VARCHAR) AS vendor, CAST(event_id AS VARCHAR) AS goods_receipt_no,
        'ev_' || substr(sha256('events|r' || event_id || '|sNone|cNone|pNone|' || user_id), 1, 16) AS evidence_id
        FROM events WHERE event_type = 'view' AND user_id % 3 = 0""",
    "rights": """SELECT 'U' || (n_nationkey % 7) AS benutzer, n_name AS mitarbeiter,
        CASE WHEN n_regionkey < 2 THEN 'x' ELSE '' END AS stammdaten_anlegen,
        CASE WHEN n_regionkey <> 2 THEN 'x' ELSE '' END AS journal_buchen,
        CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END AS zahlungslauf FROM nation""",
    "cutoff_lines": """SELECT CAST(o_orderdate AS DATE) AS service_date, CAST(l_shipdate AS DATE) AS invoice_date,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_orderkey AS VARCHAR) AS document_no,
        'ev_' || substr(sha256('lineitem|r' || l_orderkey || '|sNone|c' || l_linenumber || '|pNone|'
             || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)), 1, 16) AS evidence_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "additions": """SELECT CAST(l_partkey AS VARCHAR) AS asset_no, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
        CASE WHEN l_linestatus = 'F' THEN 'Zugang' ELSE 'Abgang' END AS posting_kind,
        CAST(l_suppkey % 5 AS VARCHAR) AS asset_group, '' AS posting_text,
        'ev_' || substr(sha256('lineitem|r' || l_orderkey || '|sNone|c' || l_linenumber || '|pNone|'
             || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)), 1, 16) AS evidence_id
        FROM lineitem""",
    "descriptions": "SELECT CAST(p_partkey AS VARCHAR) AS asset_no, p_name AS asset_desc, 0 AS table_no, p_partkey AS row_no FROM part",
    "chart": "SELECT CAST(r_regionkey AS VARCHAR) AS account, CASE WHEN r_regionkey < 3 THEN 'Bilanzkonto' ELSE 'GuV' END AS account_type FROM region",
    "texts": "SELECT doc_id AS text_id, text FROM documents",
    "invoices": """SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(o_custkey AS VARCHAR) AS vendor_id,
        CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_amount FROM orders""",
    "deliveries": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_returnflag AS receipt_id, CAST(l_orderkey AS VARCHAR) AS invoice_id,
        CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'accepted' END AS status,
        CAST(max(l_shipdate) AS DATE) AS receipt_date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS net_amount
        FROM lineitem GROUP BY l_orderkey, l_returnflag""",
    "graph_edges": """SELECT DISTINCT 'c' || o_custkey AS src, 'placed' AS relationship, 'o' || o_orderkey AS dst FROM orders
        UNION SELECT DISTINCT 'o' || l_orderkey, 'supplied_by', 's' || l_suppkey FROM lineitem
        UNION SELECT DISTINCT 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier""",
}


def with_views(*names: str, tail: str) -> str:
    """A WITH clause over the named role views, then the query."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + tail


class Tables:
    """The given tables of one folder and their role views. Views are plain selects, so only the
    columns a query uses are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (
                "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                "embeddings", "pages", "benchmark", "labels", "conversations"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _line_id(self) -> F.Column:  # type: ignore[name-defined]
        from tallymark.functions.identity import registry_id
        return registry_id(F.lit("lineitem"), F.col("l_extendedprice").cast(CENTS), row=F.col("l_orderkey"), cell=F.col("l_linenumber"))

    @cached_property
    def _event_id(self) -> F.Column:  # type: ignore[name-defined]
        from tallymark.functions.identity import registry_id
        return registry_id(F.lit("events"), F.col("user_id"), row=F.col("event_id"))

    @property
    def ledger(self) -> DataFrame:
        line = F.col("l_linenumber")
        price = F.col("l_extendedprice")
        return self.lineitem.select(
            F.col("l_suppkey").cast("string").alias("account"), F.col("l_orderkey").cast("string").alias("document_no"),
            F.to_date("l_shipdate").alias("posting_date"),
            F.when(F.col("l_returnflag") == "R", -price).otherwise(price).cast(CENTS).alias("amount"),
            F.when(F.col("l_linestatus") == "F", "Zahlung").otherwise("Rechnung").alias("posting_kind"),
            F.when(line == 7, "Saldenvortrag Vorjahr").when(line == 6, "Storno Rechnung").when(line == 5, "Gutschrift Lieferant")
            .when(line == 4, "Teilzahlung Rate").otherwise("Rechnung Lieferant").alias("posting_text"),
            F.col("l_suppkey").cast("string").alias("payment_reference"), F.col("l_partkey").cast("string").alias("part_no"),
            self._line_id.alias("evidence_id"))

    @property
    def payments(self) -> DataFrame:
        return self.events.where("event_type = 'purchase'").select(
            F.col("event_id").cast("string").alias("payment_id"), F.col("user_id").cast("string").alias("payee"),
            F.to_date("ts").alias("payment_date"), F.col("value").cast(CENTS).alias("amount"))

    @property
    def order_payments(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("payment_id"), F.col("o_custkey").cast("string").alias("payee"),
            F.to_date("o_orderdate").alias("payment_date"), F.col("o_totalprice").cast(CENTS).alias("amount"))

    @property
    def masters(self) -> DataFrame:
        return self.events.where("event_type = 'signup'").select(
            F.col("user_id").cast("string").alias("account"), F.lit("Neuanlage").alias("change_type"),
            F.when(F.col("event_id") % 5 == 0, "Kundenstamm").otherwise("Kreditor").alias("field_changed"),
            F.concat(F.lit("U"), F.col("user_id") % 7).alias("changed_by"), F.concat(F.lit("U"), F.col("event_id") % 7).alias("approved_by"),
            F.to_date("ts").alias("posting_date"), self._event_id.alias("evidence_id"))

    @property
    def receipts(self) -> DataFrame:
        return self.events.where("event_type = 'view' and user_id % 3 = 0").select(
            F.col("user_id").cast("string").alias("vendor"), F.col("event_id").cast("string").alias("goods_receipt_no"), self._event_id.alias("evidence_id"))

    @property
    def rights(self) -> DataFrame:
        mark = lambda test: F.when(test, "x").otherwise("")
        return self.nation.select(
            F.concat(F.lit("U"), F.col("n_nationkey") % 7).alias("benutzer"), F.col("n_name").alias("mitarbeiter"),
            mark(F.col("n_regionkey") < 2).alias("stammdaten_anlegen"), mark(F.col("n_regionkey") != 2).alias("journal_buchen"),
            mark(F.col("n_nationkey") % 2 == 0).alias("zahlungslauf"))

    @property
    def toxic_users(self) -> DataFrame:
        from tallymark import vocabulary as V
        from tallymark.functions.roles import resolve_column
        from tallymark.operators.joins import toxic_rights, users_with_all_rights
        rights = self.rights
        found = toxic_rights(rights.columns, V.RIGHT_CREATE, V.RIGHT_POST, V.RIGHT_PAY)
        return users_with_all_rights(rights, resolve_column(rights.columns, "permission_user"), found)

    @property
    def cutoff_lines(self) -> DataFrame:
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.to_date("o_orderdate").alias("service_date"), F.to_date("l_shipdate").alias("invoice_date"),
            F.col("l_extendedprice").cast(CENTS).alias("amount"), F.col("l_orderkey").cast("string").alias("document_no"), self._line_id.alias("evidence_id"))

    @property
    def additions(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_partkey").cast("string").alias("asset_no"), F.col("l_extendedprice").cast(CENTS).alias("amount"),
            F.when(F.col("l_linestatus") == "F", "Zugang").otherwise("Abgang").alias("posting_kind"),
            (F.col("l_suppkey") % 5).cast("string").alias("asset_group"), F.lit("").alias("posting_text"), self._line_id.alias("evidence_id"))

    @property
    def descriptions(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").cast("string").alias("asset_no"), F.col("p_name").alias("asset_desc"),
                                F.lit(0).alias("table_no"), F.col("p_partkey").alias("row_no"))

    @property
    def chart(self) -> DataFrame:
        return self.region.select(F.col("r_regionkey").cast("string").alias("account"),
                                  F.when(F.col("r_regionkey") < 3, "Bilanzkonto").otherwise("GuV").alias("account_type"))

    @property
    def texts(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("text_id"), "text")

    @property
    def invoices(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("invoice_id"), F.col("o_custkey").cast("string").alias("vendor_id"),
            F.to_date("o_orderdate").alias("invoice_date"), F.col("o_totalprice").cast(CENTS).alias("net_amount"))

    @property
    def deliveries(self) -> DataFrame:
        return self.lineitem.groupBy("l_orderkey", "l_returnflag").agg(
            F.to_date(F.max("l_shipdate")).alias("receipt_date"), F.sum(F.col("l_extendedprice").cast(CENTS)).cast(CENTS).alias("net_amount")).select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag").alias("receipt_id"), F.col("l_orderkey").cast("string").alias("invoice_id"),
            F.when(F.col("l_returnflag") == "R", "returned").otherwise("accepted").alias("status"), "receipt_date", "net_amount")

    @property
    def graph_links(self) -> DataFrame:
        """The edges of the graph with repeats, for callers that drop them."""
        def edge(df: DataFrame, a: str, src: str, relation: str, b: str, dst: str) -> DataFrame:
            return df.select(F.concat(F.lit(a), F.col(src)).alias("src"), F.lit(relation).alias("relationship"), F.concat(F.lit(b), F.col(dst)).alias("dst"))

        return (edge(self.orders, "c", "o_custkey", "placed", "o", "o_orderkey")
                .unionByName(edge(self.lineitem, "o", "l_orderkey", "supplied_by", "s", "l_suppkey"))
                .unionByName(edge(self.supplier, "s", "s_suppkey", "located_in", "n", "s_nationkey")))

    @property
    def graph_edges(self) -> DataFrame:
        return self.graph_links.distinct()

    @property
    def graph_nodes(self) -> DataFrame:
        def node(df: DataFrame, prefix: str, key: str, kind: str) -> DataFrame:
            return df.select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("kind"))

        return (node(self.customer, "c", "c_custkey", "entity").unionByName(node(self.supplier, "s", "s_suppkey", "entity"))
                .unionByName(node(self.orders, "o", "o_orderkey", "financial_event")))
