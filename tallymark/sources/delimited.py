"""Delimited text as string columns with exact physical line numbers."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.identity import raw_hash
from tallymark.session import materialize
from tallymark.sources.inventory import relative_path

#: A slice is what of an input split shares the places above these bits: at most 2^17 lines.
_SLICE_BITS = 17
_CORRUPT = "_corrupt"


def _lines(spark: SparkSession, paths: str | Sequence[str], encoding: str) -> DataFrame:
    """Physical lines with their file, input split, slice of it and place; any byte-order mark and carriage return are off."""
    reader, name = spark.read, encoding.upper().replace("_", "-")
    if name.startswith("UTF-16"):
        name = "UTF-16BE" if name.endswith("BE") else "UTF-16LE"
        reader = reader.option("encoding", name).option("lineSep", "\n")  # cuts at the two bytes of a line feed
    raw = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    # The reader keeps raw bytes, so other encodings are decoded afterwards.
    line = F.col("value") if name.startswith("UTF-8") else F.decode(F.col("value").cast("binary"), name)
    return raw.withColumns({"line": F.regexp_replace(line, "^\\uFEFF|\\r$", ""), "_slice": F.shiftright("_at", _SLICE_BITS)}).drop("value")


def _numbered(lines: DataFrame, name: str) -> DataFrame:
    """Number rows per file in order: counted per slice, with a prefix sum over the slices."""
    key = ["_file", "_start", "_slice"]
    counts = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key).orderBy("_at")
    return lines.withColumn("_index", F.row_number().over(inside)).join(offsets, key).withColumn(
        name, (F.col("_before") + F.col("_index")).cast("long")).drop("_before", "_index")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], root: str, encoding: str = "UTF-8", drop_blank: str | None = None) -> DataFrame:
    """(source_path, line_no, line) without sorting a file in one task.

    ``drop_blank`` is a delimiter: lines without any text between delimiters are then dropped before
    numbering.
    """
    lines = _lines(spark, paths, encoding)
    if drop_blank is not None:
        lines = lines.where(_has_text(drop_blank))
    return _numbered(lines, "line_no").select(relative_path(F.col("_file"), root).alias("source_path"), "line_no", "line")


def _has_text(delimiter: str) -> Column:
    return F.regexp_replace("line", f'[\\s"{delimiter}]', "") != ""


def _left_open(delimiter: str, begins_open: bool) -> Column:
    """Whether a quoted field is still open where the line ends. A quote opens a field only at the
    field's start; inside, two quotes are one."""
    outside, opened, closed, first = (F.lit(n) for n in (0, 1, 2, 3))
    pieces = F.split("line", '"')

    def at_quote(state: Column, before: Column) -> Column:
        starts = F.endswith(before, F.lit(delimiter))
        again = (before == "") & ((state == closed) | (state == first))
        return F.when(state == opened, closed).when(starts | again, opened).otherwise(outside)

    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), opened if begins_open else first, at_quote) == opened


def records(spark: SparkSession, paths: str | Sequence[str], root: str, delimiter: str, encoding: str = "UTF-8") -> DataFrame:
    """(source_path, line_no, record_no, line): lines joined where a quoted field holds a line break.

    ``line_no`` is the record's first physical line; ``record_no`` counts records with any text. What
    a line does to "a quoted field is open" is one of four functions (set, clear, keep, switch). They
    are composed along each slice of an input split, then over the slices of a file, so neither a file nor a split is
    one task's work. Lines are moved once, to their slices; after that only records that cross slices are gathered.
    """
    key = ["_f", "_start", "_slice"]
    inside, file = Window.partitionBy(*key).orderBy("_at"), Window.partitionBy("_f").orderBy("_start", "_slice")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    here, earlier = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    raw = _lines(spark, paths, encoding).withColumn("_f", F.xxhash64("_file"))  # paths are long, so lines carry their hash
    names = materialize(raw.select("_f", "_file").distinct())
    fixed, switch = F.col("_out") == F.col("_in"), F.col("_out") & ~F.col("_in")
    odd = lambda n: n % 2 == 1
    # So far in its slice: 2 if the state is known, plus the state or whether it was switched.
    known, value = lambda c: F.col(c) >= 2, lambda c: odd(F.col(c))
    turned = (
        raw.select(*key, "_at", "line", _left_open(delimiter, False).alias("_out"), _left_open(delimiter, True).alias("_in"))
        .withColumn("_turns", F.sum(switch.cast("long")).over(upto))
        .withColumn("_set", F.last(F.when(fixed, F.struct(F.col("_out").alias("open"), F.col("_turns").alias("turns"))), ignorenulls=True).over(upto))
    )
    so_far = F.coalesce(F.col("_set.open") != odd(F.col("_turns") - F.col("_set.turns")), odd(F.col("_turns"))).cast("int")
    turned = turned.withColumn("_does", F.when(F.col("_set").isNotNull(), 2).otherwise(0) + so_far)
    turned = materialize(turned.select(*key, "_at", "line", F.row_number().over(inside).alias("_index"), "_does", F.lag("_does").over(inside).alias("_prior")))

    whole = turned.groupBy(*key).agg(F.max_by("_does", "_at").alias("d"), F.max("_index").alias("n"))
    parity = whole.withColumn("t", F.sum((~known("d") & value("d")).cast("long")).over(here))
    begins = parity.withColumns({
        "s": F.last(F.when(known("d"), F.struct(value("d").alias("open"), F.col("t").alias("turns"))), ignorenulls=True).over(earlier),
        "before": F.coalesce(F.max("t").over(earlier), F.lit(0)), "_lines": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    begins = materialize(begins.select(*key, "_lines", F.coalesce(F.col("s.open") != odd(F.col("before") - F.col("s.turns")), odd(F.col("before"))).alias("_begins")))
    state = lambda c: F.when(known(c), value(c)).otherwise(F.col("_begins") != value(c))
    placed = turned.join(F.broadcast(begins), key).withColumns({
        "_continues": F.when(F.col("_prior").isNull(), F.col("_begins")).otherwise(state("_prior")), "_open": state("_does"), "line_no": (F.col("_lines") + F.col("_index")).cast("long")})
    placed = placed.withColumn("_head", F.last(F.when(~F.col("_continues"), F.col("_at")), ignorenulls=True).over(upto))
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("line")
    # A piece without a head began in an earlier slice, one that is left open may go on in a later one.
    pieces = materialize(placed.groupBy(*key, "_head").agg(F.min("_at").alias("_at"), F.min("line_no").alias("line_no"), F.max_by("_open", "_at").alias("_open"), text(["_index"])))

    complete = F.col("_head").isNotNull() & ~F.col("_open")
    owner = F.last(F.when(F.col("_head").isNotNull(), F.struct("_start", "_slice", "_at", "line_no")), ignorenulls=True).over(
        Window.partitionBy("_f").orderBy("_start", "_slice", "_at").rowsBetween(Window.unboundedPreceding, 0))
    crossing = pieces.where(~complete).withColumn("_owner", owner).groupBy("_f", "_owner").agg(text(["_start", "_slice", "_at"]))
    crossing = materialize(crossing.select("_f", "_owner.*", "line").where(_has_text(delimiter)))
    inner = pieces.where(complete & _has_text(delimiter))
    counts = inner.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(crossing.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = counts.groupBy(*key).agg(F.sum("a").alias("_inner"), F.sum("b").alias("b"))
    offsets = materialize(counts.select(*key, "_inner", F.coalesce(F.sum(F.col("_inner") + F.col("b")).over(earlier), F.lit(0)).alias("_before")))
    # A record that goes on in the next slice is the last of its own.
    parts = [df.join(F.broadcast(offsets), key).select("_f", "line_no", (F.col("_before") + at).cast("long").alias("record_no"), "line")
             for df, at in ((inner.withColumn("_index", F.row_number().over(inside)), F.col("_index")), (crossing, F.col("_inner") + 1))]
    return parts[0].unionByName(parts[1]).join(F.broadcast(names), "_f").select(relative_path(F.col("_file"), root).alias("source_path"), "line_no", "record_no", "line")


def _parsed(lines: DataFrame, columns: Sequence[str], delimiter: str) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))] + [T.StructField(_CORRUPT, T.StringType())])
    options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "quote": '"', "escape": '"',
               "nullValue": "\u0000", "emptyValue": "", "maxCharsPerColumn": "-1", "maxColumns": "100000"}
    return lines.withColumn("_row", F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), options))


def split_fields(lines: DataFrame, columns: Sequence[str], delimiter: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of (source_path, line_no, line) under a column list; a line with another number
    of fields is rejected with its text and line number."""
    parsed = _parsed(lines, columns, delimiter)
    bad = F.col(f"_row.{_CORRUPT}").isNotNull()
    rows = parsed.where(~bad).select(
        "source_path", F.col("line_no").alias("row"), F.col("line").alias("raw_row"), raw_hash(F.col("line")).alias("raw_row_sha256"),
        *[F.coalesce(F.col(f"_row.c{i}"), F.lit("")).alias(c) for i, c in enumerate(columns)])
    return rows, parsed.where(bad).select("source_path", F.col("line_no").alias("row"), F.col("line").alias("raw_row"))


def read_declared(spark: SparkSession, paths: str | Sequence[str], root: str, columns: Sequence[str], delimiter: str = ";",
                  encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files without header under a declared column list."""
    return split_fields(records(spark, paths, root, delimiter, encoding).drop("record_no"), columns, delimiter)


def pad_fields(lines: DataFrame, header: Sequence[str], delimiter: str) -> DataFrame:
    """Rows under a header: short lines are padded with empty text, long lines cut."""
    parsed = _parsed(lines, header, delimiter)
    return parsed.select("source_path", F.col("line_no").alias("row"), *[F.coalesce(F.col(f"_row.c{i}"), F.lit("")).alias(c) for i, c in enumerate(header)])


def sniff_delimiter(head: str) -> str:
    sample = head[:4096]
    return ";" if sample.count(";") >= sample.count(",") else ","


def read_with_header(spark: SparkSession, path: str, root: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV whose first record with text is the header. Blank records are dropped before numbering;
    short rows are padded with empty text and long rows cut. Only the header record and the head that
    shows the delimiter reach the driver."""
    head = _lines(spark, path, encoding).limit(200).select(F.left("line", F.lit(4096)).alias("line")).collect()
    delimiter = sniff_delimiter("\n".join(r["line"] for r in head))
    rows = records(spark, path, root, delimiter, encoding)
    first = rows.where("record_no = 1").select("line").first()
    if first is None:
        raise ValueError(f"empty CSV: {path}")
    header = [h.strip() for h in next(csv.reader(io.StringIO(first["line"], newline=""), delimiter=delimiter))]
    return pad_fields(rows.where("record_no > 1").drop("line_no").withColumnRenamed("record_no", "line_no"), header, delimiter)
