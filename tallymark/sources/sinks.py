"""Sinks: runs, upserts, replacement of one source, reconciliation log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.checks import RejectedRecords
from tallymark.operators.ordering import latest_per_key
from tallymark.session import materialize, shared_folder

#: Files that a source's rows are spread over.
FILES = 8


def persist_run(cells: DataFrame, path: str, engagement_id: str, run_id: str) -> None:
    """Write one run into its own partition folder; a run id that exists is an error.

    The partition folder is the unit of the write, so other runs are untouched and a failed write
    leaves no committed run.
    """
    target = f"{path}/engagement_id={engagement_id}/run_id={run_id}"
    cells.write.mode("errorifexists").parquet(target)


def load_run(spark: SparkSession, path: str, engagement_id: str, run_id: str) -> DataFrame:
    """Read one run; the partition columns prune to its folder. Unknown runs are an error."""
    rows = spark.read.parquet(path).where((F.col("engagement_id") == engagement_id) & (F.col("run_id") == run_id))
    if rows.isEmpty():
        raise KeyError(f"unknown run {engagement_id}/{run_id}")
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write per key wins. Write the result to a new folder; never over its own input."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return latest_per_key(both, keys, [version, *[c for c in rest if c != version]], rest).select(*old.columns)


def with_source_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("source_bucket", F.sha2("source_path", 256))


class Written(NamedTuple):
    """What a replacement wrote: rows in all, and (source_path, parsed_rows) per source."""

    rows: int
    sources: DataFrame


def replace_source(df: DataFrame, path: str, expected: DataFrame | None = None, files: int = FILES) -> Written:
    """Replace all rows of the sources in ``df`` and leave the others.

    The input runs once: it is written to a staging folder, hashed into at most ``files`` files a source,
    and its rows are counted on the way. With ``expected`` (source_path, source_rows) the staged counts must
    agree, else nothing is replaced. Only then the staged files replace the sources' folders.
    """
    spark = df.sparkSession
    staged, seen = f"{shared_folder(spark)}/staged", Observation()
    salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]), F.lit(files))
    bucketed = with_source_bucket(df.observe(seen, F.count(F.lit(1)).alias("rows"))).withColumn("_part", salt)
    bucketed.repartition("source_bucket", "_part").drop("_part").write.partitionBy("source_bucket").parquet(staged)
    rows = spark.read.schema(with_source_bucket(df).schema).parquet(staged)
    sources = materialize(rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("parsed_rows")))
    total = sources.agg(F.coalesce(F.sum("parsed_rows"), F.lit(0))).first()[0]
    if total and total != seen.get["rows"]:  # an input that is planned away as empty has no metrics
        raise RejectedRecords(f"{seen.get['rows']} rows were parsed and {total} written")
    if expected is not None:
        mismatch = expected.join(sources, "source_path", "full").where(~F.col("source_rows").eqNullSafe(F.col("parsed_rows"))).orderBy("source_path").first()
        if mismatch:
            raise RejectedRecords(f"row counts differ: {mismatch.asDict()}")
    if total:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_bucket").parquet(path)
    return Written(total, sources)


def replace_workbook(cells: DataFrame, names: DataFrame, records: DataFrame, headers: DataFrame, path: str) -> dict[str, Written]:
    """The four tables of parsed workbooks, each replaced per source."""
    return {name: replace_source(df, f"{path}/{name}") for name, df in (("cells", cells), ("headers", names), ("records", records), ("sheets", headers))}


class ImportLog(NamedTuple):
    """``log``: one row per source with its counts and status. ``notes``: every warning and error, a row each."""

    log: DataFrame
    notes: DataFrame


def reconciliation_log(manifest: DataFrame, parsed: DataFrame, warnings: DataFrame, errors: DataFrame | None = None, source_rows: DataFrame | None = None) -> ImportLog:
    """Source rows, parsed rows, warnings and errors of every source.

    ``parsed`` has a row per parsed row, or counts as ``replace_source`` returns them. A source with errors,
    with other parsed than source rows, or with warnings and nothing parsed has failed.
    """
    counts = parsed.select("source_path", "parsed_rows") if "parsed_rows" in parsed.columns else parsed.groupBy("source_path").agg(F.count(F.lit(1)).alias("parsed_rows"))
    kinds = [warnings.select("source_path", F.lit("warning").alias("kind"), "message")] + ([errors.select("source_path", F.lit("error").alias("kind"), "message")] if errors is not None else [])
    notes = reduce(DataFrame.unionByName, kinds)
    per = notes.groupBy("source_path").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_count") for k in ("warning", "error")])
    rows = manifest.select(F.col("path").alias("source_path"), "file_type").join(counts, "source_path", "left").join(per, "source_path", "left")
    rows = rows.join(source_rows.select("source_path", "source_rows"), "source_path", "left") if source_rows is not None else rows.withColumn("source_rows", F.lit(None).cast("long"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("warning_count", "error_count")})
    uneven = F.coalesce(F.col("source_rows") != F.coalesce("parsed_rows", F.lit(0)), F.lit(False))
    status = (F.when((F.col("error_count") > 0) | uneven, "failed").when(F.col("parsed_rows").isNotNull(), F.when(F.col("warning_count") > 0, "warning").otherwise("parsed"))
              .when(F.col("warning_count") > 0, "failed").otherwise("skipped"))
    log = rows.withColumns({"status": status, "parsed_rows": F.coalesce("parsed_rows", F.lit(0).cast("long"))})
    return ImportLog(log.select("source_path", "file_type", "source_rows", "parsed_rows", "warning_count", "error_count", "status"), notes)
