"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # CSV and decode() reach windows-1252 only through the Java charset list.
    "spark.sql.legacy.javaCharsets": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster supplies its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tallymark")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        # Small local shuffles keep their partitions instead of being merged into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        # Rounds of a loop leave no files behind once their frames are gone.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster names for checkpoints, which all executors share."""
    context = spark.sparkContext
    _ensure_checkpoints(spark)
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def _ensure_checkpoints(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``. Only a local master without one gets a
    fresh folder of its own, since there the driver and the executors share one disk.
    """
    _ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
