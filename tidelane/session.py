"""Session for tests and bench, and the folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelane")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDELANE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Where it is unset, a session of one machine takes a temporary one; a
    cluster is refused, as a folder of the driver's machine isn't there for its executors."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelane-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that what lies before is computed once, even if executors are lost.

    The files go with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """Rows spread by a hash of `key` over a few tasks per core, if the scan gives fewer.

    For stages that work long on each row of a small table; a table with splits enough is left as it is, unshuffled. The rows
    are the same either way.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
