"""Session helpers: a local session for tests, durable intermediate results."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that a lost
    executor costs no recomputation and several consumers read one result.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset
    (local tests) is a temporary folder of this machine taken.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-", dir=os.environ.get("TMPDIR")))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str, waves: int = 2) -> DataFrame:
    """The same rows in enough partitions to keep all cores busy with work that is heavy per row.

    A table in a few files is read by a few tasks, however long each row takes. Only then are
    the rows shuffled, by hash of ``keys`` (which, unlike dealing them out in turn, sends
    a row to the same place when a lost task is run again).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= waves * cores:
        return df
    return df.repartition(waves * cores, *keys)
