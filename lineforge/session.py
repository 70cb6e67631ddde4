"""Session construction and shared-folder helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lineforge", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session with the engine's settings. The master is the one that spark-submit or the configuration gives; local without one.

    Shuffle partitions follow the cores on a local master only; on a cluster they are the cluster's, and adaptive execution
    merges small ones.
    """
    given = SparkConf().get("spark.master")
    builder = SparkSession.builder.appName(app)
    if not given:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus)).config("spark.driver.memory", "12g")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        shared = tempfile.mkdtemp(prefix="lineforge-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A DataFrame computed once into the shared folder, and removed at the end."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
