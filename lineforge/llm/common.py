"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
    found = tempfile.mkdtemp(prefix="lineforge-")
    spark.sparkContext.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession):
    """What runs here deletes its shuffle files at its end: its result is a table, and nothing reads the files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, tag: str = "t", codec: str = "zstd") -> DataFrame:
    """Write to a fresh Parquet table in the shared folder and read it back.

    Cuts the lineage and computes the plan once. What a lost executor had computed is in the shared folder. Tables stay until
    the owner of the folder clears it, as lazy results read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _freed_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., so that no name clashes with an operator's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def renamed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Inverse of ``numbered``: only the columns c0, c1, ... under their names."""
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(columns)])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents in ``gone`` (gone: doc_id)."""
    own = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    return renamed(numbered(docs).join(gone, own == F.col("gone"), "left_anti"), docs.columns)


def one_row_each(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with one row, the least by all columns, for each ``key``; rows with a null key stay.

    Rows that don't repeat aren't moved, and a key that very many rows have is settled within each task first.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    own = f"c{docs.columns.index(key)}"
    rows = numbered(docs)
    repeated = rows.where(f"{own} is not null").groupBy(F.col(own).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    repeated = written(repeated, "repeated")
    once = rows.join(repeated, F.col(own) == F.col("k"), "left_anti")
    least = rows.join(repeated, F.col(own) == F.col("k"), "left_semi").groupBy(own).agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    return renamed(once.union(least), docs.columns)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hand freed memory back to the system: Python workers stay between tasks, and the next stage has others beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back at the end of the task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return f


def small_batches(spark: SparkSession, most: int = 4 << 20, rows: int = 512) -> None:
    """Send texts to Python in batches of a few MB, whatever their lengths, and read Parquet in batches of few rows, unless the
    session asks for less.

    The reader holds a batch's texts in one array that doubles as it grows; with Spark's 4096 rows an executor's heap grew to
    its limit and stayed there, beside the Python workers of the stages that follow.
    """
    for key, limit in (("spark.sql.execution.arrow.maxBytesPerBatch", most), ("spark.sql.parquet.columnarReaderBatchSize", rows)):
        now = spark.conf.get(key, None) or ""
        if not (now.isdigit() and int(now) <= limit):
            spark.conf.set(key, str(limit))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make`` builds a task's batch function once."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(tidy(run), schema)


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together, so work arrays stay small."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_names(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that ``repartition(n, name)`` deals to ``n`` different tasks."""
    spread, found = 8 * n + 64, {}
    while len(found) < n:
        rows = spark.range(spread).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task"), F.col("id").cast("int").alias("id"))
        found = {r.task: r.id for r in rows.groupBy("task").agg(F.min("id").alias("id")).collect()}
        spread *= 2
    return [found[k] for k in range(n)]
