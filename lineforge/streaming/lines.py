"""Record lines as a stream: text files arriving in a folder are parsed as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.sources.records import ARROW
from lineforge.sources.schema import RecordSchema
from lineforge.sources.text_format import LINE_SCHEMA, parse_line


def stream_records(spark: SparkSession, folder: str, schema: RecordSchema) -> DataFrame:
    """Data lines of header-less text files; line_no is null, as a stream's lines have no place in one file."""
    raw = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), "value").where(F.length("value") > 0)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file": f, "line_no": None, **parse_line(t, schema)} for f, t in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return raw.mapInArrow(parse, LINE_SCHEMA)


def running_line_stats(lines: DataFrame) -> DataFrame:
    """(line_type, n, max_len, total_len) so far, for an update or complete sink."""
    return lines.groupBy("line_type").agg(F.count("*").alias("n"), F.max("list_len").alias("max_len"), F.sum("list_len").alias("total_len"))
