"""Long sequences and tables that one task or one level of a regular expression wouldn't hold."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lineforge.operators import scaffold
from lineforge.plans.catalogue import QUERIES
from lineforge.sources import records, sequences
from lineforge.sources.schema import RecordSchema
from lineforge.sources.text_format import Header


def test_scaffold_break_of_a_long_sequence_with_many_gaps(spark):
    unit = "acgtn" * 40_000 + "acgt"
    df = spark.createDataFrame([(1, "n" + unit + "nn" + unit + "nnn"), (2, "n"), (3, ""), (4, None), (5, "aénnXXcN")], "doc int, s string")
    got = {r.id: (r.pos, r.seq) for r in scaffold.scaffold_break(df, "doc", F.col("s"), 2).collect()}
    assert got == {"1.1": (1, unit), "1.2": (len(unit) + 3, unit), "5.1": (0, "a"), "5.2": (6, "c")}


def test_scaffold_join_of_a_long_sequence_with_many_gaps(spark):
    seq = "n" + "acgtnacnn" * 30_000
    df = spark.createDataFrame([(1, seq), (2, "nnn")], "doc int, s string")
    contigs = scaffold.scaffold_break(df, "doc", F.col("s"), 2).select("doc", "pos", "seq")
    got = scaffold.scaffold_join(contigs, "doc", df.select("doc", F.length("s").alias("length")))
    assert {r.doc: r.seq for r in got.collect()} == {1: seq, 2: "nnn"}


def test_fasta_parts_go_on_where_the_one_before_ended(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 5).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("desc"), F.repeat(F.lit("ac"), (F.col("id") % 7).cast("int")).alias("seq"))
    sequences.write_fasta(rows, str(tmp_path / "f"))
    (tmp_path / "f" / "part-9.txt").write_text("\n>1000\nacgt\n")
    got = sequences.read_fasta(spark, str(tmp_path / "f"), continued=True).collect()
    assert len({r.file for r in got}) == 6
    assert sorted((r.ord, int(r.id)) for r in got) == [(k + 1, k) for k in range(1001)]


def test_fasta_roundtrip_is_written_by_several_tasks(spark, tmp_path):
    rows = [(k, "acgtn " * 50, "en") for k in range(2000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["fasta_roundtrip"](spark, str(tmp_path))
        assert len(got.inputFiles()) > 1
        assert sorted((r.ord, r.id) for r in got.select("ord", "id").collect()) == [(k + 1, str(k)) for k in range(2000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_binary_folders_have_more_files_than_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PART", 4000)
    schema = RecordSchema.for_type("P 3 seq\nO S 1 3 DNA\nD I 1 6 STRING\n", "seq")
    rows = spark.range(200).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("acgt" * 40).alias("seq"))
    records.write_binary(sequences.sequence_lines(rows), Header("seq", schema=schema), str(tmp_path / "b"))
    f = records.read_records(spark, str(tmp_path / "b"))
    sizes = [r.n for r in f.lines.groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 100 and sum(sizes) == 400
    assert f.header.counts["S"] == {"count": 200, "max": 160, "total": 32_000}
    assert sorted((int(r.id), r.seq) for r in sequences.sequences_of(f).collect()) == [(k, "acgt" * 40) for k in range(200)]


@pytest.mark.parametrize(("name", "folder"), [("header_inherit", "inherit"), ("footer_counts", "binary"), ("binary_roundtrip", "binary")])
def test_files_of_a_query_grow_in_number_not_in_size(spark, monkeypatch, name, folder):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/{folder}-*/part-*"))
    monkeypatch.setattr(records, "PART", 60_000)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    sizes = [os.path.getsize(f) for f in set(glob.glob(f"{shared}/{folder}-*/part-*")) - before]
    assert len(sizes) > 4 and max(sizes) < 120_000
    assert not glob.glob(f"{shared}/lines-*")
