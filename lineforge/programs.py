"""The record and sequence programs as functions: view, stat, convert, extract, unitigs, pairs and a form flip.

Every function takes a session and paths and returns DataFrames, or writes where it is given an output path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.functions import sequence as S
from lineforge.operators import joins, ordinals, scaffold
from lineforge.sources import bam, records, sequences
from lineforge.sources.schema import RecordSchema
from lineforge.sources.text_format import Header, write_counts, write_head, write_line

# fixed values: the definitions of sequence and unitig files
SEQUENCES = """P 3 seq
O s 2 3 INT 6 STRING
G S 0
D n 2 4 CHAR 3 INT
O S 1 3 DNA
D I 1 6 STRING
D Q 1 6 STRING
D N 3 3 INT 4 CHAR 3 INT
D H 1 8 INT_LIST
"""
UNITIGS = """P 3 utg
O S 1 3 DNA
D I 1 6 STRING
D K 1 4 REAL
D L 3 4 CHAR 3 INT 4 CHAR
"""


def _text(f: records.RecordFile, lines: DataFrame) -> DataFrame:
    import pyarrow as pa

    schema = f.schema
    keep = [c for c in lines.columns if c in ("req_no", "file", "line_no")]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([write_line(r, schema) for r in b.to_pylist()])], [*keep, "text"])

    kinds = {"req_no": "int", "file": "string", "line_no": "long"}
    return lines.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "text string"]))


def view(spark: SparkSession, path: str, index: str | None = None, schema: str | None = None, primary: str | None = None, out: str | None = None, binary: bool = False, no_header: bool = False) -> DataFrame:
    """Lines of a record file as text, in file order; ``index`` such as ``S 3,5,9-12`` picks objects. ``out`` writes them too,
    there in file order."""
    f = records.read_records(spark, path, RecordSchema.for_type(schema, primary) if schema and primary else None, primary)
    if index:
        kind, ranges = index.split(" ", 1)
        picked = f.select(kind, ranges).select("req_no", *f.lines.columns)
    else:
        picked = f.lines.orderBy("file", "line_no")
    if out and binary:
        records.write_binary_file(picked.drop("req_no"), f.header, out)
    elif out:
        records.write_records(picked.drop("req_no"), f.header, out, with_header=not no_header)
    return _text(f, picked)


def view_header(spark: SparkSession, path: str, schema_only: bool = False) -> list[str]:
    """Header lines of a record file, or its schema alone."""
    f = records.read_records(spark, path)
    return f.schema.text().splitlines() if schema_only else write_head(f.header) + write_counts(f.header)


def stat(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``counts`` (given against recomputed), ``usage`` (bytes by line type) and ``maxima`` of every object type."""
    f = records.read_records(spark, path)
    found = {f"maxima_{ordinals.tag(t)}": f.maxima(t) for t, inner in f.schema.contains().items() if inner}
    return {"counts": f.validate(), "usage": f.usage(), **found}


def flip(spark: SparkSession, path: str, out: str) -> None:
    """A text file to a binary one and back."""
    f = records.read_records(spark, path)
    if f.header.big_endian is None:
        records.write_binary_file(f.lines, f.header, out)
    else:
        records.write_records(f.lines, f.header, out, single=True)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, id, desc, seq, qual) of FASTA, FASTQ, SAM, BAM, packed or record files, by suffix."""
    name = path.removesuffix(".gz")
    none = F.lit(None).cast("string")
    if name.endswith((".fa", ".fasta", ".fna")):
        return sequences.read_fasta(spark, path).withColumn("qual", none)
    if name.endswith((".fq", ".fastq")):
        return sequences.read_fastq(spark, path)
    if name.endswith((".sam", ".bam")):
        rows = (bam.read_bam if name.endswith(".bam") else sequences.read_sam)(spark, path)
        return sequences.sam_sequences(rows).select(F.lit(path).alias("file"), F.monotonically_increasing_id().alias("ord"), "id", none.alias("desc"), "seq", "qual")
    if name.endswith(".bin"):
        return sequences.read_packed(spark, path)
    return sequences.sequences_of(records.read_records(spark, path)).withColumnRenamed("obj", "ord")


def convert(spark: SparkSession, path: str, out: str, kind: str = "record", hoco: bool = False, threshold: int = 0, qualities: bool = False, compression: str | None = None) -> None:
    """Sequences of any readable file as ``fasta``, ``fastq``, ``packed`` or ``record`` (binary) files.

    ``hoco`` compresses homopolymers; record files keep the run ends, so that reading them expands the sequences again.
    """
    rows = read_any(spark, path)
    if hoco and kind != "record":
        rows = rows.withColumn("seq", S.homopolymer_compress(F.col("seq")))
    if kind == "fasta":
        sequences.write_fasta(rows.orderBy("ord"), out, compression)
    elif kind == "fastq":
        sequences.write_fastq(rows.withColumn("qual", F.coalesce("qual", F.repeat(F.lit("I"), F.length("seq")))).orderBy("ord"), out, compression)
    elif kind == "packed":
        sequences.write_packed(rows, out, threshold=threshold)
    elif kind == "record":
        schema = RecordSchema.for_type(SEQUENCES, "seq")
        keep = {"S", "I", "N", *(["Q"] if qualities else []), *(["H"] if hoco else [])}
        schema = RecordSchema("seq", [], [d for d in schema.definitions if d.type in keep and d.kind != "G"])
        lines = sequences.sequence_lines(rows, qualities=qualities, homopolymers=hoco)
        records.write_binary_file(lines, Header("seq", schema=schema).add_provenance("lineforge convert", "1", path), out)
    else:
        raise ValueError(f"not a kind of sequence file: {kind!r}")


def extract(spark: SparkSession, path: str, fragments: list[str], by: str = "id") -> DataFrame:
    """(id or ord, label, seq) of fragments such as ``chr1:10-20R``; by record id, or by place in the file with ``by='ord'``."""
    wanted = spark.createDataFrame([(f.key, f.start, f.end, f.rc) for f in map(scaffold.parse_fragment, fragments)], "key string, start bigint, end bigint, rc boolean")
    rows = read_any(spark, path)
    return scaffold.extract(rows, wanted, by, F.col("id"), F.col("seq"))


def unitig_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Lines S, I, K and L of unitigs and their links, which name unitigs by ordinal; ``nodes``: (ord, id, seq, coverage)."""
    ids = nodes.select(F.col("id").alias("dst"), F.col("ord").alias("to"))
    edges = links.join(ids, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("to", "orient", "end"))).alias("links"))
    rows = nodes.join(edges, F.col("id") == F.col("src"), "left")
    types = {"ints": "array<bigint>", "reals": "array<double>", "chars": "array<string>", "list_len": "bigint", "str": "string", "int_list": "array<bigint>", "real_list": "array<double>", "str_list": "array<string>", "comment": "string"}
    line = lambda kind, **f: F.struct(F.lit(kind).alias("line_type"), *[(f[k] if k in f else F.array() if k in ("ints", "reals", "chars") else F.lit(None)).cast(t).alias(k) for k, t in types.items()])
    fixed = [F.array(line("S", str=F.col("seq"), list_len=F.length("seq"))), F.array(line("I", str=F.col("id"), list_len=F.length("id"))), F.filter(F.array(line("K", reals=F.array("coverage"))), lambda x: F.get(x["reals"], 0).isNotNull())]
    more = F.transform(F.coalesce("links", F.array().cast("array<struct<to: bigint, orient: string, end: string>>")), lambda x: line("L", ints=F.array(x["to"]), chars=F.array(x["orient"], x["end"])))
    sized = ordinals.with_running(rows.select("ord", F.concat(*fixed, more).alias("x")), "ord", {"upto": F.size("x")})
    return sized.select((F.col("upto") - F.size("x")).alias("first"), F.posexplode("x").alias("k", "x")).select(F.lit("").alias("file"), (F.col("first") + F.col("k")).alias("line_no"), "x.*")


def unitigs(spark: SparkSession, path: str, out: str) -> None:
    """A unitig FASTA as a binary record file."""
    r = sequences.read_fasta(spark, path)
    nodes, links = sequences.read_unitigs(spark, path)
    nodes = nodes.join(r.select("id", "ord"), "id")
    records.write_binary_file(unitig_lines(nodes, links), Header("utg", schema=RecordSchema.for_type(UNITIGS, "utg")).add_provenance("lineforge unitigs", "1", path), out)


def pair(spark: SparkSession, forward: str, reverse: str) -> DataFrame:
    """(ord, id, seq, qual, mate_seq, mate_qual) of two files of equally many reads, the i-th with the i-th."""
    f = read_any(spark, forward).select("ord", "id", "seq", "qual")
    r = read_any(spark, reverse).select("ord", F.col("seq").alias("mate_seq"), F.col("qual").alias("mate_qual"))
    return joins.zip_join(f, r)


def ingest(spark: SparkSession, paths: list[str], paired: bool = False, group: tuple[str, int] | None = None) -> DataFrame:
    """Reads of several files in order: (no, id, seq, qual, group_key, group_no, pair_no, mate) as asked for.

    ``group`` (character, k) groups by the name up to its k-th character; ``paired`` takes neighbours of the same name together.
    """
    parts = None
    for k, p in enumerate(paths):
        one = read_any(spark, p).select(F.lit(k).alias("part"), "ord", "id", "seq", "qual")
        parts = one if parts is None else parts.unionByName(one)
    sizes = {r.part: r.n for r in parts.groupBy("part").agg(F.max("ord").alias("n")).collect()}
    before = F.lit(0)
    for k in range(len(paths)):
        before = F.when(F.col("part") == k, sum(sizes.get(j, 0) for j in range(k))).otherwise(before)
    rows = parts.select((F.col("ord") + before).alias("no"), "id", "seq", "qual")
    if paired:
        rows = joins.adjacent_pairs(rows, "id", "no")
    if group:
        rows = joins.prefix_groups(rows, S.group_prefix(F.col("id"), *group), "no")
    return rows


def quality_usage(reads: DataFrame, qual: str = "qual") -> DataFrame:
    """(symbol, n) of quality symbols over all reads: each task counts its own first."""
    return reads.select(F.explode(F.split(qual, "")).alias("symbol")).where("symbol != ''").groupBy("symbol").agg(F.count("*").alias("n"))


def quality_bits_needed(usage: DataFrame) -> int:
    """Bits for the symbols in use, numbered from 0."""
    return max(1, (usage.count() - 1).bit_length())
