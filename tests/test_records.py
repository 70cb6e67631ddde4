"""Record and sequence files on Spark."""

import itertools
import random

import pytest
from lineforge.functions import sequence as S
from lineforge.operators import barcode, filterexpr, joins, ordinals, scaffold
from lineforge.sources import records, sequences
from lineforge.sources.schema import RecordSchema
from lineforge.sources.text_format import FormatError
from pyspark.sql import functions as F

NESTED = """1 3 seq 2 1
! 4 4 prog 1 1 6 prog x 19 2024-01-01_00:00:00
~ O s 2 3 INT 6 STRING
~ G S 0
~ D n 1 3 INT
~ O S 1 3 DNA
# s 1
@ s 4
+ s 4
# S 3
@ S 6
+ S 12
.
s 20 4 pile
n 3
S 6 ggcatt
n 5
S 6 ccagta a remark
"""


@pytest.fixture(scope="module")
def nested(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("rec") / "nested.seq"
    p.write_text(NESTED)
    return records.read_records(spark, str(p))


def body(df):
    return [(r.line_type, r.ints, r.str) for r in df.collect()]


def test_index_selection(nested):
    get = lambda kind, text: [t for t, _, _ in body(nested.select(kind, text))]
    assert get("s", "0") == []
    assert get("s", "1") == ["s", "n", "S", "n", "S"]
    assert get("S", "0") == ["s", "n"]
    assert body(nested.select("S", "1")) == [("S", [], "ggcatt")]
    assert [x for _, _, x in body(nested.select("S", "2,1"))] == ["ccagta", "ggcatt"]
    assert [x for _, _, x in body(nested.select("S", "1,1-3"))] == ["ggcatt", "ggcatt", "ccagta"]


def test_statistics_and_validation(nested):
    assert {(r.line_type, r.n, r.max_len, r.total_len) for r in nested.stats().collect()} == {("s", 1, 4, 4), ("n", 2, 0, 0), ("S", 2, 6, 12)}
    status = {(r.line_type, r.measure): r.status for r in nested.validate().collect()}
    assert status["S", "n"] == "bad" and status["S", "total_len"] == "ok" and status["n", "n"] == "missing" and status["s", "n"] == "ok"
    assert {(r.line_type, r.max_count, r.max_total) for r in nested.maxima("s").collect()} == {("n", 2, 0), ("S", 2, 12)}
    assert {r.obj: r.n for r in nested.count_until_next("n", "S").collect()} == {0: 1, 1: 1, 2: 0}
    assert sum(r.n_bytes for r in nested.usage().collect()) == len(NESTED.split(".\n", 1)[1])
    assert nested.typed("s").columns == ["file", "line_no", "f0", "f1", "comment"] and nested.typed("S").first().f0 == "ggcatt"


def test_write_and_read_back(spark, nested, tmp_path):
    out = str(tmp_path / "out")
    records.write_records(nested.lines, nested.header, out, single=True)
    again = records.read_records(spark, out)
    drop = lambda f: [tuple(r)[2:] for r in f.lines.orderBy("line_no").collect()]
    assert drop(again) == drop(nested)
    assert again.header.provenance == nested.header.provenance and {r.status for r in again.validate().collect()} == {"ok"}
    assert again.header.maxima["s", "S"] == (2, 12)
    bare = str(tmp_path / "bare")
    records.write_records(nested.lines, nested.header, bare, with_header=False, single=True)
    schema = RecordSchema.for_type(nested.schema.text(), "seq")
    assert drop(records.read_records(spark, bare, schema, "seq")) == drop(nested)
    with pytest.raises(FormatError):
        records.read_records(spark, bare)


def test_containment_equals_a_walk(spark):
    rng, contains = random.Random(3), {"A": {"b", "C", "d"}, "C": {"d"}}
    lines = [(f"f{k}", i, rng.choice("AbCdx")) for k in range(4) for i in range(300)]
    df = spark.createDataFrame(lines, "file string, line_no bigint, line_type string")
    old, ordinals.BLOCK = ordinals.BLOCK, 64
    try:
        got = {(r.file, r.line_no): (r.obj_A, r.in_A, r.obj_C, r.in_C) for r in ordinals.containment_positions(df, ["A", "C"], contains).collect()}
    finally:
        ordinals.BLOCK = old
    n, is_open = {}, {}
    for f, i, t in lines:
        for kind in "AC":
            if t == kind:
                n[f, kind], is_open[f, kind] = n.get((f, kind), 0) + 1, True
            elif t not in contains[kind]:
                is_open[f, kind] = False
        assert got[f, i] == (n.get((f, "A"), 0), is_open.get((f, "A"), False), n.get((f, "C"), 0), is_open.get((f, "C"), False))


def test_fasta_fastq_sam(spark, tmp_path):
    fa = tmp_path / "x.fa"
    fa.write_text(">one first entry\nACGT\nnnac\n>two\n\n>three  d\nac gt1u\n")
    got = {r.id: (r.desc, r.seq) for r in sequences.read_fasta(spark, str(fa)).collect()}
    assert got == {"one": ("first entry", "ACGTnnac"), "two": (None, ""), "three": ("d", "acgtu")}
    out = str(tmp_path / "fa")
    sequences.write_fasta(sequences.read_fasta(spark, str(fa)), out, "gzip")
    assert {r.id: (r.desc, r.seq) for r in sequences.read_fasta(spark, out).collect()} == got
    fq = tmp_path / "x.fq"
    fq.write_text("@r1 d\nACGT\n+\nIIII\n@r2\nGG\n+r2\n!~\n")
    rows = sequences.with_qualities(sequences.read_fastq(spark, str(fq))).orderBy("ord").collect()
    assert [(r.ord, r.id, r.desc, r.seq, r.qual) for r in rows] == [(1, "r1", "d", "ACGT", [40] * 4), (2, "r2", None, "GG", [0, 93])]
    (tmp_path / "bad.fq").write_text("@r1\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="bad FASTQ record"):
        sequences.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    sam = tmp_path / "x.sam"
    base = "*\t0\t255\t*\t*\t0\t0\t"
    sam.write_text("@HD\tVN:1\n" + "".join(f"m/{z}/0_9\t{flag}\t{base}AACG\tIJKL\tzm:i:{z}\trq:f:0.9\tsn:B:f,1,2,3,4\tbc:B:S,1,2\tpw:B:S,1,9,4,2\n" for z, flag in ((1, 0), (2, 16), (3, 0x100), (4, 0x800))))
    r = sequences.read_sam(spark, str(sam))
    assert r.count() == 2 and sequences.read_sam(spark, str(sam), False).count() == 4
    assert {(x.id, x.seq, x.qual) for x in sequences.sam_sequences(r).collect()} == {("m/1/0_9", "AACG", "IJKL"), ("m/2/0_9", "CGTT", "LKJI")}
    sub = sequences.subreads(r)
    assert {x.arr for x in sub.collect()} == {"1442"} and filterexpr.filter_records(sub, "zm==2 && rq>=899 && bc2==2").count() == 1


def test_sequences_of_record_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "some text", "acnnngtx"), (2, "b", None, "gg")], "ord bigint, id string, desc string, seq string")
    schema = RecordSchema.for_type("P 3 seq\nO S 1 3 DNA\nD I 1 6 STRING\nD Q 1 6 STRING\nD N 3 3 INT 4 CHAR 3 INT\n", "seq")
    from lineforge.sources.text_format import Header

    records.write_records(sequences.sequence_lines(rows), Header("seq", schema=RecordSchema("seq", [], schema.definitions)), str(tmp_path / "s"), single=True)


def test_sequence_functions(spark):
    seqs = ["", "a", "aacnnngtt", "nnnacgtnnacnng", "ACGTNacgtn", "ttttt"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    s = F.col("s")
    h = S.homopolymer_compress(s)
    for r in df.select("s", S.reverse_complement(s).alias("rc"), h.alias("h"), S.run_ends(s).alias("e"), S.homopolymer_expand(h, S.run_ends(s)).alias("x"), S.pack2bit(s).alias("p"), S.unpack2bit(S.pack2bit(s), F.length(s)).alias("u"), S.non_acgt_runs(s).alias("n")).collect():
        comp = str.maketrans("acgtnACGTN", "tgcanTGCAN")
        runs = [(k, len(list(g))) for k, g in itertools.groupby(r.s)]
        assert r.rc == r.s.translate(comp)[::-1] and r.h == "".join(k for k, _ in runs) and r.x == r.s
        assert r.e == list(itertools.accumulate(n for _, n in runs))
        assert r.u == "".join(c if c in "acgt" else "a" for c in r.s.lower())
        at = [sum(n for _, n in runs[:k]) for k in range(len(runs))]
        assert [tuple(x) for x in r.n] == [(a, k, n) for a, (k, n) in zip(at, runs, strict=True) if k.lower() not in "acgt"]


def test_scaffolds(spark):
    df = spark.createDataFrame([("x", "nnacgnaannnccnn"), ("y", "nnnn"), ("z", "acgt")], "id string, s string")
    cut = scaffold.scaffold_break(df, "id", F.col("s"), 2)
    got = sorted((r.contig, r.pos, r.seq) for r in cut.select("contig", "pos", "seq").collect())
    assert got == [(1, 0, "acgt"), (1, 2, "acgnaa"), (2, 11, "cc")]


def test_pairing_and_lookups(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, x string")
    b = spark.createDataFrame([(1, "c"), (2, "d")], "ord int, y string")
    assert sorted(map(tuple, joins.zip_join(a, b).collect())) == [(1, "a", "c"), (2, "b", "d")]
    with pytest.raises(Exception, match="different numbers"):
        joins.zip_join(a, b.where("ord = 1")).collect()
    r = spark.createDataFrame([(0, "p"), (1, "p"), (2, "q"), (3, "q")], "i bigint, name string")
    assert [(x.pair_no, x.mate) for x in joins.adjacent_pairs(r, "name", "i").orderBy("i").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    with pytest.raises(Exception, match="no mate"):
        joins.adjacent_pairs(r.where("i < 3"), "name", "i").collect()


def test_barcodes_against_brute_force(spark):
    rng = random.Random(8)
    codes = ["".join(rng.choice("acgt") for _ in range(5)) for _ in range(8)]
    reads = [rng.choice(codes) for _ in range(200)]
    reads += ["".join(c if k != j else rng.choice("acgt") for k, c in enumerate(x)) for x in codes for j in (rng.randrange(5), rng.randrange(5))] + ["acgta"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(reads)], "i int, code string")
    valid = {c for c in set(reads) if reads.count(c) >= 4}
    near = lambda c: [v for v in valid if sum(a != b for a, b in zip(c, v, strict=True)) == 1]
    for r in barcode.correct(df, 4, 5).collect():
        want = ("valid", r.code) if r.code in valid else ("repaired", near(r.code)[0]) if len(near(r.code)) == 1 else ("dropped", None)
        assert (r.status, r.corrected) == want


def test_data_source(spark, tmp_path):
    from lineforge.sources import datasource

    p = tmp_path / "n.seq"
    p.write_text(NESTED)
    datasource.register(spark)
    df = spark.read.format("lineforge").option("path", str(p)).option("splitBytes", 9).load()
    assert [(r.line_type, r.str) for r in df.orderBy("line_no").collect()] == [("s", "pile"), ("n", None), ("S", "ggcatt"), ("n", None), ("S", "ccagta")]
    assert df.where("line_type = 'S'").count() == 2 and df.where("line_type in ('s', 'n') and line_type != 's'").count() == 2
    out = str(tmp_path / "w")
    df.write.format("lineforge").option("path", out).option("schemaText", "P 3 seq\nO s 2 3 INT 6 STRING\nG S 0\nD n 1 3 INT\nO S 1 3 DNA\n").option("type", "seq").mode("append").save()
    assert sum(len(x.read_text().splitlines()) for x in (tmp_path / "w").glob("part-*")) == 5


def test_streamed_lines(spark, tmp_path):
    from lineforge.streaming.lines import running_line_stats, stream_records

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("S 4 acgt\nI 2 xy\nS 2 gg\n")
    schema = RecordSchema.for_type("P 3 seq\nO S 1 3 DNA\nD I 1 6 STRING\n", "seq")
    q = running_line_stats(stream_records(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName("line_stats_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.line_type, r.n, r.max_len, r.total_len) for r in spark.table("line_stats_test").collect()} == {("S", 2, 4, 6), ("I", 1, 2, 2)}


def test_simulated_reads(spark):
    from lineforge.operators import simulate

    seq = "".join(random.Random(1).choice("acgt") for _ in range(5000))
    df = spark.createDataFrame([("x", seq), ("short", "acgt")], "id string, seq string")
    reads = simulate.shotgun(df, 3, 400, seed=5).collect()
    assert reads == simulate.shotgun(df, 3, 400, seed=5).collect() and sum(r.end - r.beg for r in reads) >= 15000
    comp = str.maketrans("acgt", "tgca")
    assert all(r.seq == (seq[r.beg : r.end].translate(comp)[::-1] if r.rc else seq[r.beg : r.end]) for r in reads)
    v = spark.range(2000).select(simulate.poisson(3, 2.0).alias("p"), simulate.geometric(9, 0.5).alias("g")).agg(F.avg("p"), F.avg("g")).first()
    assert abs(v[0] - 2) < 0.2 and abs(v[1] - 1) < 0.2
