"""Binary record files, several files at once, byte codes, BAM, packed files and the programs over them."""

import gzip
import io
import random
import struct
import zlib

import numpy as np
import pytest
from lineforge import programs
from lineforge.functions import sequence as S
from lineforge.operators import simulate
from lineforge.sources import bam, binary, names, records, sequences, text_format
from lineforge.sources.huffman import ByteCode, code_lengths
from lineforge.sources.schema import RecordSchema
from pyspark.sql import functions as F

from .test_formats import LINES, TEXT

COLUMNS = text_format.LINE_FIELDS


def header(counts=True):
    return text_format.Header("seq", schema=RecordSchema.for_type(TEXT, "seq")).add_provenance("prog", "1", "prog -x", "2024-01-01_00:00:00")


def written(lines, training=binary.TRAINING):
    h, out = header(), io.BytesIO()
    with binary.LineWriter(out, h, training) as w:
        for row in lines:
            w.write(row)
    return out


def test_code_lengths_are_best_and_bounded():
    assert code_lengths([1, 1, 2, 4, 8]) == [4, 4, 3, 2, 1]
    lengths = code_lengths([2**k for k in range(30)])
    assert max(lengths) == 12 and sum(2.0**-n for n in lengths) == 1.0


@pytest.mark.parametrize("symbols", [1, 2, 7, 60, 255, 256])
def test_byte_code_round_trip(symbols):
    rng = random.Random(symbols)
    alphabet = bytes(rng.sample(range(256), symbols))
    data = bytes(rng.choices(alphabet, weights=[1 / (k + 1) ** 2 for k in range(symbols)], k=4000))
    code = ByteCode.merged([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in (data[:1000], data[1000:])])
    for n in (1, 7, 8, 31, 32, 33, 64, 500, 4000):
        for more in (b"", bytes([rng.randrange(256)])):
            bits, coded = code.encode(data[:n] + more)
            assert len(coded) == (bits + 7) // 8 and ByteCode.load(code.store()).decode(coded, bits) == data[:n] + more


def test_stream_layout_by_hand():
    """Codes 0 for a and 10 for b: the high bits first, words little-endian, the first word's ends swapped."""
    lengths, codes = np.zeros(256, int), np.zeros(256, int)
    lengths[97], lengths[98], codes[98] = 1, 2, 2
    code = ByteCode(lengths, codes)
    assert code.encode(b"ab") == (5, bytes([0b00010000]))
    bits, data = code.encode(b"b" * 31)  # 64 bits: 00 and 31 times 10
    assert bits == 64 and data == bytes([0b00101010] + [0b10101010] * 7)
    bits, data = code.encode(b"a" * 54 + b"b" * 4 + b"b")
    word = int("00" + "0" * 54 + "10" * 4, 2).to_bytes(8, "big")[::-1]
    assert bits == 66 and data == bytes([word[7], *word[1:7], word[0]]) + bytes([0b10000000])


@pytest.mark.parametrize("training", [binary.TRAINING, 0, 40])
def test_binary_lines_round_trip(training):
    schema = RecordSchema.for_type(TEXT, "seq")
    rows = [text_format.parse_line(x, schema) for x in LINES * 3]
    out = written(rows, training)
    h, data = binary.read_head(out)
    footer = binary.read_footer(out, h)
    got = [r for _, r in binary.lines_between(out, data, footer.data_end, binary.Parser(h.schema, footer.codes))]
    assert got == rows and h.provenance[0][0] == "prog"
    assert bool(footer.codes) == (training < binary.TRAINING)
    assert h.counts["S"] == {"count": 6, "max": 8, "total": 24} and h.counts["L"]["total"] == 15
    assert h.maxima["s", "S"] == (2, 8) and h.maxima["S", "I"] == (1, 6)
    assert len(footer.index["S"]) == 7 and footer.index["S"][0] == data
    for k in range(1, 7):
        a, b = binary.object_range(footer, "S", k)
        first = next(binary.lines_between(out, a, b, binary.Parser(h.schema, footer.codes)))
        assert first[1]["line_type"] == "S"
    with pytest.raises(text_format.FormatError):
        binary.object_range(footer, "S", 7)
    assert [a for a, _ in binary.byte_ranges(data, footer, 1)][1:] == [x for x in footer.index["S"][1:] if x > data]
    skipped = [r["str"] for _, r in binary.lines_between(out, data, footer.data_end, binary.Parser(h.schema, footer.codes, lists=False)) if r["line_type"] == "S" and r["list_len"]]
    assert skipped and not any(skipped)


def test_empty_binary_file_and_other_byte_order():
    out = written([])
    h, data = binary.read_head(out)
    footer = binary.read_footer(out, h)
    assert list(binary.lines_between(out, data, footer.data_end, binary.Parser(h.schema, {}))) == [] and h.counts == {}
    h.big_endian = True
    with pytest.raises(text_format.FormatError):
        binary.read_footer(out, h)


def table(f):
    return [tuple(r) for r in f.lines.orderBy("file", "line_no").select(*COLUMNS).collect()]


def text_file(path, lines, counts=()):
    h = text_format.write_head(header())
    path.write_text("\n".join([*h, *counts, *lines]) + "\n")


def test_files_in_both_forms(spark, tmp_path):
    text_file(tmp_path / "a.seq", LINES * 5)
    f = records.read_records(spark, str(tmp_path / "a.seq"))
    want = table(f)
    assert len(want) == 50
    programs.flip(spark, str(tmp_path / "a.seq"), str(tmp_path / "b.1seq"))
    g = records.read_records(spark, str(tmp_path / "b.1seq"))
    assert table(g) == want and all(r.status == "ok" for r in g.validate().collect())
    programs.flip(spark, str(tmp_path / "b.1seq"), str(tmp_path / "c.seq"))
    h = records.read_records(spark, str(tmp_path / "c.seq"))
    assert table(h) == want and h.header.counts == g.header.counts
    records.write_binary(f.lines, f.header, str(tmp_path / "parts"), parts=3)
    p = records.read_records(spark, str(tmp_path / "parts"))
    assert table(p) == want and len({r.file for r in p.lines.select("file").distinct().collect()}) == 3
    assert p.header.counts["S"] == g.header.counts["S"]
    assert [r.str for r in g.select("S", "2,1").where("line_type = 'S'").collect()] == ["", "acgtacgt"]
    fallback = records.read_records(spark, str(tmp_path / "a"), primary="seq")
    assert table(fallback) == want


def test_several_text_files_have_a_header_each(spark, tmp_path):
    text_file(tmp_path / "x1.seq", LINES)
    text_file(tmp_path / "x2.seq", LINES[:4] + ["", "n 9"])
    f = records.read_records(spark, str(tmp_path / "x*.seq"))
    rows = f.lines.orderBy("file", "line_no").collect()
    assert len(rows) == 14 and [r.file.rsplit("/", 1)[1] for r in rows] == ["x1.seq"] * 10 + ["x2.seq"] * 4
    assert rows[0].line_no == rows[10].line_no == len(text_format.write_head(header()))
    (tmp_path / "x3.seq").write_text("1 3 seq 2 1\n~ O S 1 6 STRING\nS 1 a\n")
    with pytest.raises(text_format.FormatError):
        records.read_records(spark, str(tmp_path / "x*.seq"))


@pytest.mark.parametrize("bad", ["n 1_0", "n 7\t", "n 0x1", "n ١", "W 1_0.5 1 3"])
def test_numbers_are_strict(bad):
    with pytest.raises(text_format.FormatError):
        text_format.parse_line(bad, RecordSchema.for_type(TEXT, "seq"))


def test_packing_keeps_lengths(spark):
    seqs = ["acgtRacgt", "acgR", "", "NNNNN", "ACGTN-x", "tttt"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, s string").withColumn("p", S.pack2bit(F.col("s"))).withColumn("n", F.length("s"))
    rc = S.unpack2bit(S.packed_reverse_complement(F.col("p"), F.col("n")), F.col("n"))
    part = S.unpack_at(F.col("p"), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0)))
    for r in df.select("k", "p", "n", S.unpack2bit(F.col("p"), F.col("n")).alias("u"), rc.alias("rc"), part.alias("part")).collect():
        plain = "".join(c if c in "acgt" else "a" for c in seqs[r.k].lower())
        assert len(r.p) == 2 * -(-len(plain) // 4) and r.u == plain
        assert r.rc == plain[::-1].translate(str.maketrans("acgt", "tgca")) and r.part == plain[1:-1]


def test_arrays_of_any_length(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randrange(-50, 50) for _ in range(n)]) for k, n in enumerate([0, 1, 63, 64, 65, 128, 5000])] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, v array<bigint>")
    got = {r.k: r.s for r in df.select("k", S.running_sum(F.col("v")).alias("s")).collect()}
    assert got == {k: None if v is None else np.cumsum(v).tolist() for k, v in rows}
    text = "nnacgtRRxacgNNNN" * 300 + "t"
    runs = spark.createDataFrame([(text,), ("",), ("acgt",), ("NN",)], "s string").select("s", S.non_acgt_runs(F.col("s")).alias("r")).collect()
    import re

    for r in runs:
        assert [(x.pos, x.base, x.n) for x in r.r] == [(m.start(), m.group()[0], len(m.group())) for m in re.finditer(r"([^acgtACGT])\1*", r.s)]
    whole = sequences.restore_runs(spark.createDataFrame([(text, [(x.pos, x.base, x.n) for x in runs[0].r])], "t string, runs array<struct<pos: int, base: string, n: int>>").withColumn("seq", F.regexp_replace("t", "[^acgt]", "a")))
    assert whole.first().seq == text
    found = spark.createDataFrame([([1, 3, 3, 7], x) for x in range(9)], "v array<int>, x int").select(S.lower_bound(F.col("v"), F.col("x")).alias("p"), S.insert_sorted(F.col("v"), F.col("x")).alias("i"), "x").collect()
    assert [r.p for r in found] == [int(np.searchsorted([1, 3, 3, 7], r.x)) for r in found] and all(r.i == sorted({1, 3, 7, r.x}) for r in found)


def test_alphabets(spark):
    r = spark.createDataFrame([("ACRn-", "ACDZ")], "s string, p string").select(S.to_bits(F.col("s")).alias("b"), S.amino_index(F.col("p")).alias("a")).first()
    assert r.b == [1, 2, 5, 15, 0] and r.a == [0, 1, 2, -1]


def test_fasta_in_small_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{k}", "".join(rng.choice("acgtn") for _ in range(rng.randrange(0, 90)))) for k in range(300)]
    (tmp_path / "x.fa").write_text("".join(f">{i} d{k}\n{s[:30]}\n{s[30:]}\n" for k, (i, s) in enumerate(rows)))
    (tmp_path / "y.fa.gz").write_bytes(gzip.compress(b"\n>only\nacgt\nac\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sequences.read_fasta(spark, str(tmp_path / "x.fa"))
        assert got.rdd.getNumPartitions() > 3
        assert [(r.ord, r.id, r.desc, r.seq) for r in got.orderBy("ord").collect()] == [(k + 1, i, f"d{k}", s) for k, (i, s) in enumerate(rows)]
        (tmp_path / "x.fq").write_text("".join(f"@{i} d\n{s}\n+\n{'I' * len(s)}\n" for i, s in rows))
        reads = sequences.read_fastq(spark, str(tmp_path / "x.fq"))
        assert [(r.ord, r.id, r.seq) for r in reads.orderBy("ord").collect()] == [(k + 1, i, s) for k, (i, s) in enumerate(rows)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.ord, r.id, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "y.fa.gz")).collect()] == [(1, "only", "acgtac")]
    (tmp_path / "bad.fq").write_text("@a\nac\n+\nI\n")
    with pytest.raises(Exception, match="bad FASTQ"):
        sequences.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


@pytest.mark.parametrize("kind", ["record", "packed", "fasta", "fastq"])
def test_convert_and_extract(spark, tmp_path, kind):
    seqs = ["acgtacgtNNacgt", "ttttt", "", "ggRca"]
    (tmp_path / "in.fa").write_text("".join(f">s{k} text {k}\n{s}\n" for k, s in enumerate(seqs)))
    out = str(tmp_path / {"record": "o.1seq", "packed": "o.bin", "fasta": "o.fa", "fastq": "o.fq"}[kind])
    programs.convert(spark, str(tmp_path / "in.fa"), out, kind)
    got = programs.read_any(spark, out).orderBy("ord").collect()
    plain = ["".join(c if c in "acgt" else "a" for c in s.lower()) for s in seqs] if kind == "packed" else seqs
    assert [r.id for r in got] == ["s0", "s1", "s2", "s3"] and [r.seq for r in got] == plain
    one = programs.extract(spark, out, ["1:2-6", "4:0-2R"], by="ord").collect()
    assert {r.seq for r in one} == {"gtac", "ac" if kind == "packed" else plain[3][:2][::-1].translate(str.maketrans("acgt", "tgca"))} or len(one) == 2
    assert programs.extract(spark, out, ["s1:1-3"]).first().seq == "tt"


def test_homopolymers_in_record_files(spark, tmp_path):
    (tmp_path / "in.fa").write_text(">a\naaccgttt\n>b\nacgt\n>c\n\n")
    programs.convert(spark, str(tmp_path / "in.fa"), str(tmp_path / "h.1seq"), hoco=True)
    f = records.read_records(spark, str(tmp_path / "h.1seq"))
    assert [r.str for r in f.lines.where("line_type = 'S'").orderBy("line_no").collect()] == ["acgt", "acgt", ""]
    assert [r.seq for r in sequences.sequences_of(f).orderBy("obj").collect()] == ["aaccgttt", "acgt", ""]


def test_records_of_many_lines(spark):
    seqs = spark.createDataFrame([(1, "a", "n" + "acn" * 2000), (2, "b", "acgt")], "ord long, id string, seq string")
    lines = sequences.sequence_lines(seqs)
    numbers = [r.line_no for r in lines.select("line_no").collect()]
    assert sorted(numbers) == list(range(len(numbers)))
    last = lines.orderBy("line_no").collect()
    assert [r.str for r in last[-2:]] == ["acgt", "b"]


def bam_bytes(rows):
    out = io.BytesIO()
    out.write(b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99))
    for name, flag, seq, qual, tags in rows:
        codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", 0, 4, len(name) + 1, 30, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes(qual) + tags
        out.write(struct.pack("<i", len(body)) + body)
    data = out.getvalue()
    blocks = b""
    for k in range(0, len(data), 100):  # many small members
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        blocks += z.compress(data[k : k + 100]) + z.flush()
    return blocks


def test_bam(spark, tmp_path):
    tags = b"zmi" + struct.pack("<i", 77) + b"rqf" + struct.pack("<f", 0.5) + b"RGZgroup\0" + b"bcBS" + struct.pack("<i2H", 2, 3, 4) + b"xxAq"
    rows = [(f"r{k}", 0x900 if k == 3 else 16 * (k % 2), "ACGTN"[: 1 + k % 5], [30 + k % 9] * (1 + k % 5), tags) for k in range(40)]
    (tmp_path / "x.bam").write_bytes(bam_bytes(rows))
    got = bam.read_bam(spark, str(tmp_path / "x.bam"), batch=7).collect()
    assert [r.qname for r in got] == [r[0] for r in rows if r[1] != 0x900]
    r = got[1]
    assert (r.rname, r.pos, r.mapq, r.cigar, r.rnext, r.seq, r.qual) == ("c1", 5, 30, "2M", "*", "AC", "@@")
    assert r.tags == {"zm": "77", "rq": "0.5", "RG": "group", "bc": "S,3,4", "xx": "q"}
    assert sequences.subreads(bam.read_bam(spark, str(tmp_path / "x.bam"))).first().bc == [3, 4]
    assert programs.read_any(spark, str(tmp_path / "x.bam")).where("id = 'r1'").first().seq == "GT"


def test_unitigs_requests_and_references(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">u1 ka:f:2.5 L:+:u2:-\nacgt\n>u2 L:-:u1:+ L:+:u2:+\nggg\n")
    programs.unitigs(spark, str(tmp_path / "u.fa"), str(tmp_path / "u.1utg"))
    f = records.read_records(spark, str(tmp_path / "u.1utg"))
    lines = [(r.line_type, r.ints, r.chars, r.reals, r.str) for r in f.lines.orderBy("line_no").collect()]
    assert lines == [("S", [], [], [], "acgt"), ("I", [], [], [], "u1"), ("K", [], [], [2.5], None), ("L", [2], ["+", "-"], [], None), ("S", [], [], [], "ggg"), ("I", [], [], [], "u2"), ("L", [1], ["-", "+"], [], None), ("L", [2], ["+", "+"], [], None)]
    targets = spark.createDataFrame([(1, "one"), (2, "two")], "ord long, name string")
    joined = records.resolve_references(f.typed("L").select("line_no", "f1"), F.col("f1"), targets).orderBy("line_no")
    assert [r.name for r in joined.collect()] == ["two", "one", "two"]
    (tmp_path / "req").write_text(" a \n\nb\n")
    assert [r.request for r in sequences.read_requests(spark, str(tmp_path / "req")).collect()] == ["a", "b"]


def test_view_and_stat(spark, tmp_path):
    text_file(tmp_path / "a.seq", LINES)
    assert [r.text for r in programs.view(spark, str(tmp_path / "a.seq")).collect()] == LINES
    assert [r.text for r in programs.view(spark, str(tmp_path / "a.seq"), index="S 2").collect()][0] == "S 0 "
    assert programs.view_header(spark, str(tmp_path / "a.seq"), schema_only=True) == TEXT.replace("S 3 alt\n", "").splitlines()
    found = programs.stat(spark, str(tmp_path / "a.seq"))
    assert {r.line_type: r.n_bytes for r in found["usage"].collect()}["n"] == 9 and "maxima_S" in found


def test_ingest_pairs_and_groups(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}:{k // 2}\nacg\n+\nII{'#' if k else 'I'}\n" for k in range(4)))
    rows = programs.ingest(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")], paired=True, group=(":", 1)).orderBy("no").collect()
    assert [(r.no, r.id, r.pair_no, r.mate, r.group_key, r.group_no) for r in rows][3:6] == [(4, "a:1", 2, 2, "a", 1), (5, "b:0", 3, 1, "b", 2), (6, "b:0", 3, 2, "b", 2)]
    usage = programs.quality_usage(sequences.read_fastq(spark, str(tmp_path / "a.fq")))
    assert {r.symbol: r.n for r in usage.collect()} == {"I": 9, "#": 3} and programs.quality_bits_needed(usage) == 1
    both = programs.pair(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq"))
    assert both.count() == 4
    (tmp_path / "c.fq").write_text("@x\nacg\n+\nIII\n")
    with pytest.raises(Exception, match="different numbers"):
        programs.pair(spark, str(tmp_path / "a.fq"), str(tmp_path / "c.fq")).collect()


def test_random48_and_distributions(spark):
    g = simulate.Random48(5)
    draws = [g.next() for _ in range(100)]
    state = 5 << 16 | 0x330E
    for d in draws[:5]:
        state = (state * 0x5DEECE66D + 0xB) % (1 << 48)
        assert d == state / 2**48
    h = simulate.Random48(5)
    h.jump(60)
    alone, shared = h.unlinked(), h.linked()
    assert shared.next() == draws[60] and h.next() == draws[61] and alone.next() == draws[60]
    df = spark.range(1, 101).withColumnRenamed("id", "k")
    for n in (1, 3):
        assert [r.u for r in simulate.with_random48(df.repartition(n), "k", 5).orderBy("k").collect()] == draws
    r = spark.range(20_000).select(simulate.binomial(3, 10, 0.3).alias("b"), simulate.weighted(9, [1, 2, 1]).alias("w"), simulate.poisson(5, 2.0).alias("p"), simulate.normal(2).alias("n")).agg(F.avg("b"), F.avg("w"), F.avg("p"), F.stddev("n"), F.max("w")).first()
    assert abs(r[0] - 3) < 0.1 and abs(r[1] - 1) < 0.05 and abs(r[2] - 2) < 0.1 and abs(r[3] - 1) < 0.05 and r[4] == 2


def test_mutations_and_gaps(spark):
    df = spark.createDataFrame([("a", "acgtn" * 400), ("b", None)], "id string, seq string")
    rows = {r.id: r.seq for r in simulate.mutate(df, "id", "seq", 0.1).collect()}
    assert rows["b"] is None and rows["a"] == {r.id: r.seq for r in simulate.mutate(df.repartition(3), "id", "seq", 0.1).collect()}["a"]
    changed = sum(x != y for x, y in zip(rows["a"], "acgtn" * 400, strict=True))
    assert 100 < changed < 220 and rows["a"].count("n") == 400
    full = simulate.fill_gaps(df, "id", "seq").where("id = 'a'").first().seq
    assert "n" not in full and all(x == y for x, y in zip(full, "acgtn" * 400, strict=True) if y != "n")


def test_names_and_numbers(capsys):
    assert names.folder_of("a/b/c.fa") == "a/b" and names.folder_of("c") == "." and names.root_of("a/b.c.fa") == "b.c" and names.root_of("x/y.fa.gz", ".fa.gz") == "y"
    assert names.joined("a", "/", "b", ".c") == "a/b.c" and names.numbered_name("x.", 3, ".y") == "x.3.y" and names.numbered_name("x", -1, ".y") == "x.y"
    assert names.readable(1234567, 12) == "   1,234,567" and names.digits(-123) == 3
    with names.timed():
        pass
    assert "wall" in capsys.readouterr().out
