"""Schemas, the text format, codecs and the filter language, without Spark."""

import random

import pytest
from lineforge.operators import filterexpr, ordinals, scaffold
from lineforge.sources import codec, text_format
from lineforge.sources.schema import RecordSchema, SchemaError

TEXT = """P 3 seq
S 3 alt
O s 2 3 INT 6 STRING a scaffold
G S 0
D n 1 3 INT
O S 1 3 DNA
D I 1 6 STRING
D N 3 3 INT 4 CHAR 3 INT
D W 2 4 REAL 8 INT_LIST
D R 1 9 REAL_LIST
D L 1 11 STRING_LIST
"""


def test_schema_round_trip_and_containment():
    schema = RecordSchema.for_type(TEXT, "alt")
    assert schema.text() == TEXT
    assert schema.contains() == {"s": {"S", "n", "I", "N", "W", "R", "L"}, "S": {"I", "N", "W", "R", "L"}}
    assert schema.mismatches(RecordSchema.for_type("P 3 seq\nO S 1 6 STRING\n", "seq")) != []
    assert schema.mismatches(RecordSchema.for_type("P 3 seq\nO Z 1 3 INT\n", "seq"), required=True) == ["line type Z is missing"]


@pytest.mark.parametrize("bad", ["O S 1 4 DNA", "O S 2 3 DNA 6 STRING", "D I 1 3 INT", "O S 1 3 INT\nD S 1 3 INT", "X S 0"])
def test_bad_definitions(bad):
    with pytest.raises(SchemaError):
        RecordSchema.parse("P 3 seq\n" + bad)


LINES = ["s 20 5 scaf1", "n -2", "S 8 acgtacgt a comment", "S 0 ", "I 6 ü b c", "N 4 x 9223372036854775807", "W 0.1 3 1 -5 9", "R 2 1.5 -2.25", "L 3 1 a 4 b cd 0 ", "n 4"]


@pytest.mark.parametrize("line", LINES)
def test_lines_round_trip(line):
    schema = RecordSchema.for_type(TEXT, "seq")
    row = text_format.parse_line(line, schema)
    assert text_format.write_line(row, schema) == line
    if row["line_type"] == "I":
        assert row["list_len"] == 6


@pytest.mark.parametrize("bad", ["Q 1", "n", "n x", "n 1x", "n  1", "S 9 acgt", "N 1 xy 2", "n 9223372036854775808", "n 1\t2"])
def test_bad_lines(bad):
    with pytest.raises(text_format.FormatError):
        text_format.parse_line(bad, RecordSchema.for_type(TEXT, "seq"))


def test_header_round_trip():
    schema = RecordSchema.for_type(TEXT, "seq")
    h = text_format.Header("seq", "alt", schema=schema)
    h.add_provenance("prog", "1.0", "prog -x a b", "2024-01-01_00:00:00")
    h.references.append(("other file", 7))
    h.deferred.append("later")
    h.text.append("some text")
    h.counts = {"S": {"count": 2, "max": 8, "total": 14}, "n": {"count": 1}}
    h.maxima = {("s", "S"): (2, 14), ("s", "n"): (1, 0)}
    back = text_format.parse_header(text_format.write_header(h))
    assert (back.primary, back.subtype, back.provenance, back.references, back.deferred, back.text) == ("seq", "alt", h.provenance, h.references, h.deferred, h.text)
    assert back.counts == h.counts and back.maxima == h.maxima and back.schema.definitions == schema.definitions
    child = text_format.Header("seq").add_provenance("next", "2", "next", "d").inherit(back)
    assert [p[0] for p in child.provenance] == ["prog", "next"]


def test_header_errors():
    for bad in (["1 3 seq 3 0"], ["1 3 seq 2 9"], ["1 3 seq 2 1", "# Q 4"], ["? x"]):
        with pytest.raises(text_format.FormatError):
            text_format.parse_header(bad)


def test_integer_codec():
    edges = [0, 1, 63, 64, 8191, 8192, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 1 << 32, (1 << 56) - 1, 1 << 56, (1 << 63) - 1]
    for v in [*edges, *(-e - 1 for e in edges)]:
        data = codec.put_int(v)
        assert codec.get_int(data + b"\xaa" * 9) == (v, len(data))
    assert [len(codec.put_int(v)) for v in (63, 64, 8192, 65536, -64, -65, 1 << 62)] == [1, 2, 3, 4, 1, 3, 9]


def test_list_and_dna_codecs():
    rng = random.Random(1)
    for _ in range(200):
        v = [rng.randrange(-(10 ** rng.randrange(1, 15)), 10 ** rng.randrange(1, 15)) for _ in range(rng.randrange(0, 9))]
        width, data = codec.pack_ints(v)
        assert codec.unpack_ints(width, data, len(v)).tolist() == v
        s = "".join(rng.choice("acgt") for _ in range(rng.randrange(0, 19)))
        assert codec.unpack_dna(codec.pack_dna(s), len(s)) == s
    assert codec.pack_dna("acgtc") == bytes([0b11100100, 1]) and codec.unpack_dna(codec.pack_dna("nacX"), 4) == "aaca"


def test_filter_language():
    assert filterexpr.parse("zm<1 || ln>2 && rq==3") == ("or", ("<", "zm", 1), ("and", (">", "ln", 2), ("==", "rq", 3)))
    assert filterexpr.parse("(zm<1||ln>2)&&rq!=3")[0] == "and"
    assert filterexpr.variables_of(filterexpr.parse(filterexpr.DEFAULT)) == {"ln", "rq"}
    for bad in ("", "zm", "zm<", "zm<1 x", "foo<1", "(zm<1", "zm<1)", "zm<-1", "zm=1", "zm<1 &&"):
        with pytest.raises(filterexpr.FilterError):
            filterexpr.parse(bad)


def test_requests():
    assert ordinals.parse_ranges("3,5,9-12") == [(3, 4), (5, 6), (9, 12)]
    assert scaffold.parse_fragment(r"a\:b:3-7R") == scaffold.Fragment("a:b", 3, 7, True)
    assert scaffold.parse_fragment("x:R") == scaffold.Fragment("x", 0, 0, True)
    assert scaffold.parse_fragment("x:5-") == scaffold.Fragment("x", 5, 0, False)
    for bad in ("3-1", "x", "5-5"):
        with pytest.raises(ValueError):
            ordinals.parse_ranges(bad)
    with pytest.raises(ValueError):
        scaffold.parse_fragment("x:9-3")
