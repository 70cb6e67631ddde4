"""Column functions on sequences, as text, in whole-stage code where Spark has it; folds along a sequence in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# fixed values: IUPAC codes, their complements (S and W swap), and the base that stands for each
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
IUPAC_COMPLEMENT = "TGCAAKYSWRMBDHVNtgcaakyswrmbdhvn"
IUPAC_BASE = "acgtaaaaccgaaacaacgtaaaaccgaaaca"
# fixed values: code points of bases, and of what ``.`` doesn't match in Java's regular expressions
BASES = np.frombuffer(b"acgtACGT", np.uint8)
_LINE_ENDS = np.array([0x0A, 0x0D, 0x85, 0x2028, 0x2029], np.uint32)


def dna_projection(text: Column) -> Column:
    """Lower-cased letters a, c, g, t and n of a text."""
    return F.regexp_replace(F.lower(text), "[^acgtn]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, IUPAC_COMPLEMENT))


def complement_codes(codes: Column) -> Column:
    """Reverse complement of numeric codes 0 to 3."""
    return F.transform(F.reverse(codes), lambda x: 3 - x)


def homopolymer_compress(seq: Column) -> Column:
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def runs(seq: Column) -> Column:
    """array<string>: the maximal runs of equal characters."""
    return F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))


def run_lengths(seq: Column) -> Column:
    return F.transform(runs(seq), F.length)


@F.arrow_udf(ArrayType(LongType()))
def _running_sum(values: pa.Array) -> pa.Array:
    out = []
    for v in values:
        x = v.values
        if x is None:
            out.append(None)
            continue
        sums = np.cumsum(x.fill_null(0).to_numpy(zero_copy_only=False))
        known = len(x) if not x.null_count else int(np.flatnonzero(x.is_null().to_numpy(zero_copy_only=False))[0])
        out.append(sums if known == len(x) else [*sums[:known].tolist(), *[None] * (len(x) - known)])
    return pa.array(out, pa.list_(pa.int64()))


def running_sum(values: Column) -> Column:
    """array<bigint>: prefix sums, null from the first null on; in Arrow batches, as a fold in Spark copies what it has at each step."""
    return _running_sum(values.cast("array<bigint>"))


def letters(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def run_bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of equal values."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return (np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]])) if len(x) else (cuts, cuts)


def lists(parts: list[np.ndarray | None], values: pa.Array) -> pa.Array:
    """Lists of as many of ``values`` as each part has; null for None."""
    sizes = np.array([0 if p is None else len(p) for p in parts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    offsets = pa.array(ends, pa.int32(), mask=np.array([*[p is None for p in parts], False]))
    return pa.ListArray.from_arrays(offsets, values)


def joined(parts: list[np.ndarray | None], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[p for p in parts if p is not None]]).astype(kind)


@F.arrow_udf(ArrayType(LongType()))
def _run_ends(seq: pa.Array) -> pa.Array:
    out = []
    for text in seq.to_pylist():
        if text is None:
            out.append(None)
            continue
        x = letters(text)
        starts, ends = run_bounds(x)
        lines = np.isin(x[starts], _LINE_ENDS)
        out.append(np.cumsum((ends - starts)[~lines]) if lines.any() else ends)
    return lists(out, pa.array(joined(out, np.int64)))


def run_ends(seq: Column) -> Column:
    """Where each run of equal characters ends, counted in characters from the start; line ends aren't counted, as in ``runs``."""
    return _run_ends(seq)


def deltas(values: Column) -> Column:
    """First value, then differences of neighbours."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def undeltas(values: Column) -> Column:
    return running_sum(values)


@F.arrow_udf(StringType())
def _expand(compressed: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, e in zip(compressed.to_pylist(), ends, strict=True):
        if text is None or e.values is None:
            out.append(None)
            continue
        x, n = letters(text), np.diff(e.values.to_numpy(zero_copy_only=False), prepend=0)
        k = min(len(x), len(n))
        whole = np.repeat(x[:k], np.maximum(n[:k], 0))
        out.append(whole.tobytes().decode("ascii" if x.itemsize == 1 else "utf-32-le"))
    return pa.array(out, pa.string())


def homopolymer_expand(compressed: Column, ends: Column) -> Column:
    """Inverse of compression, from run ends."""
    return _expand(compressed, ends.cast("array<bigint>"))


def base_count(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))).cast("bigint")


_RUN = StructType([StructField("pos", IntegerType()), StructField("base", StringType()), StructField("n", IntegerType())])


@F.arrow_udf(ArrayType(_RUN))
def _other_runs(seq: pa.Array) -> pa.Array:
    places, bases, sizes = [], [], []
    for text in seq.to_pylist():
        if text is None:
            for k in (places, bases, sizes):
                k.append(None)
            continue
        x = letters(text)
        starts, ends = run_bounds(x)
        own = ~np.isin(x[starts], BASES)
        places.append(starts[own])
        bases.append(x[starts[own]])
        sizes.append((ends - starts)[own])
    base = pa.array([chr(c) for c in joined(bases, np.int64).tolist()], pa.string())
    return lists(places, pa.StructArray.from_arrays([pa.array(joined(places, np.int32)), base, pa.array(joined(sizes, np.int32))], ["pos", "base", "n"]))


def non_acgt_runs(seq: Column) -> Column:
    """array<struct<pos, base, n>> of runs of one character other than a, c, g, t."""
    return _other_runs(seq)


def fragment(seq: Column, start: Column, end: Column) -> Column:
    """0-based half-open interval; end 0 or beyond the sequence means its end."""
    stop = F.when((end == 0) | (end > F.length(seq)), F.length(seq)).otherwise(end)
    return F.substring(seq, (start + 1).cast("int"), F.greatest((stop - start).cast("int"), F.lit(0)))


def fragment_label(key: Column, start: Column, end: Column, rc: Column) -> Column:
    return F.concat(key, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.when(rc, F.lit("R")).otherwise(F.lit("")))


def pack2bit(seq: Column) -> Column:
    """Hex of the little-endian 2-bit packing, four bases a byte; others than c, g, t pack as a."""
    codes = F.regexp_replace(F.translate(seq, "cgtCGT", "123123"), "[^123]", "0")
    padded = F.concat(codes, F.repeat(F.lit("0"), F.pmod(-F.length(codes), F.lit(4))))
    fours = F.regexp_extract_all(padded, F.lit("[0-3]{4}"), F.lit(0))
    return F.array_join(F.transform(fours, lambda x: F.lpad(F.conv(F.reverse(x), 4, 16), 2, "0")), "")


def unpack2bit(packed_hex: Column, length: Column) -> Column:
    """Lower-case bases of ``pack2bit`` text."""
    twos = F.regexp_extract_all(packed_hex, F.lit("[0-9A-F]{2}"), F.lit(0))
    text = F.array_join(F.transform(twos, lambda x: F.reverse(F.lpad(F.conv(x, 16, 4), 4, "0"))), "")
    return F.substring(F.translate(text, "0123", "acgt"), F.lit(1), length)


def packed_reverse_complement(packed_hex: Column, length: Column) -> Column:
    """The packing of the reverse complement of ``length`` packed bases."""
    return pack2bit(reverse_complement(unpack2bit(packed_hex, length)))


def unpack_at(packed_hex: Column, start: Column, length: Column, reverse: bool = False) -> Column:
    """``length`` bases from base ``start`` (0-based) of packed DNA; only the bytes that hold them are unpacked."""
    byte = F.floor(start / 4).cast("int")
    n = F.floor((start + length + 3) / 4).cast("int") - byte
    inside = F.substring(packed_hex, byte * 2 + 1, n * 2)
    out = F.substring(unpack2bit(inside, n * 4), (start - byte * 4 + 1).cast("int"), length.cast("int"))
    return reverse_complement(out) if reverse else out


def packed_match(a_hex: Column, a_start: Column, b_hex: Column, b_start: Column, length: Column) -> Column:
    """0 where ``length`` bases from two places of packed DNA are equal, else the 1-based place of the first difference."""
    return match_position(unpack_at(a_hex, a_start, length), unpack_at(b_hex, b_start, length))


def match_position(a: Column, b: Column) -> Column:
    """0 where equal, else the 1-based place of the first difference."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(same, False).cast("int")


def quality_bits(quals: Column, threshold: int) -> Column:
    """'0'/'1' text: whether each quality reaches the threshold."""
    return F.array_join(F.transform(quals, lambda q: F.when(q >= threshold, "1").otherwise("0")), "")


def quality_values(text: Column, offset: int = 33) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)).otherwise(F.array().cast("array<int>"))


def quality_text(values: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(values, lambda v: F.char(v + offset)), "")


def to_index(seq: Column) -> Column:
    """Codes 0 to 3 for a, c, g, t and 4 for other letters."""
    digits = F.translate(F.lower(seq), "acgtu", "01233")
    return F.transform(F.split(F.regexp_replace(digits, "[^0-3]", "4"), ""), lambda x: x.cast("int"))


def ambiguity_to_n(seq: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, "[MRWSYKVHDBU]", "N"), "[mrwsykvhdbu]", "n")


def drop_ambiguity(seq: Column) -> Column:
    """Only a, c, g, t and n, in either case; other codes are deleted."""
    return F.regexp_replace(seq, "[^acgtnACGTN]", "")


def iupac_to_acgt(seq: Column) -> Column:
    """Every code as a lower-case base that it stands for."""
    return F.translate(seq, IUPAC, IUPAC_BASE)


def amino_only(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^A-Z*-]", "")


def varint_size(value: Column) -> Column:
    """Bytes of a stored integer: one up to 63 either way, two up to 8191 for non-negatives, else one and its significant bytes."""
    size = F.lit(9)
    for n in range(7, 1, -1):
        top = 1 << (8 * n)
        size = F.when((value >= -top) & (value < top), n + 1).otherwise(size)
    return F.when((value >= -64) & (value < 64), 1).when((value >= 0) & (value < 8192), 2).otherwise(size)


def delta_width(values: Column) -> Column:
    """Fewest bytes, 1 to 8, that hold every delta as a signed integer."""
    d = F.transform(values, lambda x, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(x - F.get(values, i - 1)))
    magnitude = F.coalesce(F.array_max(F.transform(d, lambda x: F.when(x >= 0, x).otherwise(-x - 1))), F.lit(0).cast("bigint"))
    width = F.lit(8)
    for n in range(7, 0, -1):
        width = F.when(magnitude < (1 << (8 * n - 1)), n).otherwise(width)
    return width


# fixed values: the 4-bit code of each IUPAC letter, with a bit for each base it stands for
IUPAC_BITS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15}
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def to_bits(seq: Column) -> Column:
    """4-bit codes: a bit for each base that a letter stands for; 0 for other characters."""
    code = F.create_map(*[F.lit(x) for k, v in IUPAC_BITS.items() for x in (k, v)])
    return F.transform(F.split(F.upper(seq), ""), lambda c: F.coalesce(F.try_element_at(code, c), F.lit(0)))


def amino_index(seq: Column) -> Column:
    """Places of amino acids in the alphabet of twenty, -1 for others."""
    return F.transform(F.split(F.upper(seq), ""), lambda c: F.instr(F.lit(AMINO), c) - 1)


def lower_bound(values: Column, x: Column) -> Column:
    """Place from 0 of the first element of a sorted array that is not under ``x``; the array's size where there is none."""
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(values, mid) < x
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda s: s["lo"])


def insert_sorted(values: Column, x: Column) -> Column:
    """A sorted array with ``x``, once."""
    return F.array_sort(F.array_union(values, F.array(x)))


def group_prefix(name: Column, char: str, k: int) -> Column:
    """A name up to the k-th occurrence of a character; the whole name where it has fewer."""
    return F.substring_index(name, char, k)


def length_bin(length: Column) -> Column:
    return F.floor(10 * F.sqrt(length)).cast("int")
