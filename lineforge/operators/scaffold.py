"""Scaffolds: breaking at runs of non-ACGT letters, joining again, fragments."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lineforge.functions import sequence as S


_CONTIG = StructType([StructField("at", IntegerType()), StructField("parts", StringType())])


def _contigs(threshold: int):
    """array<struct<at, parts>> of the stretches of acgt, over gaps that are shorter than ``threshold``.

    A regular expression for them would go a level deeper at each gap, which long sequences don't survive.
    """

    @F.arrow_udf(ArrayType(_CONTIG))
    def cut(seq: pa.Array) -> pa.Array:
        places, parts = [], []
        for text in seq.to_pylist():
            if text is None:
                places.append(None)
                continue
            starts, ends = S.run_bounds(np.isin(S.letters(text), S.BASES))
            if len(starts):
                k = 0 if text[0] in "acgtACGT" else 1  # stretches and gaps alternate
                starts, ends = starts[k::2], ends[k::2]
            wide = starts[1:] - ends[:-1] >= threshold
            a, b = starts[np.concatenate([[True], wide])[: len(starts)]], ends[np.concatenate([wide, [True]])[: len(ends)]]
            places.append(a)
            parts += [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        return S.lists(places, pa.StructArray.from_arrays([pa.array(S.joined(places, np.int32)), pa.array(parts, pa.string())], ["at", "parts"]))

    return cut


def scaffold_break(seqs: DataFrame, key: str, seq: Column, threshold: int = 20) -> DataFrame:
    """(key, contig, id, pos, seq): contigs between gaps of at least ``threshold``; end gaps of any length go. ``pos`` from 0."""
    placed = seqs.select(key, _contigs(threshold)(seq).alias("c")).select(key, F.posexplode("c").alias("k", "c"))
    return placed.select(key, (F.col("k") + 1).alias("contig"), F.concat_ws(".", F.col(key).cast("string"), (F.col("k") + 1).cast("string")).alias("id"), F.col("c.at").cast("int").alias("pos"), F.col("c.parts").alias("seq"))


def scaffold_join(contigs: DataFrame, key: str, lengths: DataFrame, gap: str = "n") -> DataFrame:
    """(key, seq): contigs at their places, every gap as ``gap`` letters. ``lengths``: (key, length)."""
    one = contigs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("parts"))
    both = lengths.join(one, key, "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<pos: int, seq: string>>")))
    end = lambda p: F.coalesce(p["pos"] + F.length(p["seq"]), F.lit(0))
    gaps = lambda n: F.repeat(F.lit(gap), n.cast("int"))
    pieces = F.transform("parts", lambda p, i: F.concat(gaps(p["pos"] - F.when(i > 0, end(F.get(F.col("parts"), i - 1))).otherwise(0)), p["seq"]))
    last = F.col("length") - F.coalesce(end(F.try_element_at("parts", F.lit(-1))), F.lit(0))
    return both.select(key, F.concat(F.array_join(pieces, ""), gaps(last)).alias("seq"))


@dataclass(frozen=True)
class Fragment:
    key: str
    start: int
    end: int
    rc: bool


_SPEC = re.compile(r"(?P<key>(?:\\:|[^:])+)(?::(?:(?P<start>\d+)-(?P<end>\d*))?(?P<rc>R?))?$")


def parse_fragment(text: str) -> Fragment:
    """``id[:start-[end]][R]``; a colon in an id is written ``\\:``; ``id:R`` is the whole, reverse-complemented."""
    m = _SPEC.match(text.strip())
    if not m or (m["start"] is None and ":" in text.replace("\\:", "") and not m["rc"]):
        raise ValueError(f"not a fragment: {text!r}")
    start, end = int(m["start"] or 0), int(m["end"] or 0)
    if end and end < start:
        raise ValueError(f"fragment ends before it starts: {text!r}")
    return Fragment(m["key"].replace("\\:", ":"), start, end, m["rc"] == "R")


def by_ordinal(fragments: DataFrame) -> DataFrame:
    """Requests whose key is a record's ordinal, in the order of ordinals and places."""
    return fragments.withColumn("key", F.col("key").cast("long")).orderBy("key", "start", "end")


def extract(seqs: DataFrame, fragments: DataFrame, on: str, label: Column, seq: Column) -> DataFrame:
    """(on, label, seq) of (key, start, end, rc) requests; reverse-complemented ones have coordinates of the reverse strand.

    The requests are the small side; Spark broadcasts them while their size allows.
    """
    rows = seqs.join(fragments, F.col(on).cast("string") == F.col("key"))
    n = F.length(seq)
    end = F.when((F.col("end") == 0) | (F.col("end") > n), n).otherwise(F.col("end"))
    a, b = F.when(F.col("rc"), n - end).otherwise(F.col("start")), F.when(F.col("rc"), n - F.col("start")).otherwise(end)
    source = F.when(F.col("rc"), S.reverse_complement(seq)).otherwise(seq)
    piece = F.substring(source, (a + 1).cast("int"), F.greatest((b - a).cast("int"), F.lit(0)))
    return rows.select(on, S.fragment_label(label.cast("string"), a, b, F.col("rc")).alias("label"), piece.alias("seq"))
