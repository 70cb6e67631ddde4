"""Barcodes: counts, correction of single substitutions, and read clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE, TRIM = 16, 23


def code_counts(reads: DataFrame, code: str = "code") -> DataFrame:
    return reads.groupBy(code).agg(F.count("*").alias("n"))


def count_histogram(counts: DataFrame) -> DataFrame:
    """(bin, codes, reads): counts 1 to 49 singly, to 999 by tens, above pooled."""
    bin_ = F.when(F.col("n") < 50, F.col("n")).when(F.col("n") < 1000, F.expr("n div 10 * 10")).otherwise(1000)
    return counts.groupBy(bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("codes"), F.sum("n").alias("reads"))


def neighbours(code: Column, length: int, alphabet: str = "acgt") -> Column:
    """All codes with exactly one substituted letter."""
    out = []
    for i in range(length):
        head, here, tail = F.substring(code, 1, i), F.substring(code, i + 1, 1), F.substring(code, i + 2, length)
        out += [F.when(here != c, F.concat(head, F.lit(c), tail)) for c in alphabet]
    return F.array_compact(F.array(*out))


def corrections(valid: DataFrame, length: int, alphabet: str = "acgt") -> DataFrame:
    """(code, fixed): codes that are no valid code and one substitution from exactly one."""
    near = valid.select(F.col("code").alias("fixed"), F.explode(neighbours(F.col("code"), length, alphabet)).alias("code"))
    unique = near.groupBy("code").agg(F.count("*").alias("n"), F.min("fixed").alias("fixed")).where("n = 1")
    return unique.join(valid.select("code"), "code", "left_anti").select("code", "fixed")


def correct(reads: DataFrame, threshold: int, length: int = CODE, alphabet: str = "acgt") -> DataFrame:
    """``reads`` with status (valid, repaired, dropped) and corrected code.

    Decisions are made on distinct codes, so a frequent code is one row until the last join.
    """
    counts = code_counts(reads)
    valid = counts.where(F.col("n") >= threshold).select("code")
    fixes = corrections(valid, length, alphabet)
    known = counts.select("code").join(valid.withColumn("ok", F.lit(True)), "code", "left").join(fixes, "code", "left")
    verdict = known.select("code", F.when(F.col("ok"), "valid").when(F.col("fixed").isNotNull(), "repaired").otherwise("dropped").alias("status"), F.when(F.col("ok"), F.col("code")).otherwise(F.col("fixed")).alias("corrected"))
    return reads.join(verdict, "code")


def totals(corrected: DataFrame) -> DataFrame:
    """(status, reads, percent)."""
    each = corrected.groupBy("status").agg(F.count("*").alias("reads"))
    return each.select("status", "reads", F.expr("round(reads * 100.0D / sum(reads) over (), 4)").alias("percent"))


def clouds(corrected: DataFrame, read: Column, trim: int = TRIM) -> DataFrame:
    """(code, read): kept reads without their first ``trim`` letters, grouped by corrected code."""
    kept = corrected.where("status != 'dropped'")
    return kept.select(F.col("corrected").alias("cloud"), F.substring(read, trim + 1, 1 << 30).alias("trimmed"), *[c for c in corrected.columns if c not in ("corrected", "status")])
