"""Exact deduplication by content-defined chunk recipes.

Texts are cut into chunks where a rolling gear hash says so. Chunk digests (64-bit, verified against SHA-256) get one
identifier for each distinct chunk; two documents are equal when their ordered identifier lists are. Texts themselves are
read once and never moved: what is shuffled are digests and identifier lists.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import boundaries
from .common import arrow_map, numbered, raw_texts, renamed, written

RECIPES = "doc_id long, text_sha256 string, n_bytes long, chunks array<struct<h: long, sha: binary>>"


def recipes(docs: DataFrame, bits: int = 12, least: int = 1024, most: int = 16384) -> DataFrame:
    """One row a document: its digest, length and ordered chunk digests. Null text counts as empty."""

    def make():
        def f(batch: pa.RecordBatch):
            sha, sizes, hs, shas, offsets = [], [], [], [], [0]
            for x in raw_texts(batch.column("text")):
                sha.append(hashlib.sha256(x).hexdigest())
                sizes.append(len(x))
                start = 0
                for end in boundaries(x, bits, least, most):
                    piece = x[start:end]
                    hs.append(xxhash.xxh64_intdigest(piece) - (1 << 63))
                    shas.append(hashlib.sha256(piece).digest())
                    start = end
                offsets.append(len(hs))
            chunk = pa.StructArray.from_arrays([pa.array(hs, pa.int64()), pa.array(shas, pa.binary())], ["h", "sha"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sha, pa.string()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_sha256", "n_bytes", "chunks"]
            )

        return f

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, RECIPES)


def verified_ids(occurrences: DataFrame) -> DataFrame:
    """(h, sha, ord): distinct chunks, numbered among those that share a 64-bit digest (almost always 1).

    (h, ord) then names a chunk's bytes: equal identifiers mean equal SHA-256.
    """
    distinct = occurrences.groupBy("h", "sha").agg(F.count("*").alias("copies"))
    return distinct.groupBy("h").agg(F.array_sort(F.collect_set("sha")).alias("shas")).select("h", F.posexplode("shas").alias("ord", "sha"))


def _groups(docs: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    """(doc_id, text, rows, keep_id, group_size): for every doc_id and text digest its rows, and what holds for equal texts."""
    table = written(recipes(docs, bits, least, most), "recipes")
    occurrences = table.select("doc_id", F.unhex("text_sha256").alias("text"), F.posexplode("chunks").alias("seq", "c")).select("doc_id", "text", "seq", "c.h", "c.sha")
    ids = written(verified_ids(occurrences), "chunk-ids")
    lists = (
        occurrences.join(ids, ["h", "sha"])
        .groupBy("doc_id", "text")
        .agg(F.array_sort(F.collect_set(F.struct("seq", "h", "ord"))).alias("l"), F.count(F.when(F.col("seq") == 0, 1)).alias("rows"))
        .select("doc_id", "text", "rows", F.transform("l", lambda x: F.struct(x["h"].alias("h"), x["ord"].alias("ord"))).alias("recipe"))
    )
    lists = written(lists, "lists")
    groups = written(lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    return lists.join(groups, "recipe")


def exact_duplicates(docs: DataFrame, bits: int = 12, least: int = 1024, most: int = 16384) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for every row of ``docs``.

    Of equal texts the row with the largest doc_id stays; of rows that repeat that doc_id one stays. A row without doc_id
    stays only where no row of its group has one. Null text equals empty text. An empty table gives an empty result; other
    columns of ``docs``, whatever their names, are ignored. Of long texts only chunk digests are moved.
    """
    out = _groups(docs, bits, least, most).select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("text")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, bits: int = 12, least: int = 1024, most: int = 16384) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops; columns, whatever their names, unchanged.

    Where rows repeat a doc_id and a text, the least of them by all columns stays. An empty table stays empty.
    """
    groups = _groups(docs, bits, least, most).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = written(groups.select(F.col("doc_id").alias("id"), F.col("text").alias("sha"), "rows"), "kept")
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    digest = F.unhex(F.sha2(F.coalesce(at["text"].cast("string"), F.lit("")).cast("binary"), 256))
    rows = numbered(docs).select("*", at["doc_id"].cast("long").alias("own_id"), digest.alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha"))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    once = rows.join(kept.where("rows = 1"), same, "left_semi").select(columns)
    again = rows.join(kept.where("rows > 1"), same, "left_semi")
    least_row = again.groupBy("own_id", "own_sha").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    return renamed(once.union(least_row), docs.columns)
