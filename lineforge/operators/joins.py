"""Joins that the record tools make implicitly: by position, by ordinal, by interval, and adjacent pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_previous, with_running


def zip_join(left: DataFrame, right: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Inner join by ordinal that fails where one side has an ordinal that the other has not."""
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, F.col(f"l.{ordinal}") == F.col(f"r.{ordinal}"), "full")
    ok = F.col(f"l.{ordinal}").isNotNull() & F.col(f"r.{ordinal}").isNotNull()
    checked = both.where(F.assert_true(ok, F.lit("the two sides have different numbers of records")).isNull())
    return checked.select(F.col(f"l.{ordinal}").alias(ordinal), *[F.col(f"l.{c}") for c in left.columns if c != ordinal], *[F.col(f"r.{c}") for c in right.columns if c != ordinal])


def lookup(facts: DataFrame, table: DataFrame, on: Column, keep: Sequence[str]) -> DataFrame:
    """Left join to a table of attributes by ordinal; only the wanted columns travel."""
    return facts.join(table, on, "left").select(*facts.columns, *keep)


def interval_lookup(points: DataFrame, boundaries: DataFrame, order: str, start: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add to each point the ``name`` of the last boundary at or before it: one union and running maxima, no range join."""
    p = points.select(*by, F.col(order).alias("_at"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("string").alias("_name"))
    b = boundaries.select(*by, F.col(start).alias("_at"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(name).cast("string").alias("_name"))
    both = p.unionByName(b)
    mark = F.when(F.col("_name").isNotNull(), F.struct(F.col("_at"), F.col("_name")))
    out = with_running(both.withColumn("_kind", F.col("_name").isNull().cast("int")), "_at", maxima={"_last": mark}, by=by, ties=("_kind",))
    return out.where("_row is not null").select("_row.*", F.col("_last._name").alias(name))


def prefix_groups(records: DataFrame, name: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``group_no``, which grows where the group key differs from that of the record before; compares whole keys."""
    keyed = with_previous(records.withColumn("group_key", F.coalesce(name, F.lit("\0"))), order, "group_key", "_before", by)
    changed = keyed.withColumn("_new", (~F.col("_before").eqNullSafe(F.col("group_key"))).cast("int"))
    out = with_running(changed, order, {"group_no": F.col("_new")}, by=by).drop("_new", "_before")
    return out.withColumn("group_key", F.nullif(F.col("group_key"), F.lit("\0")))


def adjacent_pairs(records: DataFrame, name: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``pair_no`` and ``mate`` (1 or 2): runs of the same name must be of two."""
    runs = prefix_groups(records, F.col(name), order, by)
    inside = Window.partitionBy(*by, "group_no")
    two = F.count("*").over(inside)
    checked = runs.withColumn("mate", F.row_number().over(inside.orderBy(order))).withColumn("_n", two)
    return checked.where(F.assert_true(F.col("_n") == 2, F.lit("a record has no mate or more than one")).isNull()).drop("_n", "group_key").withColumnRenamed("group_no", "pair_no")


def nearest_code(all_codes: DataFrame, used: DataFrame) -> DataFrame:
    """(code, nearest): each code of a small alphabet with the nearest used one, the smaller of two equally near.

    Codes are single bytes: what is broadcast is one row with the used ones, 256 at most.
    """
    u = used.agg(F.array_sort(F.collect_set(F.when(F.col("code").between(0, 255), F.col("code")))).alias("used"))
    best = F.aggregate("used", F.lit(None).cast("int"), lambda acc, x: F.when(acc.isNull() | (F.abs(x - F.col("code")) < F.abs(acc - F.col("code"))), x.cast("int")).otherwise(acc))
    return all_codes.join(F.broadcast(u)).select("code", best.alias("nearest"))
