"""Consecutive numbers and running sums in sorted order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import written


def sums_before(df: DataFrame, keys: list[str], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows with smaller ``keys`` (which no two rows share).

    Rows are cut into ranges of the keys at sampled bounds, whatever prefixes they share, and written with their range's number. One task sees one row per
    range; inside a range a window adds up.
    """
    ranged = written(df.sparkSession, df.withColumn("_amount", amount).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.sum("_amount").over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(totals), "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_range", "_amount", "_inner", "_before")


def number_in_order(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: the rank from 0 of each distinct value of ``key`` (byte order for strings)."""
    return sums_before(df, [key], F.lit(1), name)
