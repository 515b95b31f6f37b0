"""Packing files into shards of about so many lines, by a running sum in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_sum(rows: DataFrame, group_col: str, order_col: str, value_col: str, block: int = 4096) -> DataFrame:
    """rows with _sum: the sum of value_col up to and including the row, by group, in the order of a long column.

    Runs inside blocks of order_col's values first, then over one row per block: so a hot group is
    as many tasks as it has blocks.  Equal order values are summed together.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order_col) / block))
    sums = rows.groupBy(group_col, "_block").agg(F.sum(value_col).alias("_of"))
    before = Window.partitionBy(group_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group_col).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_of").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group_col, "_block").orderBy(order_col)
    rows = rows.withColumn("_in", F.sum(value_col).over(within))
    joined = rows.join(starts, rows[group_col].eqNullSafe(starts["_g"]) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("_sum", F.col("_start") + F.col("_in")).drop("_g", "_b", "_block", "_start", "_in")


def shards(files: DataFrame, module_col: str, order_col: str, loc_col: str, size: int = 1200) -> DataFrame:
    """(module_col, order_col, loc_col, shard): files in order, a new shard at every `size` lines begun.

    Shards follow the running sum, so they are near the size, not packed best.
    """
    rows = running_sum(files.select(module_col, order_col, loc_col), module_col, order_col, loc_col)
    return rows.select(module_col, order_col, loc_col, F.floor((F.col("_sum") - F.col(loc_col)) / size).cast("long").alias("shard"))
