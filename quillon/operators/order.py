"""Numbering and running totals over a whole table without a task that holds it all.

Rows are range-sorted and written; each partition then needs only the sums of those before
it, one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import free_name, materialise, partitions


def _dealt(df: DataFrame, order: list[str], part: str) -> DataFrame:
    """Rows in ranges of `order`, written, with their range in `part`."""
    return materialise(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), "running")


def running_total(df: DataFrame, order: list[str], value: str | None = None, name: str = "total") -> DataFrame:
    """Adds `name`: the sum of `value` (of ones, if None) over this row and all before it in the
    order of the columns `order`, which must tell rows apart."""
    part = free_name(df, "_part")
    one = F.lit(1).cast("long") if value is None else F.col(value)
    dealt = _dealt(df, order, part)
    sums = dealt.groupBy(part).agg(F.sum(one).alias("_sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(part).alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn(name, F.sum(one).over(inside)).join(F.broadcast(sums), F.col(part) == F.col("_p"))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop(part, "_p", "_before")


def minimum_from_end(df: DataFrame, order: list[str], value: str, name: str = "least") -> DataFrame:
    """Adds `name`: the least `value` of this row and all after it in the order of the columns
    `order`, which must tell rows apart; nulls do not count."""
    part = free_name(df, "_part")
    dealt = _dealt(df, order, part)
    least = dealt.groupBy(part).agg(F.min(value).alias("_least"))
    after = Window.orderBy(part).rowsBetween(1, Window.unboundedFollowing)
    least = least.select(F.col(part).alias("_p"), F.min("_least").over(after).alias("_later"))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    out = dealt.withColumn(name, F.min(value).over(inside)).join(F.broadcast(least), F.col(part) == F.col("_p"))
    return out.withColumn(name, F.least(name, "_later")).drop(part, "_p", "_later")


def numbered(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Adds `name`: the place of each row from 0 in the order of the columns `order`."""
    return running_total(df, order, None, name).withColumn(name, F.col(name) - 1)


def average_rank(df: DataFrame, x: str, name: str = "rank") -> DataFrame:
    """Adds `name`: 1-based rank of x over the whole table, ties averaged. Equal values are counted
    before they are ordered."""
    counts = df.groupBy(F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    ranked = running_total(counts, ["_x"], "_c", "_upto").select("_x", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranked, F.col(x).eqNullSafe(F.col("_x"))).drop("_x")
