"""Weekly sums of the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

DAY0 = "1995-01-01"


def weekly_sums(spark, sf_dir):
    """Orders per week from 1995-01-01, weeks without orders as 0."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.to_date("o_orderdate"), F.lit(DAY0).cast("date"))
    counts = orders.groupBy(F.floor(day / 7).cast("long").alias("week")).agg(
        F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")
    )
    span = counts.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    weeks = span.select(F.explode(F.sequence("lo", "hi")).alias("week"))
    return weeks.join(counts, "week", "left").select(
        "week",
        F.coalesce("orders", F.lit(0)).cast("long").alias("orders"),
        (F.round(F.coalesce("total", F.lit(0.0)), 2) + F.lit(0.0)).alias("total"),
    )


QUERIES = {"weekly_sums": weekly_sums}
ORACLES = {
    "weekly_sums": """
with d as (select cast(floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / 7.0) as bigint) as week, o_totalprice from orders),
c as (select week, count(*) as orders, sum(o_totalprice) as total from d group by week),
w as (select unnest(range(min(week), max(week) + 1)) as week from c)
select w.week, cast(coalesce(c.orders, 0) as bigint) as orders, round(coalesce(c.total, 0e0), 2) + 0e0 as total
from w left join c on w.week = c.week
"""
}
