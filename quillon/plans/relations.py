"""Queries of joins by order and of whole-table families over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import sky
from quillon.operators import joins, stats
from quillon.plans.core import r6


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")


def event_before(spark, sf_dir):
    """Every event with its user's last earlier error, and the seconds since."""
    e = _events(spark, sf_dir)
    errors = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    met = joins.asof_join(e, errors, ["user_id"], "ts", "error_ts", exact=False)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("error_ts").cast("timestamp"))) / 1e6
    return met.select("event_id", F.coalesce("error_id", F.lit(-1).cast("long")).alias("error_id"), r6(F.coalesce(gap, F.lit(-1.0)), "gap"))


def order_lunations(spark, sf_dir):
    """Every order with the last mean new moon, from a table of new moons, and its age in days."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr("unix_millis(cast(o_orderdate as timestamp))").cast("double").alias("ms"))
    span = o.agg(F.floor((F.min("ms") - sky.NEW_MOON_MS) / sky.SYNODIC / sky.DAY_MS).alias("lo"), F.ceil((F.max("ms") - sky.NEW_MOON_MS) / sky.SYNODIC / sky.DAY_MS).alias("hi"))
    moons = span.select(F.explode(F.sequence("lo", "hi")).alias("lunation")).select("lunation", (sky.NEW_MOON_MS + F.col("lunation") * sky.SYNODIC * sky.DAY_MS).alias("new_ms"))
    met = joins.asof_join(o, moons, [], "ms", "new_ms")
    return met.select("o_orderkey", "lunation", r6((F.col("ms") - F.col("new_ms")) / sky.DAY_MS, "age"))


def customer_family(spark, sf_dir):
    """Every customer's chance p, from the place of its balance, and q, all customers being one family."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    p = c.select("c_custkey", F.pow((F.col("c_acctbal") + 1000) / 11000, F.lit(3)).alias("p"))
    return stats.benjamini_hochberg_whole(p, "p", ["c_custkey"]).select("c_custkey", r6(F.col("p"), "p"), r6(F.col("q"), "q"))


QUERIES = {f.__name__: f for f in (event_before, order_lunations, customer_family)}
ORACLES = {
    "event_before": """with r as (select user_id, ts as error_ts, event_id as error_id from events where event_type = 'error')
select e.event_id, coalesce(r.error_id, -1) as error_id, round(coalesce((epoch_us(e.ts) - epoch_us(r.error_ts)) / 1e6, -1e0), 6) + 0e0 as gap from events e asof left join r on e.user_id = r.user_id and e.ts > r.error_ts""",
    "order_lunations": f"""with o as (select o_orderkey, epoch_ms(o_orderdate) * 1e0 as ms from orders),
m as (select n as lunation, {sky.NEW_MOON_MS!r}::double + n * {sky.SYNODIC!r}::double * 86400000 as new_ms from (select unnest(range(-400, 800)) as n))
select o_orderkey, lunation, round((ms - new_ms) / 86400000, 6) + 0e0 as age from o asof join m on o.ms >= m.new_ms""",
    "customer_family": """with c as (select c_custkey, pow((c_acctbal + 1000) / 11000, 3) as p, row_number() over (order by c_acctbal, c_custkey) as k, count(*) over () as m from customer)
select c_custkey, round(p, 6) + 0e0 as p, round(least(1e0, min(p * m / k) over (order by k rows between current row and unbounded following)), 6) + 0e0 as q from c""",
}
