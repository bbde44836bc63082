"""Queries of draws, metric graphs and heat over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import draw_table, draws
from quillon.operators import communities, layout, metric
from quillon.plans.core import r6


def lcg_draws(spark, sf_dir):
    """The fifth draw of the generator seeded with every customer's key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", r6(draws.lcg(F.col("c_custkey"), F.lit(5)), "draw"))


def customer_draws(spark, sf_dir):
    """Up to four draws for every customer, from the third on, by the table function."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return draw_table.with_draws(c, "c_custkey", "2", "1 + c_nationkey % 4").select("c_custkey", "k", r6(F.col("draw"), "draw"))


def magnitudes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    return metric.magnitudes(p, "p_retailprice").select("p_partkey", r6(F.col("magnitude"), "magnitude"))


def nations(spark, sf_dir):
    """nodes (node): regions below 0 and nations; edges: a nation and its region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    edges = n.select(F.col("n_nationkey").cast("long").alias("edge_id"), F.col("n_nationkey").cast("long").alias("src"), (-1 - F.col("n_regionkey")).cast("long").alias("dst"))
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges


def tree_curvature(spark, sf_dir):
    """Curvature of the links between nations and regions."""
    return metric.curvature(*nations(spark, sf_dir)).select("edge_id", r6(F.col("kappa"), "kappa"))


def tree_heat(spark, sf_dir):
    """Heat-kernel signatures of nations and regions."""
    return metric.heat_kernel_signature(*nations(spark, sf_dir)).select("node", "t", r6(F.col("hks"), "hks"))


def rings(spark, sf_dir):
    """Suppliers of a nation, each linked with the next two of them and the last with the first, so
    that there are cycles and triangles."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("node"), "s_nationkey")
    w = Window.partitionBy("s_nationkey").orderBy("node")
    first = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    one = s.select((F.col("node") * 2).alias("edge_id"), F.col("node").alias("src"), F.coalesce(F.lead("node").over(w), first).alias("dst"))
    two = s.select((F.col("node") * 2 + 1).alias("edge_id"), F.col("node").alias("src"), F.lead("node", 2).over(w).alias("dst")).where("dst is not null")
    return s.select("node"), one.union(two)


def ring_curvature(spark, sf_dir):
    """Curvature of all links of the rings of suppliers."""
    return metric.curvature(*rings(spark, sf_dir)).select("edge_id", r6(F.col("kappa"), "kappa"))


def ring_heat(spark, sf_dir):
    """Heat-kernel signatures of all suppliers in their rings."""
    return metric.heat_kernel_signature(*rings(spark, sf_dir), max_dense=None).select("node", "t", r6(F.col("hks"), "hks"))


def ring_transports(spark, sf_dir):
    """Work of the curvature of the rings."""
    return metric.transport_tally(*rings(spark, sf_dir))


def cycles(spark, sf_dir):
    """Suppliers of a nation in a cycle by key; each with a link as long as balances differ, and one."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("node"), "s_nationkey", "s_acctbal")
    w = Window.partitionBy("s_nationkey").orderBy("node")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    e = s.select(F.col("node").alias("edge_id"), F.col("node").alias("src"), to("node").alias("dst"), (1 + F.abs(to("s_acctbal") - F.col("s_acctbal"))).alias("length"))
    return s.select("node"), e


def cycle_curvature(spark, sf_dir):
    """Curvature of the links of the cycles of suppliers."""
    nodes, e = cycles(spark, sf_dir)
    return metric.curvature(nodes, e.drop("length")).select("edge_id", r6(F.col("kappa"), "kappa"))


def cycle_heat(spark, sf_dir):
    """Heat-kernel signatures of the suppliers in their cycles."""
    nodes, e = cycles(spark, sf_dir)
    return metric.heat_kernel_signature(nodes, e, max_dense=None).select("node", "t", r6(F.col("hks"), "hks"))


def cycle_transports(spark, sf_dir):
    """Work of the curvature of the cycles: transports, routes of mass and rises of prices."""
    nodes, e = cycles(spark, sf_dir)
    return metric.transport_tally(nodes, e.drop("length"))


def cycle_flow(spark, sf_dir):
    """Three steps of the flow on the cycles of suppliers."""
    nodes, e = cycles(spark, sf_dir)
    return metric.ricci_flow(nodes, e.drop("length"), 3).select("edge_id", r6(F.col("length"), "length"), r6(F.col("kappa"), "kappa"))


def cut_cycles(spark, sf_dir):
    """Communities of the cycles of suppliers: the best cut of their lengths."""
    nodes, e = cycles(spark, sf_dir)
    _, one = communities.cut_communities(nodes, e.drop("length"), e.select("edge_id", "length"))
    return one.select("count", r6(F.col("cut"), "cut"), r6(F.col("q"), "q"), "parted")


def parts(spark, sf_dir):
    """All parts, each linked with the next dearer one of its brand and of its size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), "p_brand", "p_size", "p_retailprice")
    links = None
    for k, by in enumerate(("p_brand", "p_size")):
        w = Window.partitionBy(by).orderBy("p_retailprice", "node")
        e = p.select((F.col("node") * 2 + k).alias("edge_id"), F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null")
        links = e if links is None else links.union(e)
    return p.select("node"), links


def part_curvature(spark, sf_dir):
    """Curvature of all links of the parts."""
    return metric.curvature(*parts(spark, sf_dir)).select("edge_id", r6(F.col("kappa"), "kappa"))


def part_flow(spark, sf_dir):
    """Three steps of the flow on the links of the parts."""
    return metric.ricci_flow(*parts(spark, sf_dir), 3).select("edge_id", r6(F.col("length"), "length"), r6(F.col("kappa"), "kappa"))


def part_layout(spark, sf_dir):
    """Spectral embedding of all parts: one large component."""
    out = layout.spectral_embedding(*parts(spark, sf_dir))
    return out.select("node", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("z"), "z"))


def part_communities(spark, sf_dir):
    """The best cut of the parts' links after two steps of the flow."""
    nodes, e = parts(spark, sf_dir)
    flow = metric.ricci_flow(nodes, e, 2)
    _, one = communities.cut_communities(nodes, e, flow.select("edge_id", "length"))
    return one.select("count", r6(F.col("cut"), "cut"), r6(F.col("q"), "q"), "parted")


QUERIES = {f.__name__: f for f in (lcg_draws, customer_draws, magnitudes, tree_curvature, tree_heat, ring_curvature, ring_heat, ring_transports, cycle_curvature, cycle_transports, cycle_heat, cycle_flow, cut_cycles, part_curvature, part_flow, part_layout, part_communities)}

_LCG = "c_custkey"
for _ in range(5):
    _LCG = f"(({_LCG})::hugeint * 1664525 + 1013904223) % 4294967296"
#: Suppliers in cycles of n with their places i; a link's curvature follows from its cycle's size.
_CYCLES = """y as (select s_suppkey as node, s_nationkey as r, row_number() over w - 1 as i, count(*) over (partition by s_nationkey) as n,
  1 + abs(coalesce(lead(s_acctbal) over w, first_value(s_acctbal) over w) - s_acctbal) as length from supplier window w as (partition by s_nationkey order by s_suppkey)),
k as (select *, case when n = 1 then 0e0 when n = 2 then 1e0 when n < 6 then (6 - n) / 4e0 else 0e0 end as kappa from y)"""
_D = "d as (select n_regionkey as r, count(*) as d from nation group by 1)"
ORACLES = {
    "lcg_draws": f"select c_custkey, round(({_LCG})::double / 4294967296, 6) + 0e0 as draw from customer",
    "customer_draws": "with " + ", ".join(f"s{k} as (select c_custkey, c_nationkey, ({'c_custkey::hugeint' if k == 1 else 'st'} * 1664525 + 1013904223) % 4294967296 as st from {'customer' if k == 1 else f's{k - 1}'})" for k in range(1, 7))
    + " " + " union all ".join(f"select c_custkey, {k}::bigint as k, round(st::double / 4294967296, 6) + 0e0 as draw from s{k} where c_nationkey % 4 >= {k - 3}" for k in range(3, 7)),
    "magnitudes": "select p_partkey, round(-2.5 * log10(greatest(p_retailprice, 1e-12) / max(p_retailprice) over ()), 6) + 0e0 as magnitude from part",
    # In a tree a link's curvature is the sum of its ends' inverse degrees less one, here 1/1 + 1/d - 1.
    "tree_curvature": f"with {_D} select cast(n_nationkey as bigint) as edge_id, round(1e0 / d, 6) + 0e0 as kappa from nation join d on n_regionkey = r",
    "cycle_curvature": f"with {_CYCLES} select node as edge_id, round(k.kappa, 6) + 0e0 as kappa from k",
    # In a triangle one mass moves one step; in larger cycles two move, at one price up to five nodes.
    "cycle_transports": f"with {_CYCLES} select count(*) filter (n > 2) as problems, coalesce(sum(case when n = 3 then 1 when n > 3 then 2 else 0 end), 0)::bigint as routes, count(*) filter (n > 5) as rises from k",
    # A cycle has the eigenvalues 1 - cos(2 pi j / n), a node without links 1; of parallel links one counts in the matrix: 1/2 and 3/2.
    "cycle_heat": f"""with {_CYCLES}, t as (select unnest([1e0, 10e0]) as t)
select node, t, round(case when n = 1 then exp(-t) else (exp(-t / 2) + exp(-3 * t / 2)) / 2 end, 6) + 0e0 as hks from k, t where n < 3
union all select node, t, round(sum(exp(-t * (1 - cos(2 * pi() * j / n)))) / any_value(n), 6) + 0e0 from k, t, (select unnest(range(0, 100000)) as j) where j < n and n > 2 group by 1, 2""",
    "cycle_flow": f"with {_CYCLES} select node as edge_id, round(pow(1 - k.kappa / 2, 3) / avg(pow(1 - k.kappa / 2, 3)) over (), 6) + 0e0 as length, round(k.kappa, 6) + 0e0 as kappa from k",
    "cut_cycles": f"""with {_CYCLES}, a as (select length as l, row_number() over (order by length) - 1 as k, count(*) over () as n from (select distinct length from y where length > (select avg(length) from y))),
cuts as (select distinct l * (1 - 1e-9) as cut from a where n <= 64 or k in (select i * (n - 1) // 63 from (select unnest(range(0, 64)) as i)) union all select max(length) from y having not exists (select 1 from a)),
c as (select cut, node, r, i, n, sum(case when length > cut then 1 else 0 end) over (partition by cut, r order by i) - case when length > cut then 1 else 0 end as c, sum(case when length > cut then 1 else 0 end) over (partition by cut, r) as all_ from y, cuts),
lab as (select *, case when all_ > 0 then c % all_ else 0 end as label from c),
ins as (select a.cut, a.r, a.label, a.n, a.label = b.label and a.n > 1 as inside from lab a join lab b on a.cut = b.cut and a.r = b.r and b.i = (a.i + 1) % a.n),
m as (select sum(case when n > 1 then 1 else 0 end) * 1e0 as m, count(distinct r) as rings from y),
q as (select cut, r, label, sum(case when n > 1 then 2 else 0 end) as d, sum(case when inside then 1 else 0 end) as inside from ins group by 1, 2, 3),
s as (select cut, count(*) as count, coalesce(sum(inside / nullif(m, 0) - pow(d / (2 * nullif(m, 0)), 2)), 0e0) as q, any_value(rings) as rings from q, m group by cut)
select cast(count as bigint) as count, round(s.cut, 6) + 0e0 as cut, round(s.q, 6) + 0e0 as q, cast(count - rings as bigint) as parted from s order by round(s.q, 12) desc, s.cut limit 1""",
    # Stars have the eigenvalues 0, 1 and 2.
    "tree_heat": f"""with {_D}, t as (select unnest([1e0, 10e0]) as t)
select cast(n_nationkey as bigint) as node, t, round((1 + exp(-2 * t)) / (2 * d) + (d - 1e0) / d * exp(-t), 6) + 0e0 as hks from nation join d on n_regionkey = r, t
union all select cast(-1 - r as bigint), t, round((1 + exp(-2 * t)) / 2, 6) + 0e0 from d, t""",
}
