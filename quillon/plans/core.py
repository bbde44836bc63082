"""Queries of scalar models, statistics, signals and graphs over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import sky
from quillon.operators import graph, signal, stats

SIGMA = 1.5


def r6(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _ms(col):
    return F.expr(f"unix_millis(cast({col} as timestamp))").cast("double")


def instants(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(_ms("o_orderdate").alias("ms")).distinct()


def moon_age(spark, sf_dir):
    """Mean age, its phase name and illumination at every order date."""
    age = sky.mean_age(F.col("ms"))
    light = sky.illumination(age)
    return instants(spark, sf_dir).select("ms", r6(age, "age"), sky.phase_name(age).alias("phase"), r6(light["k"], "k"), r6(light["full"], "full_"))


def true_moon_age(spark, sf_dir):
    """True age at every order date."""
    return instants(spark, sf_dir).select("ms", r6(sky.phase_age(F.col("ms")), "age"))


def orbits(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    phase = sky.str_hash(F.col("s_name")) / 4294967296
    el = sky.elements((F.col("s_nationkey") % 11) / 10.0, (F.col("s_nationkey") % 5) / 5.0, F.sin(F.col("s_suppkey").cast("double")), phase)
    return s.select("s_suppkey", phase.alias("phase"), el.alias("el"))


def orbit_elements(spark, sf_dir):
    return orbits(spark, sf_dir).select("s_suppkey", r6(F.col("phase"), "phase"), *[r6(F.col("el")[c], n) for c, n in (("a", "a"), ("e", "e"), ("T", "t_ms"), ("M0", "m0"), ("tilt", "tilt"))])


def orbit_positions(spark, sf_dir):
    """Fraction, time to a fraction, place on the arc and state of every orbit at one instant."""
    ms = F.lit(1.7e12)
    o = orbits(spark, sf_dir).withColumn("f", sky.orbit_frac(F.col("el"), ms))
    arc, state = sky.arc_pos(F.col("f"), F.lit(0.3), F.col("el.tilt"), 800.0, 600.0), sky.kepler_state(F.col("el"), F.lit(3.7))
    wait = sky.time_to_frac(F.col("el"), ms, F.lit(0.25))
    return o.select("s_suppkey", r6(F.col("f"), "f"), (F.round(wait / 1000, 3) + 0.0).alias("wait_s"), r6(arc["x"], "x"), r6(arc["y"], "y"), r6(arc["up"], "up"), r6(state["x"], "px"), r6(state["y"], "py"), r6(state["vx"], "vx"), r6(state["vy"], "vy"))


def camera(spark, sf_dir):
    """Follow, damped step and fence with supplier balances as positions."""
    x = F.col("s_acctbal")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    box = sky.fence(1 + (F.col("s_suppkey") % 7) / 4.0, x - 50, x + 60, F.lit(10.0), F.lit(20.0), 800.0, 600.0)
    d = sky.step_damped(x, F.lit(1.0), F.lit(3.0), sky.CAMERA["sway_zeta"], sky.CAMERA["sway_omega"], F.lit(25.0))
    return s.select("s_suppkey", r6(sky.follow(x, F.lit(5.0), sky.CAMERA["follow_tau"], F.lit(16.0)), "followed"), r6(d["x"], "x"), r6(d["v"], "v"), *[r6(box[c], c) for c in ("min_x", "max_x", "min_y", "max_y")])


def shading(spark, sf_dir):
    """Normals and light of triangles made of three suppliers' numbers."""
    p = lambda k: F.struct((F.col("s_suppkey") % (k + 2)).cast("double").alias("x"), (F.col("s_suppkey") % (k + 5)).cast("double").alias("y"), (F.col("s_nationkey") % (k + 3)).cast("double").alias("z"))
    light = F.struct(F.lit(0.48).alias("x"), F.lit(0.6).alias("y"), F.lit(0.64).alias("z"))
    n = sky.face_normal(p(1), p(2), p(4))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", n.alias("n")).select("s_suppkey", r6(F.col("n.x"), "x"), r6(F.col("n.y"), "y"), r6(F.col("n.z"), "z"), r6(sky.lambert(F.col("n"), light), "light"))


def von_mises_density(spark, sf_dir):
    grid = spark.range(0, 40).select(F.col("id"), (F.col("id") / 7.0).alias("theta"), (F.col("id") * 1.3).alias("kappa"))
    return grid.select("id", r6(sky.von_mises_density(F.col("theta"), F.lit(1.0), F.col("kappa")), "density"))


def _weights(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("w"))


def entropy(spark, sf_dir):
    return stats.entropy_bits(_weights(spark, sf_dir), "user_id", "w").select("user_id", r6(F.col("bits"), "bits"))


def _balances(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def zscore(spark, sf_dir):
    return stats.zscore(_balances(spark, sf_dir), "c_nationkey", "c_acctbal").select("c_custkey", r6(F.col("z"), "z"))


def average_ranks(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return stats.average_rank(part, "p_brand", "p_size").select("p_partkey", r6(F.col("rank"), "rank_"))


def correlations(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_size", F.col("p_size").cast("double"))
    a = stats.pearson(part, "p_brand", "p_size", "p_retailprice").withColumnRenamed("r", "pearson")
    b = stats.spearman(part, "p_brand", "p_size", "p_retailprice").withColumnRenamed("r", "spearman")
    return a.join(b, "p_brand").select("p_brand", r6(F.col("pearson"), "pearson"), r6(F.col("spearman"), "spearman"))


def bh_qvalues(spark, sf_dir):
    s = _balances(spark, sf_dir).select("c_custkey", "c_nationkey", ((F.abs("c_acctbal") + F.col("c_custkey") / 1e6) / 20000).alias("p"))
    return stats.benjamini_hochberg(s, "c_nationkey", "p").select("c_custkey", r6(F.col("q"), "q"))


def von_mises_fit(spark, sf_dir):
    w = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", (F.dayofweek("o_orderdate") - 1).alias("k")).agg(F.sum("o_totalprice").alias("w"))
    return stats.von_mises_fit(w, "o_orderpriority", "k", "w", 7).select("o_orderpriority", r6(F.col("mu"), "mu"), r6(F.col("kappa"), "kappa"), r6(F.col("r"), "r"))


def roster(spark, sf_dir):
    """(id, t, x): orders of customers of a nation by week from 1995-01-01, dense."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(_balances(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    week = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 7).cast("long")
    n = o.groupBy(F.col("c_nationkey").alias("id"), week.alias("week")).agg(F.count("*").cast("double").alias("x"))
    span = n.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    grid = n.select("id").distinct().crossJoin(F.broadcast(span)).select("id", "lo", F.explode(F.sequence("lo", "hi")).alias("week"))
    return grid.join(n, ["id", "week"], "left").select("id", (F.col("week") - F.col("lo")).cast("long").alias("t"), F.coalesce("x", F.lit(0.0)).alias("x"))


def lagged_correlation(spark, sf_dir):
    out = stats.lagged_correlation(roster(spark, sf_dir), 7)
    return out.select("a", "b", F.col("lag").cast("int").alias("lag"), r6(F.col("r"), "r"), r6(F.col("z"), "z"))


def smoothed(spark, sf_dir):
    s = signal.smoothed(roster(spark, sf_dir), SIGMA)
    return s.select("id", F.col("t").cast("long").alias("t"), r6(F.col("level"), "level_"), r6(F.col("d1"), "d1"), r6(F.col("d2"), "d2"))


def momentum(spark, sf_dir):
    return signal.momentum(signal.smoothed(roster(spark, sf_dir), SIGMA)).select("id", r6(F.col("momentum"), "momentum"))


def dft_power(spark, sf_dir):
    return signal.dft(roster(spark, sf_dir)).select("id", "k", r6(F.col("period"), "period"), (F.round("power", 3) + 0.0).alias("power"))


def dominant_rhythm(spark, sf_dir):
    """The rhythm of every nation's orders under a wave of about a quarter, whole cycles of it."""
    s = roster(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("id"))
    s = s.select("id", "t", (F.col("x") + 8 * F.sin(2 * 3.141592653589793 * F.floor(n / 13) * F.col("t") / n)).alias("x"))
    return signal.dominant_rhythm(s).select("id", r6(F.col("period"), "period"), (F.round("ratio", 4) + 0.0).alias("ratio"))


def inflections(spark, sf_dir):
    return signal.inflections(signal.smoothed(roster(spark, sf_dir), SIGMA), 0.05).select("id", F.col("t").cast("long").alias("t"))


def weekly(spark, sf_dir):
    """Sums of sevens of every user's daily events from the first day on, days without any as 0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.to_date("ts").alias("day"))
    span = e.agg(F.min("day").alias("_first"))
    daily = e.join(F.broadcast(span)).groupBy("id", F.datediff("day", "_first").cast("long").alias("t")).agg(F.count("*").cast("double").alias("x"))
    return signal.weekly(daily).select("id", "week", r6(F.col("x"), "x"))


def trade(spark, sf_dir):
    """nodes (node) and edges: parts joined through an order of two lines or more, chained.

    Lines of one number are chained by part; edge_id is the order and the place in it.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey is not null")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    edge_id = F.shiftleft("l_orderkey", 24) + F.row_number().over(w)
    edges = li.select(edge_id.alias("edge_id"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node")), edges


def degree(spark, sf_dir):
    return graph.degree(*trade(spark, sf_dir))


def laplacian_apply(spark, sf_dir):
    nodes, edges = trade(spark, sf_dir)
    x = nodes.select("node", (F.col("node") % 17).cast("double").alias("x"))
    return graph.apply(graph.laplacian(nodes, edges), x).select("node", r6(F.col("x"), "x"))


def diffuse_3_steps(spark, sf_dir):
    nodes, edges = trade(spark, sf_dir)
    x = nodes.select("node", (F.col("node") % 17).cast("double").alias("x"))
    return graph.diffuse(x, graph.laplacian(nodes, edges), 0.25, 3, 0.9).select("node", r6(F.col("x"), "x"))


def components(spark, sf_dir):
    """Components numbered from 0 in the order of their smallest parts."""
    return graph.numbered_components(*trade(spark, sf_dir)).select("node", F.col("component").cast("long").alias("component"))


def adjacency(spark, sf_dir):
    """Neighbours of every part in the order of the links, as text."""
    return graph.adjacency(*trade(spark, sf_dir)).select("node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


def hop_distances(spark, sf_dir):
    """Hops of all reachable pairs of parts."""
    return graph.hop_distances(*trade(spark, sf_dir)).select("src", "dst", F.col("hops").cast("int").alias("hops"))


def modularity_by_label(spark, sf_dir):
    nodes, edges = trade(spark, sf_dir)
    return graph.modularity(edges, nodes.select("node", (F.col("node") % 9).alias("label"))).select(r6(F.col("q"), "q"))


QUERIES = {f.__name__: f for f in (moon_age, true_moon_age, orbit_elements, orbit_positions, camera, shading, von_mises_density, entropy, zscore, average_ranks, correlations, bh_qvalues, von_mises_fit, lagged_correlation, smoothed, momentum, dft_power, dominant_rhythm, inflections, weekly, degree, adjacency, laplacian_apply, diffuse_3_steps, components, hop_distances, modularity_by_label)}

_MS = "ms as (select distinct cast(epoch_ms(o_orderdate) as double) as ms from orders)"
_R = "round({}, 6) + 0e0"
_ROSTER = """
o as (select c_nationkey as id, cast(floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / 7.0) as bigint) as week from orders join customer on o_custkey = c_custkey),
n as (select id, week, cast(count(*) as double) as x from o group by id, week),
g as (select i.id, w.week, w.lo from (select distinct id from n) i, (select min(week) as lo, unnest(range(min(week), max(week) + 1)) as week from n) w),
s as (select g.id, g.week - g.lo as t, coalesce(n.x, 0e0) as x from g left join n on g.id = n.id and g.week = n.week)"""
_TRADE = """
e as (select l_orderkey * 16777216 + row_number() over w as edge_id, l_partkey as src, lead(l_partkey) over w as dst from lineitem where l_orderkey is not null window w as (partition by l_orderkey order by l_linenumber, l_partkey) qualify dst is not null),
y as (select src, dst from e where src <> dst union all select dst, src from e where src <> dst),
d as (select p_partkey as node, count(src) as degree from part left join y on src = p_partkey group by p_partkey)"""
_L = _TRADE + """,
l as (select y.src as row_, y.dst as col_, -1e0 / sqrt(a.degree * b.degree) as val from y join d a on y.src = a.node join d b on y.dst = b.node
      union all select node, node, 1e0 from d),
x0 as (select node, cast(node % 17 as double) as x from d)"""


# Sampled Gaussian weights from their definition: order 0 sums to one, 1 answers a unit ramp with
# one, 2 answers t^2 / 2 with one.
_KERNELS = f"""gi as (select unnest(range(-6, 7)) as i), g0 as (select i, exp(-i * i / (2e0 * {SIGMA} * {SIGMA})) as g from gi),
gm as (select sum(g) as s, sum(i * i * g) as s2, sum(i * i * i * i * g) as s4 from g0),
k0 as (select i, g / s as w from g0, gm), k1 as (select i, i * g / s2 as w from g0, gm),
k2 as (select i, 2 * (i * i - s2 / s) * g / (s4 - s2 * s2 / s) as w from g0, gm)"""
_FOLD = "case when s.t + k.i < 0 then -(s.t + k.i) when s.t + k.i >= c.n then 2 * c.n - 2 - (s.t + k.i) else s.t + k.i end"
_SMOOTH = f"""{_ROSTER}, {_KERNELS},
c as (select id, count(*) as n, arg_min(x, t) as x0, arg_max(x, t) as x1 from s group by id),
v0 as (select s.id, s.t, sum(k.w * j.x) as v from s join c on s.id = c.id cross join k0 k join s j on j.id = s.id and j.t = {_FOLD} group by all),
v2 as (select s.id, s.t, sum(k.w * j.x) as v from s join c on s.id = c.id cross join k2 k join s j on j.id = s.id and j.t = {_FOLD} group by all),
v1 as (select s.id, s.t, sum(k.w * case when s.t + k.i < 0 then 2 * c.x0 - j.x when s.t + k.i >= c.n then 2 * c.x1 - j.x else j.x end) as v from s join c on s.id = c.id cross join k1 k join s j on j.id = s.id and j.t = {_FOLD} group by all)"""
_DFT = """c as (select id, avg(x) as m, count(*) as n from s group by id),
f as (select s.id, k.k, c.n, sum((x - m) * cos(2 * pi() * k.k * t / c.n)) as re, sum((x - m) * sin(2 * pi() * k.k * t / c.n)) as im
      from s join c on s.id = c.id join (select unnest(range(1, 2000)) as k) k on k.k <= c.n // 2 group by s.id, k.k, c.n),
p as (select id, k, cast(n as double) / k as period, re * re + im * im as power from f)"""
_EL = """h as (select *, list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(s_name, ''), lambda c: cast(ascii(c) as bigint))), lambda a, c: (a * 31 + c) % 4294967296) / 4294967296e0 as phase from supplier),
el as (select s_suppkey, phase, 0.261629e0 + (1e0 - 0.261629e0) * (1 - (s_nationkey % 11) / 10e0) as a, 0.2e0 * ((s_nationkey % 5) / 5e0) as e, phase * 2 * pi() as m0, 0.04e0 * sin(cast(s_suppkey as double)) as tilt from h),
o as (select *, 179627484e0 * pow(a, 1.5e0) as t_ms from el)"""


def _newton(source, m, out):
    steps, prev = [f"{out}0 as (select *, {m} as m_, {m} as e0_ from {source})"], f"{out}0"
    for k in range(8):
        steps.append(f"{out}{k + 1} as (select * exclude (e0_), e0_ - (e0_ - e * sin(e0_) - m_) / (1 - e * cos(e0_)) as e0_ from {prev})")
        prev = f"{out}{k + 1}"
    return ", ".join(steps)


_PM = "((({0}) % {1}) + {1}) % {1}"
_TAU = "(2 * pi())"

_MS_DAY = "86400000e0"


def _moon_sql(k):
    """Unix ms of the true new moon k, from the series of sky's fixed values."""
    t = f"({k} / 1236.85e0)"
    poly = lambda c: f"({c[0]!r}::double + {c[1]!r}::double * {k} + {c[2]!r}::double * pow({t}, 2) + {c[3]!r}::double * pow({t}, 3) + {c[4]!r}::double * pow({t}, 4))"
    e = f"(1 - 0.002516e0 * {t} - 0.0000074e0 * pow({t}, 2))"
    args = [poly(c) for c in (sky.SUN, sky.MOON, sky.LATITUDE, sky.NODE)]
    terms = [f"{size!r}::double * pow({e}, {power}) * sin(radians({' + '.join(f'{m} * {a}' for m, a in zip(times, args, strict=True) if m)}))" for size, power, *times in sky.TERMS]
    return f"(({poly(sky.JDE)} + {' + '.join(terms)} - 2440587.5e0) * {_MS_DAY})"


_FENCE = lambda lo, hi, size, drift, edge, far: f"(({lo} + {hi}) / 2 * (1 - z) + {size} * {drift}) * (1 - t) + ({size} * {edge} - {far} * z) * t"

ORACLES = {
    # The true age is that of the last of the moons about the date's own.
    "true_moon_age": f"""with {_MS}, k as (select ms, floor((ms / {_MS_DAY} + 2440587.5e0 - 2451545) / 365.25e0 * 12.3685e0 + 0.5e0) as k0 from ms), n as (select ms, k0 + j as k from k, (select unnest([-2, -1, 0, 1]) as j)), m as (select ms, {_moon_sql('k')} as moon from n)
select ms, round((ms - max(moon)) / {_MS_DAY}, 6) + 0e0 as age from m where moon <= ms group by ms""",
    "camera": f"""with s as (select s_suppkey, s_acctbal as x, 1 + (s_suppkey % 7) / 4e0 as z, least(1e0, greatest(0e0, (s_suppkey % 7) / 4e0 / 1.5e0)) as t, s_acctbal - 50 as x0, s_acctbal + 60 as x1 from supplier),
a as (select *, 1 + (-144 * (x - 3) - 7.68e0) / 120 as v1 from s), b as (select *, x + v1 / 120 as y1 from a), c as (select *, v1 + (-144 * (y1 - 3) - 7.68e0 * v1) / 120 as v2 from b), d as (select *, y1 + v2 / 120 as y2 from c),
e as (select *, v2 + (-144 * (y2 - 3) - 7.68e0 * v2) / 120 as v3 from d), f as (select *, y2 + v3 / 120 as y3 from e)
select s_suppkey, round(5 + (s.x - 5) * exp(-16 / 67.1e0), 6) + 0e0 as followed, round(y3, 6) + 0e0 as x, round(v3, 6) + 0e0 as v, round({_FENCE('x0', 'x1', 800, '-0.08e0', '0.32e0', 'x1')}, 6) + 0e0 as min_x, round({_FENCE('x0', 'x1', 800, '0.08e0', '0.68e0', 'x0')}, 6) + 0e0 as max_x,
round({_FENCE('10', '20e0', 600, '-0.06e0', '0.3e0', '20')}, 6) + 0e0 as min_y, round({_FENCE('10', '20e0', 600, '0.06e0', '0.55e0', '10')}, 6) + 0e0 as max_y from f s""",
    "shading": """with p as (select s_suppkey, s_suppkey % 3 * 1e0 as ax, s_suppkey % 6 * 1e0 as ay, s_nationkey % 4 * 1e0 as az, s_suppkey % 4 * 1e0 as bx, s_suppkey % 7 * 1e0 as by_, s_nationkey % 5 * 1e0 as bz, s_suppkey % 6 * 1e0 as cx, s_suppkey % 9 * 1e0 as cy, s_nationkey % 7 * 1e0 as cz from supplier),
c as (select s_suppkey, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as y, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as z from p),
n as (select s_suppkey, x, y, z, sqrt(x * x + y * y + z * z) as s, case when z < 0 then -1 else 1 end as f from c),
u as (select s_suppkey, case when s > 0 then f * x / s else 0e0 end as x, case when s > 0 then f * y / s else 0e0 end as y, case when s > 0 then f * z / s else 1e0 end as z from n)
select s_suppkey, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, round(z, 6) + 0e0 as z, round(0.6e0 + 0.4e0 * greatest(0e0, 0.48e0 * u.x + 0.6e0 * u.y + 0.64e0 * u.z), 6) + 0e0 as light from u""",
    # The Bessel function by its integral, the mean of exp(kappa (cos - 1)) over the circle.
    "von_mises_density": """with g as (select unnest(range(0, 40)) as id), n as (select unnest(range(0, 2000)) as j), i as (select id, avg(exp(id * 1.3e0 * (cos(2 * pi() * j / 2000) - 1))) as mean from g, n group by id)
select id, round(exp(id * 1.3e0 * (cos(id / 7e0 - 1) - 1)) / (2 * pi() * mean), 6) + 0e0 as density from i""",
    "moon_age": f"""with {_MS}, a as (select ms, {_PM.format('(ms - 947182440000e0) / 86400000e0', '29.53058867e0')} as age from ms),
k as (select *, cos(2 * pi() * age / 29.53058867e0) as k from a), x as (select *, least(1e0, greatest(0e0, ((1 - k) / 2 - 0.93e0) / 0.06e0)) as x from k)
select ms, round(age, 6) + 0e0 as age, ['new moon','waxing crescent','first quarter','waxing gibbous','full moon','waning gibbous','last quarter','waning crescent'][1 + cast(floor(age / 29.53058867e0 * 8 + 0.5e0) as bigint) % 8] as phase,
round(k, 6) + 0e0 as k, round(x * x * (3 - 2 * x), 6) + 0e0 as full_ from x""",
    "orbit_elements": f"with {_EL} select s_suppkey, " + ", ".join(f"round({c}, 6) + 0e0 as {c}" for c in ("phase", "a", "e", "t_ms", "m0", "tilt")) + " from o",
    "orbit_positions": f"""with {_EL}, {_newton('o', _PM.format(f'{_TAU} * (1.7e12 / t_ms) + m0', _TAU), 'n')},
f as (select *, {_PM.format(f'2 * atan2(sqrt(1 + e) * sin(e0_ / 2), sqrt(1 - e) * cos(e0_ / 2)) / {_TAU}', '1e0')} as f, m_ as now_, 2 * atan2(sqrt(1 - e) * sin(pi() / 4), sqrt(1 + e) * cos(pi() / 4)) as et from n8),
w as (select * exclude (m_, e0_), {_PM.format(_PM.format('et - e * sin(et)', _TAU) + ' - now_', _TAU)} as gap, t_ms / 179627484e0 as per, case when f < 0.5e0 then sin(f * 2 * pi()) else 0e0 end as up from f),
{_newton('w', _PM.format(f'{_TAU} * 3.7e0 / per + m0', _TAU), 'q')},
z as (select *, sqrt(1 - e * e) as q, ({_TAU} / per) / (1 - e * cos(e0_)) as rate from q8)
select s_suppkey, round(f, 6) + 0e0 as f, round((case when gap = 0 then t_ms else gap / {_TAU} * t_ms end) / 1000, 3) + 0e0 as wait_s, round(800 * (0.05e0 + 0.9e0 * f * 2), 6) + 0e0 as x,
round(600 * 0.72e0 - up * 0.3e0 * 600 + (f * 2 - 0.5e0) * 600 * tilt, 6) + 0e0 as y, round(up, 6) + 0e0 as up, round(a * (cos(e0_) - e), 6) + 0e0 as px, round(a * q * sin(e0_), 6) + 0e0 as py,
round(-a * sin(e0_) * rate, 6) + 0e0 as vx, round(a * q * cos(e0_) * rate, 6) + 0e0 as vy from z""",
    "entropy": "with w as (select user_id, event_type, count(*) * 1e0 as w from events group by all), p as (select user_id, w / sum(w) over (partition by user_id) as p from w) select user_id, round(-sum(p * log2(p)), 6) + 0e0 as bits from p group by user_id",
    "zscore": "select c_custkey, round(coalesce((c_acctbal - avg(c_acctbal) over w) / nullif(stddev_pop(c_acctbal) over w, 0), 0e0), 6) + 0e0 as z from customer window w as (partition by c_nationkey)",
    "average_ranks": "select p_partkey, round(rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2e0, 6) + 0e0 as rank_ from part",
    "correlations": """with k as (select *, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2e0 as ra, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2e0 as rb from part)
select p_brand, round(case when count(*) < 2 then 0e0 else coalesce(covar_pop(p_size, p_retailprice) / nullif(stddev_pop(p_size) * stddev_pop(p_retailprice), 0), 0e0) end, 6) + 0e0 as pearson,
round(case when count(*) < 2 then 0e0 else coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0e0) end, 6) + 0e0 as spearman from k group by p_brand""",
    "bh_qvalues": """with p as (select c_custkey, c_nationkey, (abs(c_acctbal) + c_custkey / 1e6) / 20000 as p from customer),
k as (select *, row_number() over (partition by c_nationkey order by p) as k, count(*) over (partition by c_nationkey) as m from p)
select c_custkey, round(least(1e0, min(p * m / k) over (partition by c_nationkey order by k desc rows unbounded preceding)), 6) + 0e0 as q from k""",
    "von_mises_fit": """with w as (select o_orderpriority, dayofweek(o_orderdate) as k, sum(o_totalprice) as w from orders group by all),
s as (select o_orderpriority, sum(w * cos(2 * pi() * k / 7)) / sum(w) as c, sum(w * sin(2 * pi() * k / 7)) / sum(w) as s from w group by 1), r as (select *, least(1e0, sqrt(c * c + s * s)) as r, atan2(s, c) as m from s)
select o_orderpriority, round(case when m < 0 then m + 2 * pi() else m end, 6) + 0e0 as mu, round(least(1000e0, case when r < 0.53e0 then 2 * r + pow(r, 3) + 5 * pow(r, 5) / 6 when r < 0.85e0 then -0.4e0 + 1.39e0 * r + 0.43e0 / (1 - r) else 1 / (pow(r, 3) - 4 * pow(r, 2) + 3 * r) end), 6) + 0e0 as kappa, round(r, 6) + 0e0 as r from r""",
    "lagged_correlation": f"""with {_ROSTER}, m as (select s.id, s.t, s.x - avg(x) over (partition by id) as x from s),
l as (select a.id as a, b.id as b, k.lag, covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) as r, count(*) as m from m a cross join (select unnest(range(-7, 8)) as lag) k join m b on a.id < b.id and b.t = a.t + k.lag group by all having count(*) >= 4),
w as (select *, row_number() over (partition by a, b order by round(abs(r), 12) desc, lag) as n from l where r is not null)
select a, b, cast(lag as integer) as lag, round(r, 6) + 0e0 as r, round(atanh(greatest(-0.999999e0, least(0.999999e0, r))) * sqrt(greatest(0, m - 3)), 6) + 0e0 as z from w where n = 1""",
    "smoothed": f"with {_SMOOTH} select v0.id, v0.t, round(v0.v, 6) + 0e0 as level_, round(v1.v, 6) + 0e0 as d1, round(v2.v, 6) + 0e0 as d2 from v0 join v1 on v0.id = v1.id and v0.t = v1.t join v2 on v0.id = v2.id and v0.t = v2.t",
    "momentum": f"with {_SMOOTH} select id, round(greatest(-1e0, least(1e0, coalesce(arg_max(v, t) / nullif(stddev_pop(v), 0), 0e0))), 6) + 0e0 as momentum from v1 group by id",
    "dft_power": f"with {_ROSTER}, {_DFT} select id, k, round(period, 6) + 0e0 as period, round(power, 3) + 0e0 as power from p",
    "dominant_rhythm": f"with {_ROSTER}, s0 as (select id, t, x + 8 * sin(2 * pi() * floor(count(*) over (partition by id) / 13e0) * t / count(*) over (partition by id)) as x from s), {_DFT.replace('from s ', 'from s0 s ')}, q as (select *, row_number() over (partition by id order by power desc, k) as r, lead(power) over (partition by id order by power desc, k) as nx from p) select id, round(period, 6) + 0e0 as period, round(power / nx, 4) + 0e0 as ratio from q where r = 1 and power / nx >= 2",
    "inflections": f"with {_SMOOTH}, f as (select v1.id, v1.t, v1.v as d1, sign(v2.v) as s, lag(sign(v2.v)) over (partition by v1.id order by v1.t) as p from v1 join v2 on v1.id = v2.id and v1.t = v2.t) select id, t from f where s * p < 0 and abs(d1) > 0.05e0",
    "weekly": "with d as (select user_id as id, date_diff('day', min(cast(ts as date)) over (), cast(ts as date)) as t from events) select id, cast(t // 7 as bigint) as week, cast(count(*) as double) as x from d group by 1, 2",
    "adjacency": f"with {_TRADE}, b as (select edge_id, src, dst from e where src <> dst union all select edge_id, dst, src from e where src <> dst), l as (select src, string_agg(dst, ',' order by edge_id, dst) as n from b group by src) select p_partkey as node, coalesce(n, '') as neighbours from part left join l on src = p_partkey",
    "degree": f"with {_TRADE} select node, degree from d",
    "laplacian_apply": f"with {_L} select row_ as node, round(sum(val * x), 6) + 0e0 as x from l join x0 on col_ = node group by row_",
    "diffuse_3_steps": f"with {_L}, " + ", ".join(f"x{k} as (select p.node, 0.9e0 * (p.x - 0.25e0 * coalesce(q.x, 0e0)) as x from x{k - 1} p left join (select row_ as node, sum(val * x) as x from l join x{k - 1} on col_ = node group by row_) q on p.node = q.node)" for k in (1, 2, 3)) + " select node, round(x, 6) + 0e0 as x from x3",
    "components": f"with recursive {_TRADE}, c as (select p_partkey as node, p_partkey as root from part union select y.dst, c.root from c join y on y.src = c.node where c.root <= y.dst) select node, dense_rank() over (order by min(root)) - 1 as component from c group by node",
    "hop_distances": f"with recursive {_TRADE}, u as (select distinct src, dst from y), h(src, dst, hops) using key (src, dst) as (select p_partkey, p_partkey, 0 from part union select h.src, u.dst, min(h.hops) + 1 from h join u on h.dst = u.src left join recurring.h r on r.src = h.src and r.dst = u.dst where r.src is null group by h.src, u.dst) select src, dst, cast(hops as integer) as hops from h",
    "modularity_by_label": f"with {_TRADE}, m as (select count(*) as m from e where src <> dst), t as (select src % 9 as label, count(*) as d, count(*) filter (src % 9 = dst % 9) as i2 from y group by 1) select round(sum(i2 / 2e0 / m - pow(d / (2e0 * m), 2)), 6) + 0e0 as q from t, m",
}
