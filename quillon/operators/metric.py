"""Graphs with link lengths: shortest paths, curvature, flow, heat."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph, near, transport
from quillon.session import materialise, partitions, ship

EPS = 1e-12
#: Most links of a graph that is broadcast (both directions in arrays, some 50 MB).
DENSE = 1 << 20
#: Nodes of a block of a larger graph, on average and at most.
BLOCK, BLOCK_MOST = 256, 4096
#: Default times of the heat kernel and the largest component decomposed.
HKS_TIMES, HKS_MAX_DENSE = (1.0, 10.0), 600
#: Heat by series: nodes of a task (more than `HKS_MAX_DENSE`), of a block in it, cells of a block's products.
SERIES_NODES, SERIES_BLOCK, SERIES_CELLS = 4096, 256, 1 << 22


def _both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, length): the shortest of parallel links, in both directions, without loops."""
    e = edges.where("src != dst")
    return e.select("src", "dst", "length").union(e.select("dst", "src", "length")).groupBy("src", "dst").agg(F.min("length").alias("length"))


def _is_small(edges: DataFrame, dense: int) -> bool:
    return edges.limit(dense + 1).count() <= dense


def shortest_paths(nodes: DataFrame, edges: DataFrame, dense: int = DENSE) -> DataFrame:
    """(src, dst, dist) of reachable pairs over edges (edge_id, src, dst, length).

    Lengths must be positive; pairs apart have no row; null nodes are left out. Up to `dense` links of whole
    numbers, the links are broadcast and sources are searched in tasks; beyond, see `paths_within`.
    """
    spark = edges.sparkSession
    kind = dict(nodes.dtypes)["node"]
    nodes = nodes.where("node is not null").select("node")
    links = materialise(edges.where("src != dst").select(F.lit(0).alias("edge_id"), F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("length").cast("double").alias("length")), "links")
    if kind not in ("int", "bigint") or not _is_small(links, dense):
        return paths_within(nodes, links, None)
    ship(spark)
    known = spark.sparkContext.broadcast(near.net(links))

    def run(batches):
        net = known.value
        for batch in batches:
            for name in batch.column(0).to_pylist():
                i = int(net.at(np.int64(name)))
                found = net.search(i) if i < len(net.names) and net.names[i] == name else None
                at, far = (net.names[list(found)], list(found.values())) if found else ([name], [0.0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(far), pa.int64()), pa.array(at, pa.int64()), pa.array(far, pa.float64())], names=["src", "dst", "dist"])

    found = nodes.repartition(partitions(spark)).select(F.col("node").cast("long").alias("node")).mapInArrow(run, "src long, dst long, dist double")
    return found.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "dist")


def paths_within(nodes: DataFrame, edges: DataFrame, radius: DataFrame | None) -> DataFrame:
    """(src, dst, dist) of pairs no farther than their source's radius (node, radius; None: any).

    Rounds relax only the pairs that the round before made shorter, and only within the
    radius, so what a round writes are the pairs near their sources.
    """
    links = materialise(_both_ways(edges).select(F.col("src").alias("_mid"), F.col("dst").alias("_to"), "length"), "links")
    start = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("dist"))
    if radius is None:
        start = start.withColumn("radius", F.lit(float("inf")))
    else:
        start = start.join(radius.select(F.col("node").alias("src"), "radius"), "src")
    best = front = materialise(start, "paths")
    while not front.isEmpty():
        step = front.withColumnRenamed("dst", "_mid").join(links, "_mid").withColumn("_new", F.col("dist") + F.col("length")).where("_new <= radius")
        step = step.groupBy("src", F.col("_to").alias("dst")).agg(F.min("_new").alias("_new"), F.min("radius").alias("_radius"))
        both = best.join(step, ["src", "dst"], "full").select("src", "dst", F.least("dist", "_new").alias("dist"), F.coalesce("radius", "_radius").alias("radius"), F.coalesce(F.col("_new") < F.col("dist"), F.col("dist").isNull()).alias("_less"))
        both = materialise(both, "paths")
        best, front = both.drop("_less"), both.where("_less").drop("_less")
    return best.drop("radius")


def _reach(edges: DataFrame) -> DataFrame:
    """(node, radius): how far the other end's neighbours can be from a node next to a link's end."""
    links = materialise(_both_ways(edges), "reach")
    most = links.groupBy(F.col("src").alias("dst")).agg(F.max("length").alias("_most"))
    two = materialise(links.join(most, "dst").groupBy("src").agg(F.max(F.col("length") + F.col("_most")).alias("two")), "reach")
    three = links.join(two.select(F.col("src").alias("dst"), F.col("two").alias("_two")), "dst").groupBy("src").agg(F.max(F.col("length") + F.col("_two")).alias("three"))
    return two.join(three, "src").select(F.col("src").alias("node"), (F.greatest("two", "three") * (1 + 1e-9)).alias("radius"))


def _problem(net: near.Net, u: int, v: int, alpha: float, lengths: bool):
    """Masses that one walk has over the other's, those that it lacks, and their distances; None for equal walks."""
    (a, x), (b, y) = net.walk(u, alpha), net.walk(v, alpha)
    places, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    m = np.bincount(at, np.concatenate([x, -y]))
    give, take = places[m > EPS], places[m < -EPS]
    if not len(give) or not len(take):
        return None
    return m[m > EPS], -m[m < -EPS], net.lengths(give, take) if lengths else net.hops(give, take)


def _solved(net: near.Net, edge_id: pa.Array, src: np.ndarray, dst: np.ndarray, alpha: float, lengths: bool) -> pa.RecordBatch:
    """Transports of a batch of links: None where both walks are equal. Equal problems are solved once."""
    done, ends, known = [], {}, {}
    for u, v in zip(net.at(src).tolist(), net.at(dst).tolist(), strict=True):
        if (u, v) not in ends:
            p = _problem(net, u, v, alpha, lengths)
            key = None if p is None else tuple(x.tobytes() for x in p)
            if key is not None and key not in known:
                plan = transport.Plan(*p)
                known[key] = plan.total, plan.routes, plan.rises
            ends[u, v] = None if key is None else known[key]
        done.append(ends[u, v])
    cols = [pa.array([None if d is None else d[k] for d in done], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([edge_id, *cols], names=["edge_id", "cost", "routes", "rises"])


def _transports(nodes: DataFrame, edges: DataFrame, alpha: float, lengths: bool, dense: int, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links that are no loops (edge_id, ..., _len), and for those whose ends' walks differ
    (edge_id, cost, routes, rises).

    Up to `dense` links they are broadcast, and tasks take links by ranges of their source, so
    that a task's searches serve its next links. Beyond, a task takes the links of a block of
    neighbouring nodes and the part of the graph around it. Either way many links are solved in one
    Arrow batch.
    """
    spark = edges.sparkSession
    ship(spark)
    e = edges.where("src != dst").withColumn("_len", F.col("length").cast("double") if lengths else F.lit(1.0)).select("edge_id", "src", "dst", "_len")
    kind = dict(edges.dtypes)["edge_id"]
    schema = f"edge_id {kind}, cost double, routes long, rises long"
    whole = dict(edges.dtypes)["src"] in ("int", "bigint") and dict(edges.dtypes)["dst"] in ("int", "bigint")
    e = materialise(e, "transport")
    if not whole or not _is_small(e, dense):
        return e, _transports_by_blocks(e, alpha, lengths, schema, block_nodes(e) if blocks is None else blocks)
    known = spark.sparkContext.broadcast(near.net(e.select("src", "dst", F.col("_len").alias("length"))))

    def run(batches):
        net = known.value
        for batch in batches:
            yield _solved(net, batch.column("edge_id"), *(batch.column(c).to_numpy() for c in ("src", "dst")), alpha, lengths)

    dealt = e.repartitionByRange(4 * partitions(spark), "src", "dst").sortWithinPartitions("src", "dst").select("edge_id", "src", "dst")
    return e, dealt.mapInArrow(run, schema).where("cost is not null")


def block_nodes(edges: DataFrame) -> DataFrame:
    """(node, block): blocks of neighbouring nodes, whose links a task takes together."""
    return graph.clusters(edges, BLOCK, BLOCK_MOST).withColumnRenamed("cluster", "block")


def _around(ends: DataFrame, links: DataFrame, reach: DataFrame) -> DataFrame:
    """(block, node): what shortest paths between places of a block (block, node) pass. A path is no
    longer than either end's reach, so half a reach from each end covers it. Rounds carry for each node of a
    block how much of a reach is left there, not how far it is from every place."""
    start = ends.join(reach, "node").select("block", "node", (F.col("radius") / 2).alias("left"))
    best = front = materialise(start, "around")
    rounds = 0
    while not front.isEmpty():
        step = front.join(links, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), (F.col("left") - F.col("_len")).alias("_new")).where("_new >= 0")
        step = step.groupBy("block", "node").agg(F.max("_new").alias("_new"))
        new = step.join(best.groupBy("block", "node").agg(F.max("left").alias("left")), ["block", "node"], "left").where("left is null or _new > left")
        front = materialise(new.select("block", "node", F.col("_new").alias("left")), "around")
        best, rounds = best.union(front), rounds + 1
        if rounds % 8 == 0:
            best = materialise(best.groupBy("block", "node").agg(F.max("left").alias("left")), "around")
    return best.select("block", "node").distinct()


def _transports_by_blocks(e: DataFrame, alpha: float, lengths: bool, schema: str, blocks: DataFrame) -> DataFrame:
    """(edge_id, cost, routes, rises) of links (edge_id, src, dst, _len), a block of them in a task with all links of their
    ends and of their ends' neighbours, and with lengths of all nodes that shortest paths there pass."""
    links = materialise(e.select("src", "dst", "_len").union(e.select("dst", "src", "_len")), "both-ways")
    own = materialise(e.join(blocks.withColumnRenamed("node", "src"), "src").select("block", "edge_id", "src", "dst", "_len", F.lit(True).alias("own")), "block-links")
    ends = own.select("block", F.explode(F.array("src", "dst")).alias("node")).distinct()
    ends = materialise(ends.join(links, F.col("node") == F.col("src")).select("block", F.explode(F.array("src", "dst")).alias("node")).distinct(), "block-ends")
    inside = _around(ends, links, _reach(e.withColumnRenamed("_len", "length"))) if lengths else ends
    near_by = inside.join(links, F.col("node") == F.col("src")).select("block", F.lit(None).cast(dict(e.dtypes)["edge_id"]).alias("edge_id"), "src", "dst", "_len", F.lit(False).alias("own"))

    def solve(table: pa.Table) -> pa.Table:
        mine = table["own"].to_numpy()
        src, dst = (table[c].to_numpy() for c in ("src", "dst"))
        # A link comes from both its ends, or from one if the other is outside.
        once = ~mine & ((src < dst) | ~np.isin(dst, np.unique(src[~mine])))
        net = near.Net(src[once], dst[once], table["_len"].to_numpy()[once])
        done = _solved(net, table["edge_id"].filter(pa.array(mine)).combine_chunks(), src[mine], dst[mine], alpha, lengths)
        return pa.Table.from_batches([done])

    return own.union(near_by).groupBy("block").applyInArrow(solve, schema).where("cost is not null")


def curvature(nodes: DataFrame, edges: DataFrame, alpha: float = 0.5, lengths: bool = False, dense: int = DENSE, blocks: DataFrame | None = None) -> DataFrame:
    """(edge_id, kappa): one less the transport cost of the lazy walks at a link's two ends.

    A walk keeps `alpha` and spreads the rest evenly over its neighbours, parallel links
    counted. With `lengths` costs are shortest paths over the column length and kappa is per
    length. A self-loop has 0, equal walks 1. Mass that both walks share stays; so the
    distances that count are near the link, and nothing asks for those of all pairs. `blocks`: `block_nodes`
    of the edges, where they are known.
    """
    e, cost = _transports(nodes, edges, alpha, lengths, dense, blocks)
    known = e.join(cost, "edge_id", "left").select("edge_id", (1 - F.coalesce("cost", F.lit(0.0)) / F.col("_len")).alias("kappa"))
    return known.union(edges.where("src = dst").select("edge_id", F.lit(0.0)))


def transport_tally(nodes: DataFrame, edges: DataFrame, alpha: float = 0.5, dense: int = DENSE) -> DataFrame:
    """(problems, routes, rises): transports solved for a graph's curvature, paths along which they
    sent mass, and times that their prices rose, in all."""
    _, cost = _transports(nodes, edges, alpha, False, dense)
    zero = F.lit(0).cast("long")
    return cost.agg(F.count("*").alias("problems"), F.coalesce(F.sum("routes"), zero).alias("routes"), F.coalesce(F.sum("rises"), zero).alias("rises"))


#: Fixed values of the flow: laziness, share of curvature taken in a step, shortest and longest link.
ALPHA, STEP, FLOOR, CEIL = 0.5, 0.5, 0.1, 16.0


def ricci_flow_step(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA, step: float = STEP, floor: float = FLOOR, ceil: float = CEIL, blocks: DataFrame | None = None) -> DataFrame:
    """(edge_id, src, dst, length, kappa) after one step from edges with lengths: each changes by its
    curvature within [floor, ceil], then all are scaled to mean 1; kappa is what drove the step."""
    now = edges.select("edge_id", "src", "dst", F.col("length").cast("double").alias("length"))
    k = curvature(nodes, now, alpha, lengths=True, blocks=blocks)
    moved = now.join(k, "edge_id").withColumn("length", F.least(F.lit(float(ceil)), F.greatest(F.lit(float(floor)), F.col("length") * (1 - step * F.col("kappa")))))
    moved = materialise(moved, "flow")
    mean = moved.agg(F.avg("length").alias("_mean"))
    return materialise(moved.join(F.broadcast(mean)).select("edge_id", "src", "dst", (F.col("length") / F.col("_mean")).alias("length"), "kappa"), "flow")


def ricci_flow(nodes: DataFrame, edges: DataFrame, steps: int, alpha: float = ALPHA, step: float = STEP, floor: float = FLOOR, ceil: float = CEIL) -> DataFrame:
    """(edge_id, src, dst, length, kappa) after `steps` steps from lengths of 1; kappa is that of the
    last step."""
    now = edges.select("edge_id", "src", "dst", F.lit(1.0).alias("length"), F.lit(0.0).alias("kappa"))
    blocks = None if _is_small(edges.where("src != dst"), DENSE) else block_nodes(edges)
    for _ in range(steps):
        now = ricci_flow_step(nodes, now, alpha, step, floor, ceil, blocks)
    return now


def _heat_by_series(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, wanted: range, times: list[float]) -> np.ndarray:
    """Signatures of the nodes `wanted` of a component, one row each: the squared length of
    exp(-t/2 L) e, as a Chebyshev series of L - 1, whose norm is at most 1. A term reaches one hop farther
    than the one before, so that a block of nodes needs only what lies within the series' length."""
    key, first = np.unique(row * n + col, return_index=True)  # of parallel links one counts
    row, col, val = row[first], col[first], np.where(row[first] == col[first], 0.0, val[first])
    start = np.searchsorted(row, np.arange(n + 1))
    # Coefficients exp(-s) I_k(s) by the trapezoid rule, which is exact to rounding here.
    s = np.array(times) / 2
    points = 1 << int(np.ceil(np.log2(64 + 16 * s.max())))
    angle = np.pi * (np.arange(points) + 0.5) / points
    waves = np.exp(s[:, None] * (np.cos(angle) - 1))
    terms = [waves.mean(1)]
    while len(terms) < points // 2 and np.abs(terms[-1]).max() > 1e-16:
        terms.append(2 * (-1) ** len(terms) * (waves * np.cos(len(terms) * angle)).mean(1))
    out = np.empty((len(wanted), len(times)))
    for at in range(0, len(wanted), SERIES_BLOCK):
        some = np.arange(wanted.start + at, min(wanted.start + at + SERIES_BLOCK, wanted.stop))
        inside = np.zeros(n, bool)
        inside[some] = True
        front = some
        for _ in terms:
            size = start[front + 1] - start[front]
            near = np.unique(col[np.repeat(start[front] - np.cumsum(size) + size, size) + np.arange(size.sum())])
            front = near[~inside[near]]
            if not len(front):
                break
            inside[front] = True
        ball = np.flatnonzero(inside)
        size = start[ball + 1] - start[ball]
        entry = np.repeat(start[ball] - np.cumsum(size) + size, size) + np.arange(size.sum())
        here, weight, first = np.searchsorted(ball, col[entry]), np.where(inside[col[entry]], val[entry], 0.0)[:, None], np.cumsum(size) - size
        here[here == len(ball)] = 0
        step = max(1, min(len(some), SERIES_CELLS // len(entry)))
        for i in range(0, len(some), step):
            mine = some[i : i + step]
            old = np.zeros((len(ball), len(mine)))
            old[np.searchsorted(ball, mine), np.arange(len(mine))] = 1.0
            times_m = lambda x: np.add.reduceat(weight * x[here], first, axis=0)
            now = times_m(old)
            sums = [c * old for c in terms[0]]
            for k, c in enumerate(terms[1:]):
                if k:
                    old, now = now, 2 * times_m(now) - old
                for y, w in zip(sums, c, strict=True):
                    y += w * now
            out[at + i : at + i + len(mine)] = np.array([(y * y).sum(0) for y in sums]).T
    return out


def heat_kernel_signature(nodes: DataFrame, edges: DataFrame, times=HKS_TIMES, max_dense: int | None = HKS_MAX_DENSE) -> DataFrame:
    """(node, t, hks) of each component's normalised Laplacian; nodes of components over `max_dense`
    nodes (None: of none) have their degree's share of it, the limit of large t.

    Components of up to `HKS_MAX_DENSE` nodes are decomposed, larger ones are solved by series
    in tasks of `SERIES_NODES` nodes each, in memory that grows with the component's links.
    """
    ship(edges.sparkSession)
    comp = graph.components(nodes, edges)
    size = comp.groupBy("component").agg(F.count("*").alias("_size"))
    size = size.select("component", (F.lit(True) if max_dense is None else F.col("_size") <= max_dense).alias("_dense"), F.ceil(F.col("_size") / SERIES_NODES).cast("int").alias("_tasks"))
    comp = materialise(comp.join(size, "component"), "components")
    times = [float(t) for t in times]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(pdf["row"], sort=True)
        n, to = len(names), np.searchsorted(names, pdf["col"])
        if n <= HKS_MAX_DENSE:
            a = np.zeros((n, n))
            a[at, to] = pdf["val"]
            values, vectors = np.linalg.eigh(a)
            out = vectors**2 @ np.exp(-np.outer(values, times))
        else:
            k = int(pdf["_task"].iloc[0]) * SERIES_NODES
            wanted = range(k, min(k + SERIES_NODES, n))
            out = _heat_by_series(at, to, pdf["val"].to_numpy(), n, wanted, times)
            names = names[wanted.start : wanted.stop]
        return pd.DataFrame({"node": np.repeat(names, len(times)), "t": np.tile(times, len(names)), "hks": out.ravel()})

    kind = dict(nodes.dtypes)["node"]
    own = comp.where("_dense").withColumnRenamed("node", "row").withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    matrix = graph.laplacian(nodes, edges).join(own, "row").select("component", "_task", "row", "col", "val")
    small = matrix.groupBy("component", "_task").applyInPandas(solve, f"node {kind}, t double, hks double")
    if max_dense is None:
        return small
    large = graph.degree(nodes, edges).join(comp.where("!_dense"), "node")
    whole = large.groupBy("component").agg(F.sum("degree").alias("_all"))
    share = large.join(whole, "component").select("node", F.explode(F.array(*map(F.lit, times))).alias("t"), (F.col("degree") / F.col("_all")).alias("hks"))
    return small.union(share)


def magnitudes(df: DataFrame, value: str, floor: float = 1e-12) -> DataFrame:
    """Adds magnitude: -2.5 log10 of the share of the largest value; all 0 where that is not positive."""
    top = df.agg(F.max(value).alias("_top"))
    share = F.greatest(F.col(value), F.lit(floor)) / F.col("_top")
    return df.join(F.broadcast(top)).withColumn("magnitude", F.when(F.col("_top") > 0, -2.5 / math.log(10) * F.log(share)).otherwise(0.0)).drop("_top")


def procrustes(layout: DataFrame, target: DataFrame) -> DataFrame:
    """(node, x, y), and z as it is where `layout` has it: `layout` turned, mirrored or not, and
    moved onto `target` by node.

    Means and cross moments are one aggregation; the best of rotations and of reflections
    has a closed form in the plane.
    """
    rest = ["z"] if "z" in layout.columns else []
    both = layout.select("node", "x", "y").join(target.select("node", F.col("x").alias("u"), F.col("y").alias("v")), "node")
    mean = both.agg(*[F.avg(c).alias(f"_{c}") for c in "xyuv"])
    m = both.join(F.broadcast(mean)).select("*", *[(F.col(c) - F.col(f"_{c}")).alias(f"d{c}") for c in "xyuv"])
    s = m.agg(*[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(a + b) for a, b in ("xu", "xv", "yu", "yv")])
    turn, mirror = (F.hypot(F.expr("xu + yv"), F.expr("xv - yu")), F.hypot(F.expr("xu - yv"), F.expr("xv + yu")))
    s = s.select(F.when(turn >= mirror, 1.0).otherwise(-1.0).alias("_f"), F.when(turn >= mirror, F.expr("atan2(xv - yu, xu + yv)")).otherwise(F.expr("atan2(xv + yu, xu - yv)")).alias("_w"))
    return layout.select("node", "x", "y", *rest).join(F.broadcast(mean)).join(F.broadcast(s)).selectExpr("node", "_u + cos(_w) * (x - _x) - _f * sin(_w) * (y - _y) as x", "_v + sin(_w) * (x - _x) + _f * cos(_w) * (y - _y) as y", *rest)
