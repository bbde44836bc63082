"""Graphs as edges (edge_id, src, dst) and nodes (node): undirected, parallel links count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import order
from quillon.session import drop, materialise, ship

#: Most links, and most nodes, of a graph that is broadcast (about 100 MB).
DENSE_LINKS = 1 << 22
#: Most links that one task takes as a whole to label components (4 MB).
ONE_TASK = 1 << 18
#: Most links (both directions) of a component that a task gets whole for searches, sources that it searches,
#: links of which it holds the bits of ends at once, and most tasks of such searches. More sources go to a task where a
#: `FEW_TASKS`th of all is more, for links are sent once to each task of a component.
TASK_LINKS, TASK_SOURCES, SEARCH_LINKS, MOST_TASKS, FEW_TASKS = 1 << 23, 1 << 12, 1 << 19, 1 << 12, 64
#: Neighbours of each node by which components are labelled before all links are looked at.
FIRST_NEAR = 2


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, self-loops dropped, parallel links kept."""
    e = edges.where("src != dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, neighbours) in edge order."""
    e = edges.where("src != dst")
    both = e.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("to")).union(e.select("edge_id", "dst", "src"))
    lists = both.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("edge_id", "to"))).alias("l")).select("node", F.col("l.to").alias("neighbours"))
    return nodes.join(lists, "node", "left").select("node", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))


def laplacian(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, col, val) of I - D^-1/2 A D^-1/2; an isolated node has 1 on the diagonal."""
    d = degree(nodes, edges)
    a, b = (d.select(F.col("node").alias(n), F.col("degree").alias(f"_{n}")) for n in ("src", "dst"))
    off = symmetric(edges).join(a, "src").join(b, "dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), (-1 / F.sqrt(F.col("_src") * F.col("_dst"))).alias("val"))
    return off.union(nodes.select(F.col("node"), F.col("node"), F.lit(1.0)))


def apply(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(node, x): matrix (row, col, val) times x (node, x)."""
    return matrix.join(x, F.col("col") == F.col("node")).groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("x")).withColumnRenamed("row", "node")


def diffuse(u: DataFrame, matrix: DataFrame, dt: float, steps: int, decay: float = 1.0) -> DataFrame:
    """u <- decay (u - dt L u), steps times; dt must be at most 0.45."""
    if not dt <= 0.45:
        raise ValueError("dt must be at most 0.45")
    for k in range(steps):
        change = apply(matrix, u).withColumnRenamed("x", "_lx")
        u = u.join(change, "node", "left").select("node", (F.lit(decay) * (F.col("x") - dt * F.coalesce("_lx", F.lit(0.0)))).alias("x"))
        if k % 3 == 2:
            u = materialise(u, "diffuse")
    return u


def _labels_in_a_task(batches):
    """All links -> (node, component), by rounds of minimum labels over arrays."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    src, dst = (np.concatenate(p) for p in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["node", "c"])


def contracted(links: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(node, top) for every end of links (src, dst), which are distinct and in both directions, and the
    links of that kind between tops, both written. A node goes to its neighbour of the smallest hash, if that is
    below its own, and on from there, four steps in all; about half of the nodes or fewer are tops."""
    key = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("n"))
    least = links.groupBy(F.col("src").alias("node")).agg(F.min(key("dst")).alias("k"))
    top = materialise(least.select("node", F.when(F.col("k") < key("node"), F.col("k.n")).otherwise(F.col("node")).alias("top")), "tops")
    for _ in range(2):
        up = top.select(F.col("node").alias("_n"), F.col("top").alias("_up"))
        top = materialise(top.join(up, F.col("top") == F.col("_n")).select("node", F.col("_up").alias("top")), "tops")
    for end in ("src", "dst"):
        links = links.join(top.select(F.col("node").alias(end), F.col("top").alias(f"_{end}")), end)
    return top, materialise(links.where("_src != _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "links")


def _through(tops: list[DataFrame]) -> DataFrame:
    """(node, top) after steps (node, top), the first of which names all nodes."""
    out = tops[-1]
    for t in reversed(tops[:-1]):
        out = t.join(out.select(F.col("node").alias("_n"), F.col("top").alias("_up")), F.col("top") == F.col("_n"), "left").select("node", F.coalesce("_up", "top").alias("top"))
    return out


def linked_components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, c): smallest node of its component for every end of links (src, dst), written. The graph is
    contracted, the more links the more often but whatever its diameter, until one task takes the rest
    (up to `one_task` links of whole numbers) or no link is left."""
    kind = dict(links.dtypes)["src"]
    whole = kind in ("int", "bigint") and dict(links.dtypes)["dst"] == kind
    fits = lambda e: whole and e.limit(one_task + 1).count() <= one_task
    in_task = lambda e: e.coalesce(1).mapInArrow(_labels_in_a_task, f"node {kind}, c {kind}")
    ship(links.sparkSession)
    if fits(links):
        return materialise(in_task(links), "labels")
    links, tops = materialise(symmetric(links).distinct(), "links"), []
    while not links.isEmpty():
        if fits(links):
            tops.append(in_task(links).withColumnRenamed("c", "top"))
            break
        top, links = contracted(links, len(tops))
        tops.append(top)
    if not tops:
        return materialise(links.select(F.col("src").alias("node"), F.col("src").alias("c")), "labels")
    top = materialise(_through(tops), "labels")
    least = top.groupBy("top").agg(F.min("node").alias("c"))
    return materialise(top.join(least, "top").select("node", "c"), "labels")


def clusters(links: DataFrame, size: int, most: int) -> DataFrame:
    """(node, cluster) for every end of links (src, dst), written: neighbours together, `size` of them on average
    unless components are smaller, at most about `most`."""
    links = materialise(symmetric(links).distinct(), "links")
    out, level, n, left = None, 0, None, None
    while not links.isEmpty() and (n is None or left * size > n):
        top, links = contracted(links, level)
        if out is None:
            many = top.groupBy("top").agg(F.ceil(F.count("*") / most).alias("_parts"))
            out = top.join(many, "top").select("node", "top", F.xxhash64(F.lit(0), "top", F.pmod(F.xxhash64("node"), F.col("_parts"))).alias("cluster"))
        else:  # a cluster grows into the next level's where that is not too large
            to = out.join(top.select(F.col("node").alias("_n"), F.col("top").alias("_up")), F.col("top") == F.col("_n"), "left").select("node", F.coalesce("_up", "top").alias("top"), "cluster")
            whole = to.groupBy("top").agg((F.count("*") <= most).alias("_whole"))
            out = to.join(whole, "top").select("node", "top", F.when(F.col("_whole"), F.xxhash64(F.lit(level), "top")).otherwise(F.col("cluster")).alias("cluster"))
        out, level = materialise(out, "clusters"), level + 1
        n, left = n or out.count(), out.select("top").distinct().count()
    if out is None:
        return links.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("cluster"))
    return out.select("node", "cluster")


def components(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): smallest node of its component. Nodes are of any ordered type; null
    nodes are left out, and so are links that miss a node.

    Up to `one_task` links are labelled in one task, if nodes are whole numbers; more are contracted first.
    """
    nodes = nodes.where("node is not null").select("node")
    links = edges.where("src != dst").select("src", "dst")
    links = links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = materialise(links.select("src", "dst"), "links")
    return materialise(nodes.join(linked_components(links, one_task), "node", "left").select("node", F.coalesce("c", "node").alias("component")), "labels")


def numbered_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): components numbered from 0 in the order of their smallest nodes."""
    at = materialise(components(nodes, edges), "components")
    number = order.numbered(at.select("component").distinct(), ["component"], "_number")
    return at.join(number, "component").select("node", F.col("_number").alias("component"))


def _indexed(src: np.ndarray, dst: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links in both directions as arrays: all nodes in order, places of those with links, where the
    neighbours of each begin, and the places of neighbours."""
    names = np.unique(np.concatenate([own, src]))
    by = np.argsort(src, kind="stable")
    at, start = np.unique(np.searchsorted(names, src[by]), return_index=True)
    return names, at, start, np.searchsorted(names, dst[by]).astype(np.int32)


def _search(graph: tuple[np.ndarray, ...], sources: np.ndarray, limit: int | None):
    """Batches (src, dst, hops) by breadth-first search of 256 sources at a time, a bit each."""
    names, at, start, near = graph
    end = np.append(start[1:], len(near))
    cuts = np.searchsorted(end, np.arange(SEARCH_LINKS, len(near), SEARCH_LINKS)) if len(near) else []
    parts = [(i, j) for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True) if i < j]
    for first in range(0, len(sources), 256):
        some = sources[first : first + 256]
        k = np.arange(len(some))
        front = np.zeros((len(names), -(-len(some) // 64)), np.uint64)
        front[np.searchsorted(names, some), k >> 6] = np.uint64(1) << (k & 63).astype(np.uint64)
        seen, hops = front.copy(), 0
        while True:
            rows = np.flatnonzero(front.any(axis=1))
            for i in range(0, len(rows), 2048):
                mine = rows[i : i + 2048]
                row, col = np.nonzero(np.unpackbits(front[mine].astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array(some[col]), pa.array(names[mine[row]]), pa.array(np.full(len(row), hops, np.int32))], names=["src", "dst", "hops"])
            if not len(rows) or not len(near) or limit is not None and hops == limit:
                break
            reach = np.zeros_like(front)
            for i, j in parts:
                reach[at[i:j]] = np.bitwise_or.reduceat(front[near[start[i] : end[j - 1]]], start[i:j] - start[i], axis=0)
            front = reach & ~seen
            seen |= front
            hops += 1


def _hops_in_tasks(own: DataFrame, links: DataFrame, limit: int | None) -> DataFrame:
    """(src, dst, hops): search of 256 sources in a task, with the links broadcast; the caller has
    checked how many there are."""
    spark = links.sparkSession
    table = links.toArrow()
    own = np.unique(own.toArrow()["node"].to_numpy())
    known = spark.sparkContext.broadcast((_indexed(table["src"].to_numpy(), table["dst"].to_numpy(), own), own))

    def run(batches):
        graph, own = known.value
        for batch in batches:
            for k in batch.column(0).to_numpy():
                yield from _search(graph, own[256 * k : 256 * k + 256], limit)

    tasks = max(1, -(-len(own) // 256))
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "src long, dst long, hops int")


def _labelled(near: DataFrame) -> DataFrame:
    """(node, c): smallest node of its component for every row (src, near) of all neighbours, which both ends have.

    A few links of each node are labelled first; of the others only those between two labels are moved."""
    some = near.select("src", F.explode(F.slice("near", 1, FIRST_NEAR)).alias("dst"))
    label = linked_components(some)
    at = near.join(label.withColumnRenamed("node", "src"), "src").select(F.explode("near").alias("node"), F.col("c").alias("src")).distinct()
    across = materialise(at.join(label, "node").where("src != c").select("src", F.col("c").alias("dst")).distinct(), "across")
    more = linked_components(across).select(F.col("node").alias("c"), F.col("c").alias("_c"))
    return materialise(label.join(more, "c", "left").select("node", F.coalesce("_c", "c").alias("c")), "labels")


def _hops_by_component(own: DataFrame, near: DataFrame, label: DataFrame, limit: int | None) -> DataFrame:
    """(src, dst, hops): sources (node, c) of a component are dealt to as few tasks as keep all busy, smaller
    components to one of `TASK_SOURCES`; with them go the neighbours (src, near) of their components
    (node, c), which the caller has bounded."""
    spark = own.sparkSession
    sources = materialise(order.numbered(own.select("node", "c"), ["c", "node"], "index"), "sources")
    share = max(TASK_SOURCES, -(-sources.count() // FEW_TASKS))
    size = sources.groupBy("c").agg(F.min("index").alias("_at"), F.count("*").alias("_n"))
    size = size.withColumn("_parts", F.greatest(F.lit(1), F.round(F.col("_n") / share).cast("long"))).withColumn("_first", F.expr(f"_at div {TASK_SOURCES}"))
    sources = materialise(sources.join(size, "c").select("node", "c", F.expr("_first + (index - _at) * _parts div _n").alias("t"), "_first", "_parts"), "sources")
    reach = label.join(sources.select("c", "_first", "_parts").distinct(), "c").select(F.col("node").alias("src"), "_first", "_parts")
    rows = near.join(reach, "src").select(F.explode(F.expr("sequence(_first, _first + _parts - 1)")).alias("t"), "src", "near")
    rows = rows.union(sources.select("t", "node", F.lit(None).cast("array<long>")))

    def solve(batches):
        table = pa.Table.from_batches(batches)
        src, near = table["src"].combine_chunks().to_numpy(), table["near"].combine_chunks()
        alone = near.is_null().to_numpy(zero_copy_only=False)
        many = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return _search(_indexed(np.repeat(src, many), near.flatten().to_numpy(), src[alone]), np.sort(src[alone]), limit)

    def run(batches):
        kept, now = [], None
        for batch in batches:
            at, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            for t, i, j in zip(at, first, [*first[1:], batch.num_rows], strict=True):
                if kept and t != now:
                    yield from solve(kept)
                    kept = []
                now = t
                kept.append(batch.slice(i, j - i))
        if kept:
            yield from solve(kept)

    tasks = sources.agg(F.count_distinct("t")).first()[0]
    dealt = rows.repartitionByRange(max(1, min(tasks, MOST_TASKS)), "t").sortWithinPartitions("t")
    return dealt.mapInArrow(run, "src long, dst long, hops int")


def hop_distances(nodes: DataFrame, edges: DataFrame, limit: int | None = None, dense: int = DENSE_LINKS, task: int = TASK_LINKS) -> DataFrame:
    """(src, dst, hops) of reachable pairs from `nodes`; `limit` stops at so many hops.

    Up to `dense` links (both directions) and as many nodes, links are broadcast and sources searched in
    tasks, a bit each. Beyond, a task searches some sources of a component with the component's links; only in
    components of more than `task` links do frontiers meet the links in joins, in which a link carries
    64 neighbouring sources in one row. Nodes are whole numbers; null nodes are left out, on any way.
    """
    kind = dict(nodes.dtypes)["node"]
    typed = lambda df: df.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "hops")
    links = symmetric(edges).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    # One move of the links makes them distinct and gathers them by node.
    near = materialise(links.repartition("src").distinct().groupBy("src").agg(F.collect_list("dst").alias("near")), "near")
    pairs = lambda n: n.select("src", F.explode("near").alias("dst"))
    own = materialise(nodes.where("node is not null").select(F.col("node").cast("long").alias("node")).distinct(), "hops")
    ship(links.sparkSession)
    many = near.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0]
    if many <= dense and own.limit(dense + 1).count() <= dense:
        return typed(_hops_in_tasks(own, pairs(near), limit))
    label = _labelled(near)
    out = own.join(label, "node", "left_anti").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hops"))
    at = label.withColumnRenamed("node", "src")
    large = materialise(near.select("src", F.size("near").alias("_n")).join(at, "src").groupBy("c").agg(F.sum("_n").alias("_n")).where(F.col("_n") > task).select("c"), "large")
    if large.isEmpty():
        return typed(out.union(_hops_by_component(own.join(label, "node"), near, label, limit)))
    in_task = label.join(large, "c", "left_anti")
    out = out.union(_hops_by_component(own.join(in_task, "node"), near, in_task, limit))
    far = label.join(large, "c", "left_semi").select("node")
    links = materialise(pairs(near.join(far.withColumnRenamed("node", "src"), "src", "left_semi")), "links")
    return typed(out.union(_hops_by_joins(own.join(far, "node", "left_semi"), links, limit)))


def _hops_by_joins(own: DataFrame, links: DataFrame, limit: int | None) -> DataFrame:
    """(src, dst, hops): sources go in blocks of 64 neighbouring numbers, a bit each, in one row."""
    own = own.select("node", F.expr("shiftright(node, 6)").alias("block"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bits"))
    seen = front = materialise(own, "hops")
    found = [front]
    while limit is None or len(found) <= limit:
        reach = front.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("_new"))
        new = reach.join(seen, ["node", "block"], "left").select("node", "block", F.expr("_new & ~coalesce(bits, 0L)").alias("bits"))
        front = materialise(new.where("bits != 0"), "hops")
        if front.isEmpty():
            break
        found.append(front)
        before, seen = seen, materialise(seen.union(front).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")), "seen")
        if before is not found[0]:
            drop(before)
    out = None
    for k, f in enumerate(found):
        pairs = _pairs(f.select("node", "block", "bits", F.lit(k).alias("hops")))
        out = pairs if out is None else out.union(pairs)
    return out


def _pairs(bits: DataFrame) -> DataFrame:
    """(src, dst, hops) of rows (node, block, bits, hops)."""
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1L = 1L)")).alias("_bit")
    return bits.select("node", "block", "hops", bit).select(F.expr("shiftleft(block, 6) + _bit").alias("src"), F.col("node").alias("dst"), "hops")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q): of labels (node, label); 0 without edges. Self-loops are skipped. One pass over the
    edges' ends counts degrees and inner links of every label; their sum is the total."""
    e = edges.where("src != dst")
    a, b = (labels.select(F.col("node").alias(n), F.col("label").alias(f"_{n}")) for n in ("src", "dst"))
    inside = F.when(F.col("_src") == F.col("_dst"), 0.5).otherwise(0.0).alias("i")
    ends = e.join(a, "src").join(b, "dst").select(F.explode(F.array("_src", "_dst")).alias("label"), inside)
    by_label = ends.groupBy("label").agg(F.count("*").alias("d"), F.sum("i").alias("i"))
    sums = by_label.agg(F.sum("i").alias("i"), F.sum("d").alias("d"), F.sum(F.col("d").cast("double") * F.col("d")).alias("d2"))
    return sums.select(F.coalesce(2 * F.col("i") / F.col("d") - F.col("d2") / (F.col("d").cast("double") * F.col("d")), F.lit(0.0)).alias("q"))
