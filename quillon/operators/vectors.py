"""Vectors (node, v): cosines, similar pairs, agreement with a graph, layouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.draws import stream
from quillon.operators import graph, layout, metric, order
from quillon.session import materialise, partitions, ship

#: Vectors of a block; two blocks meet in one task.
BLOCK = 2048
#: Groups of blocks, more of them only where a group would hold more rows than these.
GROUPS, GROUP_ROWS = 16, 1 << 16
#: Most cells, and rows drawn for their pivots.
PIVOTS = 256
#: Most nodes whose rank matrices are broadcast (two of 8 n^2 bytes) for relabellings.
DENSE = 1500
#: The pairs listed, the least similarity and the quota of a node (0: none).
COUNT, MIN_SIM, PER_NODE = 12, 0.5, 0
#: Relabellings of the agreement test, and their seed.
PERMUTATIONS, SEED = 200, 1


def dot(a: Column, b: Column) -> Column:
    """Inner product; missing and null numbers count as 0."""
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: number(x) * number(y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one is the zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def known(vectors: DataFrame) -> DataFrame:
    """Vectors other than zero, of a node."""
    return vectors.where(F.col("node").isNotNull() & (dot(F.col("v"), F.col("v")) > 0))


def _unit(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a column (zeros at the end of shorter ones) and their sizes."""
    sizes = np.diff(np.asarray(column.offsets))
    x = np.zeros((len(sizes), width))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[np.repeat(np.arange(len(sizes)), sizes), at] = np.nan_to_num(np.asarray(column.flatten().cast(pa.float64()).fill_null(0.0)))
    return x, np.sqrt((x * x).sum(1))


class Blocks:
    """Vectors in blocks of near ones, and all pairs of blocks with the largest cosine they can have.

    Pivots are a bounded sample of rows; a vector goes to the pivot at the least angle, and a cell of more than
    `BLOCK` vectors is several blocks. By the triangle inequality on angles two blocks hold no pair
    nearer than the angle of their pivots less both largest angles to them.
    """

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        ship(spark)
        some = materialise(known(vectors).select(F.col("node").cast("long").alias("node"), F.col("v").cast("array<double>").alias("v")), "vectors")
        n, width = some.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        cells = min(PIVOTS, max(1, -(-2 * n // BLOCK)))
        rows = some.orderBy(F.xxhash64("node"), "node").limit(cells).select("v").collect()
        pivots = np.zeros((max(1, len(rows)), width))
        for k, r in enumerate(rows):
            pivots[k, : len(r.v)] = [x or 0.0 for x in r.v]
            pivots[k] /= np.linalg.norm(pivots[k])

        def assign(batches):
            for batch in batches:
                x, size = _unit(batch.column("v"), width)
                cos = np.clip(x @ pivots.T / size[:, None], -1.0, 1.0) if len(x) else np.zeros((0, 1))
                cell = cos.argmax(1) if len(x) else np.zeros(0, np.int64)
                angle = np.arccos(cos[np.arange(len(x)), cell])
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["node", "v", "cell", "angle"])

        placed = materialise(some.mapInArrow(assign, "node long, v array<double>, cell int, angle double"), "vectors-cells")
        # At most `PIVOTS` rows.
        parts = {r.cell: max(1, -(-r["count"] // BLOCK)) for r in placed.groupBy("cell").count().collect()}
        first, self.count = {}, 0
        for cell in sorted(parts):
            first[cell] = self.count
            self.count += parts[cell]
        table = spark.createDataFrame([(c, first[c], parts[c]) for c in sorted(parts)], "cell int, first int, parts int")
        self.places = placed.join(F.broadcast(table), "cell").withColumn("own", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
        self.rows = n
        self.width, self.vectors = width, materialise(self.places.select("node", "v", "own", "cell", "angle"), "vectors-blocks")
        turn = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
        between = spark.createDataFrame([(i, j, float(turn[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "ca int, cb int, turn double")
        reach = materialise(self.vectors.groupBy("own").agg(F.max("angle").alias("reach"), F.first("cell").alias("cell")), "vectors-reach")
        side = lambda c: reach.select(F.col("own").alias(c), F.col("reach").alias(f"r{c}"), F.col("cell").alias(f"c{c}"))
        pairs = side("a").select("a", "ra", "ca", F.explode(F.sequence("a", F.lit(max(0, self.count - 1)))).alias("b")).join(side("b"), "b").join(F.broadcast(between), ["ca", "cb"])
        least = F.greatest(F.lit(0.0), F.col("turn") - F.col("ra") - F.col("rb") - 1e-7)
        self.pairs = materialise(pairs.select(F.col("a").alias("p"), F.col("b").alias("q"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.cos(F.least(least, F.lit(float(np.pi))))).alias("most")), "vectors-pairs")

    def solve(self, pairs: DataFrame, edges: DataFrame | None, min_sim: float, top: int | None, per_node: int | None = None) -> DataFrame:
        """(a, b, sim) of the vectors of pairs of blocks (p, q): each pair is one product.

        Blocks lie in groups, and a task has the pairs of two groups, so that a row is sent once for each
        group, not for each block: `GROUPS` times, and a task holds two groups of at most `GROUP_ROWS` rows or
        `GROUPS`. Of a task's pairs the strongest `top` come back, before that of each node `per_node`.
        """
        spark, width = pairs.sparkSession, self.width
        block = self.vectors.select("node", "v", "own")
        groups = min(max(1, self.count), max(GROUPS, -(-self.rows // GROUP_ROWS)))
        group = lambda c, name: F.expr(f"cast(cast({c} as bigint) * {groups} div {max(1, self.count)} as int)").alias(name)
        some = pairs.select("p", "q", group("p", "gp"), group("q", "gq"))
        ends = some.select("gp", "gq", F.explode(F.array(F.struct(F.col("p").alias("own"), F.col("q").alias("to")), F.struct(F.col("q").alias("own"), F.lit(None).cast("int").alias("to")))).alias("e"))
        ends = ends.groupBy("gp", "gq", "e.own").agg(F.sort_array(F.collect_set("e.to")).alias("to"))
        left = block.join(ends, "own").select("node", "v", "own", "to", "gp", "gq")
        links = spark.createDataFrame([], "src long, dst long") if edges is None else edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src != dst")
        links = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        home = lambda c: block.select(F.col("node").alias(c), F.col("own").alias(f"o{c}"))
        links = links.join(home("a"), "a").join(home("b"), "b").select("a", "b", F.least("oa", "ob").alias("p"), F.greatest("oa", "ob").alias("q"))
        links = links.select("a", "b", "p", "q", group("p", "gp"), group("q", "gq"))

        def product(names, x, joined, same):
            sim = (x[0][0] @ x[1][0].T) / (x[0][1][:, None] * x[1][1][None, :])
            if same:
                sim[np.tril_indices(len(sim))] = -9
            for a, b in ((joined["a"], joined["b"]), (joined["b"], joined["a"])):
                i, j = (np.searchsorted(n, c.to_numpy()) for n, c in zip(names, (a, b), strict=True))
                here = (i < len(names[0])) & (j < len(names[1]))
                i, j, a, b = i[here], j[here], a.to_numpy()[here], b.to_numpy()[here]
                here = (names[0][i] == a) & (names[1][j] == b)
                sim[i[here], j[here]] = -9
            i, j = np.nonzero(sim >= max(min_sim, -2.0))
            a, b = names[0][i], names[1][j]
            return np.minimum(a, b), np.maximum(a, b), sim[i, j]

        def run(key: tuple, rows: pd.DataFrame, joined: pd.DataFrame) -> pd.DataFrame:
            parts = {k: r.sort_values("node") for k, r in rows.groupby("own")}
            near = dict(list(joined.groupby(["p", "q"])))
            names = {k: r["node"].to_numpy() for k, r in parts.items()}
            unit = {k: _unit(pa.array(r["v"], pa.list_(pa.float64())), width) for k, r in parts.items()}
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            found = [best]
            for p, r in parts.items():
                for q in r["to"].iloc[0]:
                    if q not in parts:
                        continue
                    found.append(product((names[p], names[q]), (unit[p], unit[q]), near.get((p, q), joined.iloc[:0]), p == q))
                    if top is not None:
                        best = _strongest(*(np.concatenate([x, y]) for x, y in zip(best, found.pop(), strict=True)), top, per_node)
            a, b, s = best if top is not None else (np.concatenate(x) for x in zip(*found, strict=True))
            return pd.DataFrame({"a": a, "b": b, "sim": s})

        return left.groupBy("gp", "gq").cogroup(links.groupBy("gp", "gq")).applyInPandas(run, "a long, b long, sim double")


def _strongest(a: np.ndarray, b: np.ndarray, s: np.ndarray, top: int, per_node: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `top` pairs in order, after those are gone that are not among an end's first `per_node`."""
    if len(s) > top or per_node is not None:
        at = np.lexsort((b, a, -np.round(s, 12)))
        if per_node is not None:
            ends = np.stack([a[at], b[at]], 1).ravel()
            by = np.argsort(ends, kind="stable")
            new = np.flatnonzero(np.diff(ends[by], prepend=ends[by][:1] - 1))
            rank = np.empty(len(ends), np.int64)
            rank[by] = np.arange(len(ends)) - np.repeat(new, np.diff(new, append=len(ends)))
            at = at[(rank.reshape(-1, 2) < per_node).all(1)]
        a, b, s = a[at[:top]], b[at[:top]], s[at[:top]]
    return a, b, s


def pair_cosines(vectors: DataFrame, edges: DataFrame | None = None, min_sim: float = -2.0) -> DataFrame:
    """(a, b, sim) for nodes a < b with sim >= min_sim that no edge joins.

    Pairs of blocks that cannot reach `min_sim` are left out; each other pair is one matrix product in one
    task, no pair of rows is shuffled, and a task holds two blocks. Zero vectors have no
    pairs; shorter vectors end in zeros, null numbers are 0. Nodes are whole numbers; null ones are left out.
    """
    blocks = Blocks(vectors)
    return blocks.solve(blocks.pairs.where(F.col("most") >= min_sim), edges, min_sim, None)


def strongest_pairs(vectors: DataFrame, edges: DataFrame, count: int, min_sim: float, per_node: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The `count` strongest pairs that no edge joins, of at least `min_sim`, as `similar_links` orders
    them, and how many pairs of blocks there are and were solved.

    The pairs of blocks that may hold the strongest go first; each round's weakest listed
    pair is the bound below which the next round's pairs of blocks are skipped, and rounds
    take four times as many as the one before. With `per_node`, pairs that are not among the first
    so many of both ends, by all that is known by then, are not listed.
    """
    blocks = Blocks(vectors)
    total = blocks.pairs.count()
    ranked = order.numbered(blocks.pairs.withColumn("_down", -F.col("most")), ["_down", "p", "q"], "_at")
    ranked = materialise(ranked, "vectors-ranked")
    place = [F.round("sim", 12).desc(), "a", "b"]
    best, least, start, size, solved = None, min_sim, 0, max(blocks.count, 4 * partitions(vectors.sparkSession)), 0
    while start < total:
        now = ranked.where((F.col("_at") >= start) & (F.col("_at") < start + size) & (F.col("most") >= least - 1e-9))
        some = now.count()
        if not some:
            break  # they come in order of what they can reach
        solved += some
        found = blocks.solve(now.select("p", "q"), edges, least - 1e-9 if least > min_sim else min_sim, count, per_node)
        if per_node is None:
            best = found if best is None else best.union(found)
        else:
            best = _first_of_ends(materialise(found if best is None else best.union(found), "vectors-found"), per_node)
        best = materialise(best.orderBy(*place).limit(count), "vectors-best")
        if count and best.count() == count:
            least = max(min_sim, best.agg(F.min("sim")).first()[0])
        start, size = start + size, 4 * size
    if best is None:
        best = vectors.sparkSession.createDataFrame([], "a long, b long, sim double")
    return best.orderBy(*place), {"pairs": total, "solved": solved}


def _first_of_ends(pairs: DataFrame, per_node: int) -> DataFrame:
    """Of pairs (a, b, sim) those that are, at both ends, among the node's first `per_node`."""
    key = F.struct((-F.round("sim", 12)).alias("s"), "a", "b")
    ends = pairs.select("a", "b", "sim", key.alias("k"), F.explode(F.array("a", "b")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("k"))
    return ends.withColumn("_rank", rank).where(F.col("_rank") <= per_node).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.count("*").alias("_n")).where("_n = 2").select("a", "b", "sim")


def _within_quota(pairs: DataFrame, per_node: int) -> DataFrame:
    """Of pairs (a, b, sim) those that a greedy pass down the list takes, a pair if both its nodes are in fewer
    than `per_node` taken before: in rounds, each takes the pairs that are, at both ends, among as
    many of the node's best as the node has places left."""
    left, out = materialise(pairs.withColumns({"fa": F.lit(per_node), "fb": F.lit(per_node)}), "quota"), None
    while not left.isEmpty():
        key = F.struct((-F.round("sim", 12)).alias("s"), "a", "b")
        ends = left.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("fa").alias("free")), F.struct(F.col("b").alias("node"), F.col("fb").alias("free")))).alias("e"), key.alias("k"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("k"))
        good = ends.select("a", "b", "e.node", "e.free", "k").withColumn("rank", rank).where("rank <= free").groupBy("a", "b").count().where("count = 2").select("a", "b")
        taken = materialise(left.join(good, ["a", "b"], "left_semi").select("a", "b", "sim"), "quota-taken")
        out = taken if out is None else out.union(taken)
        used = materialise(taken.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("used")), "quota-used")
        rest = left.join(taken.select("a", "b"), ["a", "b"], "left_anti")
        for c in "ab":
            rest = rest.join(used.select(F.col("node").alias(c), F.col("used").alias(f"u{c}")), c, "left").withColumn(f"f{c}", F.col(f"f{c}") - F.coalesce(f"u{c}", F.lit(0))).drop(f"u{c}")
        left = materialise(rest.where("fa > 0 and fb > 0").select("a", "b", "sim", "fa", "fb"), "quota")
    return pairs if out is None else out


def similar_links(vectors: DataFrame, edges: DataFrame, count: int = COUNT, min_sim: float = MIN_SIM, per_node: int = PER_NODE) -> DataFrame:
    """(a, b, sim) of the `count` strongest pairs that no edge joins, of at least `min_sim`.

    Order: sim (to twelve places) down, then a, then b. With `per_node`, a pair is listed
    only while both nodes are in fewer than `per_node` pairs before it.
    """
    if not per_node:
        return strongest_pairs(vectors, edges, count, min_sim)[0]
    if not count:
        return strongest_pairs(vectors, edges, 0, min_sim)[0]
    # Of the first `count` pairs taken at most `full` nodes are full. A pair that has `full` + `per_node` before it
    # at one end is not taken: the partners of those not taken were full. And each pair passed over has a full
    # node, which is in so many of the rest. So the pairs taken are among these strongest ones.
    full = 2 * count // per_node
    each = full + per_node
    kept = _within_quota(strongest_pairs(vectors, edges, count + full * each, min_sim, each)[0], per_node)
    return kept.orderBy(F.round("sim", 12).desc(), "a", "b").limit(count)


def relabellings(n: int, trials: range, seed: int) -> np.ndarray:
    """Permutations of 0..n-1, one row for each trial, by shuffles from the end with the
    generator's stream; trial k has the k-th n - 1 draws."""
    out = np.empty((len(trials), n), np.int64)
    for row, k in enumerate(trials):
        u = stream(seed, k * (n - 1), n - 1)
        p = np.arange(n)
        for i, x in zip(range(n - 1, 0, -1), u, strict=True):
            j = int(x * (i + 1))
            p[i], p[j] = p[j], p[i]
        out[row] = p
    return out


def mantel(pairs: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """(rho, p) of two distances: rank correlation over pairs (i, j, a, b) with i < j, one row for
    each pair of nodes, and the share of relabellings of a's nodes that reach it.

    Below three nodes or without variance rho is 0 and p is 1. Ranks are found over the
    distributed pairs. Up to `dense` nodes the two rank matrices are broadcast and trials are
    spread over tasks; beyond, relabelled pairs meet their ranks in a join.
    """
    spark = pairs.sparkSession
    ship(spark)
    nodes = pairs.select(F.col("i").alias("node")).union(pairs.select("j")).distinct()
    nodes = materialise(order.numbered(nodes, ["node"]), "mantel-nodes")
    n, m = nodes.count(), pairs.count()
    none = spark.createDataFrame([(0.0, 1.0)], "rho double, p double")
    if n < 3:
        return none
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("index").alias(f"_{c}"))
    ranked = order.average_rank(order.average_rank(pairs, "a", "ra"), "b", "rb")
    mean = (m + 1) / 2
    ranked = ranked.join(at("i"), "i").join(at("j"), "j").select("_i", "_j", (F.col("ra") - mean).alias("ra"), (F.col("rb") - mean).alias("rb"))
    ranked = materialise(ranked, "mantel-ranks")
    va, vb, s = ranked.agg(F.sum(F.col("ra") * F.col("ra")), F.sum(F.col("rb") * F.col("rb")), F.sum(F.col("ra") * F.col("rb"))).first()
    if not va or not vb:
        return none
    rho = s / (va * vb) ** 0.5
    if n <= dense:
        table = ranked.toArrow()
        i, j = table["_i"].to_numpy(), table["_j"].to_numpy()
        ra, rb = np.zeros((n, n)), np.zeros((n, n))
        ra[i, j] = ra[j, i] = table["ra"].to_numpy()
        rb[i, j] = table["rb"].to_numpy()
        known_ = spark.sparkContext.broadcast((ra, rb))

        def draw(batches):
            one, two = known_.value
            for batch in batches:
                for k in batch["id"]:
                    p = relabellings(n, range(k, k + 1), seed)[0]
                    yield pd.DataFrame({"s": [float((one[np.ix_(p, p)] * two).sum())]})

        sums = spark.range(0, permutations, 1, min(permutations, 32) or 1).mapInPandas(draw, "s double")
    else:

        def maps(batches):
            for batch in batches:
                for k in batch["id"]:
                    yield pd.DataFrame({"trial": k, "_k": np.arange(n), "to": relabellings(n, range(k, k + 1), seed)[0]})

        perm = materialise(spark.range(0, permutations, 1, min(permutations, 32) or 1).mapInPandas(maps, "trial long, _k long, to long"), "mantel-maps")
        moved = ranked.select("_i", "_j", "rb").join(perm.select("trial", F.col("_k").alias("_i"), F.col("to").alias("x")), "_i").join(perm.select(F.col("trial").alias("_t"), F.col("_k").alias("_j2"), F.col("to").alias("y")), F.expr("_j = _j2 and trial = _t"))
        moved = moved.select("trial", "rb", F.least("x", "y").alias("_a"), F.greatest("x", "y").alias("_b"))
        own = ranked.select(F.col("_i").alias("_a"), F.col("_j").alias("_b"), "ra")
        sums = moved.join(own, ["_a", "_b"]).groupBy("trial").agg(F.sum(F.col("ra") * F.col("rb")).alias("s"))
    # Sums of equal terms in another order must not count as less.
    hit = sums.where(F.col("s") >= s - 1e-9 * (va * vb) ** 0.5).count()
    return spark.createDataFrame([(float(rho), (1 + hit) / (1 + permutations))], "rho double, p double")


def agreement(vectors: DataFrame, nodes: DataFrame, edges: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(rho, p, known): Mantel's test of hops in the graph (nodes apart count as all nodes) and one
    less the cosine, over nodes with a vector other than zero."""
    have = known(vectors).count()
    spark = vectors.sparkSession
    if have < 3:
        return spark.createDataFrame([(0.0, 1.0, have)], "rho double, p double, known long")
    hops = graph.hop_distances(nodes, edges).where("src < dst")
    far = F.lit(nodes.count())
    pairs = pair_cosines(vectors).join(hops, F.expr("a = src and b = dst"), "left")
    pairs = materialise(pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.coalesce("hops", far).cast("double").alias("a"), F.round(1 - F.col("sim"), 12).alias("b")), "agreement")
    return mantel(pairs, permutations, seed).withColumn("known", F.lit(have).cast("long"))


def semantic_layout(vectors: DataFrame, links: DataFrame, w: float, h: float) -> DataFrame:
    """(node, x, y, z): the first two directions scaled into a box, then turned, mirrored or not,
    and moved onto the layout `links`; vectors of fewer than two numbers lie at 0."""
    flat = F.size("v") >= 2
    xy = vectors.select("node", *[F.when(flat, F.get("v", F.lit(k)).cast("double")).otherwise(0.0).alias(c) for k, c in enumerate("xy")], F.lit(0.0).alias("z"))
    return metric.procrustes(layout.scale_to_box(xy, w, h), links)


