"""Layouts (node, x, y, z) of graphs: eigenvectors of components, packing, boxes, springs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.draws import stream
from quillon.operators import graph, order
from quillon.session import materialise, ship

#: The shift under which the matrix is inverted, the change of a unit vector at
#: which iteration ends, its most steps, the seed's distance to the third mode's stream.
SHIFT, TOLERANCE, STEPS, DEPTH_SEED = 1e-3, 1e-8, 200, 1_000_000
#: Most nodes of a component that is inverted as a dense matrix; most steps in a Krylov space, and the
#: shift there, far below the eigenvalues that are told apart.
DENSE, LANCZOS, NEAR = 1200, 120, 1e-10
#: Fewest nodes that elimination leaves where modes are found together; vectors beside them, most steps, and what
#: the residual may be as a share of the gap to the next mode.
TOGETHER, GUARDS, MOST, CLOSE = 1 << 13, 2, 200, 1e-8
#: Fixed values of packing: the margin between components, the ring of lone nodes, its angle.
MARGIN, RING, GOLDEN = 1.0, 0.6, 2.399963229728653
#: Strengths of the spring layout, its damping, and the cap of speed with what a
#: hot layout adds to it.
FORCES = {"repulsion": 0.05, "spring": 0.01, "rest": 0.002, "window": 0.015, "ellipse_x": 0.0005, "ellipse_y": 0.0013, "clearing": 0.55, "floor": 0.02, "damping": 0.82, "cap": 2.5, "hot_cap": 4.0}


def modes(laplacian: np.ndarray, degree: np.ndarray, start: list[list[float]]) -> np.ndarray:
    """Smallest non-trivial eigenvectors of a connected graph's normalised Laplacian over the
    roots of degrees, one row for each start vector, of length 1, the entry largest in size
    positive. Where eigenvalues repeat, the start decides the vector."""
    inverse = np.linalg.inv(laplacian + SHIFT * np.eye(len(degree)))
    root = np.sqrt(degree)
    basis = [root / np.linalg.norm(root)]

    def unit(v):
        for b in basis:
            v = v - (v @ b) * b
        return v / (np.linalg.norm(v) or 1.0)

    for draws in start:
        v = unit(np.array(draws) - 0.5)
        for _ in range(STEPS):
            w = unit(inverse @ v)
            if w @ v < 0:
                w = -w
            moved = np.linalg.norm(w - v)
            v = w
            if moved < TOLERANCE:
                break
        basis.append(v)
    out = []
    for v in basis[1:]:
        u = v / root
        u = u / (np.linalg.norm(u) or 1.0)
        out.append(u if u[int(np.argmax(np.abs(u)))] > 0 else -u)
    return np.array(out)


class Sparse:
    """A connected graph's normalised Laplacian plus a shift as links and grounds, and solutions with it: `SHIFT` where
    parallel links are, else `NEAR`.

    Nodes of at most two neighbours are eliminated in rounds of nodes apart, whatever the number of nodes, without
    differences of like numbers: links and grounds stay positive. Conjugate gradients solve what is left."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int):
        key = row * n + col
        last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]  # of parallel links one counts
        self.row, self.col, self.val, self.n = row[last], col[last], val[last], n

    def factor(self, root: np.ndarray) -> None:
        """Links between unlike nodes and grounds of root times matrix times root, eliminated."""
        n, up, own = self.n, self.row < self.col, self.row == self.col
        a, b, g = self.row[up], self.col[up], -self.val[up] * root[self.row[up]] * root[self.col[up]]
        ground = np.bincount(self.row[own], self.val[own], n) * root**2 - np.bincount(a, g, n) - np.bincount(b, g, n)
        ground = np.where(ground > 1e-9 * root**2, ground, 0.0)
        # With parallel links the roots are no eigenvector, and what is found clear of them depends on the shift.
        self.grounded = bool(ground.any())
        ground += (SHIFT if self.grounded else NEAR) * root**2
        turn, alive = np.random.default_rng(0).permutation(n), np.ones(n, bool)
        self.root, self.rounds, left = root, [], n
        while left:
            few = alive & (np.bincount(a, minlength=n) + np.bincount(b, minlength=n) <= 2)
            both = few[a] & few[b]
            few[np.where(turn[a[both]] > turn[b[both]], a[both], b[both])] = False
            gone = np.flatnonzero(few)
            if not len(gone) or len(gone) < left // 100:
                break
            near, weight = np.repeat(gone[:, None], 2, axis=1), np.zeros((len(gone), 2))
            place = np.searchsorted(gone, np.concatenate([a[few[a]], b[few[b]]]))
            to, by = np.concatenate([b[few[a]], a[few[b]]]), np.concatenate([g[few[a]], g[few[b]]])
            order_ = np.argsort(place, kind="stable")
            place, to, by = place[order_], to[order_], by[order_]
            side = np.arange(len(place)) - np.searchsorted(place, place)
            near[place, side], weight[place, side] = to, by
            total = weight.sum(1) + ground[gone]
            self.rounds.append((gone, near, weight / total[:, None], total))
            np.add.at(ground, near, weight * (ground[gone] / total)[:, None] * (weight > 0))
            keep, two = ~(few[a] | few[b]), (weight > 0).all(1)
            p, q = near[two].min(1), near[two].max(1)
            a, b, g = np.concatenate([a[keep], p]), np.concatenate([b[keep], q]), np.concatenate([g[keep], weight[two].prod(1) / total[two]])
            key, at = np.unique(a * n + b, return_inverse=True)
            a, b, g = key // n, key % n, np.bincount(at, g, len(key))
            alive[gone] = False
            left -= len(gone)
        self.core = np.flatnonzero(alive)
        a, b, k = np.searchsorted(self.core, a), np.searchsorted(self.core, b), np.arange(left)
        self.diagonal = ground[self.core] + np.bincount(a, g, left) + np.bincount(b, g, left)
        row, col, val = np.concatenate([a, b, k]), np.concatenate([b, a, k]), np.concatenate([-g, -g, self.diagonal])
        by = np.argsort(row, kind="stable")
        self._row, self._to, self._by, self._start = row[by], col[by], val[by], np.searchsorted(row[by], k)

    def solve(self, b: np.ndarray, x: np.ndarray, core: Callable | None = None) -> np.ndarray:
        """From a first guess, which counts where nodes were not eliminated; `core` may solve these another way."""
        c, y = b * self.root, x / self.root
        for gone, near, share, _ in self.rounds:
            np.add.at(c, near, share * c[gone][:, None] * (share > 0))
        if len(self.core):
            y[self.core] = core(c[self.core]) if core else self._gradients(c[self.core], y[self.core])
        for gone, near, share, total in reversed(self.rounds):
            y[gone] = c[gone] / total + (share * np.where(share > 0, y[near], 0.0)).sum(1)
        return y * self.root

    def _gradients(self, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        times = lambda v: np.add.reduceat(self._by * v[self._to], self._start)
        r = b - times(x)
        z = r / self.diagonal
        p, rz, least = z.copy(), r @ z, 1e-13 * np.linalg.norm(b)
        for _ in range(20 * len(b) + 100):
            if np.linalg.norm(r) <= least:
                break
            q = times(p)
            a = rz / (p @ q)
            x, r = x + a * p, r - a * q
            z = r / self.diagonal
            rz, old = r @ z, rz
            p = z + rz / old * p
        return x


class Levels:
    """A matrix of links and grounds, symmetric, on coarser and coarser nodes: pairs by strongest links, twice a level."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, least: int = 800):
        self.levels, self.joint, self.last = [], [], None
        while True:
            by = np.argsort(row, kind="stable")
            row, col, val = row[by], col[by], val[by]
            self.levels.append((n, col, val, np.searchsorted(row, np.arange(n)), np.bincount(row, np.where(row == col, val, 0.0), n)))
            if n <= least:
                break
            joint, size = np.arange(n), n
            for _ in range(2):
                names, to = np.unique(self._pairs(row, col, -val, n), return_inverse=True)
                n = len(names)
                key, at = np.unique(to[row] * n + to[col], return_inverse=True)
                joint, row, col, val = to[joint], key // n, key % n, np.bincount(at, val, len(key))
            if n > 0.9 * size:
                break
            self.joint.append(joint)
        n, col, val, start, _ = self.levels[-1]
        if n <= 4 * least:
            full = np.zeros((n, n))
            full[np.repeat(np.arange(n), np.diff(np.append(start, len(col)))), col] = val
            self.last = np.linalg.inv(full)

    @staticmethod
    def _pairs(row: np.ndarray, col: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """The smaller node of each pair that choose each other, in some rounds; ties are broken alike on both ends."""
        mate, keep = np.full(n, -1), row != col
        for k in range(4):
            row, col, weight = row[keep], col[keep], weight[keep]
            if not len(row):
                break
            mixed = (np.minimum(row, col) * 2654435761 + np.maximum(row, col) * 40503 + k * 97) % 1000003
            by = np.lexsort((weight * (1 + mixed / 1e9), row))
            last = np.append(np.flatnonzero(np.diff(row[by])), len(by) - 1)
            best = np.full(n, -1)
            best[row[by][last]] = col[by][last]
            i = np.flatnonzero(best >= 0)
            i = i[best[best[i]] == i]
            mate[i] = best[i]
            keep = (mate[row] < 0) & (mate[col] < 0)
        return np.where(mate >= 0, np.minimum(np.arange(n), mate), np.arange(n))

    def times(self, v: np.ndarray, k: int = 0) -> np.ndarray:
        _, col, val, start, _ = self.levels[k]
        return np.add.reduceat(val * v[col], start)

    def cycle(self, b: np.ndarray, k: int = 0) -> np.ndarray:
        """Roughly the solution: smoothed, corrected on the coarser level (twice below the first) and smoothed."""
        diagonal = self.levels[k][4]
        if k == len(self.joint):
            return b / diagonal if self.last is None else self.last @ b
        x = 0.7 * b / diagonal
        for _ in range(1 if k == 0 else 2):
            r = np.bincount(self.joint[k], b - self.times(x, k), self.levels[k + 1][0])
            x = x + self.cycle(r, k + 1)[self.joint[k]]
        return x + 0.7 * (b - self.times(x, k)) / diagonal

    def halved(self, b: np.ndarray, left: float = 0.5) -> np.ndarray:
        """Conjugate gradients until half of the residual is gone, or all but a share."""
        x, r = np.zeros(len(b)), b
        z = self.cycle(r)
        p, rz, least = z, r @ z, left * np.linalg.norm(b)
        for _ in range(500):
            if np.linalg.norm(r) <= least:
                break
            q = self.times(p)
            a = rz / (p @ q)
            x, r = x + a * p, r - a * q
            z = self.cycle(r)
            rz, old = r @ z, rz
            p = z + rz / old * p
        return x


def modes_together(matrix: Sparse, t: np.ndarray, start: list[list[float]]) -> np.ndarray | None:
    """The vectors to which inverse iterations clear of `t` tend, all at once, or None where they are not told apart
    or not found within `MOST` steps. With M the shifted matrix, x = M z is clear of t and z' M M z / z' M z least; a
    step takes the best of the vectors, of rough solutions for their residuals, and of the last moves."""
    n, want, k = matrix.n, len(start), len(start) + GUARDS
    by = np.argsort(matrix.row, kind="stable")
    to, val, first = matrix.col[by], matrix.val[by], np.searchsorted(matrix.row[by], np.arange(n))
    shift = SHIFT if matrix.grounded else NEAR
    times = lambda rows: np.array([np.add.reduceat(val * v[to], first) + shift * v for v in rows])
    levels = Levels(matrix._row, matrix._to, matrix._by, len(matrix.core))
    clear_of, along = (times([t])[0], matrix.solve(t, t, lambda b: levels.halved(b, 1e-3))) if matrix.grounded else (t, t)
    rough = lambda rows: np.array([matrix.solve(v, np.zeros(n), levels.halved) for v in rows])
    clear = lambda rows: rows - np.outer(rows @ clear_of / (along @ clear_of), along)
    z = np.array([*[np.array(d) - 0.5 for d in start], *np.random.default_rng(0).random((GUARDS, n)) - 0.5])
    z = clear(rough(z - np.outer(z @ t, t)))
    x = times(z)
    s, y = z, x
    for _ in range(MOST):
        while True:
            scale = 1 / np.linalg.norm(y, axis=1)
            a, b = (y @ y.T) * np.outer(scale, scale), (s @ y.T) * np.outer(scale, scale)
            try:
                c = np.linalg.inv(np.linalg.cholesky(a))
                break
            except np.linalg.LinAlgError:  # the last moves, or else the newest vectors, add nothing
                if len(s) == k:
                    return None
                s, y = s[: max(k, len(s) - k)], y[: max(k, len(s) - k)]
        value, u = np.linalg.eigh(c @ (b + b.T) @ c.T / 2)
        value, u = value[::-1][:k], (c.T @ u[:, ::-1][:, :k]) * scale[:, None]
        z, x = u.T @ s, u.T @ y
        off = x - (z - np.outer(z @ t, t)) / value[:, None]
        size = np.linalg.norm(off, axis=1)
        gap = (value[:want] - value[1 : want + 1]) / value[:want]
        gap = np.minimum(gap, np.append(np.inf, gap[:-1]))
        done = np.maximum(CLOSE * gap, 1e-12)
        if (size[:want] <= done).all():
            return x[:want] / np.linalg.norm(x[:want], axis=1)[:, None] if gap.min() > 1e-6 else None
        more = np.append(size[:want] > done, np.ones(GUARDS, bool))
        w = clear(rough(off[more] / size[more][:, None]))
        moves = u.copy()
        moves[:k] = 0
        moved = (moves.T @ s, moves.T @ y) if len(s) > k else (z[:0], x[:0])
        s, y = np.concatenate([z, w, moved[0]]), np.concatenate([x, times(w), moved[1]])
    return None


def sparse_modes(matrix: Sparse, degree: np.ndarray, start: list[list[float]], together: int = TOGETHER) -> np.ndarray:
    """What `modes` gives, in memory that grows with the links: inverse iteration from a start stays in
    the start's Krylov space, and so does the vector that it tends to, which is found there by Lanczos
    steps with all vectors kept orthogonal. Where elimination leaves more than `together` nodes, modes that are told
    apart, and thus do not hang on the start, are found together."""
    root = np.sqrt(degree)
    basis = [root / np.linalg.norm(root)]
    matrix.factor(root)
    found = modes_together(matrix, basis[0], start) if len(matrix.core) > together else None
    if found is not None:
        basis.extend(found)
    for draws in start if found is None else ():
        fixed = np.array(basis)
        clear = lambda v, f=fixed: v - f.T @ (f @ v)
        v = clear(clear(np.array(draws) - 0.5))
        room, alpha, beta, best = np.empty((8, matrix.n)), [], [], None
        room[0] = v / (np.linalg.norm(v) or 1.0)
        for k in range(min(LANCZOS, matrix.n)):
            space = room[: k + 1]
            w = clear(matrix.solve(room[k], room[k] * (alpha[-1] if k else 1.0)))
            alpha.append(float(w @ room[k]))
            for _ in range(2):
                w = clear(w - space.T @ (space @ w))
            beta.append(float(np.linalg.norm(w)))
            values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
            best = vectors[:, -1]
            if beta[-1] * abs(best[-1]) <= 1e-11 * values[-1] or beta[-1] <= 1e-13 * values[-1]:
                break
            if k + 1 == len(room):
                room = np.concatenate([room, np.empty((min(len(room), LANCZOS), matrix.n))])
            room[k + 1] = w / beta[-1]
        v = room[: len(best)].T @ best
        basis.append(v / np.linalg.norm(v))
    out = []
    for v in basis[1:]:
        u = v / root
        u = u / (np.linalg.norm(u) or 1.0)
        out.append(u if u[int(np.argmax(np.abs(u)))] > 0 else -u)
    return np.array(out)


def spectral_embedding(nodes: DataFrame, edges: DataFrame, seed: int = 1, dense: int = DENSE) -> DataFrame:
    """(node, x, y, z): three modes of each component, components packed along x, the whole
    centred with root mean square 1 on each axis (an axis of zeros stays).

    Components are solved one in a task: up to `DENSE` nodes by a dense inverse, larger ones in
    memory that grows with their links. They are numbered
    by their smallest node and take their start vectors in that order from one stream (two
    modes) and another (the third), jumping to their place. Packing: the largest component in
    the middle, others right and left in turn; lone nodes sit on a ring. Parallel links count
    in degrees and once in the matrix; self-loops do not count.
    """
    ship(edges.sparkSession)
    comp = materialise(graph.components(nodes, edges), "spectral-components")
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    size = size.withColumn("flat", F.when(F.col("size") > 1, F.col("size") * F.least(F.lit(2), F.col("size") - 1)).otherwise(0)).withColumn("deep", F.when(F.col("size") > 3, F.col("size")).otherwise(0))
    size = order.running_total(order.running_total(size, ["component"], "flat", "flat_to"), ["component"], "deep", "deep_to")
    size = materialise(size.select("component", "size", (F.col("flat_to") - F.col("flat")).alias("flat_at"), (F.col("deep_to") - F.col("deep")).alias("deep_at")), "spectral-sizes")
    many = comp.join(size.where("size > 1"), "component").withColumnRenamed("node", "row")
    matrix = graph.laplacian(nodes, edges).join(many, "row").join(graph.degree(nodes, edges).withColumnRenamed("node", "row"), "row")
    kind = dict(nodes.dtypes)["node"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(pdf["row"], sort=True)
        n, to = len(names), np.searchsorted(names, pdf["col"])
        degree = np.zeros(n)
        degree[at] = pdf["degree"]
        flat, deep = int(pdf["flat_at"].iloc[0]), int(pdf["deep_at"].iloc[0])
        start = [stream(seed, flat + k * n, n) for k in range(min(2, n - 1))]
        if n > 3:
            start.append(stream(seed + DEPTH_SEED, deep, n))
        if n <= dense:
            a = np.zeros((n, n))
            a[at, to] = pdf["val"]
            u = modes(a, degree, start)
        else:
            u = sparse_modes(Sparse(at, to, pdf["val"].to_numpy(), n), degree, start)
        xyz = np.zeros((3, n))
        xyz[: len(u)] = (u - u.mean(1, keepdims=True)) * math.sqrt(n)
        return pd.DataFrame({"node": names, "component": pdf["component"].iloc[0], "x": xyz[0], "y": xyz[1], "z": xyz[2]})

    placed = matrix.groupBy("component").applyInPandas(solve, f"node {kind}, component {kind}, x double, y double, z double")
    lone = comp.join(size.where("size = 1"), "component")
    by_size = order.numbered(size.withColumn("_neg", -F.col("size")), ["_neg", "component"], "rank")
    by_size = order.running_total(by_size.withColumn("_one", F.when(F.col("size") == 1, 1).otherwise(0)), ["rank"], "_one", "lone").select("component", "size", "rank", (F.col("lone") - F.col("_one")).alias("lone"))
    by_size = materialise(by_size, "spectral-ranks")
    angle = F.col("lone") * GOLDEN
    ring = lone.select("node", "component").join(by_size, "component").select("node", "component", (RING * F.cos(angle)).alias("x"), (RING * F.sin(angle)).alias("y"), F.lit(0.0).alias("z"))
    placed = materialise(placed.union(ring), "spectral-modes")
    half = placed.groupBy("component").agg(F.greatest(F.lit(RING), F.max(F.abs("x"))).alias("half")).join(by_size, "component")
    half = half.withColumn("side", F.when(F.col("rank") == 0, 0).otherwise(2 - F.col("rank") % 2))
    half = half.withColumn("step", F.when(F.col("side") > 0, MARGIN + 2 * F.col("half")).otherwise(0.0))
    half = materialise(order.running_total(half, ["side", "rank"], "step", "upto"), "spectral-packing")
    middle = half.where("rank = 0").select(F.col("half").alias("_middle"))
    left = half.groupBy().agg(F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("step"))), F.lit(0.0)).alias("_right"))
    upto = F.col("upto") - F.when(F.col("side") == 2, F.col("_right")).otherwise(0.0)
    at = F.when(F.col("side") == 0, 0.0).otherwise((F.col("_middle") + upto - F.col("half")) * F.when(F.col("side") == 1, 1.0).otherwise(-1.0))
    slots = half.join(F.broadcast(middle)).join(F.broadcast(left)).select(F.col("component").alias("_c"), at.alias("_at"))
    packed = materialise(placed.join(slots, F.col("component") == F.col("_c")).select("node", (F.col("x") + F.col("_at")).alias("x"), "y", "z"), "spectral-packed")
    mean = packed.agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    moved = packed.join(F.broadcast(mean)).select("node", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"])
    rms = moved.agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"_{c}") for c in "xyz"])
    return moved.join(F.broadcast(rms)).select("node", *[F.when(F.col(f"_{c}") > 1e-12, F.col(c) / F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"])


def scale_to_box(layout: DataFrame, w: float, h: float) -> DataFrame:
    """All coordinates times the one factor with which x and y just fit into a w x h box about 0; a
    layout without extent stays."""
    most = layout.agg(F.max(F.abs("x")).alias("_mx"), F.max(F.abs("y")).alias("_my"))
    k = F.least(F.when(F.col("_mx") > 0, w / 2 / F.col("_mx")), F.when(F.col("_my") > 0, h / 2 / F.col("_my")))
    return layout.join(F.broadcast(most.select(F.coalesce(k, F.lit(1.0)).alias("_k")))).select("node", *[(F.col(c) * F.col("_k")).alias(c) for c in "xyz"])


def spring_step(bodies: DataFrame, edges: DataFrame, rest: DataFrame, scale: float, window: tuple[float, float, float, float], clearing: float, floor: float, heat: float, lengths: DataFrame | None = None, forces: dict | None = None) -> DataFrame:
    """Bodies (node, x, y, px, py, deg, ...) after one step, and outside_mean, the mean distance to
    the window (centre x, y, half width, half height) before it.

    Forces: pairs nearer than three scales push off, found by cells of that size (nine
    cells of a body, an equi-join); links pull to 0.8 scales times their length (edges with
    edge_id, lengths (edge_id, length)); each body to its place in `rest` (node, x, y), into
    the window, to the middle, off the clearing and above the floor. Speed is what the
    place moved since the step before, damped and capped.
    """
    f = {**FORCES, **(forces or {})}
    cut = 3.0 * scale
    cell = lambda c: F.floor(F.col(c) / cut).cast("long")
    at = bodies.select("node", "x", "y", "deg")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    near = at.select(F.col("node").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("ci"), cell("y").alias("cj"))
    near = at.select("node", "x", "y", around).select("node", "x", "y", (cell("x") + F.col("d.i")).alias("ci"), (cell("y") + F.col("d.j")).alias("cj")).join(near, ["ci", "cj"]).where("node != _n")
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    d2 = dx * dx + dy * dy
    # Of two bodies in one place the one with the smaller number goes up and right.
    side = F.when(F.col("node") < F.col("_n"), 0.5).otherwise(-0.5)
    near = near.select("node", F.when(d2 < 1, side).otherwise(dx).alias("dx"), F.when(d2 < 1, side).otherwise(dy).alias("dy"), F.when(d2 < 1, 0.5).otherwise(d2).alias("d2")).where(F.col("d2") <= cut * cut)
    push = scale * scale / F.col("d2") * f["repulsion"] * heat / F.sqrt("d2")
    pushed = near.select("node", (F.col("dx") * push).alias("ax"), (F.col("dy") * push).alias("ay"))
    links = edges.select("edge_id", "src", "dst") if lengths is None else edges.select("edge_id", "src", "dst").join(lengths, "edge_id")
    ends = [at.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x", "y", "deg")]) for n in ("src", "dst")]
    links = links.join(ends[0], "src").join(ends[1], "dst")
    lx, ly = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    long = F.sqrt(lx * lx + ly * ly) + 0.01
    pull = (long - scale * 0.8 * (F.lit(1.0) if lengths is None else F.col("length"))) / long * f["spring"] * heat / F.sqrt(1 + F.least("src_deg", "dst_deg") / 3)
    links = links.select("src", "dst", (lx * pull).alias("ax"), (ly * pull).alias("ay"))
    pulled = links.select(F.col("src").alias("node"), "ax", "ay").union(links.select("dst", -F.col("ax"), -F.col("ay")))
    total = pushed.union(pulled).groupBy("node").agg(F.sum("ax").alias("_ax"), F.sum("ay").alias("_ay"))
    own = bodies.join(total, "node", "left").join(rest.select("node", F.col("x").alias("_rx"), F.col("y").alias("_ry")), "node", "left")
    x, y, (wx, wy, hw, hh) = F.col("x"), F.col("y"), window
    ox, oy = x - F.greatest(F.lit(float(wx - hw)), F.least(F.lit(float(wx + hw)), x)), y - F.greatest(F.lit(float(wy - hh)), F.least(F.lit(float(wy + hh)), y))
    ex = x / 2.2
    hd = F.hypot(ex, y) + 0.01
    off = F.when(hd < clearing, (clearing - hd) / clearing * f["clearing"] * heat).otherwise(0.0) if clearing else F.lit(0.0)
    zero = F.lit(0.0)
    ax = F.coalesce("_ax", zero) + (F.coalesce("_rx", x) - x) * f["rest"] * heat - ox * f["window"] * heat - x * f["ellipse_x"] * heat + ex / 2.2 / hd * off
    ay = F.coalesce("_ay", zero) + (F.coalesce("_ry", y) - y) * f["rest"] * heat - oy * f["window"] * heat - y * f["ellipse_y"] * heat + y / hd * off - F.when(y > floor, (y - floor) * f["floor"] * heat).otherwise(0.0)
    own = materialise(own.withColumns({"_vx": (x - F.col("px") + ax) * f["damping"], "_vy": (y - F.col("py") + ay) * f["damping"], "_out": F.hypot(ox, oy)}), "springs")
    mean = own.agg(F.avg("_out").alias("outside_mean"))
    cap = f["cap"] + F.least(F.lit(0.5), F.col("outside_mean") * 0.004) * f["hot_cap"]
    speed = F.hypot("_vx", "_vy")
    slow = F.when(speed > cap, cap / speed).otherwise(1.0)
    moved = own.join(F.broadcast(mean)).withColumns({"_nx": x + F.col("_vx") * slow, "_ny": y + F.col("_vy") * slow})
    new = {"x": F.col("_nx"), "y": F.col("_ny"), "px": x, "py": y}
    return moved.select(*[new[c].alias(c) if c in new else F.col(c) for c in bodies.columns if c != "outside_mean"], "outside_mean")


def impulse(bodies: DataFrame, kick: Callable[[], tuple[Column, Column]] | tuple[Column, Column]) -> DataFrame:
    """Bodies with a change of speed (two column expressions, or a function that gives them): the
    place before moves the other way."""
    dvx, dvy = kick() if callable(kick) else kick
    return bodies.withColumns({"px": F.col("px") - dvx, "py": F.col("py") - dvy})
