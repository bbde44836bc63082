import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import draws
from quillon.operators import metric, transport

NODES, EDGES = "node long", "edge_id long, src long, dst long"


def graph(spark, n, pairs):
    nodes = spark.createDataFrame([(i,) for i in range(n)], NODES)
    return nodes, spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], EDGES)


def test_draws_follow_the_recurrence(spark):
    got = spark.range(1, 60).select(draws.lcg(F.lit(20260831), F.col("id")).alias("u"), "id").orderBy("id").toPandas()["u"]
    s, want = 20260831, []
    for _ in range(59):
        s = (1664525 * s + 1013904223) % 2**32
        want.append(s / 2**32)
    assert list(got) == want and want[0] == 0.3702976522035897


def test_transport_equals_the_best_assignment():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5):
        cost = rng.integers(0, 4, (n, n)) + rng.random((n, n)) * (n % 2)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
        assert transport.transport_cost(np.full(n, 1 / n), np.full(n, 1 / n), cost) == pytest.approx(best, abs=1e-12)


def test_two_cliques_and_a_bridge(spark):
    pairs = [*itertools.combinations(range(5), 2), *itertools.combinations(range(5, 10), 2), (4, 5), (3, 3)]
    got = {r.edge_id: r.kappa for r in metric.curvature(*graph(spark, 11, pairs)).collect()}
    assert got[20] == pytest.approx(-3 / 5) and got[21] == 0 and len(got) == 22
    assert min(got, key=got.get) == 20


def test_clique_is_still_under_flow(spark):
    pairs = list(itertools.combinations(range(4), 2))
    got = metric.ricci_flow(*graph(spark, 4, pairs), steps=1).collect()
    assert [r.length for r in got] == pytest.approx([1] * 6)
    assert [r.kappa for r in got] == pytest.approx([4 / 6] * 6)


def test_shortest_paths_equal_floyd(spark):
    rng = np.random.default_rng(5)
    nodes, edges = graph(spark, 9, rng.integers(0, 8, (12, 2)).tolist())
    edges = edges.withColumn("length", 1.0 + F.col("edge_id") % 5)
    d = np.full((9, 9), np.inf)
    np.fill_diagonal(d, 0)
    for r in edges.collect():
        d[r.src, r.dst] = d[r.dst, r.src] = min(d[r.src, r.dst], r.length)
    for k in range(9):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    got = {(r.src, r.dst): r.dist for r in metric.shortest_paths(nodes, edges).collect()}
    assert got == {(i, j): d[i, j] for i in range(9) for j in range(9) if d[i, j] < np.inf}


def test_heat_of_a_triangle_a_lone_node_and_a_large_component(spark):
    nodes, edges = graph(spark, 4, [(0, 1), (1, 2), (0, 2)])
    got = {(r.node, r.t): r.hks for r in metric.heat_kernel_signature(nodes, edges).collect()}
    assert got[0, 1.0] == pytest.approx(1 / 3 + 2 / 3 * math.exp(-1.5)) and got[3, 10.0] == pytest.approx(math.exp(-10))
    got = {(r.node, r.t): r.hks for r in metric.heat_kernel_signature(nodes, edges, max_dense=2).collect()}
    assert got[0, 1.0] == pytest.approx(1 / 3) and got[3, 1.0] == pytest.approx(math.exp(-1))


def test_procrustes_undoes_a_turn_and_a_mirror(spark):
    a = np.random.default_rng(1).normal(size=(6, 2))
    for f in (1, -1):
        turn = np.array([[math.cos(2), -math.sin(2)], [math.sin(2), math.cos(2)]]) @ np.diag([1, f])
        b = a @ turn.T + [3, -1]
        one, two = (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "node long, x double, y double") for q in (a, b))
        got = np.array([(r.x, r.y) for r in metric.procrustes(one, two).orderBy("node").collect()])
        assert np.allclose(got, b)


def brute_curvature(n, pairs, alpha=0.5):
    """Curvature by networks of unit masses: walks as multiples of one share, matched at best cost."""
    near = {i: [] for i in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].append(b)
            near[b].append(a)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b in pairs:
        if a != b:
            d[a, b] = d[b, a] = 1
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    out = {}
    for e, (a, b) in enumerate(pairs):
        if a == b:
            out[e] = 0.0
            continue
        share = math.lcm(2, 2 * len(near[a]), 2 * len(near[b]))
        masses = []
        for x in (a, b):
            m = [x] * int(share * alpha)
            for y in near[x]:
                m += [y] * (share // (2 * len(near[x])))
            masses.append(m)
        # Shortest augmenting matching of unit masses, by relaxing a small cost matrix.
        left, right = masses
        cost = np.array([[d[i, j] for j in right] for i in left])
        u, v, match = np.zeros(len(left)), np.zeros(len(right)), [-1] * len(right)
        for i in range(len(left)):
            best, back, used, cur, j0 = np.full(len(right), np.inf), [-1] * len(right), [False] * len(right), i, -1
            while True:
                slack = cost[cur] - u[cur] - v
                for j in range(len(right)):
                    if not used[j] and slack[j] < best[j]:
                        best[j], back[j] = slack[j], j0
                j1 = min((j for j in range(len(right)) if not used[j]), key=lambda j: best[j])
                step = best[j1]
                u[i] += step
                for j in range(len(right)):
                    if used[j]:
                        u[match[j]] += step
                        v[j] -= step
                    else:
                        best[j] -= step
                used[j1], j0 = True, j1
                if match[j1] < 0:
                    break
                cur = match[j1]
            while j0 >= 0:
                match[j0] = match[back[j0]] if back[j0] >= 0 else i
                j0 = back[j0]
        out[e] = 1 - sum(cost[match[j], j] for j in range(len(right))) / share
    return out


def test_curvature_of_a_graph_with_cycles_equals_matching(spark):
    rng = np.random.default_rng(11)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 9, (16, 2))] + [(0, 1), (0, 1), (2, 2)]
    got = {r.edge_id: r.kappa for r in metric.curvature(*graph(spark, 9, pairs)).collect()}
    want = brute_curvature(9, pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_tally_and_one_step_of_the_flow(spark):
    pairs = [*itertools.combinations(range(4), 2), (3, 4), (4, 5)]
    nodes, edges = graph(spark, 6, pairs)
    problems, routes, rises = metric.transport_tally(nodes, edges).first()
    assert 0 < problems <= len(pairs) and problems <= routes and rises <= 2 * len(pairs)
    one = metric.ricci_flow_step(nodes, edges.withColumn("length", F.lit(1.0))).orderBy("edge_id").collect()
    kappa = brute_curvature(6, pairs)
    raw = [min(16, max(0.1, 1 - 0.5 * kappa[k])) for k in range(len(pairs))]
    assert [r.length for r in one] == pytest.approx([x / np.mean(raw) for x in raw])


def test_work_stays_within_its_budgets(spark):
    """Some 190 nodes and 1,300 links: at most one transport, two rises and 32 routes a link; with
    three hubs of 90 links routes stay near what the places of the walks need."""
    rng = np.random.default_rng(191)
    clusters = [(g * 16 + i, g * 16 + j) for g in range(11) for i, j in itertools.combinations(range(16), 2)]
    bridges = [(int(a), int(b)) for a, b in rng.integers(0, 176, (60, 2)) if a != b]
    hubs = [(hub, int(k)) for hub in (0, 1, 2) for k in rng.choice(np.arange(3, 176), 90, replace=False)]
    for pairs, most in ((clusters + bridges, 32), (clusters + bridges + hubs, 60)):
        nodes, edges = graph(spark, 176, pairs)
        problems, routes, rises = metric.transport_tally(nodes, edges).first()
        assert problems <= len(pairs) and rises <= 2 * len(pairs) and routes <= most * len(pairs)
    assert metric.transport_tally(nodes, edges.limit(0)).first()[:] == (0, 0, 0)


def floyd(n, pairs, lengths):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), x in zip(pairs, lengths, strict=True):
        d[a, b] = d[b, a] = min(d[a, b], x)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d


@pytest.mark.parametrize("dense", [metric.DENSE, 3])
def test_three_steps_of_the_flow_equal_all_pairs(spark, dense, monkeypatch):
    """Broadcast or joined, the flow on a graph with cycles is that of all shortest paths."""
    rng = np.random.default_rng(5)
    n, pairs = 12, [(0, 1), (0, 1), (5, 5)]
    pairs += [tuple(map(int, p)) for p in rng.integers(0, 12, (20, 2)) if p[0] != p[1]]
    nodes, edges = graph(spark, n, pairs)
    now, lengths = edges.withColumn("length", F.lit(1.0)), np.ones(len(pairs))
    monkeypatch.setattr(metric, "curvature", lambda *a, **k: REAL_CURVATURE(*a, **k, dense=dense))
    near = [[b if a == i else a for a, b in pairs if a != b and i in (a, b)] for i in range(n)]
    for _ in range(3):
        now = metric.ricci_flow_step(nodes, now)
        d, kappa = floyd(n, pairs, lengths), []
        for (a, b), x in zip(pairs, lengths, strict=True):
            if a == b:
                kappa.append(0.0)
                continue
            m = np.zeros((2, n))
            for k, i in enumerate((a, b)):
                m[k, i] += 0.5
                for j in near[i]:
                    m[k, j] += 0.5 / len(near[i])
            over = m[0] - m[1]
            give, take = np.flatnonzero(over > 1e-12), np.flatnonzero(over < -1e-12)
            kappa.append(1 - (transport.transport_cost(over[give], -over[take], d[np.ix_(give, take)]) if len(give) else 0.0) / x)
        lengths = np.clip(lengths * (1 - 0.5 * np.array(kappa)), 0.1, 16)
        lengths /= lengths.mean()
        got = now.orderBy("edge_id").collect()
        assert [r.kappa for r in got] == pytest.approx(kappa, abs=1e-9) and [r.length for r in got] == pytest.approx(lengths.tolist(), abs=1e-9)


REAL_CURVATURE = metric.curvature


def test_curvature_by_joins_equals_that_by_broadcast(spark):
    rng = np.random.default_rng(12)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 15, (30, 2))]
    nodes, edges = graph(spark, 15, pairs)
    a, b = ({r.edge_id: r.kappa for r in metric.curvature(nodes, edges, dense=k).collect()} for k in (0, metric.DENSE))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_paths_by_rounds_and_by_searches(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 14, (20, 2))]
    lengths = rng.uniform(0.1, 3, 20).round(2).tolist()
    nodes, edges = graph(spark, 14, pairs)
    edges = edges.join(spark.createDataFrame(list(enumerate(lengths)), "edge_id long, length double"), "edge_id")
    d = floyd(14, pairs, [0.0 if a == b else x for (a, b), x in zip(pairs, lengths, strict=True)])
    want = {(i, j): d[i, j] for i in range(14) for j in range(14) if d[i, j] < np.inf}
    for dense in (0, metric.DENSE):
        got = {(r.src, r.dst): r.dist for r in metric.shortest_paths(nodes, edges, dense).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    near = metric.paths_within(nodes, edges, nodes.withColumn("radius", F.lit(1.5)))
    assert {(r.src, r.dst) for r in near.collect()} == {k for k, x in want.items() if x <= 1.5}


def test_text_hash_counts_utf16_units(spark):
    def brute(t):
        h, b = 0, t.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h = (31 * h + b[i] * 256 + b[i + 1]) % 2**32
        return h

    from quillon.functions import sky

    texts = ["", "a", "Supplier#1", "é漢", "😀x😀", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sky.str_hash(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: brute(t) for t in texts}
