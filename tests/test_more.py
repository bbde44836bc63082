"""Operators against closed forms, brute force and invariants on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import draws, sky
from quillon.operators import binaries, communities, dense, graph, layout, metric, order, stats, systems, terrain, vectors, wavelets

rng = np.random.default_rng(7)


def graph_of(spark, n, pairs):
    return spark.range(n).select(F.col("id").alias("node")), spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(pairs)], "edge_id long, src long, dst long")


def cliques(k, size, bridges):
    out = [(g * size + i, g * size + j) for g in range(k) for i, j in itertools.combinations(range(size), 2)]
    return out + list(bridges)


def test_running_total_and_ranks(spark):
    rows = [(int(k), int(x)) for k, x in enumerate(rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "k long, x long").repartition(5)
    got = {r["k"]: r["total"] for r in order.running_total(df, ["x", "k"], "x").collect()}
    at = 0
    for k, x in sorted(rows, key=lambda r: (r[1], r[0])):
        at += x
        assert got[k] == at
    assert sorted(r["index"] for r in order.numbered(df, ["k"]).collect()) == list(range(200))
    values = np.array([x for _, x in rows])
    ranks = {r["k"]: r["rank"] for r in order.average_rank(df, "x").collect()}
    assert all(ranks[k] == (values < x).sum() + ((values == x).sum() + 1) / 2 for k, x in rows)
    assert order.numbered(df.limit(0), ["k"]).collect() == []


def test_stream_is_the_generator(spark):
    s = draws.stream(20260831, 0, 40)
    assert s[0] == 0.3702976522035897 and draws.stream(20260831, 17, 23) == s[17:]


def some_vectors(spark, n=60, dim=5):
    v = rng.normal(size=(n, dim)).round(3)
    v[[3, 11]] = 0
    v[n // 3] = v[n // 3 + 1]
    return v, spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "node long, v array<double>")


def brute_links(v, edges, count, least, per_node):
    linked = {(min(p), max(p)) for p in edges}
    size = np.linalg.norm(v, axis=1)
    rows = [(i, j, float(v[i] @ v[j] / size[i] / size[j])) for i, j in itertools.combinations(range(len(v)), 2) if size[i] and size[j] and (i, j) not in linked]
    rows = sorted((r for r in rows if r[2] >= least), key=lambda r: (-round(r[2], 12), r[0], r[1]))
    used, out = [0] * len(v), []
    for a, b, s in rows:
        if len(out) < count and not (per_node and (used[a] >= per_node or used[b] >= per_node)):
            used[a] += 1
            used[b] += 1
            out.append((a, b, round(s, 9)))
    return out


@pytest.mark.parametrize("block, per_node", [(2048, 0), (7, 0), (7, 1), (2048, 2)])
def test_similar_links(spark, monkeypatch, block, per_node):
    monkeypatch.setattr(vectors, "BLOCK", block)
    v, df = some_vectors(spark)
    edges = [(1, 0), (20, 21), (5, 9), (5, 9), (4, 4), (30, 2)]
    got = vectors.similar_links(df, graph_of(spark, 60, edges)[1], 12, 0.4, per_node).collect()
    assert [(r["a"], r["b"], round(r["sim"], 9)) for r in got] == brute_links(v, edges, 12, 0.4, per_node)


def brute_mantel(a, b, permutations, seed):
    n = len(a)
    at = np.triu_indices(n, 1)
    rank = lambda x: np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])
    ra, rb = rank(a[at]), rank(b[at])
    full = np.zeros((n, n))
    full[at] = ra
    full += full.T
    ra, rb, mean = ra - ra.mean(), rb - rb.mean(), ra.mean()
    norm = math.sqrt((ra @ ra) * (rb @ rb))
    rho, u, hit = ra @ rb / norm, iter(draws.stream(seed, 0, permutations * (n - 1))), 0
    for _ in range(permutations):
        p = list(range(n))
        for i in range(n - 1, 0, -1):
            j = math.floor(next(u) * (i + 1))
            p[i], p[j] = p[j], p[i]
        hit += (full[np.ix_(p, p)][at] - mean) @ rb / norm >= rho - 1e-9
    return rho, (1 + hit) / (1 + permutations)


@pytest.mark.parametrize("most", [1500, 0])
def test_mantel(spark, most):
    x = rng.normal(size=(14, 2))
    a = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 1)
    b = np.round(a + rng.normal(size=a.shape) * 1.5, 1)
    b = np.triu(b, 1) + np.triu(b, 1).T
    rows = [(i, j, float(a[i, j]), float(b[i, j])) for i, j in itertools.combinations(range(14), 2)]
    df = spark.createDataFrame(rows, "i long, j long, a double, b double")
    assert tuple(vectors.mantel(df, 60, 5, most).first()) == pytest.approx(brute_mantel(a, b, 60, 5))
    assert tuple(vectors.mantel(df.withColumn("a", F.lit(1.0)), 20).first()) == (0.0, 1.0)
    assert tuple(vectors.mantel(df.where("j < 2"), 20).first()) == (0.0, 1.0)


def test_meaning_agrees_with_planted_communities(spark):
    v = np.repeat(np.eye(3) * 3, 8, axis=0) + rng.normal(size=(24, 3)) * 0.3
    df = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "node long, v array<double>")
    nodes, edges = graph_of(spark, 24, cliques(3, 8, [(7, 8), (15, 16)]))
    rho, p, known = vectors.agreement(df, nodes, edges).first()
    assert rho > 0.5 and p < 0.01 and known == 24
    assert tuple(vectors.agreement(df.where("node < 2"), nodes, edges).first()) == (0.0, 1.0, 2)


def test_semantic_layout_faces_the_links(spark):
    v, df = some_vectors(spark, 20, 3)
    links = spark.createDataFrame([(k, float(-x[1]), float(x[0]), 5.0) for k, x in enumerate(v)], "node long, x double, y double, z double")
    out = np.array([tuple(r)[1:] for r in vectors.semantic_layout(df, links, 8, 8).orderBy("node").collect()])
    k = min(4 / np.abs(v[:, 0]).max(), 4 / np.abs(v[:, 1]).max())
    middle = np.array([-v[:, 1].mean(), v[:, 0].mean()])
    assert np.allclose(out[:, :2] - out[:, :2].mean(0), k * np.stack([-v[:, 1] + v[:, 1].mean(), v[:, 0] - v[:, 0].mean()], 1)) and np.allclose(out[:, :2].mean(0), middle) and not out[:, 2].any()
    thin = df.select("node", F.slice("v", 1, 1).alias("v"))
    assert vectors.semantic_layout(thin, links, 8, 8).where("z != 0").count() == 0


def points(df):
    return np.array([(r["x"], r["y"], r["z"]) for r in df.orderBy("node").collect()])


def test_spectral_embedding(spark):
    # A path's first mode is its cosine, from end to end.
    nodes, edges = graph_of(spark, 9, [(k, k + 1) for k in range(8)])
    p = points(layout.spectral_embedding(nodes, edges))
    assert np.allclose(p.mean(0), 0, atol=1e-9) and np.allclose((p**2).mean(0), 1)
    assert (np.diff(p[:, 0]) > 0).all() or (np.diff(p[:, 0]) < 0).all()
    want = np.cos(np.pi * np.arange(9) / 8)
    assert abs(np.corrcoef(p[:, 0], want)[0, 1]) > 1 - 1e-9
    # Two cliques and a bridge: the sign tells them apart.
    nodes, edges = graph_of(spark, 12, cliques(2, 6, [(5, 6)]))
    p = points(layout.spectral_embedding(nodes, edges))
    assert set(np.sign(p[:6, 0])) != set(np.sign(p[6:, 0])) and len(set(np.sign(p[:6, 0]))) == 1


def mixed(spark):
    pairs = [(k, (k + 1) % 6) for k in range(6)] + [(6, 7), (7, 8)] + list(itertools.combinations(range(9, 13), 2)) + [(14, 15), (15, 16), (14, 16), (14, 15), (3, 3)]
    return graph_of(spark, 19, pairs), pairs


def test_spectral_packing(spark):
    (nodes, edges), _ = mixed(spark)
    p = points(layout.spectral_embedding(nodes, edges, 3))
    groups = [range(6), range(9, 13), range(6, 9), range(14, 17), [13], [17], [18]]
    spans = sorted((p[list(g), 0].min(), p[list(g), 0].max()) for g in groups)
    assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
    again = points(layout.spectral_embedding(nodes.repartition(4), edges.repartition(5), 3))
    assert np.allclose(p, again, atol=1e-9)
    # Modes of each component: orthogonal under degrees, eigenvectors of the random walk.
    box = points(layout.scale_to_box(layout.spectral_embedding(nodes, edges, 3), 10, 4))
    assert np.isclose(max(abs(box[:, 0]).max() / 5, abs(box[:, 1]).max() / 2), 1)


def test_modes_on_degenerate_graphs_follow_the_start(spark):
    n = 6
    a = np.eye(n) - (np.roll(np.eye(n), 1, 0) + np.roll(np.eye(n), -1, 0)) / 2
    u = layout.modes(a, np.full(n, 2.0), [draws.stream(1, 0, n), draws.stream(1, n, n)])
    assert np.allclose(a @ u.T, 0.5 * u.T, atol=1e-6) and abs(u[0] @ u[1]) < 1e-7
    start = np.array(draws.stream(1, 0, n)) - 0.5
    k = np.arange(n)
    plane = np.stack([np.cos(2 * np.pi * k / n), np.sin(2 * np.pi * k / n)])
    inside = plane.T @ (plane @ start)
    assert abs(abs(u[0] @ inside) / np.linalg.norm(inside) - 1) < 1e-6


def brute_step(b, edges, rest, scale, win, clearing, floor, heat, lengths):
    f, n = layout.FORCES, len(b)
    acc = np.zeros((n, 2))
    for i, j in itertools.combinations(range(n), 2):
        d = b[i, :2] - b[j, :2]
        d2 = d @ d
        if d2 < 1:
            d, d2 = np.array([0.5, 0.5]), 0.5
        if d2 <= 9 * scale * scale:
            k = scale * scale / d2 * f["repulsion"] * heat / math.sqrt(d2)
            acc[i] += d * k
            acc[j] -= d * k
    for (i, j), l in zip(edges, lengths, strict=True):
        d = b[j, :2] - b[i, :2]
        r = math.sqrt(d @ d) + 0.01
        k = (r - scale * 0.8 * l) / r * f["spring"] * heat / math.sqrt(1 + min(b[i, 4], b[j, 4]) / 3)
        acc[i] += d * k
        acc[j] -= d * k
    out = []
    for i in range(n):
        x, y = b[i, :2]
        o = np.array([x - np.clip(x, win[0] - win[2], win[0] + win[2]), y - np.clip(y, win[1] - win[3], win[1] + win[3])])
        out.append(np.hypot(*o))
        acc[i] += (rest[i] - b[i, :2]) * f["rest"] * heat - o * f["window"] * heat - np.array([x * f["ellipse_x"], y * f["ellipse_y"]]) * heat
        hd = math.hypot(x / 2.2, y) + 0.01
        if hd < clearing:
            push = (clearing - hd) / clearing * f["clearing"] * heat
            acc[i] += np.array([x / 2.2 / 2.2 / hd, y / hd]) * push
        if y > floor:
            acc[i, 1] -= (y - floor) * f["floor"] * heat
    mean = float(np.mean(out))
    cap = f["cap"] + min(0.5, mean * 0.004) * f["hot_cap"]
    v = (b[:, :2] - b[:, 2:4] + acc) * f["damping"]
    speed = np.hypot(*v.T)
    v[speed > cap] *= (cap / speed[speed > cap])[:, None]
    return np.column_stack([b[:, :2] + v, b[:, :2]]), mean


def test_spring_step(spark):
    n = 40
    b = np.column_stack([rng.normal(size=(n, 2)) * 60, np.zeros((n, 2)), rng.integers(0, 5, n)])
    b[1, :2] = b[0, :2] + 0.1
    b[2, :2] = 0.3
    b[:, 2:4] = b[:, :2] - rng.normal(size=(n, 2)) * 3
    edges, lengths = rng.integers(0, n, (50, 2)).tolist(), rng.random(50) + 0.5
    rest = rng.normal(size=(n, 2)) * 50
    nodes, e = graph_of(spark, n, edges)
    bodies = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(b)], "node long, x double, y double, px double, py double, deg double")
    places = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rest)], "node long, x double, y double")
    ls = spark.createDataFrame([(k, float(x)) for k, x in enumerate(lengths)], "edge_id long, length double")
    got = layout.spring_step(bodies, e, places, 20.0, (5.0, 0.0, 50.0, 40.0), 30.0, 45.0, 0.7, ls).orderBy("node").collect()
    want, mean = brute_step(b, edges, rest, 20.0, (5, 0, 50, 40), 30.0, 45.0, 0.7, lengths)
    assert np.allclose([[r["x"], r["y"], r["px"], r["py"]] for r in got], want) and got[0]["outside_mean"] == pytest.approx(mean)
    kicked = layout.impulse(bodies, lambda: (F.col("deg"), F.lit(2.0))).orderBy("node").collect()
    assert np.allclose([[r["px"], r["py"]] for r in kicked], b[:, 2:4] - np.column_stack([b[:, 4], np.full(n, 2.0)]))


def cells(spark, matrices):
    return spark.createDataFrame([(k, i, j, float(a[i, j])) for k, a in matrices.items() for i in range(a.shape[0]) for j in range(a.shape[1])], "key string, row long, col long, val double")


def test_dense_kernels(spark):
    a = {k: (x := rng.normal(size=(n, n))) @ x.T + np.eye(n) for k, n in (("p", 4), ("q", 7))}
    df = cells(spark, a)
    low = dense.cholesky(df)
    b = spark.createDataFrame([("p", i, float(i + 1)) for i in range(4)], "key string, row long, val double")
    x = np.array([r["val"] for r in dense.solve_cholesky(low.where("key = 'p'"), b).orderBy("row").collect()])
    assert np.allclose(a["p"] @ x, [1, 2, 3, 4])
    eig = dense.symmetric_eigen(df).where("key = 'q'").orderBy("k", "row").collect()
    v = np.array([r["x"] for r in eig]).reshape(7, 7)
    values = np.array([r["value"] for r in eig]).reshape(7, 7)[:, 0]
    assert np.allclose(values, np.linalg.eigvalsh(a["q"])) and np.allclose(v @ a["q"] @ v.T, np.diag(values)) and (np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) > 0).all()
    with pytest.raises(Exception, match="not positive definite"):
        dense.cholesky(cells(spark, {"z": -np.eye(2)})).collect()
    basis = np.linalg.qr(rng.normal(size=(6, 2)))[0].T
    w = rng.normal(size=6)
    vs = spark.createDataFrame([("k", i, float(w[i])) for i in range(6)], "key string, row long, val double")
    bs = spark.createDataFrame([("k", k, i, float(basis[k, i])) for k in range(2) for i in range(6)], "key string, k long, row long, val double")
    got = np.array([r["val"] for r in dense.orthogonalise(vs, bs).orderBy("row").collect()])
    assert np.allclose(got, w - basis.T @ (basis @ w)) and np.allclose(basis @ got, 0)


@pytest.mark.parametrize("shape", [(6, 3), (3, 6), (5, 5)])
def test_svd_rebuilds(spark, shape):
    a = rng.normal(size=shape)
    a[-1] = a[0]
    rows = dense.svd(cells(spark, {"m": a})).collect()
    k = min(shape)
    u, v, s = np.zeros((shape[0], k)), np.zeros((shape[1], k)), np.zeros(k)
    for r in rows:
        (u if r["side"] == "u" else v)[r["at"], r["k"]] = r["x"]
        s[r["k"]] = r["s"]
    assert np.allclose(u @ np.diag(s) @ v.T, a) and np.allclose(s, np.linalg.svd(a)[1], atol=1e-6) and (np.diff(s) <= 1e-12).all()


@pytest.mark.parametrize("most", [1024, 1])
def test_language_space(spark, monkeypatch, most):
    """From one small matrix, and iterated by joins."""
    monkeypatch.setattr(dense, "MOST_LANGUAGES", most)
    sizes = [("a", "Go", 900), ("a", "C", 80), ("b", "Go", 5000), ("b", "C", 100), ("c", "TS", 700), ("c", "CSS", 90), ("d", "TS", 9000), ("d", "CSS", 300), ("e", "Go", 60), ("f", "TS", 44), ("g", "Go", 0)]
    lost = [("z", None, 5), (None, "Go", 5)]  # left out
    xy, ends = dense.language_space(spark.createDataFrame(sizes + lost, "repo string, lang string, bytes long"))
    names, langs = sorted({r[0] for r in sizes}), sorted({r[1] for r in sizes})
    m = np.zeros((len(names), len(langs)))
    for r, l, b in sizes:
        m[names.index(r), langs.index(l)] = math.log1p(b)
    m = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    m -= m.mean(0)
    _, _, vt = np.linalg.svd(m)
    vt = vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(1)] < 0, -1, 1)[:, None]
    got = {r["repo"]: (r["pc1"], r["pc2"]) for r in xy.collect()}
    assert got.keys() == set(names) and np.allclose([got[r] for r in names], m @ vt[:2].T / math.sqrt(len(names)))
    assert tuple(ends.first()) == (langs[int(vt[0].argmin())], langs[int(vt[0].argmax())])
    assert len({got[r][0] > 0 for r in "ab"} | {got[r][0] < 0 for r in "cd"}) == 1


def test_cut_communities(spark):
    nodes, edges = graph_of(spark, 10, cliques(2, 5, [(4, 5)]))
    lengths = edges.select("edge_id", F.when(F.col("edge_id") == 20, 4.0).otherwise(0.5 + F.col("edge_id") % 3 / 10).alias("length"))
    labels, one = communities.cut_communities(nodes, edges, lengths)
    count, cut, q, parted = one.first()
    assert (count, parted) == (2, 1) and q == pytest.approx(19 / 42) and cut == pytest.approx(4, rel=1e-8) and cut < 4
    assert [r["label"] for r in labels.orderBy("node").collect()] == [0] * 5 + [1] * 5
    labels, one = communities.cut_communities(nodes, edges, edges.select("edge_id", F.lit(1.0).alias("length")))
    assert tuple(one.first())[:1] == (1,) and one.first()["q"] == pytest.approx(0) and one.first()["parted"] == 0
    two = [(a + 10 * k, b + 10 * k) for k in (0, 1) for a, b in cliques(2, 5, [(4, 5)])]
    nodes, edges = graph_of(spark, 20, two)
    lengths = edges.select("edge_id", F.when(F.col("edge_id").isin(20, 41), 4.0).otherwise(0.5).alias("length"))
    _, one = communities.cut_communities(nodes, edges, lengths)
    assert tuple(one.first())[0] == 4 and one.first()["parted"] == 2


def test_many_lengths_try_64_cuts(spark):
    lengths = spark.createDataFrame([(k, 1.0 + k) for k in range(400)], "edge_id long, length double")
    above = [1.0 + k for k in range(400) if 1.0 + k > 200.5]
    want = sorted({above[i * (len(above) - 1) // 63] for i in range(64)})
    assert communities.candidate_cuts(lengths) == pytest.approx([c * (1 - 1e-9) for c in want], rel=1e-15)


def test_flow_parts_two_cliques(spark):
    nodes, edges = graph_of(spark, 10, cliques(2, 5, [(4, 5)]))
    flow = metric.ricci_flow(nodes, edges, 2)
    rows = flow.collect()
    assert max(rows, key=lambda r: r["length"])["edge_id"] == 20 and np.mean([r["length"] for r in rows]) == pytest.approx(1)
    _, one = communities.cut_communities(nodes, edges, flow.select("edge_id", "length"))
    assert one.first()["q"] == pytest.approx(19 / 42)


def brute_notes(notes, links, most):
    landing = {i for i, c, _ in notes if (i or "").endswith(f"/{c}.qmd")}
    stars = {i for i, c, w in notes if w is None and i not in landing}
    out, seen, hosts = [], set(), {}

    def add(a, b):
        if a != b and frozenset((a, b)) not in seen:
            seen.add(frozenset((a, b)))
            out.append((a, b))

    for a, b in links:
        if a in stars and b in stars:
            add(a, b)
        elif a in stars and b not in landing:
            hosts.setdefault(b, []).append(a)
        elif b in stars and a not in landing:
            hosts.setdefault(a, []).append(b)
    for near in hosts.values():
        if len(near) <= most:
            for i, a in enumerate(near):
                for b in near[i + 1 :]:
                    add(a, b)
    return out, hosts


@pytest.mark.parametrize("most", [64, 3])
def test_notes_graph(spark, most):
    notes = [(f"s{k}", "c", None) for k in range(12)] + [(f"w{k}", "c", 1.0) for k in range(5)] + [("x/c.qmd", "c", None)]
    ids = [n[0] for n in notes]
    links = [(ids[a], ids[b]) for a, b in rng.integers(0, len(ids), (60, 2))] + [("s0", "x/c.qmd"), ("w1", "s3"), ("w1", "s3"), ("s4", "s4")]
    n = spark.createDataFrame([(k, *r) for k, r in enumerate(notes)], "pos long, id string, course string, week double")
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(links)], "pos long, a string, b string").repartition(3)
    stars, out, hosts = communities.notes_graph(n, e, most)
    want, near = brute_notes(notes, links, most)
    assert [r["id"] for r in stars.orderBy("pos").collect()] == [f"s{k}" for k in range(12)]
    assert [(r["a"], r["b"]) for r in out.orderBy("ord").collect()] == want
    got = {}
    for r in hosts.orderBy("hidden", "pos").collect():
        got.setdefault(r["hidden"], []).append(r["star"])
    assert got == near


def brute_lag(a, b, most):
    best, n = (0, 0.0), min(len(a), len(b))
    for lag in range(-most, most + 1):
        lo, hi = max(0, -lag), min(n, n - lag)
        if hi - lo >= 4:
            x, y = a[lo:hi] - a[lo:hi].mean(), b[lo + lag : hi + lag] - b[lo + lag : hi + lag].mean()
            if x @ x and y @ y:
                r = x @ y / math.sqrt((x @ x) * (y @ y))
                if abs(r) > abs(best[1]):
                    best = (lag, r)
    return best


def test_binaries(spark):
    n = 64
    base = rng.poisson(1.5, n + 3).astype(float)
    s = {0: base[3:], 1: base[:n], 2: base[3:] + rng.poisson(2, n), 3: np.zeros(n), 4: rng.poisson(1, n).astype(float), 5: rng.poisson(1, n).astype(float)}
    s[3][:3] = 1
    df = spark.createDataFrame([(k, t, float(x)) for k, v in s.items() for t, x in enumerate(v)], "id long, t long, x double")
    got = binaries.find_binaries(df, draws=200)
    rows = sorted(map(tuple, got.collect()))
    ids = [0, 1, 2, 4, 5]
    pairs = list(itertools.combinations(ids, 2))
    u, null = draws.stream(1, 0, 200), []
    for k in range(200):
        a, b = pairs[k % len(pairs)]
        shift = 7 + math.floor(u[k] * (n - 14))
        null.append(abs(brute_lag(s[a], np.roll(s[b], -shift), 7)[1]))
    seen = [brute_lag(s[a], s[b], 7) for a, b in pairs]
    p = np.array([(1 + sum(x >= abs(r) - 1e-12 for x in null)) / 201 for _, r in seen])
    by, q, low = np.argsort(p, kind="stable"), np.zeros(len(p)), 1.0
    for k in range(len(p), 0, -1):
        low = min(low, p[by[k - 1]] * len(p) / k)
        q[by[k - 1]] = low
    cands = sorted(((a, b, lag, r, pp, qq) for (a, b), (lag, r), pp, qq in zip(pairs, seen, p, q, strict=True) if abs(r) >= 0.3 and qq <= 0.1), key=lambda c: (-abs(c[3]), c[0], c[1]))
    used, want = set(), []
    for c in cands:
        if not used & {c[0], c[1]}:
            used |= {c[0], c[1]}
            want.append(c)
    assert want[0][:3] == (0, 1, 3)
    assert len(rows) == len(want) and all(g == pytest.approx(w) for g, w in zip(rows, sorted(want), strict=True))
    assert binaries.find_binaries(df.where("id = 3")).collect() == []


def test_systems(spark):
    el = lambda k: F.struct(F.lit(0.3 + 0.1 * k).alias("a"), F.lit(0.05 * k).alias("e"), F.lit(sky.K_MS * (0.3 + 0.1 * k) ** 1.5).alias("T"), F.lit(0.7 * k).alias("M0"), F.lit(0.0).alias("tilt"))
    one = spark.range(1)
    bodies = None
    for k in range(4):
        b = one.select(F.lit("s").alias("system"), F.lit(k).alias("body"), F.lit(0.25 * (k + 1)).alias("m"), el(k).alias("el"))
        bodies = b if bodies is None else bodies.union(b)
    states = bodies.select("system", "body", "m", sky.kepler_state(F.col("el"), F.lit(0.4)).alias("s")).select("system", "body", "m", "s.x", "s.y", "s.vx", "s.vy")
    e0 = systems.energy(states, 1e-3).first()["energy"]
    there = systems.leapfrog(states, 1e-4, 400, 1e-3)
    assert systems.energy(there, 1e-3).first()["energy"] == pytest.approx(e0, rel=1e-6)
    back = systems.leapfrog(there.withColumns({"vx": -F.col("vx"), "vy": -F.col("vy")}), 1e-4, 400, 1e-3)
    a, b = (np.array([(r["x"], r["y"]) for r in d.orderBy("body").collect()]) for d in (states, back))
    assert np.allclose(a, b, atol=1e-10)
    shifts = {g: np.array([r["shift"] for r in systems.phase_perturbations(bodies, 0.0, 2e8, 2e5, g).orderBy("body").collect()]) for g in (1e-7, 2e-7)}
    assert np.abs(shifts[1e-7]).max() > 0 and np.allclose(shifts[2e-7], 2 * shifts[1e-7], rtol=1e-3, atol=1e-12)
    assert not np.any([r["shift"] for r in systems.phase_perturbations(bodies, 5.0, 5.0, 1.0).collect()])


def test_fit_kepler(spark):
    act = rng.random(40)
    a_min, k = 0.2616, 1.8e8
    rows = [(float(x), float(k * (a_min + (1 - a_min) * (1 - x)) ** 1.5)) for x in act]
    fit = systems.fit_kepler(spark.createDataFrame(rows, "activity double, T double"))
    assert fit["a_min"] == pytest.approx(a_min, abs=1e-6) and fit["k"] == pytest.approx(k, rel=1e-6) and (fit["a_max"], fit["e_max"]) == (1.0, 0.2)


def bump(spark, f, cols=16, rows=12):
    return spark.createDataFrame([("f", r, c, float(f(c, r))) for r in range(rows + 1) for c in range(cols + 1)], "field string, r int, c int, h double")


def test_terrain_fields(spark):
    grid = spark.createDataFrame([("f", r, c, float(3 * r + c + 1)) for r in range(2) for c in range(2)] + [("f", 5, 0, 99.0)], "field string, row int, col int, h double")
    h = {(r["r"], r["c"]): r["h"] for r in terrain.corner_heights(grid, 2, 2).collect()}
    assert len(h) == 9 and h[0, 0] == 0.25 and h[1, 1] == (1 + 2 + 4 + 5) / 4 and h[2, 1] == (4 + 5) / 4
    doubled = {(r["r"], r["c"]): r["h"] for r in terrain.corner_heights(grid, 2, 2, F.col("h") * 2).collect()}
    assert doubled[1, 1] == 6
    field = bump(spark, lambda x, y: 2 * x + 3 * y + x * y, 4, 3)
    at = spark.createDataFrame([("f", 0, 1.25, 2.5), ("f", 1, -3.0, 9.0), ("f", 2, 4.0, 3.0), ("f", 3, 2.0, 0.0)], "field string, k int, x double, y double")
    got = {r["k"]: r["h"] for r in terrain.sample(field, at).collect()}
    assert got == pytest.approx({0: 2.5 + 7.5 + 3.125, 1: 9.0, 2: 8 + 9 + 12, 3: 4.0})
    g = {r["k"]: (r["gx"], r["gy"]) for r in terrain.gradient(field, at).collect()}
    assert g[0] == pytest.approx((2 + 2.5, 3 + 1.25))
    ground = terrain.Ground(np.array([[2 * x + 3 * y + x * y for x in range(5)] for y in range(4)], float))
    assert ground.height(1.25, 2.5) == pytest.approx(got[0]) and ground.slope(1.25, 2.5) == pytest.approx(g[0])


def test_rivers(spark):
    one = terrain.trace_rivers(bump(spark, lambda x, y: 9 * math.exp(-((x - 4.5) ** 2 + (y - 5.5) ** 2) / 12)), min_peak=1.0).orderBy("river", "pos").collect()
    assert {r["river"] for r in one} == {0} and (one[0]["x"], one[0]["y"]) == (4.5, 5.5)
    heights = [r["h"] for r in one]
    assert all(a >= b - 1e-9 for a, b in itertools.pairwise(heights))
    two = terrain.trace_rivers(bump(spark, lambda x, y: 9 * math.exp(-((x - 4.4) ** 2 + (y - 5.4) ** 2) / 6) + 7 * math.exp(-((x - 11.3) ** 2 + (y - 6.4) ** 2) / 6) - 0.05 * y), min_peak=1.0).collect()
    top = {}
    for r in two:
        if r["pos"] == 0:
            top[r["river"]] = r["h"]
    assert top[0] == max(top.values()) and len(top) >= 2
    flat = terrain.trace_rivers(bump(spark, lambda x, y: 1.0, 2, 2))
    assert {r["pos"] for r in flat.collect()} == {0} and len(flat.collect()) == 4


def test_snow(spark):
    tri = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xyz", p, strict=True)]) for p in ((0, 0, 0), (2, 0, 4), (0, 2, 4))])
    one = spark.range(1)
    cap = one.select(terrain.clip_z(tri, F.lit(2.0)).alias("c")).first()["c"]
    assert [tuple(p) for p in cap] == [(1, 0, 2), (2, 0, 4), (0, 2, 4), (0, 1, 2)]
    tooth = one.select(terrain.serrate(terrain.clip_z(tri, F.lit(2.0)), F.lit(2.0), F.lit(0.5)).alias("c")).first()["c"]
    assert len(tooth) == 5 and tuple(tooth[4])[:2] == (0.5, 0.5) and 2 - 0.65 <= tooth[4]["z"] <= 2 - 0.35
    assert one.select(F.size(terrain.clip_z(tri, F.lit(9.0)))).first()[0] == 0
    assert one.select(F.size(terrain.serrate(terrain.clip_z(tri, F.lit(9.0)), F.lit(9.0), F.lit(1.0)))).first()[0] == 0
    assert one.select(F.size(terrain.serrate(tri, F.lit(2.0), F.lit(1.0)))).first()[0] == 3


def brute_power(x, scales):
    n, c = len(x), x - x.mean()
    out = np.zeros((len(scales), n))
    for k, s in enumerate(scales):
        h = math.ceil(4 * s)
        for t in range(n):
            w = 0
            for i in range(-h, h + 1):
                j = t + i
                while not 0 <= j < n:
                    j = -j if j < 0 else 2 * n - 2 - j
                w += c[j] * np.exp(-((i / s) ** 2) / 2 - 6j * i / s) / math.sqrt(s * math.sqrt(math.pi))
            out[k, t] = abs(w) ** 2 / x.var()
    return out


def test_wavelets(spark):
    scales = wavelets.morlet_scales(52)
    assert len(scales) == 24 and wavelets.morlet_period(scales[0]) == pytest.approx(2) and wavelets.morlet_period(scales[-1]) == pytest.approx(26)
    x = np.sin(2 * np.pi * np.arange(52) / 13) * 3 + rng.normal(size=52) * 0.1
    power, room = wavelets.power_of(x, scales)
    assert np.allclose(power, brute_power(x, scales), rtol=1e-8, atol=1e-10)
    reach = np.minimum(np.arange(52), 51 - np.arange(52))
    assert all(room[t] == max([s for s in scales if math.sqrt(2) * s <= reach[t]], default=0) for t in range(52))
    flat, _ = wavelets.power_of(np.ones(9), scales)
    assert not flat.any()
    up = np.cos(2 * np.pi * (np.arange(106) / 40 + np.arange(106) ** 2 / 2200))
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(x)] + [(1, t, 5.0) for t in range(20)] + [(2, t, float(v)) for t, v in enumerate(up)], "id long, t long, x double")
    waves = wavelets.scalogram(df)
    got = {(r["id"], r["t"]): (r["period"], r["power"]) for r in wavelets.ridge(waves).collect()}
    assert got[0, 26][0] == pytest.approx(13, rel=0.05) and all(got[1, t] == (0, 0) for t in range(20)) and got[0, 0] == (0, 0)
    beat = [got[2, t][0] for t in range(20, 90) if got[2, t][0] > 0]
    assert beat[0] > beat[-1]
    for t in range(52):
        ok = [k for k in range(24) if scales[k] <= room[t]]
        top = max(ok, key=lambda k: (power[k, t], -k), default=None)
        if top is None or top == ok[-1] or not power[top, t]:
            assert got[0, t] == (0, 0)
            continue
        s = scales[top]
        if top > 0:
            lo, mid, hi = power[top - 1 : top + 2, t]
            s *= (scales[top + 1] / scales[top - 1]) ** ((lo - hi) / (4 * (lo - 2 * mid + hi)))
        assert got[0, t] == pytest.approx((wavelets.morlet_period(s), power[top, t]))


def test_weekly_entropy(spark):
    weeks = spark.range(3).select(F.col("id").alias("week"))
    w = spark.createDataFrame([(1, c, 2.0) for c in "abcd"] + [(2, "a", 5.0), (2, "b", 0.0)], "week long, lang string, weight double")
    assert [r["bits"] for r in wavelets.weekly_entropy(w, weeks).orderBy("week").collect()] == [0.0, 2.0, 0.0]


def test_lagged_correlation_is_brute_force(spark):
    s = {k: rng.poisson(2, n).astype(float) for k, n in enumerate((30, 30, 28, 3))}
    df = spark.createDataFrame([(k, t, float(x)) for k, v in s.items() for t, x in enumerate(v)] + [(9, t, 4.0) for t in range(30)], "id long, t long, x double")
    s[9] = np.full(30, 4.0)
    got = {(r["a"], r["b"]): (r["lag"], r["r"]) for r in stats.lagged_correlation(df, 5).collect()}
    assert got.keys() == set(itertools.combinations([0, 1, 2, 3, 9], 2))
    for (a, b), g in got.items():
        assert g == pytest.approx(brute_lag(s[a], s[b], 5), abs=1e-12)


def test_components_are_numbered_by_first_touch(spark):
    nodes, edges = graph_of(spark, 8, [(5, 1), (7, 0), (3, 3), (1, 6)])
    got = [r["component"] for r in graph.numbered_components(nodes, edges).orderBy("node").collect()]
    assert got == [0, 1, 2, 3, 4, 1, 1, 0]
