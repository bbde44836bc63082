"""Joins by order, families of chances, components of any ids: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import draws
from quillon.operators import communities, graph, joins, layout, metric, order, signal, stats, vectors

rng = np.random.default_rng(11)


def asof(left, right, exact):
    out = []
    for i, k, t in left:
        found = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and (r[2] <= t if exact else r[2] < t)]
        best = max(found, key=lambda r: (r[2], r[3] is not None, r[3] or 0, r[0])) if found else (None,) * 4
        out.append((i, k, t, best[2], best[3], best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("parts", [1, 7])
def test_asof_join(spark, exact, parts):
    """Ties, nulls, keys without a match, a hot key over many partitions, repeated rows."""
    draw = lambda n: [(i, [None, "a", "a", "a", "b", "c"][rng.integers(6)], None if rng.random() < 0.05 else int(rng.integers(0, 40))) for i in range(n)]
    left, right = [*draw(200), (0, "only left", 3), (1, "a", 39), (1, "a", 39)], [(*r, None if rng.random() < 0.1 else int(rng.integers(3))) for r in [*draw(60), (1, "only right", 2)]]
    l = spark.createDataFrame(left, "i long, k string, t long").repartition(3)  # noqa: E741
    r = spark.createDataFrame([(k, t, v, j) for j, k, t, v in right], "k string, rt long, v long, j long").repartition(2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = joins.asof_join(l, r, ["k"], "t", "rt", exact)
        assert got.columns == ["i", "k", "t", "rt", "v", "j"]
        assert sorted(map(tuple, got.collect()), key=str) == asof(left, right, exact)
        assert sorted(map(tuple, joins.asof_join(l, r.limit(0), ["k"], "t", "rt").collect()), key=str) == asof(left, [], exact)
        assert joins.asof_join(l.limit(0), r, ["k"], "t", "rt").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_asof_join_without_keys_and_with_clashes(spark):
    l = spark.createDataFrame([(i, float(i)) for i in range(10)], "i long, t double")  # noqa: E741
    r = spark.createDataFrame([(2.5, "x"), (6.0, "y")], "t double, name string")
    assert [x.name for x in joins.asof_join(l, r, [], "t").orderBy("i").collect()] == [None] * 3 + ["x"] * 3 + ["y"] * 4
    with pytest.raises(ValueError, match="clash"):
        joins.asof_join(l, r.withColumnRenamed("name", "I"), [], "t")


def test_whole_family_equals_one_key(spark):
    rows = [(k, float(x)) for k, x in enumerate(rng.choice([0.001, 0.01, 0.02, 0.3, 0.9, 1.0], 150))]
    df = spark.createDataFrame(rows, "k long, p double").repartition(5)
    want = {r.k: r.q for r in stats.benjamini_hochberg(df.withColumn("one", F.lit(1)), "one", "p").collect()}
    got = {r.k: r.q for r in stats.benjamini_hochberg_whole(df, "p", ["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-15) for k in want)
    some = stats.benjamini_hochberg_whole(spark.createDataFrame([(1, None), (2, 0.2), (3, 0.01)], "k long, p double"), "p", ["k"])
    assert {r.k: r.q for r in some.collect()} == {1: None, 2: 0.2, 3: 0.02}
    assert stats.benjamini_hochberg_whole(df.limit(0), "p", ["k"]).collect() == []


def test_minimum_from_end(spark):
    rows = [(int(k), None if k % 7 == 0 else int(x)) for k, x in enumerate(rng.integers(0, 1000, 120))]
    got = {r.k: r.least for r in order.minimum_from_end(spark.createDataFrame(rows, "k long, x long").repartition(4), ["k"], "x").collect()}
    assert got == {k: min((x for j, x in rows if j >= k and x is not None), default=None) for k, _ in rows}


HUGE = [2**62, 2**62 + 1, 2**62 + 5, 2**63 - 1, 2**63 - 2, -(2**63), -5, 0]


def test_components_of_huge_and_negative_ids(spark):
    nodes = spark.createDataFrame([(n,) for n in HUGE], "node long")
    edges = spark.createDataFrame([(0, HUGE[0], HUGE[1]), (1, HUGE[1], HUGE[2]), (2, HUGE[3], HUGE[4]), (3, HUGE[5], HUGE[6]), (4, HUGE[2], HUGE[0]), (5, 0, 0)], "edge_id long, src long, dst long")
    least = {HUGE[0]: HUGE[0], HUGE[1]: HUGE[0], HUGE[2]: HUGE[0], HUGE[3]: HUGE[4], HUGE[4]: HUGE[4], HUGE[5]: HUGE[5], HUGE[6]: HUGE[5], 0: 0}
    for dense_links in (0, graph.ONE_TASK):
        assert {r.node: r.component for r in graph.components(nodes, edges, dense_links).collect()} == least
    assert {r.node: r.component for r in graph.numbered_components(nodes, edges).collect()} == {n: sorted(set(least.values())).index(c) for n, c in least.items()}
    assert layout.spectral_embedding(nodes, edges).count() == len(HUGE)
    assert metric.heat_kernel_signature(nodes, edges).where("t = 1").count() == len(HUGE)
    labels, one = communities.cut_communities(nodes, edges, edges.select("edge_id", F.lit(1.0).alias("length")))
    assert one.first()["count"] == 4 and labels.select("label").distinct().count() == 4


def test_components_take_any_ids_both_ways(spark):
    n = 300
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (200, 2))] + [(i, i + 1) for i in range(200, 260)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(n)] + [(None,)], "node long"), spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "edge_id long, src long, dst long")
    a, b = ({r.node: r.component for r in graph.components(nodes, edges, d).collect()} for d in (0, graph.ONE_TASK))
    assert a == b and len(a) == n
    text = lambda c: F.format_string("n%03d", c)
    named = graph.components(nodes.where("node is not null").select(text("node").alias("node")), edges.select("edge_id", text("src").alias("src"), text("dst").alias("dst")))
    assert {r.node: r.component for r in named.collect()} == {f"n{i:03d}": f"n{c:03d}" for i, c in a.items()}


def test_null_nodes_are_left_out_of_hops(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,), (None,)], "node long")
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, None, 2)], "edge_id long, src long, dst long")
    a, b = (sorted(map(tuple, graph.hop_distances(nodes, edges, dense=d).collect())) for d in (0, 100))
    assert a == b and len(a) == 9


def series_of(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, x) for i, xs in rows.items() for t, x in enumerate(xs)], f"id {kind}, t int, x double").repartition(3)


def test_pieces_of_any_size_answer_as_the_whole(spark):
    rows = {0: rng.normal(size=157).tolist(), 1: [3.0], 2: [1.0, 2.0], 3: rng.normal(size=20).tolist(), 4: [0.5] * 41}
    df = series_of(spark, rows)
    whole = {(r.id, r.t): (r.level, r.d1, r.d2) for r in signal.smoothed(df).collect()}
    assert len(whole) == sum(map(len, rows.values()))
    h = len(signal.gaussian_kernel(1.5, 0)) // 2
    for k, x in rows.items():
        if len(x) > 1:
            want = np.correlate(signal._reflected(np.array(x), h, True), np.array(signal.gaussian_kernel(1.5, 1)), "valid")
            assert [whole[k, t][1] for t in range(len(x))] == pytest.approx(want.tolist())
    for size in (1, 14, 20, 39, 100):
        got = {(r.id, r.t): (r.level, r.d1, r.d2) for r in signal.smoothed(df, size=size).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k], abs=1e-12) for k in got)


def test_lags_of_pieces_equal_those_of_the_whole(spark):
    base = rng.normal(size=130)
    rows = {0: base[5:125].tolist(), 1: base[:120].tolist(), 2: rng.normal(size=37).tolist(), 3: [1.0] * 50, 4: [2.0, 3.0], 5: (1e6 + base[:77]).tolist()}
    want = {}
    for a in rows:
        for b in rows:
            if a < b:
                n, best = min(len(rows[a]), len(rows[b])), []
                for lag in range(-6, 7):
                    lo, hi = max(0, -lag), min(n, n - lag)
                    if hi - lo >= 4:
                        x, y = np.array(rows[a][lo:hi]), np.array(rows[b][lo + lag : hi + lag])
                        if x.std() > 0 and y.std() > 0:
                            best.append((lag, float(np.corrcoef(x, y)[0, 1])))
                top = max((abs(r) for _, r in best), default=0.0)
                want[a, b] = next(((lag, r) for lag, r in best if abs(r) >= top - 1e-12), (0, 0.0))
    assert want[0, 1][0] == 5
    for size in (7, 30, 1 << 14):
        got = {(r.a, r.b): (r.lag, r.r) for r in stats.lagged_correlation(series_of(spark, rows), 6, size=size).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-7) for k in want)


def test_null_samples_count_as_nothing(spark):
    rows = {0: [1.0, None, 3.0, 4.0, None, 2.0, 7.0], 1: [None] * 6 + [2.0]}
    zero = {k: [x or 0.0 for x in v] for k, v in rows.items()}
    a, b = series_of(spark, rows), series_of(spark, zero)
    lost = spark.createDataFrame([(0, None, 5.0)], "id long, t int, x double")
    for f in (signal.smoothed, signal.dft, lambda d: signal.convolve_reflect(d, [0.25, 0.5, 0.25]), lambda d: stats.lagged_correlation(d, 2)):
        assert sorted(map(str, f(a).collect())) == sorted(map(str, f(b).collect()))
    assert signal.smoothed(a.union(lost)).count() == 14 and signal.smoothed(a.limit(0)).count() == 0 == stats.lagged_correlation(a.limit(0), 2).count()


def test_pairs_of_far_blocks_are_skipped(spark, monkeypatch):
    """Vectors in narrow cones: the same pairs as all pairs give, and most pairs of blocks are never solved."""
    monkeypatch.setattr(vectors, "BLOCK", 12)
    cones = rng.normal(size=(9, 8))
    v = (cones[np.arange(360) % 9] + rng.normal(size=(360, 8)) * 0.02).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "node long, v array<double>")
    edges = spark.createDataFrame([(0, 0, 9), (1, 18, 9), (2, 5, 5)], "edge_id long, src long, dst long")
    got, work = vectors.strongest_pairs(df, edges, 10, 0.5)
    x = np.array(v)
    sim = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    want = sorted(((a, b, sim[a, b]) for a in range(360) for b in range(a + 1, 360) if (a, b) not in ((0, 9), (9, 18))), key=lambda p: (-round(p[2], 12), p[0], p[1]))[:10]
    assert [(r.a, r.b) for r in got.collect()] == [p[:2] for p in want]
    assert work["solved"] < 0.5 * work["pairs"]
    assert vectors.pair_cosines(df, edges, 0.9).count() == sum(sim[a, b] >= 0.9 and (a, b) not in ((0, 9), (9, 18)) for a in range(360) for b in range(a + 1, 360))


def test_vectors_of_unequal_length_and_nulls(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0]), (3, [None, 1.0]), (4, []), (5, None), (None, [1.0]), (6, [0.0, 3.0, None]), (7, [0.0])]
    df = spark.createDataFrame(rows, "node long, v array<double>")
    none = spark.createDataFrame([], "edge_id long, src long, dst long")
    assert [tuple(r) for r in vectors.similar_links(df, none, 10, 0.5).collect()] == [(1, 2, 1.0), (3, 6, 1.0)]
    assert vectors.similar_links(df, none, 10, 0.5, 1).count() == 2 and vectors.similar_links(df.limit(0), none).count() == 0
    got = df.where("node in (1, 3)").crossJoin(df.where("node = 6").select(F.col("v").alias("w"))).select(vectors.cosine(F.col("v"), F.col("w")).alias("c"))
    assert sorted(r.c for r in got.collect()) == [0.0, 1.0]


def entries(n, pairs):
    degree = np.bincount(np.array(pairs).ravel(), minlength=n).astype(float)
    full, row, col, val = np.eye(n), list(range(n)), list(range(n)), [1.0] * n
    for a, b in pairs:
        w = -1 / np.sqrt(degree[a] * degree[b])
        full[a, b] = full[b, a] = w
        row, col, val = [*row, a, b], [*col, b, a], [*val, w, w]
    return full, degree, layout.Sparse(np.array(row), np.array(col), np.array(val), n)


@pytest.mark.parametrize("kind", ["random", "cycle"])
def test_sparse_modes_equal_dense_ones(kind):
    """600 nodes: a random graph with a path hung on it and parallel links; a cycle, whose eigenvalues
    repeat. Where the largest entries are as large on both sides, only the sign is open."""
    n = 600
    pairs = [(k, (k + 1) % n) for k in range(n)]
    if kind == "random":
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 580, (1500, 2)) if a != b] + [(k, k + 1) for k in range(n - 1)] + [(0, 1), (0, 1)]
    full, degree, sparse = entries(n, pairs)
    start = [draws.stream(3, 0, n), draws.stream(3, n, n), draws.stream(3 + layout.DEPTH_SEED, 0, n)]
    for a, b in zip(layout.modes(full, degree, start), layout.sparse_modes(sparse, degree, start), strict=True):
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) * np.sqrt(n) < 1e-4


def test_an_embedding_by_sparse_modes(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(31, 32), (33, 34), (34, 35)]
    nodes = spark.range(37).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "edge_id long, src long, dst long")
    a, b = (np.array([(r.x, r.y, r.z) for r in layout.spectral_embedding(nodes, edges, 3, d).orderBy("node").collect()]) for d in (layout.DENSE, 3))
    assert np.allclose((b**2).mean(0), 1) and np.allclose(np.sort(np.abs(a[:31, 1])), np.sort(np.abs(b[:31, 1])), atol=1e-5)
