"""What larger tables brought out: caps, coincidences and ways beyond the small ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import plans
from quillon.functions import draws
from quillon.operators import communities, graph, layout, metric, systems, vectors
from quillon.plans import more
from quillon.sources import text_index


def test_energy_of_two_bodies_in_one_place(spark):
    one = "system long, body long, m double, x double, y double, vx double, vy double"
    states = spark.createDataFrame([(1, 1, 0.5, 1.0, 0.0, 0.0, 1.0), (1, 2, 0.5, 1.0, 0.0, 0.0, 1.0), (2, 3, 0.5, 1.0, 0.0, 0.0, 1.0)], one)
    got = {r.system: r.energy for r in systems.energy(states, 1e-3).collect()}
    assert got[1] == float("-inf") and got[2] == pytest.approx(0.25 - 4 * np.pi**2 * 0.5)


def test_bodies_in_one_place_step_as_in_sql(spark, tmp_path):
    """Suppliers 1,513 apart have one place; where they are of one nation, their pull is no number."""
    keys = [(1, 0), (1514, 0), (2, 0), (1, 1), (2, 1), (1513 + 7, 2), (7, 3)]
    keys = [(k + 3026 * n, n) for k, n in keys]
    spark.createDataFrame(keys, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got = text(plans.queries()["leapfrog_step"](spark, str(tmp_path)).collect())
    assert got == text(con.sql(plans.oracle_sql()["leapfrog_step"]).fetchall())
    assert sum("nan" in r[1:] for r in got) == 3


def test_heat_by_series_is_heat_by_eigenvectors():
    rng = np.random.default_rng(3)
    n = 700
    a, b = np.concatenate([np.arange(n - 1), rng.integers(0, n, 300)]), np.concatenate([np.arange(1, n), rng.integers(0, n, 300)])
    a, b = a[a != b], b[a != b]
    row, col = np.concatenate([a, b]), np.concatenate([b, a])
    root = np.sqrt(np.bincount(row, minlength=n))
    row, col, val = np.concatenate([row, np.arange(n)]), np.concatenate([col, np.arange(n)]), np.concatenate([-1 / (root[row] * root[col]), np.ones(n)])
    m = np.zeros((n, n))
    m[row, col] = val
    values, vectors = np.linalg.eigh(m)
    want = vectors**2 @ np.exp(-np.outer(values, [1.0, 10.0, 60.0]))
    got = metric._heat_by_series(row, col, val, n, range(5, 690), [1.0, 10.0, 60.0])
    assert np.abs(got - want[5:690]).max() < 1e-12


def test_heat_of_a_large_cycle_has_no_cut(spark):
    n = 5000
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = nodes.select(F.col("node").alias("edge_id"), F.col("node").alias("src"), ((F.col("node") + 1) % n).alias("dst"))
    got = metric.heat_kernel_signature(nodes, edges, max_dense=None).groupBy("t").agg(F.count_distinct("node").alias("n"), F.min("hks").alias("low"), F.max("hks").alias("high")).collect()
    for r in got:
        want = np.exp(-r.t * (1 - np.cos(2 * np.pi * np.arange(n) / n))).mean()
        assert r.n == n and r.low == pytest.approx(want, abs=1e-12) and r.high == pytest.approx(want, abs=1e-12)
    assert len(got) == 2


#: Queries whose files, one for each nation, once met the caps of their validators.
FED = ("feed_graph", "feed_flow", "feed_semantic", "feed_text_index", "feed_language_bytes", "feed_repo_languages", "feed_repos")


@pytest.fixture(scope="session")
def many_suppliers(tmp_path_factory):
    """18,000 suppliers of two nations."""
    d = tmp_path_factory.mktemp("suppliers")
    with duckdb.connect() as c:
        c.execute(f"copy (select i::bigint as s_suppkey, 'S' || i as s_name, (i // 25 % 2)::int as s_nationkey, i % 1000 * 1e0 as s_acctbal from range(1, 18001) t(i)) to '{d}/supplier.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("query", FED)
def test_feeds_without_caps(spark, many_suppliers, query):
    got = plans.queries()[query](spark, many_suppliers)
    with duckdb.connect() as c:
        c.execute(f"create view supplier as select * from '{many_suppliers}/supplier.parquet'")
        want = sorted(map(str, c.execute(f"select {', '.join(f'"{x}"' for x in got.columns)} from ({plans.oracle_sql()[query]})").fetchall()))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_quota_among_hubs_and_copies_is_the_greedy_pass(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    x[20:60] = x[7] + rng.normal(size=(40, 3)) * 1e-3  # one hub's neighbours
    x[60:100] = x[11]  # copies, all ties
    rows = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in enumerate(x)], "node long, v array<double>")
    edges = spark.createDataFrame([(0, 60, 61)], "edge_id long, src long, dst long")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 12)
    pairs = sorted((-sim[a, b], a, b) for a in range(120) for b in range(a + 1, 120) if sim[a, b] >= 0.2 and (a, b) != (60, 61))
    for count, quota in ((12, 1), (9, 2)):
        used, want = np.zeros(120, int), []
        for _, a, b in pairs:
            if len(want) < count and used[a] < quota and used[b] < quota:
                used[[a, b]] += 1
                want.append((a, b))
        got = vectors.similar_links(rows, edges, count, 0.2, quota).collect()
        assert [(r.a, r.b) for r in got] == want


def test_rows_go_once_to_each_group_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "GROUPS", 3)
    x = np.random.default_rng(6).normal(size=(90, 4))
    blocks = vectors.Blocks(spark.createDataFrame([(k, [float(z) for z in v]) for k, v in enumerate(x)], "node long, v array<double>"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.a, r.b): r.sim for r in blocks.solve(blocks.pairs, None, -2.0, None).collect()}
    assert len(got) == 90 * 89 // 2 and blocks.count > 3
    assert all(abs(s - unit[a] @ unit[b]) < 1e-12 for (a, b), s in got.items())


def test_bodies_pull_in_blocks_and_not_from_one_place(monkeypatch):
    rng = np.random.default_rng(8)
    x, m = rng.normal(size=(2, 37)), rng.uniform(0.1, 1.0, 37)
    x[:, 30] = x[:, 4]
    want = -4 * np.pi**2 * x / (x * x).sum(0) ** 1.5
    for i in range(37):
        for j in range(37):
            d = x[:, j] - x[:, i]
            if d.any():
                want[:, i] += 1e-3 * 4 * np.pi**2 * m[j] * d / (d @ d) ** 1.5
    for cells in (1, 100, 1 << 17):
        monkeypatch.setattr(systems, "CELLS", cells)
        assert np.allclose(systems._accelerate(x, m, 1e-3), want, rtol=1e-12, atol=0)


def test_search_meets_lists_of_each_block(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    docs = [(k, " ".join(w for w, p in (("two", 2), ("three", 3), ("seven", 7), ("late", 1)) if k % p == 0 and (w != "late" or k > 60))) for k in range(70)]
    index = text_index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = [(1, "two THREE two"), (2, "three seven late"), (3, "two none"), (4, "late"), (5, "")]
    found = text_index.search(spark, index, spark.createDataFrame(asked, "query long, text string"))
    want = [(q, k) for q, text in asked for k, words in docs if text and set(text.lower().split()) <= set(words.split())]
    assert sorted((r.query, r.id) for r in found.collect()) == want
    # No step counts pairs of a query and a document: what is grouped are blocks.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query" in plan and not any("Aggregate" in line and "pos" in line for line in plan.splitlines())


def test_curvature_of_a_larger_graph_takes_no_pairs_of_nodes(spark, monkeypatch):
    """Beyond a broadcast, links are solved by blocks: neither hops nor paths of pairs are searched for."""

    def none(*a, **k):
        raise AssertionError("pairs")

    monkeypatch.setattr(graph, "hop_distances", none)
    monkeypatch.setattr(metric, "paths_within", none)
    monkeypatch.setattr(metric, "BLOCK", 8)
    monkeypatch.setattr(metric, "BLOCK_MOST", 12)
    rng = np.random.default_rng(4)
    n = 90
    pairs = [(i, i + 1) for i in range(n - 1)] + [(i, i + 1) for i in range(0, n - 1, 3)] + [tuple(map(int, p)) for p in rng.integers(0, n, (25, 2))] + [(7, i) for i in range(0, n, 9)]
    lengths = rng.choice([0.5, 1.0, 2.0], len(pairs)).tolist()
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(k, *p, x) for k, (p, x) in enumerate(zip(pairs, lengths, strict=True))], "edge_id long, src long, dst long, length double")
    named = lambda c: F.format_string("n%03d", c).alias(c)
    text = nodes.select(named("node")), edges.select("edge_id", named("src"), named("dst"), "length")
    for by_length in (False, True):
        want = {r.edge_id: r.kappa for r in metric.curvature(nodes, edges, lengths=by_length).collect()}
        for at in ((nodes, edges), text) if by_length else (text,):
            got = {r.edge_id: r.kappa for r in metric.curvature(*at, lengths=by_length, dense=0).collect()}
            assert got == pytest.approx(want, abs=1e-9) and len(got) == len(pairs)


def test_components_of_a_long_path_need_few_rounds(spark, monkeypatch):
    """Rounds of labels once grew with the diameter of a graph in no order."""
    written, materialise = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    n = 600
    name = np.random.default_rng(6).permutation(n).tolist()
    nodes = spark.range(2 * n).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, name[i], name[i + 1]) for i in range(n - 1)] + [(n + i, n + i, n + i + 1) for i in range(5)], "edge_id long, src long, dst long")
    got = {r.node: r.component for r in graph.components(nodes, edges, 0).collect()}
    assert got == {i: 0 if i < n else n if i <= n + 5 else i for i in range(2 * n)}
    assert len(written) < 50


def test_clusters_are_neighbours_and_bounded(spark):
    n = 2000
    links = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).union(spark.range(1, 900).select(F.lit(n).alias("src"), (F.col("id") + n).alias("dst")))
    got = graph.clusters(links, 20, 50).toPandas()
    assert sorted(got.node) == list(range(n + 900)) and got.groupby("cluster").size().max() < 100
    ring = got[got.node < n].sort_values("node").cluster.to_numpy()
    assert (ring != np.roll(ring, 1)).sum() < n / 4


def test_hosts_of_notes_number_no_links(spark, sf, monkeypatch):
    """The hosts once waited for all pairs of stars to be written and numbered."""
    want = communities.notes_graph(*more._notes(spark, sf))[2].count()

    def none(*a, **k):
        raise AssertionError("numbered")

    monkeypatch.setattr(communities.order, "numbered", none)
    got = plans.queries()["notes_hosts"](spark, sf)
    assert got.count() == want > 0
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(plans.oracle_sql()["notes_hosts"]).fetchall())


def test_links_of_notes_move_as_numbers(spark, sf, monkeypatch):
    """All pairs of stars once went with their ids through three shuffles and a written table; now none is numbered or written."""
    rows, numbered = [], communities.order.running_total
    monkeypatch.setattr(communities.order, "running_total", lambda df, *a: rows.append(df.count()) or numbered(df, *a))
    got = plans.queries()["notes_links"](spark, sf)
    found = sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()["notes_links"]).fetchall()
    assert found == sorted(want)
    lines = con.sql("select count(*) from lineitem").fetchall()[0][0]
    assert len(want) > lines > max(rows)


def test_modes_of_a_long_chain_are_cosines():
    """Under the shift of small graphs, a long chain's first modes were not told apart."""
    n, name = 8000, np.random.default_rng(8).permutation(8000)
    a, b = name[:-1], name[1:]
    degree = np.bincount(np.concatenate([a, b]), minlength=n).astype(float)
    row, col, val = np.concatenate([a, b, np.arange(n)]), np.concatenate([b, a, np.arange(n)]), np.concatenate([*[-1 / np.sqrt(degree[a] * degree[b])] * 2, np.ones(n)])
    start = [np.random.default_rng(k).random(n).tolist() for k in range(3)]
    got = layout.sparse_modes(layout.Sparse(row, col, val, n), degree, start)
    for k, u in enumerate(got):
        want = np.cos(np.pi * (k + 1) * np.arange(n) / (n - 1))
        assert abs(want @ u[name]) / np.linalg.norm(want) == pytest.approx(1, abs=1e-9)


def test_links_go_once_to_few_tasks(spark, monkeypatch):
    """All links both ways were written twice and went to every task of a fixed number of sources."""
    monkeypatch.setattr(graph, "TASK_SOURCES", 3)
    monkeypatch.setattr(graph, "FEW_TASKS", 2, raising=False)
    seen, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: seen.append((label, write(df, label))) or seen[-1][1])
    n = 40
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if a * b % 7 < 4] + [(50, 51)]
    nodes = spark.createDataFrame([(k,) for k in [*range(n), 50, 51, 60]], "node long")
    edges = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "edge_id long, src long, dst long")
    want = sorted(map(tuple, graph.hop_distances(nodes, edges).collect()))
    seen.clear()
    assert sorted(map(tuple, graph.hop_distances(nodes, edges, dense=0).collect())) == want
    assert all(df.count() < len(pairs) for label, df in seen if label == "links")
    assert [df for label, df in seen if label == "sources"][-1].select("t").distinct().count() <= 3


@pytest.mark.parametrize("parallel", [True, False])
def test_modes_of_a_large_component_are_found_together(monkeypatch, parallel):
    """Each mode once took a Krylov space of its own, with exact solutions by plain gradients for every vector of it."""
    rng = np.random.default_rng(7)
    n = 3000
    places = np.sort(rng.random(n))
    pairs = [(int(a), int(b)) for k in (6, 9) for by in [np.lexsort((places, rng.integers(0, k, n)))] for a, b in zip(by, by[1:], strict=False)]
    pairs = list({(min(p), max(p)) for p in pairs}) + (pairs[5:60] if parallel else [])
    a, b = np.array(pairs).T
    degree = np.bincount(np.concatenate([a, b]), minlength=n).astype(float)
    w = -1 / np.sqrt(degree[a] * degree[b])
    matrix = layout.Sparse(np.concatenate([a, b, np.arange(n)]), np.concatenate([b, a, np.arange(n)]), np.concatenate([w, w, np.ones(n)]), n)
    start = [draws.stream(3, 0, n), draws.stream(3, n, n), draws.stream(3 + layout.DEPTH_SEED, 0, n)]
    want = layout.sparse_modes(matrix, degree, start)
    exact, solve = [], layout.Sparse._gradients
    monkeypatch.setattr(layout.Sparse, "_gradients", lambda self, *x: exact.append(0) or solve(self, *x))
    got = layout.sparse_modes(matrix, degree, start, 100)
    assert len(exact) <= 1
    assert np.minimum(np.abs(got - want).max(1), np.abs(got + want).max(1)).max() * np.sqrt(n) < 1e-6
