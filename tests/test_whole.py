"""Queries against the whole job, where the catalogue's SQL states a part of it."""

import itertools

import duckdb
import pytest
from test_core import TABLES, rows

from quillon import plans
from quillon.operators import graph
from quillon.plans import core


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_all_pairs_are_correlated(spark, sf, duck):
    got = plans.queries()["lagged_correlation"](spark, sf).toPandas()
    sql = plans.oracle_sql()["lagged_correlation"].replace(" where id < 8", "")
    assert len(got) == 300 and rows(got) == rows(duck.sql(sql).df())


def test_all_series_have_a_rhythm(spark, tmp_path):
    """52 weeks, four whole cycles of thirteen, so that every one of nine nations has the peak."""
    spark.range(9).selectExpr("id as c_custkey", "id as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    each = "explode(sequence(0, 51)) as w", "explode(sequence(0L, 8L)) as o_custkey"
    orders = spark.range(1).selectExpr("id", each[0]).selectExpr("w", each[1]).where("w in (0, 51) or (w * 7 + o_custkey) % 3 > 0")
    orders.selectExpr("o_custkey", "cast(date_add(date '1995-01-01', 7 * w) as timestamp) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = plans.queries()["dominant_rhythm"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.period) for r in got) == [(k, 13.0) for k in range(9)]


CHAIN = "e as (select l_orderkey as edge_id, l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem qualify dst is not null)"
TRADE = ("degree", "laplacian_apply", "diffuse_3_steps", "components", "modularity_by_label")


@pytest.mark.parametrize("name", TRADE)
def test_all_lines_are_chained(spark, sf, duck, name):
    part = next(x for x in plans.oracle_sql()[name].split("\n") if x.startswith("e as ")).rstrip(",")
    sql = plans.oracle_sql()[name].replace(part, CHAIN)
    assert rows(plans.queries()[name](spark, sf).toPandas()) == rows(duck.sql(sql).df())


def test_chain_of_lines_with_gaps_and_ties(spark, tmp_path):
    lines = [(1, 3, 10), (1, 7, 12), (1, 7, 11), (2, 2, 13), (3, 4, 10), (3, 1, 14), (4, 5, 15), (4, 6, 15)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10, 17).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    nodes, edges = core.trade(spark, str(tmp_path))
    got = edges.collect()
    assert sorted((r.src, r.dst) for r in got) == [(10, 11), (11, 12), (14, 10), (15, 15)]
    assert len({r.edge_id for r in got}) == 4 and nodes.count() == 7


def bfs(nodes, links):
    near = {n: set() for n in nodes}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for s in nodes:
        front, k = {s}, 0
        while front:
            out |= {(s, n): k for n in front}
            front, k = {m for n in front for m in near[n] if (s, m) not in out}, k + 1
    return out


def test_hops_of_all_pairs_equal_bfs(spark):
    names = [-130, -65, -64, -63, -1, 0, 1, 62, 63, 64, 65, 127, 128, 1 << 40, 7, 8, 9]
    links = [*zip(names[:13], names[1:14]), (names[2], names[9]), (7, 8), (7, 8), (9, 9)]
    nodes = spark.createDataFrame([(n,) for n in names], "node long")
    edges = spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "edge_id long, src long, dst long")
    want = bfs(names, links)
    assert max(want.values()) > 6
    for limit, dense in itertools.product((None, 0, 1, 3), (graph.DENSE_LINKS, 0)):
        got = graph.hop_distances(nodes, edges, limit, dense).collect()
        assert len(got) == len({(r.src, r.dst) for r in got})
        assert {(r.src, r.dst): r.hops for r in got} == {k: v for k, v in want.items() if limit is None or v <= limit}


def test_hops_of_components_in_tasks_and_by_joins(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_SOURCES", 3)
    monkeypatch.setattr(graph, "SEARCH_LINKS", 4)
    links = [(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 99), (99, 41), (50, 51)]
    names = [*range(21), 30, 31, 32, 40, 41, 50, 51, 60, 60]
    nodes = spark.createDataFrame([(n,) for n in names], "node int")
    edges = spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "edge_id long, src int, dst int")
    want = {k: v for k, v in bfs([*names, 99], links).items() if k[0] != 99}
    joined, joins = [], graph._hops_by_joins
    monkeypatch.setattr(graph, "_hops_by_joins", lambda own, *rest: joined.append(own.count()) or joins(own, *rest))
    for dense, task, by in ((graph.DENSE_LINKS, 0, []), (0, graph.TASK_LINKS, []), (0, 10, [21]), (0, 0, [28])):
        got = graph.hop_distances(nodes, edges, None, dense, task)
        assert dict(got.dtypes) == {"src": "int", "dst": "int", "hops": "int"}
        rows = list(map(tuple, got.collect()))
        assert len(rows) == len(want) and {(a, b): h for a, b, h in rows} == want and joined == by
        joined.clear()


def test_hop_distances_go_to_the_last_hop(spark, tmp_path):
    spark.range(6).selectExpr("1L as l_orderkey", "cast(id as int) as l_linenumber", "id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.src, r.dst): r.hops for r in plans.queries()["hop_distances"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): abs(a - b) for a in range(6) for b in range(6)} | {(6, 6): 0}
