"""Queries of this subpackage against their DuckDB SQL."""

import duckdb
import pytest

from quillon.llm import catalogue


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted((tuple(str(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, sf), con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    nulls = [c for c in got.columns if c in ("refers_to", "parent_conv_id")]
    got, want = got.toPandas(), want.df()
    for c in nulls:
        got[c], want[c] = (f[c].astype("float").fillna(-1.0) for f in (got, want))
    assert rows(got) == rows(want)
