import os
from types import SimpleNamespace

import pytest

from quillon import session


def test_a_cluster_must_name_its_folder():
    stub = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: folder)))
    assert session.shared_root(stub("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(stub("spark://host:7077", None))


def test_what_a_process_wrote_can_be_removed(spark):
    df = session.materialise(spark.range(5), "check")
    path = df._quillon_path.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    session.drop(df)
    assert not os.path.exists(path)
    before, session._PATHS[:] = list(session._PATHS), []
    paths = [session.materialise(spark.range(3), "check")._quillon_path.removeprefix("file://") for _ in range(2)]
    session.clean(spark)
    assert not any(map(os.path.exists, paths)) and session._PATHS == []
    session._PATHS[:] = before


def test_columns_get_free_names(spark):
    assert session.free_name(spark.range(1).selectExpr("id as _row", "id as _ROW_"), "_row") == "_row__"
