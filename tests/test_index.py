"""The text index: which shards a look-up reads, long lists, hard rows."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from quillon.sources import text_index

DOCS = [(10, "Tea and cup"), (20, "tea\ttea TEA"), (30, None), (40, ""), (None, "tea lost"), (50, "cup é漢"), (50, "and a second row of it"), (7, "x" * 70 + " tea")]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in DOCS], "doc_id long, text string, id int, term string, pos int").repartition(3)
    return text_index.build(df, shards=8)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_look_up_of_lists_and_tables(spark, index):
    want = [("cup", 10), ("cup", 50), ("tea", 7), ("tea", 10), ("tea", 20)]
    assert found(text_index.look_up(spark, index, ["tea", "cup", "cup", "none", None])) == want
    asked = spark.createDataFrame([("tea",), ("cup",), ("cup",), ("none",), (None,)], "term string")
    assert found(text_index.look_up(spark, index, asked)) == want
    assert found(text_index.look_up(spark, index, [])) == found(text_index.look_up(spark, index, asked.limit(0))) == []
    assert found(text_index.look_up(spark, index, ["x" * 70, "é漢"])) == [("x" * 70, 7), ("é漢", 50)]


def test_other_shards_are_not_read(spark, index, tmp_path):
    """With the folders of all other shards gone a look-up still answers, and its plan says why."""
    here = f"{tmp_path}/postings"
    shutil.copytree(index.postings.removeprefix("file://"), here)
    small = text_index.TextIndex(here, index.ids, index.shards)
    for folder in glob.glob(f"{here}/shard=*"):
        if folder.rsplit("=", 1)[1] != str(index.shard("tea")):
            shutil.rmtree(folder)
    assert len(os.listdir(here)) < len(os.listdir(index.postings.removeprefix("file://")))
    assert found(text_index.look_up(spark, small, ["tea"])) == [("tea", 7), ("tea", 10), ("tea", 20)]
    plan = text_index.look_up(spark, index, ["tea"])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(shard" in plan or f"(shard#" in plan and f"= {index.shard('tea')}" in plan
    assert "PushedFilters: [" in plan and "tea" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_shards_of_columns_and_texts_agree(spark, index):
    terms = [t for (t,) in spark.createDataFrame([("tea",), ("é漢",), ("x" * 70,)], "t string").collect()]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", index.shard_of(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: index.shard(t) for t in terms}
    postings, _ = index.read(spark)
    assert all(r.shard == index.shard(r.term) for r in postings.collect())


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("all w"), (F.col("id") % 3).cast("string")).alias("text"))
    index = text_index.build(df)
    postings, _ = index.read(spark)
    assert max(len(r.ids) for r in postings.collect()) <= 16 and postings.where("term = 'all'").count() == 7
    assert found(text_index.look_up(spark, index, ["all"])) == [("all", i) for i in range(100)]


def test_search_needs_all_words(spark, index):
    asked = spark.createDataFrame([(1, "TEA cup"), (2, "tea"), (3, "tea none"), (4, ""), (5, None), (None, "tea"), (6, "cup cup")], "query long, text string")
    assert found(text_index.search(spark, index, asked)) == [(1, 10), (2, 7), (2, 10), (2, 20), (6, 10), (6, 50)]


def test_empty_index(spark):
    index = text_index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert found(text_index.look_up(spark, index, ["tea"])) == [] and index.read(spark)[0].count() == 0
