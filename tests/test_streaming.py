"""Streams against their batch forms: late rows, restarts, draws as a table."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import draw_table, draws
from quillon.operators import signal
from quillon.streaming import rhythms

DAY = 86400


def run(spark, stream, name, tmp, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp}/{name}")


def test_weekly_stream_equals_batch_and_restarts(spark, tmp_path):
    """Files come in order; after a restart from the checkpoint more come, one row too late."""
    schema = "id long, ts timestamp, x double"
    first = [(k, d) for d in range(0, 30) for k in (1, 2)]
    more = [(k, d) for d in range(30, 60) for k in (1, 2, 3)]

    def frame(rows):
        return spark.createDataFrame([(k, d, float(d % 5 + k)) for k, d in rows], "id long, d int, x double").select("id", F.timestamp_seconds(F.col("d") * DAY + 4 * DAY + 3600).alias("ts"), "x")

    frame(first).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = rhythms.weekly(rhythms.read(spark, f"{tmp_path}/in", schema))
    assert run(spark, stream, "weeks", tmp_path).count() == 8  # four whole weeks are over for two keys
    frame(more).union(frame([(1, 2)])).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    frame([(9, 90)]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    got = run(spark, rhythms.weekly(rhythms.read(spark, f"{tmp_path}/in", schema)), "weeks", tmp_path)
    daily = spark.createDataFrame([(k, d, float(d % 5 + k)) for k, d in first + more], "id long, t int, x double")
    want = {(r.id, r.week): r.x for r in signal.weekly(daily).collect()}
    assert {(r.id, r.week): r.x for r in got.collect()} == want  # the late row of the first week is not in it


def test_follow_stream_equals_the_sums(spark, tmp_path):
    rows = [(k, 1000.0 * t, float((t * (k + 3)) % 7)) for t in range(40) for k in (1, 2)]
    schema, folder = "id long, ms double, target double", f"{tmp_path}/in"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        conf = "spark.sql.streaming.stateStore.providerClass"
        spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            got = run(spark, rhythms.follow(rhythms.read(spark, folder, schema), 2500.0), "follow", tmp_path)
        finally:
            spark.conf.unset(conf)
    want = {}
    for k in (1, 2):
        x = None
        for key, ms, target in rows:
            if key == k:
                x = target if x is None else x + (target - x) * (1 - math.exp(-1000.0 / 2500.0))
                want[k, ms] = x
    found = {(r.id, r.ms): r.x for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_draws_as_a_table(spark):
    df = spark.createDataFrame([(1, 5, 0, 3), (2, 9, 4, 2), (3, None, 0, 2), (4, 7, 0, 0), (5, 2**40, 1, 1)], "id long, s long, a int, n int")
    got = {}
    for r in draw_table.with_draws(df, "s", "a", "n").collect():
        got.setdefault(r.id, []).append((r.k, r.draw))
    assert got == {i: list(enumerate(draws.stream(s, a, n), a + 1)) for i, s, a, n in ((1, 5, 0, 3), (2, 9, 4, 2), (5, 2**40, 1, 1))}
