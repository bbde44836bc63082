"""Pairs of series that move together, against a null of shifted series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.draws import stream
from quillon.operators import order, stats
from quillon.session import materialise

#: Days of lag, days with activity, least strength, false discoveries allowed, draws
#: of the null and their seed.
MAX_LAG, MIN_ACTIVE, MIN_R, FDR, DRAWS, SEED = 7, 8, 0.3, 0.1, 1000, 1


def active_pairs(series: DataFrame, min_active: int = MIN_ACTIVE) -> DataFrame:
    """(a, b, index): pairs a < b of series with enough values other than 0, numbered in order."""
    active = materialise(series.groupBy("id").agg(F.count_if(F.col("x") != 0).alias("days")).where(F.col("days") >= min_active).select("id"), "active")
    pairs = active.select(F.col("id").alias("a")).join(active.select(F.col("id").alias("b")), F.expr("a < b"))
    return materialise(order.numbered(pairs, ["a", "b"]), "pairs")


def null_strengths(series: DataFrame, pairs: DataFrame, max_lag: int, draws: int, seed: int) -> list[float]:
    """|r| of each draw, sorted: draw k takes pair k (in turn) and turns its second series by at
    least `max_lag` samples. `draws` numbers reach the driver."""
    spark = series.sparkSession
    m = pairs.count()
    u = spark.createDataFrame([(k, k % m, x) for k, x in enumerate(stream(seed, 0, draws))], "draw long, index long, u double")
    size = series.groupBy("id").agg(F.count("*").alias("n"))
    taken = u.join(pairs, "index").join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    n = F.least("na", "nb")
    room = n - 2 * max_lag
    shift = F.when(room > 0, max_lag + F.floor(F.col("u") * room)).otherwise(F.floor(F.col("u") * F.greatest(F.lit(1), n)))
    taken = materialise(taken.select("draw", "a", "b", "nb", shift.alias("shift")), "null")
    still = taken.join(series.withColumnRenamed("id", "a"), "a").select((F.col("draw") * 2).alias("id"), "t", "x")
    turned = taken.join(series.withColumnRenamed("id", "b"), "b").select((F.col("draw") * 2 + 1).alias("id"), F.pmod(F.col("t") - F.col("shift"), F.col("nb")).alias("t"), "x")
    each = stats.lagged_correlation(still.union(turned), max_lag, taken.select((F.col("draw") * 2).alias("a"), (F.col("draw") * 2 + 1).alias("b")))
    return sorted(abs(r[0]) for r in each.select("r").collect())


def _with_p(seen: DataFrame, null: list[float]) -> DataFrame:
    """Adds p: one more than the draws that reach |r|, over one more than all of them, by binary
    search in the sorted draws."""
    known = np.array(null)

    def run(batches):
        for batch in batches:
            r = np.abs(batch.column("r").to_numpy())
            p = (1 + len(known) - np.searchsorted(known, r - stats.ROUNDING, side="left")) / (1.0 + len(known))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

    return seen.mapInArrow(run, T.StructType([*seen.schema.fields, T.StructField("p", T.DoubleType())]))


def find_binaries(series: DataFrame, max_lag: int = MAX_LAG, min_active: int = MIN_ACTIVE, min_r: float = MIN_R, fdr: float = FDR, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(a, b, lag, r, p, q) of disjoint pairs of series (id, t, x), dense in t from 0.

    r is the strongest lagged correlation, p its place among the pooled null, q its share of
    false discoveries over all pairs. Pairs with |r| >= min_r and q <= fdr are taken from the
    strongest on (|r| to twelve places down, then a, b), each series once: in rounds, a pair that is the best
    of both its series is taken, which gives the same pairs as going down the list.
    """
    spark = series.sparkSession
    pairs = active_pairs(series, min_active)
    none = spark.createDataFrame([], f"a {dict(series.dtypes)['id']}, b {dict(series.dtypes)['id']}, lag long, r double, p double, q double")
    if pairs.isEmpty():
        return none
    null = null_strengths(series, pairs, max_lag, draws, seed)
    seen = stats.lagged_correlation(series, max_lag, pairs.select("a", "b"))
    judged = stats.benjamini_hochberg_whole(materialise(_with_p(seen, null), "judged"), "p", ["a", "b"])
    left = judged.where((F.abs("r") >= min_r) & (F.col("q") <= fdr)).select("a", "b", F.col("lag").cast("long").alias("lag"), "r", "p", "q")
    left, found = materialise(left, "binaries"), []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("id"), F.struct((-F.round(F.abs("r"), 12)).alias("s"), "a", "b").alias("k"))
        best = ends.groupBy("id").agg(F.min("k").alias("k")).groupBy("k.a", "k.b").count().where("count = 2").select("a", "b")
        taken = materialise(left.join(best, ["a", "b"], "left_semi"), "binaries")
        found.append(taken)
        gone = taken.select(F.explode(F.array("a", "b")).alias("_id"))
        left = materialise(left.join(gone, F.col("a") == F.col("_id"), "left_anti").join(gone, F.col("b") == F.col("_id"), "left_anti"), "binaries")
    out = none
    for f in found:
        out = out.union(f)
    return out


