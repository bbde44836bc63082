"""Statistics of keyed series as window and group operations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import order, signal
from quillon.session import materialise, ship

KAPPA_MAX = 1000.0
#: Correlations nearer than this are equal: they differ by the rounding of sums.
ROUNDING = 1e-12


def zscore(df: DataFrame, key: str, x: str) -> DataFrame:
    """Adds z: (x - mean) / population deviation within key; 0 where that is 0."""
    w = Window.partitionBy(key)
    return df.withColumn("z", F.coalesce(F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w)), F.lit(0.0)))


def entropy_bits(df: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, bits): Shannon entropy of positive weights; 0 for a key without any."""
    total = F.sum(F.when(F.col(weight) > 0, F.col(weight))).over(Window.partitionBy(key))
    p = F.when(F.col(weight) > 0, F.col(weight) / total)
    return df.withColumn("_p", p).groupBy(key).agg(F.coalesce(-F.sum(F.col("_p") * F.log2("_p")), F.lit(0.0)).alias("bits"))


def average_rank(df: DataFrame, key: str, x: str) -> DataFrame:
    """Adds rank: 1-based within key, ties averaged."""
    by, tie = Window.partitionBy(key).orderBy(x), Window.partitionBy(key, x)
    return df.withColumn("rank", F.rank().over(by) + (F.count("*").over(tie) - 1) / 2)


def pearson(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, r); 0 below two rows or without variance."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.groupBy(key).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("r"))


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, r): correlation of average ranks."""
    ranked = average_rank(average_rank(df, key, a).withColumnRenamed("rank", "_ra"), key, b)
    return pearson(ranked, key, "_ra", "rank")


def benjamini_hochberg(df: DataFrame, key: str, p: str) -> DataFrame:
    """Adds q: the smallest p m / rank from the top, at most 1, within key."""
    by, whole = Window.partitionBy(key).orderBy(p), Window.partitionBy(key)
    down = whole.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_k", F.row_number().over(by)).withColumn("_v", F.col(p) * F.count("*").over(whole) / F.col("_k"))
    return out.withColumn("q", F.least(F.lit(1.0), F.min("_v").over(down))).drop("_k", "_v")


def benjamini_hochberg_whole(df: DataFrame, p: str, ties: list[str]) -> DataFrame:
    """Adds q as `benjamini_hochberg` does, the whole table being one family; `ties` are columns that
    tell rows of equal p apart. Rows are ranged by p, and no task holds more than a range. A
    null p has a null q and is not in the family."""
    have = df.where(F.col(p).isNotNull())
    ranked = materialise(order.numbered(have, [p, *ties], "_k"), "family")
    m = float(ranked.count())
    least = order.minimum_from_end(ranked.withColumn("_v", F.col(p) * m / (F.col("_k") + 1)), ["_k"], "_v", "q")
    out = least.withColumn("q", F.least(F.lit(1.0), "q")).select(*df.columns, "q")
    return out.union(df.where(F.col(p).isNull()).select("*", F.lit(None).cast("double")))


def _lag_sums(batches, max_lag: int, size: int):
    """Pieces of pairs -> for each pair and lag the number, sums, squares and products of the samples
    that meet in this piece, by one product of all lags' windows."""
    names = ["a", "b", "lag", "m", "x", "y", "xx", "yy", "xy"]
    lags = np.arange(-max_lag, max_lag + 1)
    for batch in batches:
        cols = [batch.column(c) for c in ("piece", "n", "ta", "xa", "tb", "xb")]
        sums = []
        for piece, n, ta, xa, tb, xb in zip(*cols, strict=True):
            lo = piece.as_py() * size
            ta, xa, tb, xb = (c.values.to_numpy() for c in (ta, xa, tb, xb))
            own = (ta >= lo) & (ta < min(lo + size, n.as_py()))
            a, first = xa[own], lo
            window = np.zeros((3, len(a) + 2 * max_lag))
            at = tb - (first - max_lag)
            here = (at >= 0) & (at < window.shape[1]) & (tb < n.as_py())
            window[0, at[here]], window[1, at[here]], window[2, at[here]] = 1.0, xb[here], xb[here] ** 2
            if not len(a):
                sums.append(np.zeros((6, len(lags))))
                continue
            v, y, yy = (np.lib.stride_tricks.sliding_window_view(w, len(a)) for w in window)
            sums.append(np.stack([v.sum(1), v @ a, y.sum(1), v @ (a * a), yy.sum(1), y @ a]))
        if sums:
            many = np.stack(sums)
            ends = [batch.column(c).take(pa.array(np.repeat(np.arange(len(sums)), len(lags)))) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(np.tile(lags, len(sums))), *[pa.array(np.ascontiguousarray(many[:, k]).ravel()) for k in range(6)]], names=names)


def _strongest(batches):
    """Sums of all lags of a pair -> the first lag of the strongest |r| within rounding, r and z."""
    for batch in batches:
        out = []
        for row in batch.column("l").to_pylist():
            lag, m, x, y, xx, yy, xy = (np.array([s[c] for s in row]) for c in ("lag", "m", "x", "y", "xx", "yy", "xy"))
            with np.errstate(divide="ignore", invalid="ignore"):
                vx, vy = xx - x * x / m, yy - y * y / m
                # What is left of squares by rounding is no variance.
                good = (m >= 4) & (vx > ROUNDING * xx) & (vy > ROUNDING * yy)
                r = np.where(good, (xy - x * y / m) / np.sqrt(np.where(good, vx * vy, 1.0)), 0.0)
            if not good.any():
                out.append((0, 0.0, 0.0))
                continue
            k = int(np.flatnonzero(good & (np.abs(r) >= np.abs(r).max() - ROUNDING))[0])
            out.append((int(lag[k]), float(r[k]), math.atanh(max(-0.999999, min(0.999999, r[k]))) * math.sqrt(max(0.0, m[k] - 3))))
        lag, r, z = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(lag, pa.int64()), pa.array(r, pa.float64()), pa.array(z, pa.float64())], names=["a", "b", "lag", "r", "z"])


def lagged_correlation(series: DataFrame, max_lag: int, pairs: DataFrame | None = None, size: int = signal.PIECE) -> DataFrame:
    """(a, b, lag, r, z) for pairs a < b of series (id, t, x), dense in t from 0: the strongest |r| of
    all lags of b against a, over the samples that both have.

    Overlaps below four and those without variance do not count; of |r| equal within rounding
    the first lag wins; without any lag all are 0. Null x counts as 0. pairs: (a, b); None takes all.
    Series are cut into pieces of `size` samples with a halo of `max_lag`; a pair's pieces
    meet by their place, and sums over pieces, of samples less their series' mean, give r. So no row holds a
    whole series.
    """
    ship(series.sparkSession)
    size = max(size, max_lag + 1)
    series = series.where("t is not null").select("id", "t", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    cut = signal.pieces(series, max_lag, size)
    own = F.filter(F.arrays_zip("t", "x"), lambda s: (s["t"] >= F.col("piece") * size) & (s["t"] < (F.col("piece") + 1) * size))
    cut = materialise(cut.withColumn("_own", own), "series")
    total = F.aggregate("_own", F.lit(0.0), lambda s, e: s + e["x"])
    whole = materialise(cut.groupBy("id").agg(F.sum(F.size("_own")).alias("n"), (F.sum(total) / F.sum(F.size("_own"))).alias("mean")), "series-means")
    cut = cut.drop("_own")
    if pairs is None:
        pairs = whole.select(F.col("id").alias("a")).join(whole.select(F.col("id").alias("b")), F.expr("a < b"))
    side = lambda c: whole.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("mean").alias(f"mean{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    both = materialise(both.select("a", "b", F.least("na", "nb").alias("n"), "meana", "meanb"), "series-pairs")
    # A pair's pieces: those that begin before the shorter series ends.
    asked = both.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("piece"))
    less = lambda c: F.transform("x", lambda x: x - F.col(f"mean{c}")).alias(f"x{c}")
    met = asked.join(cut.select(F.col("id").alias("a"), "piece", F.col("t").alias("ta"), "x"), ["a", "piece"]).select("a", "b", "n", "piece", "ta", less("a"), "meanb")
    met = met.join(cut.select(F.col("id").alias("b"), "piece", F.col("t").alias("tb"), "x"), ["b", "piece"]).select("a", "b", "n", "piece", "ta", "xa", "tb", less("b"))
    kinds = dict(both.dtypes)
    sums = met.mapInArrow(lambda it: _lag_sums(it, max_lag, size), f"a {kinds['a']}, b {kinds['b']}, lag long, " + ", ".join(f"{c} double" for c in ("m", "x", "y", "xx", "yy", "xy")))
    sums = sums.groupBy("a", "b", "lag").agg(*[F.sum(c).alias(c) for c in ("m", "x", "y", "xx", "yy", "xy")])
    by_pair = sums.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("lag", "m", "x", "y", "xx", "yy", "xy"))).alias("l"))
    return by_pair.mapInArrow(_strongest, f"a {kinds['a']}, b {kinds['b']}, lag long, r double, z double")


def von_mises_fit(df: DataFrame, key: str, k: str, weight: str, directions: int) -> DataFrame:
    """(key, mu, kappa, r) of weights on equal directions k = 0..directions-1."""
    th = F.col(k) * (2 * math.pi / directions)
    w = F.when(F.col(weight) > 0, F.col(weight))
    s = df.groupBy(key).agg(F.sum(w).alias("w"), F.sum(w * F.cos(th)).alias("c"), F.sum(w * F.sin(th)).alias("s"))
    r = F.least(F.lit(1.0), F.hypot(F.col("c") / F.col("w"), F.col("s") / F.col("w")))
    s = s.withColumn("r", F.coalesce(r, F.lit(0.0)))
    r = F.col("r")
    d = F.pow(r, 3) - 4 * F.pow(r, 2) + 3 * r
    kappa = F.when(r < 0.53, 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(F.when(d > 0, 1 / d).otherwise(KAPPA_MAX))
    mu = F.atan2("s", "c")
    mu = F.when(mu < 0, mu + 2 * math.pi).otherwise(mu)
    return s.select(key, F.coalesce(mu, F.lit(0.0)).alias("mu"), F.least(F.lit(KAPPA_MAX), kappa).alias("kappa"), "r")
