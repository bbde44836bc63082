"""Series (id, t, x), dense in t from 0: smoothing, spectra, rhythm."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import ship

#: Samples of a piece of a series.
PIECE = 1 << 14


def gaussian_kernel(sigma: float, order: int) -> list[float]:
    """Weights of a Gaussian or its first or second derivative, of half-width ceil(4 sigma),
    scaled so that a constant, a unit ramp or t^2/2 answers with one."""
    h = max(1, math.ceil(4 * sigma))
    at = range(-h, h + 1)
    g = [math.exp(-i * i / (2 * sigma * sigma)) for i in at]
    if order == 0:
        return [w / sum(g) for w in g]
    if order == 1:
        return [i * w / sum(j * j * v for j, v in zip(at, g, strict=True)) for i, w in zip(at, g, strict=True)]
    mean = sum(i * i * w for i, w in zip(at, g, strict=True)) / sum(g)
    raw = [(i * i - mean) * w for i, w in zip(at, g, strict=True)]
    return [w / sum(v * j * j / 2 for j, v in zip(at, raw, strict=True)) for w in raw]


def _reflected(x: np.ndarray, h: int, odd: bool) -> np.ndarray:
    """x with h samples more on both sides, mirrored or point-reflected about its ends, as often as
    that takes: the extension has period 2(n-1), over which an odd one rises by its ends'
    difference, twice."""
    n = len(x)
    at = np.arange(-h, n + h)
    if n == 1:
        return np.where((at == 0) | (not odd), x[0], 0.0)
    turn, place = np.divmod(at, 2 * (n - 1))
    back = place >= n
    out = x[np.where(back, 2 * (n - 1) - place, place)]
    return np.where(back, 2 * x[-1] - out, out) + 2 * (x[-1] - x[0]) * turn if odd else out


def pieces(series: DataFrame, halo: int, size: int) -> DataFrame:
    """(id, piece, t, x): pieces of `size` samples of each series as arrays, with up to `halo` samples
    more on both sides. Null x counts as 0; rows without t are left out."""
    t = F.col("t").cast("long")
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((t - halo) / size)), F.floor((t + halo) / size)
    rows = series.where("t is not null").select("id", t.alias("t"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.explode(F.sequence(first, last)).alias("piece"))
    lists = rows.groupBy("id", "piece").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    return lists.select("id", "piece", F.col("s.t").alias("t"), F.col("s.x").alias("x"))


def _filtered(series: DataFrame, kernels: list[tuple[str, list[float], bool]], size: int) -> DataFrame:
    """(id, t, name, ...): each kernel's answer, all in one pass over pieces of series with halos.
    A piece that reaches its series' end, which it knows from its halo, is mirrored there."""
    ship(series.sparkSession)
    names = [name for name, _, _ in kernels]
    halo = max(len(kernel) // 2 for _, kernel, _ in kernels)
    size = max(size, 2 * halo + 1)

    def answer(x, kernel, odd, at_start, at_end):
        h = len(kernel) // 2
        if len(x) == 1 and at_start and at_end and odd:
            return np.zeros(1)
        if at_start and at_end:
            return np.correlate(_reflected(x, h, odd), np.array(kernel), "valid")
        left = _reflected(x, h, odd)[:h] if at_start else np.zeros(h)
        right = _reflected(x, h, odd)[-h:] if at_end else np.zeros(h)
        return np.correlate(np.concatenate([left, x, right]), np.array(kernel), "valid")

    def run(batches):
        for batch in batches:
            for key, piece, t, x in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                t, x = t.values.to_numpy(), x.values.to_numpy()
                own = (t >= piece * size) & (t < (piece + 1) * size)
                if not own.any():
                    continue
                ends = t[0] == 0, t[-1] < (piece + 1) * size + halo - 1
                cols = [pa.array(answer(x, kernel, odd, *ends)[own]) for _, kernel, odd in kernels]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * int(own.sum()), batch.schema.types[0]), pa.array(t[own].astype(np.int32)), *cols], names=["id", "t", *names])

    kind = dict(series.dtypes)["id"]
    return pieces(series, halo, size).mapInArrow(run, f"id {kind}, t int, " + ", ".join(f"{n} double" for n in names))


def convolve_reflect(series: DataFrame, kernel: list[float], odd: bool = False, size: int = PIECE) -> DataFrame:
    """(id, t, y): correlation with the kernel, mirrored (even) or point-reflected (odd) ends. A series
    of one sample is a level: y = x times the kernel's sum, or 0 for odd reflection. Null x
    counts as 0. Series are cut into pieces of `size` samples, so their length has no bound."""
    return _filtered(series, [("y", kernel, odd)], size)


def smoothed(series: DataFrame, sigma: float = 1.5, size: int = PIECE) -> DataFrame:
    """(id, t, level, d1, d2); of a series of one sample the derivatives are 0. Null x counts as 0."""
    return _filtered(series, [(name, gaussian_kernel(sigma, k), k == 1) for k, name in enumerate(("level", "d1", "d2"))], size)


def inflections(smooth: DataFrame, floor: float) -> DataFrame:
    """(id, t) where d2 changes sign and |d1| is above the floor."""
    w = Window.partitionBy("id").orderBy("t")
    flip = F.lag(F.signum("d2")).over(w) * F.signum("d2") < 0
    return smooth.withColumn("_f", flip & (F.abs("d1") > floor)).where("_f").select("id", "t")


def momentum(smooth: DataFrame) -> DataFrame:
    """(id, momentum): the last d1 over its deviation, in [-1, 1]."""
    m = F.coalesce(F.try_divide(F.max_by("d1", "t"), F.stddev_pop("d1")), F.lit(0.0))
    return smooth.groupBy("id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m)).alias("momentum"))


def dft(series: DataFrame) -> DataFrame:
    """(id, k, period, power) for k = 1..n/2, the mean removed; one fast transform for a series, which is
    one array for that. Null x counts as 0."""
    ship(series.sparkSession)
    arrays = series.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")))).alias("s")).select("id", F.col("s.x").alias("v"))

    def run(batches):
        for batch in batches:
            for key, row in zip(batch.column(0), batch.column(1), strict=True):
                x = row.values.to_numpy()
                n = len(x)
                f = np.fft.rfft(x - x.mean())[1 : n // 2 + 1]
                k = np.arange(1, len(f) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(k), batch.schema.types[0]), pa.array(k), pa.array(n / k), pa.array(f.real**2 + f.imag**2)], names=["id", "k", "period", "power"])

    return arrays.mapInArrow(run, f"id {dict(series.dtypes)['id']}, k long, period double, power double")


def dominant_rhythm(series: DataFrame) -> DataFrame:
    """(id, period, power, ratio) of spectra of four bins or more whose peak is twice the next."""
    w = Window.partitionBy("id").orderBy(F.col("power").desc(), "k")
    top = dft(series).withColumn("r", F.row_number().over(w)).withColumn("bins", F.count("*").over(Window.partitionBy("id")))
    top = top.withColumn("next", F.lead("power").over(w)).where("r = 1 and bins >= 4 and power > 0")
    ratio = F.when(F.col("next") > 0, F.col("power") / F.col("next")).otherwise(F.lit(float("inf")))
    return top.withColumn("ratio", ratio).where("ratio >= 2").select("id", "period", "power", "ratio")


def weekly(daily: DataFrame) -> DataFrame:
    """(id, week, x): sums of sevens from t = 0, the last one partial."""
    return daily.groupBy("id", F.floor(F.col("t") / 7).cast("long").alias("week")).agg(F.sum("x").alias("x"))
