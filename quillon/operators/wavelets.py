"""Wavelet power of series (id, t, x), dense in t from 0, and entropy by week."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import stats
from quillon.session import ship

#: The wavelet's frequency, its support and the reach of its edge in scales.
OMEGA, SUPPORT, EDGE = 6.0, 4, math.sqrt(2)


def morlet_period(scale: Column | float, omega: float = OMEGA):
    """The period that a wavelet of a scale answers to."""
    return scale * (4 * math.pi / (omega + math.sqrt(2 + omega * omega)))


def morlet_scales(n: int, count: int = 24) -> list[float]:
    """Scales evenly spaced in their logs, of periods from 2 to n / 2."""
    low, high = 2 / morlet_period(1.0), n / 2 / morlet_period(1.0)
    return [low * (high / low) ** (k / (count - 1) if count > 1 else 0) for k in range(count)]


def _folded(x: np.ndarray, h: int) -> np.ndarray:
    """x mirrored at its ends, h samples to both sides."""
    n = len(x)
    at = np.abs(np.arange(-h, n + h)) % max(1, 2 * (n - 1))
    return x[np.where(at < n, at, 2 * (n - 1) - at)]


def power_of(x: np.ndarray, scales, omega: float = OMEGA) -> tuple[np.ndarray, np.ndarray]:
    """Power (scales, n) of a series over its variance (0 without any), and the largest scale that
    both ends leave room for at each sample."""
    x, n = np.asarray(x, float), len(x)
    reach = np.minimum(np.arange(n), n - 1 - np.arange(n))
    s = np.asarray(scales, float)
    room = np.where(EDGE * s[:, None] <= reach[None, :], s[:, None], 0.0).max(0) if len(s) else np.zeros(n)
    out = np.zeros((len(s), n))
    centred = x - x.mean() if n else x
    variance = (centred**2).mean() if n else 0.0
    if variance > 0:
        for k, scale in enumerate(s):
            h = math.ceil(SUPPORT * scale)
            u = np.arange(-h, h + 1) / scale
            wave = np.exp(-u * u / 2 + 1j * omega * u) / math.sqrt(scale * math.sqrt(math.pi))
            padded = _folded(centred, h)
            size = 1 << (len(padded) + len(wave) - 1).bit_length()
            full = np.fft.ifft(np.fft.fft(padded, size) * np.fft.fft(wave, size))
            out[k] = np.abs(full[2 * h : 2 * h + n]) ** 2 / variance
    return out, room


def scalogram(series: DataFrame, scales: list[float] | None = None, count: int = 24, omega: float = OMEGA) -> DataFrame:
    """(id, k, t, scale, power, coi): one task for a series, by fast transforms; without `scales`
    each series has its own `morlet_scales`."""
    ship(series.sparkSession)
    kind = dict(series.dtypes)["id"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["x"].to_numpy()
        own = scales if scales is not None else morlet_scales(len(x), count)
        power, room = power_of(x, own, omega)
        n = len(x)
        return pd.DataFrame({"id": key[0], "k": np.repeat(np.arange(len(own)), n), "t": np.tile(np.arange(n), len(own)), "scale": np.repeat(own, n), "power": power.ravel(), "coi": np.tile(room, len(own))})

    return series.groupBy("id").applyInPandas(run, f"id {kind}, k long, t long, scale double, power double, coi double")


def ridge(waves: DataFrame) -> DataFrame:
    """(id, t, period, power): the strongest scale within `coi` at each sample, the first of equals,
    moved to the top of the parabola through it and its neighbours; 0 where it is the largest
    scale within, where there is none or no power."""
    at = Window.partitionBy("id", "t").orderBy("k")
    near = waves.select("*", *[f("power").over(at).alias(f"_p{n}") for f, n in ((F.lag, 0), (F.lead, 2))], *[f("scale").over(at).alias(f"_s{n}") for f, n in ((F.lag, 0), (F.lead, 2))])
    inside = F.when(F.col("scale") <= F.col("coi"), F.struct("power", (-F.col("k")).alias("k"), "scale", "_p0", "_p2", "_s0", "_s2"))
    best = near.groupBy("id", "t").agg(F.max(inside).alias("b"), F.max(F.when(F.col("scale") <= F.col("coi"), F.col("k"))).alias("edge"))
    bend = F.col("b._p0") - 2 * F.col("b.power") + F.col("b._p2")
    turn = F.when(F.col("b._p0").isNotNull() & (bend != 0), F.pow(F.col("b._s2") / F.col("b._s0"), (F.col("b._p0") - F.col("b._p2")) / (4 * bend))).otherwise(1.0)
    found = F.col("b").isNotNull() & (F.col("b.power") > 0) & (-F.col("b.k") != F.col("edge"))
    zero = F.lit(0.0)
    return best.select("id", "t", F.when(found, morlet_period(F.col("b.scale") * turn)).otherwise(zero).alias("period"), F.when(found, F.col("b.power")).otherwise(zero).alias("power"))


def weekly_entropy(weights: DataFrame, weeks: DataFrame) -> DataFrame:
    """(week, bits) for every week of `weeks`: entropy of weights (week, lang, weight) in bits, 0
    without any."""
    bits = stats.entropy_bits(weights, "week", "weight")
    return weeks.select("week").join(bits, "week", "left").select("week", F.coalesce("bits", F.lit(0.0)).alias("bits"))
