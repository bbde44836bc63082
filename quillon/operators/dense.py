"""Dense matrices (key, row, col, val), one in a task each, and the space of languages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, ship

#: Most columns whose cross products the driver decomposes (8 MB).
MOST_LANGUAGES = 1024


def _matrix(pdf: pd.DataFrame, square: bool = False) -> np.ndarray:
    rows, cols = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
    n = max(rows, cols)
    a = np.zeros((n, n) if square else (rows, cols))
    a[pdf["row"], pdf["col"]] = pdf["val"]
    return a


def _cells(key, a: np.ndarray, names=("row", "col", "val")) -> pd.DataFrame:
    i, j = np.indices(a.shape).reshape(2, -1)
    return pd.DataFrame({"key": key, names[0]: i, names[1]: j, names[2]: a.ravel()})


def _by_key(matrix: DataFrame, solve, schema: str) -> DataFrame:
    ship(matrix.sparkSession)
    kind = dict(matrix.dtypes)["key"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return solve(key[0], pdf)

    return matrix.groupBy("key").applyInPandas(run, f"key {kind}, {schema}")


def cholesky(matrix: DataFrame) -> DataFrame:
    """(key, row, col, val): lower factors; an error for a matrix that is not positive definite.
    Absent entries are 0; matrices are symmetric."""

    def solve(key, pdf):
        try:
            return _cells(key, np.linalg.cholesky(_matrix(pdf, True)))
        except np.linalg.LinAlgError as e:
            raise ValueError(f"matrix {key} is not positive definite") from e

    return _by_key(matrix, solve, "row long, col long, val double")


def solve_cholesky(factor: DataFrame, right: DataFrame) -> DataFrame:
    """(key, row, val): x of L L' x = b, from factors and right sides (key, row, val)."""
    ship(factor.sparkSession)
    kind = dict(factor.dtypes)["key"]

    def solve(key: tuple, low: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(low):
            return pd.DataFrame({"key": [], "row": [], "val": []})
        a = _matrix(low, True)
        v = np.zeros(len(a))
        v[b["row"]] = b["val"]
        return pd.DataFrame({"key": key[0], "row": np.arange(len(a)), "val": np.linalg.solve(a.T, np.linalg.solve(a, v))})

    return factor.groupBy("key").cogroup(right.groupBy("key")).applyInPandas(solve, f"key {kind}, row long, val double")


def symmetric_eigen(matrix: DataFrame) -> DataFrame:
    """(key, k, value, row, x): eigenvalues ascending with unit vectors, the entry largest in size
    positive (the first of equals)."""

    def solve(key, pdf):
        values, vectors = np.linalg.eigh(_matrix(pdf, True))
        top = np.abs(np.round(vectors, 12)).argmax(0)
        vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
        out = _cells(key, vectors.T, ("k", "row", "x"))
        out.insert(2, "value", values[out["k"]])
        return out

    return _by_key(matrix, solve, "k long, value double, row long, x double")


def orthogonalise(vectors: DataFrame, basis: DataFrame) -> DataFrame:
    """(key, row, val): vectors (key, row, val) without their parts along unit vectors of the basis
    (key, k, row, val), taken away one after the other in order of k. One pass over the basis:
    it must be orthonormal."""
    along = vectors.join(basis.select("key", "k", "row", F.col("val").alias("_b")), ["key", "row"]).groupBy("key", "k").agg(F.sum(F.col("val") * F.col("_b")).alias("_d"))
    part = basis.join(along, ["key", "k"]).groupBy("key", "row").agg(F.sum(F.col("val") * F.col("_d")).alias("_p"))
    return vectors.join(part, ["key", "row"], "left").select("key", "row", (F.col("val") - F.coalesce("_p", F.lit(0.0))).alias("val"))


def svd(matrix: DataFrame) -> DataFrame:
    """(key, k, s, side, at, x): singular values descending, with vectors of side 'u' (rows) and 'v'
    (columns). Of a value within rounding of 0 the vectors of one side, the longer, are 0."""

    def solve(key, pdf):
        a = _matrix(pdf)
        short = a.shape[1] <= a.shape[0]
        values, vectors = np.linalg.eigh(a.T @ a if short else a @ a.T)
        s, own = np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]
        other = np.zeros((max(a.shape), len(s)))
        big = s > np.sqrt(np.abs(values).max() or 1.0) * 1e-9
        other[:, big] = (a if short else a.T) @ own[:, big] / s[big]
        parts = []
        for side, x in zip("vu" if short else "uv", (own, other), strict=True):
            p = _cells(key, x.T, ("k", "at", "x"))
            p.insert(2, "s", s[p["k"]])
            p.insert(3, "side", side)
            parts.append(p)
        return pd.concat(parts)[["key", "k", "s", "side", "at", "x"]]

    return _by_key(matrix, solve, "k long, s double, side string, at long, x double")


def _times(share: DataFrame, mean: DataFrame, w: DataFrame, n: int, r: int) -> DataFrame:
    """(lang, w0, ..): cross products of the centred columns times w, through the repos."""
    cols = [f"w{k}" for k in range(r)]
    c = mean.join(w, "lang").agg(*[F.sum(F.col("m") * F.col(x)).alias(f"c{x}") for x in cols])
    y = share.join(w, "lang").groupBy("repo").agg(*[F.sum(F.col("a") * F.col(x)).alias(x) for x in cols])
    y = materialise(y.join(F.broadcast(c)).select("repo", *[(F.col(x) - F.col(f"c{x}")).alias(x) for x in cols]), "languages-repos")
    one = y.agg(*[F.sum(x).alias(f"s{x}") for x in cols])
    z = share.join(y, "repo").groupBy("lang").agg(*[F.sum(F.col("a") * F.col(x)).alias(x) for x in cols])
    return materialise(z.join(mean, "lang").join(F.broadcast(one)).select("lang", *[(F.col(x) - F.col("m") * F.col(f"s{x}")).alias(x) for x in cols]), "languages-step")


def _mixed(w: DataFrame, by: np.ndarray) -> DataFrame:
    """w times a small matrix."""
    return w.select("lang", *[sum((F.col(f"w{j}") * float(by[j, k]) for j in range(len(by))), F.lit(0.0)).alias(f"w{k}") for k in range(by.shape[1])])


def _inner(v: DataFrame, w: DataFrame, r: int) -> np.ndarray:
    """Inner products of the columns of two tables, r squared numbers."""
    both = v.join(w.select("lang", *[F.col(f"w{k}").alias(f"u{k}") for k in range(r)]), "lang")
    row = both.agg(*[F.sum(F.col(f"w{i}") * F.col(f"u{j}")) for i in range(r) for j in range(r)]).first()
    return np.array([x or 0.0 for x in row]).reshape(r, r)


def _iterated(share: DataFrame, mean: DataFrame, n: int, r: int = 6, steps: int = 100) -> DataFrame:
    """(lang, w0, w1): the two strongest directions by iteration of a block of `r`, made orthonormal
    by its own inner products in each step; only r squared numbers reach the driver."""
    draw = lambda k: (F.xxhash64("lang", F.lit(k)) / F.lit(2.0**63)).alias(f"w{k}")
    w, old = materialise(mean.select("lang", *[draw(k) for k in range(r)]), "languages-start"), None
    for _ in range(steps):
        values, vectors = np.linalg.eigh(_inner(w, w, r))
        good = values > values.max() * 1e-13
        w = materialise(_mixed(w, vectors[:, good] / np.sqrt(values[good])), "languages-unit")
        r = int(good.sum())
        z = _times(share, mean, w, n, r)
        values, vectors = np.linalg.eigh(_inner(w, z, r))
        w = _mixed(z, vectors[:, ::-1])
        done = old is not None and len(old) == len(values) and np.abs(values - old).max() <= 1e-14 * np.abs(values).max()
        if done:
            break
        old = values
    # The last product is that of the directions, in order, times their strengths.
    w = materialise(w, "languages-last")
    size = np.sqrt(np.maximum(np.diag(_inner(w, w, r)), 1e-300))
    return w.select("lang", *[(F.col(f"w{k}") / float(size[k]) if k < r else F.lit(0.0)).alias(f"w{k}") for k in range(2)])


def _solved(share: DataFrame, mean: DataFrame, n: int) -> DataFrame:
    """(lang, w0, w1): the two strongest directions from all cross products, by one small matrix."""
    spark = share.sparkSession
    table = mean.toArrow()
    names = sorted(table["lang"].to_pylist())
    at = {x: k for k, x in enumerate(names)}
    m = np.zeros(len(names))
    m[[at[x] for x in table["lang"].to_pylist()]] = table["m"].to_numpy()
    gram = -n * np.outer(m, m)
    one, two = share.select("repo", F.col("lang").alias("l"), F.col("a").alias("x")), share.select("repo", F.col("lang").alias("k"), F.col("a").alias("y"))
    sums = one.join(two, "repo").where("l <= k").groupBy("l", "k").agg(F.sum(F.col("x") * F.col("y")).alias("s")).toArrow()
    i, j = ([at[x] for x in sums[c].to_pylist()] for c in "lk")
    part = np.zeros_like(gram)
    part[i, j] = sums["s"].to_numpy()
    gram += part + np.triu(part, 1).T + np.tril(part, -1).T
    _, vectors = np.linalg.eigh(gram)
    loads = np.zeros((len(names), 2))
    k = min(2, len(names), n)
    loads[:, :k] = vectors[:, ::-1][:, :k]
    return spark.createDataFrame([(x, *map(float, loads[k])) for x, k in at.items()], "lang string, w0 double, w1 double")


def language_space(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (repo, pc1, pc2) and one row (neg, pos), the languages at the ends of the first
    direction, from sizes (repo, lang, bytes).

    Rows are shares of log(1 + bytes), columns centred. Up to `MOST_LANGUAGES` languages
    their cross products are one small matrix; more are iterated by joins. A direction's largest loading (the
    first language of equals) is positive. A repo without bytes stands where a row of zeros
    does. Without a second direction pc2 is 0. Rows without a repo or a language are left out.
    """
    spark = sizes.sparkSession
    sizes = sizes.where("repo is not null and lang is not null")
    logs = sizes.groupBy("repo", "lang").agg(F.log1p(F.greatest(F.lit(0.0), F.max(F.coalesce("bytes", F.lit(0)).cast("double")))).alias("v"))
    total = logs.groupBy("repo").agg(F.sum("v").alias("t"))
    share = materialise(logs.join(total, "repo").select("repo", "lang", F.coalesce(F.try_divide("v", "t"), F.lit(0.0)).alias("a")), "languages")
    n = share.select("repo").distinct().count()
    if not n:
        return share.select("repo", F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2")), spark.createDataFrame([], "neg string, pos string")
    mean = materialise(share.groupBy("lang").agg((F.sum("a") / n).alias("m")), "languages-means")
    small = mean.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    w = materialise(_solved(share, mean, n) if small else _iterated(share, mean, n), "languages-directions")
    # The sign of each direction: its largest loading, the first of equals within rounding.
    top = w.agg(*[F.min_by(F.col(f"w{k}"), F.struct(-F.round(F.abs(F.col(f"w{k}")), 12), F.col("lang"))).alias(f"t{k}") for k in range(2)])
    w = w.join(F.broadcast(top)).select("lang", *[(F.col(f"w{k}") * F.when(F.col(f"t{k}") < 0, -1.0).otherwise(1.0)).alias(f"w{k}") for k in range(2)])
    w = materialise(w, "languages-directions")
    shift = mean.join(w, "lang").agg(*[F.sum(F.col("m") * F.col(f"w{k}")).alias(f"s{k}") for k in range(2)])
    met = F.broadcast(w) if small else w
    xy = share.join(met, "lang").groupBy("repo").agg(*[F.sum(F.col("a") * F.col(f"w{k}")).alias(f"p{k}") for k in range(2)])
    xy = xy.join(F.broadcast(shift)).select("repo", *[((F.col(f"p{k}") - F.col(f"s{k}")) / float(n) ** 0.5).alias(f"pc{k + 1}") for k in range(2)])
    ends = w.agg(F.min_by("lang", F.struct(F.round("w0", 12), "lang")).alias("neg"), F.min_by("lang", F.struct(-F.round("w0", 12), F.col("lang"))).alias("pos"))
    return xy, ends
