"""Fields of heights at corners (field, r, c, h), rivers down them, and snow on faces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, ship

#: Rows of a year's field; the least peak of a river, its step, its most steps, the
#: slope at which it stops, the distance at which it joins another.
ROWS = 7
RIVERS = {"min_peak": 0.0, "step": 0.25, "max_steps": 80, "min_slope": 1e-3, "join": 0.5}


def corner_heights(cells: DataFrame, cols: int, rows: int = ROWS, height: Column | str = "h") -> DataFrame:
    """(field, r, c, h): every corner's height is a quarter of the sum over its four cells, those
    absent or outside being 0. cells: (field, row, col, ...); `height` is a column or an
    expression over the cells."""
    h = F.coalesce(F.expr(height) if isinstance(height, str) else height, F.lit(0.0))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("d")
    inside = cells.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    sums = inside.select("field", "row", "col", h.alias("_h"), near).groupBy("field", (F.col("row") + F.col("d.i")).cast("int").alias("r"), (F.col("col") + F.col("d.j")).cast("int").alias("c")).agg((F.sum("_h") / 4).alias("_s"))
    grid = cells.select("field").distinct().select("field", F.explode(F.sequence(F.lit(0), F.lit(rows))).alias("r")).select("field", "r", F.explode(F.sequence(F.lit(0), F.lit(cols))).alias("c"))
    return grid.join(sums, ["field", "r", "c"], "left").select("field", "r", "c", F.coalesce("_s", F.lit(0.0)).alias("h"))


def _patches(corners: DataFrame, points: DataFrame) -> DataFrame:
    """points (field, x, y, ...) with their place u, v in a cell and its corners h00, h10, h01, h11."""
    size = corners.groupBy("field").agg(F.max("r").alias("_rows"), F.max("c").alias("_cols"))
    at = points.join(size, "field")
    x, y = (F.least(F.col(m), F.greatest(F.lit(0.0), F.col(c))) for c, m in (("x", "_cols"), ("y", "_rows")))
    at = at.withColumns({"_c": F.least(F.col("_cols") - 1, F.floor(x)).cast("int"), "_r": F.least(F.col("_rows") - 1, F.floor(y)).cast("int")})
    at = at.withColumns({"u": x - F.col("_c"), "v": y - F.col("_r")})
    for i in (0, 1):
        for j in (0, 1):
            one = corners.select(F.col("field").alias("_f"), (F.col("r") - i).alias("_ri"), (F.col("c") - j).alias("_cj"), F.col("h").alias(f"h{j}{i}"))
            at = at.join(one, (F.col("field") == F.col("_f")) & (F.col("_r") == F.col("_ri")) & (F.col("_c") == F.col("_cj"))).drop("_f", "_ri", "_cj")
    return at


def _mix(a: str, b: str, t: str) -> Column:
    return F.col(a) * (1 - F.col(t)) + F.col(b) * F.col(t)


def sample(corners: DataFrame, points: DataFrame) -> DataFrame:
    """points with h, the height between the corners of their cell; places outside count as on the
    edge."""
    h = (F.col("h00") * (1 - F.col("u")) + F.col("h10") * F.col("u")) * (1 - F.col("v")) + (F.col("h01") * (1 - F.col("u")) + F.col("h11") * F.col("u")) * F.col("v")
    return _patches(corners, points).select(*[F.col(c) for c in points.columns if c != "h"], h.alias("h"))


def gradient(corners: DataFrame, points: DataFrame) -> DataFrame:
    """points with gx, gy, the slope of their cell there."""
    gx = (F.col("h10") - F.col("h00")) * (1 - F.col("v")) + (F.col("h11") - F.col("h01")) * F.col("v")
    gy = (F.col("h01") - F.col("h00")) * (1 - F.col("u")) + (F.col("h11") - F.col("h10")) * F.col("u")
    return _patches(corners, points).select(*[F.col(c) for c in points.columns if c not in ("gx", "gy")], gx.alias("gx"), gy.alias("gy"))


def peaks(corners: DataFrame, min_peak: float = 0.0) -> DataFrame:
    """(field, r, c, h): cells whose middle is no lower than the middles of the cells around."""
    quad = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("d")
    size = corners.groupBy("field").agg(F.max("r").alias("_rows"), F.max("c").alias("_cols"))
    mid = corners.select("field", "r", "c", "h", quad).groupBy("field", (F.col("r") - F.col("d.i")).alias("r"), (F.col("c") - F.col("d.j")).alias("c")).agg((F.sum("h") / 4).alias("h"))
    mid = mid.join(size, "field").where("r >= 0 and c >= 0 and r < _rows and c < _cols").select("field", "r", "c", "h")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])).alias("d")
    top = mid.select("field", "h", around, "r", "c").groupBy("field", (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).agg(F.max("h").alias("_near"))
    return mid.join(top, ["field", "r", "c"], "left").where((F.col("h") >= min_peak) & (F.col("_near").isNull() | (F.col("_near") <= F.col("h")))).select("field", "r", "c", "h")


class Ground:
    """A field in one task, for traces."""

    def __init__(self, h: np.ndarray):
        self.h, self.rows, self.cols = h, h.shape[0] - 1, h.shape[1] - 1

    def _patch(self, x: float, y: float):
        x, y = min(self.cols, max(0.0, x)), min(self.rows, max(0.0, y))
        c, r = min(self.cols - 1, math.floor(x)), min(self.rows - 1, math.floor(y))
        return x - c, y - r, self.h[r : r + 2, c : c + 2]

    def height(self, x: float, y: float) -> float:
        u, v, p = self._patch(x, y)
        return float(np.array([1 - v, v]) @ p @ np.array([1 - u, u]))

    def slope(self, x: float, y: float) -> tuple[float, float]:
        u, v, p = self._patch(x, y)
        return float(np.array([1 - v, v]) @ (p[:, 1] - p[:, 0])), float((p[1] - p[0]) @ np.array([1 - u, u]))


def trace(ground: Ground, springs, how: dict) -> list[np.ndarray]:
    """Rivers (points x, y, h) from springs (x, y, h), the tallest first: each step goes down the
    slope found half a step on; it ends on flat ground, beyond the edge, or at an earlier river."""
    rivers: list[np.ndarray] = []
    met = np.zeros((0, 2))
    for x, y, h in springs:
        points = [(x, y, h)]
        for _ in range(how["max_steps"]):
            gx, gy = ground.slope(x, y)
            g = math.hypot(gx, gy)
            if g < how["min_slope"]:
                break
            gx, gy = ground.slope(x - how["step"] / 2 * gx / g, y - how["step"] / 2 * gy / g)
            g = math.hypot(gx, gy)
            if g == 0:
                break
            x, y = x - how["step"] * gx / g, y - how["step"] * gy / g
            if not (0 <= x <= ground.cols and 0 <= y <= ground.rows):
                break
            points.append((x, y, ground.height(x, y)))
            if len(met) and (((met - (x, y)) ** 2).sum(1) <= how["join"] ** 2).any():
                break
        rivers.append(np.array(points))
        met = np.concatenate([met, rivers[-1][:, :2]])
    return rivers


def trace_rivers(corners: DataFrame, **how) -> DataFrame:
    """(field, river, pos, x, y, h): rivers from all peaks, numbered from the tallest (of equals, by
    row and column). Later rivers end at earlier ones, so a field is one task."""
    ship(corners.sparkSession)
    how = {**RIVERS, **how}
    kind = dict(corners.dtypes)["field"]

    def run(key: tuple, field: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((int(field["r"].max()) + 1, int(field["c"].max()) + 1))
        h[field["r"], field["c"]] = field["h"]
        top = top.assign(order=-top["h"].round(12)).sort_values(["order", "r", "c"])
        rivers = trace(Ground(h), zip(top["c"] + 0.5, top["r"] + 0.5, top["h"], strict=True), how)
        parts = [pd.DataFrame({"field": key[0], "river": k, "pos": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "h": p[:, 2]}) for k, p in enumerate(rivers)]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("field", "river", "pos", "x", "y", "h")})

    top = materialise(peaks(corners, how["min_peak"]), "peaks")
    return corners.groupBy("field").cogroup(top.groupBy("field")).applyInPandas(run, f"field {kind}, river long, pos long, x double, y double, h double")


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def clip_z(polygon: Column, level: Column) -> Column:
    """The part of a polygon (array of structs x, y, z) at or above a level, as an array; new points
    lie exactly on the level."""
    n = F.size(polygon)

    def corner(p, i):
        q = F.get(polygon, (i + 1) % n)
        k = (level - p["z"]) / (q["z"] - p["z"])
        own = F.when(p["z"] >= level, F.array(_point(p["x"], p["y"], p["z"])))
        cross = F.when((p["z"] >= level) != (q["z"] >= level), F.array(_point(p["x"] + (q["x"] - p["x"]) * k, p["y"] + (q["y"] - p["y"]) * k, level)))
        none = F.array().cast("array<struct<x:double,y:double,z:double>>")
        return F.concat(F.coalesce(own, none), F.coalesce(cross, none))

    return F.flatten(F.transform(polygon, corner))


def serrate(cap: Column, level: Column, amp: Column) -> Column:
    """A clipped polygon with one tooth below the level between its last and first point, if both
    lie exactly on it; its depth is a hash of the place."""
    a, b = F.element_at(cap, -1), F.element_at(cap, 1)
    mx, my = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2
    # Fixed values of the hash.
    h = F.sin(mx * 12.9898 + my * 78.233) * 43758.5453
    tooth = F.array(_point(mx, my, level - amp * (0.7 + 0.6 * (h - F.floor(h)))))
    whole = (F.size(cap) > 0) & (F.try_element_at(cap, F.lit(1))["z"] == level) & (F.try_element_at(cap, F.lit(-1))["z"] == level)
    return F.when(whole, F.concat(cap, tooth)).otherwise(cap)
