"""Closed forms of moon, orbits, camera and light as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
# The mean synodic month in days, the epoch of a new moon in unix ms, ms of a day.
SYNODIC = 29.53058867
NEW_MOON_MS = 947182440000
DAY_MS = 86400000
PHASES = ("new moon", "waxing crescent", "first quarter", "waxing gibbous", "full moon", "waning gibbous", "last quarter", "waning crescent")
# The fitted third law (smallest and largest axis, ms per a^1.5, largest eccentricity).
A_MIN, A_MAX, K_MS, E_MAX = 0.261629, 1.0, 179627484.0, 0.2
# Time constants of the camera in ms, and its sway.
CAMERA = {"follow_tau": 67.1, "zoom_tau": 27.9, "homing_tau": 84.0, "fling_tau": 269.0, "sway_zeta": 0.32, "sway_omega": 12.0}
# Mean phase polynomial (JDE, days) and arguments (degrees) in k and T = k / 1236.85.
JDE = (2451550.09766, 29.530588861, 0.00015437, -0.000000150, 0.00000000073)
SUN = (2.5534, 29.10535670, -0.0000014, -0.00000011, 0.0)
MOON = (201.5643, 385.81693528, 0.0107582, 0.00001238, -0.000000058)
LATITUDE = (160.7108, 390.67050284, -0.0016118, -0.00000227, 0.000000011)
NODE = (124.7746, -1.56375588, 0.0020672, 0.00000215, 0.0)
# Periodic terms (days, power of E, multiples of sun, moon, latitude, node).
TERMS = (
    (-0.40720, 0, 0, 1, 0, 0), (0.17241, 1, 1, 0, 0, 0), (0.01608, 0, 0, 2, 0, 0), (0.01039, 0, 0, 0, 2, 0),
    (0.00739, 1, -1, 1, 0, 0), (-0.00514, 1, 1, 1, 0, 0), (0.00208, 2, 2, 0, 0, 0), (-0.00111, 0, 0, 1, -2, 0),
    (-0.00057, 0, 0, 1, 2, 0), (0.00056, 1, 1, 2, 0, 0), (-0.00042, 0, 0, 3, 0, 0), (0.00042, 1, 1, 0, 2, 0),
    (0.00038, 1, 1, 0, -2, 0), (-0.00024, 1, -1, 2, 0, 0), (-0.00017, 0, 0, 0, 0, 1), (-0.00007, 0, 2, 1, 0, 0),
)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def wrap(x: Column, m: float) -> Column:
    """x modulo m in [0, m)."""
    return F.pmod(x, F.lit(float(m)))


def mean_age(ms: Column) -> Column:
    """Days since the last mean new moon."""
    return wrap((ms - F.lit(NEW_MOON_MS)) / DAY_MS, SYNODIC)


def _poly(c, k: Column, t: Column) -> Column:
    return F.lit(c[0]) + F.lit(c[1]) * k + F.lit(c[2]) * t * t + F.lit(c[3]) * t * t * t + F.lit(c[4]) * t * t * t * t


def new_moon_ms(k: Column) -> Column:
    """Unix ms of the k-th true new moon since 2000."""
    t = k / 1236.85
    e = F.lit(1.0) - 0.002516 * t - 0.0000074 * t * t
    args = [_poly(c, k, t) * (math.pi / 180) for c in (SUN, MOON, LATITUDE, NODE)]
    jde = _poly(JDE, k, t)
    for size, power, *times in TERMS:
        angle = sum((F.lit(float(m)) * a for m, a in zip(times, args, strict=True) if m), F.lit(0.0))
        weight = F.lit(size) * (e if power == 1 else e * e if power == 2 else F.lit(1.0))
        jde = jde + weight * F.sin(angle)
    return (jde - 2440587.5) * DAY_MS


def phase_age(ms: Column) -> Column:
    """Days since the true new moon before: the latest of three neighbouring candidates."""
    k = F.floor((ms / DAY_MS + 2440587.5 - 2451545.0) / 365.25 * 12.3685 + 0.5).cast("double")
    moons = F.transform(F.array(k - 2, k - 1, k, k + 1), new_moon_ms)
    return (ms - F.array_max(F.filter(moons, lambda m: m <= ms))) / DAY_MS


def phase_name(age: Column) -> Column:
    names = F.array(*[F.lit(p) for p in PHASES])
    return F.get(names, F.pmod(F.floor(age / SYNODIC * 8 + 0.5), F.lit(8)).cast("int"))


def illumination(age: Column) -> Column:
    """struct(k, full): cosine of the phase, and the wash-out near full moon."""
    k = F.cos(TAU * age / SYNODIC)
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((1 - k) / 2 - 0.93) / 0.06))
    return F.struct(k.alias("k"), (x * x * (3 - 2 * x)).alias("full"))


def elements(activity: Column, distance: Column, lean: Column, phase: Column) -> Column:
    """struct(a, e, T, M0, tilt) of an orbit."""
    a = F.lit(A_MIN) + F.lit(A_MAX - A_MIN) * (1 - activity)
    return F.struct(a.alias("a"), (F.lit(E_MAX) * distance).alias("e"), (F.lit(K_MS) * F.pow(a, F.lit(1.5))).alias("T"), (phase * TAU).alias("M0"), (F.lit(0.04) * lean).alias("tilt"))


def solve_kepler(m: Column, e: Column) -> Column:
    """Eccentric anomaly by eight Newton steps; an error where the residual is 1e-12 or more."""
    root = F.aggregate(F.sequence(F.lit(1), F.lit(8)), m.cast("double"), lambda x, _: x - (x - e * F.sin(x) - m) / (1 - e * F.cos(x)))
    return F.when(F.abs(root - e * F.sin(root) - m) < 1e-12, root).otherwise(F.raise_error("Kepler's equation did not converge").cast("double"))


def true_anomaly(x: Column, e: Column) -> Column:
    return 2 * F.atan2(F.sqrt(1 + e) * F.sin(x / 2), F.sqrt(1 - e) * F.cos(x / 2))


def orbit_frac(el: Column, ms: Column) -> Column:
    """True anomaly as a fraction of a turn in [0, 1)."""
    m = wrap(TAU * (ms / el["T"]) + el["M0"], TAU)
    return wrap(true_anomaly(solve_kepler(m, el["e"]), el["e"]) / TAU, 1.0)


def time_to_frac(el: Column, ms: Column, f: Column) -> Column:
    """ms in (0, T] until the orbit is at fraction f."""
    nu = TAU * f
    x = 2 * F.atan2(F.sqrt(1 - el["e"]) * F.sin(nu / 2), F.sqrt(1 + el["e"]) * F.cos(nu / 2))
    gap = wrap(wrap(x - el["e"] * F.sin(x), TAU) - wrap(TAU * (ms / el["T"]) + el["M0"], TAU), TAU)
    return F.when(gap == 0, el["T"]).otherwise(gap / TAU * el["T"])


def arc_pos(f: Column, alt: Column, tilt: Column, w: float, h: float) -> Column:
    """struct(x, y, up): the place over the horizon at orbit fraction f."""
    up = F.when(f < 0.5, F.sin(f * 2 * math.pi)).otherwise(F.lit(0.0))
    return F.struct((_c(w) * (0.05 + 0.9 * f * 2)).alias("x"), (_c(h) * 0.72 - up * alt * _c(h) + (f * 2 - 0.5) * _c(h) * tilt).alias("y"), up.alias("up"))


def kepler_state(el: Column, tau: Column, k: float = K_MS) -> Column:
    """struct(x, y, vx, vy) in the orbit's plane, time in units of k."""
    period = el["T"] / k
    x = solve_kepler(wrap(TAU * tau / period + el["M0"], TAU), el["e"])
    q, rate = F.sqrt(1 - el["e"] * el["e"]), (TAU / period) / (1 - el["e"] * F.cos(x))
    return F.struct((el["a"] * (F.cos(x) - el["e"])).alias("x"), (el["a"] * q * F.sin(x)).alias("y"), (-el["a"] * F.sin(x) * rate).alias("vx"), (el["a"] * q * F.cos(x) * rate).alias("vy"))


def follow(x: Column, target: Column, tau: float, dt: Column) -> Column:
    return target + (x - target) * F.exp(-dt / tau)


def step_damped(x: Column, v: Column, target: Column, zeta: float, omega: float, dt: Column) -> Column:
    """struct(x, v) after dt ms, by steps of 1/120 s at most, velocity first."""
    n = F.ceil(dt / 1000 * 120).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(s, i):
        h = F.least(F.lit(1 / 120), dt / 1000 - (i - 1) / 120)
        speed = s["v"] + (-omega * omega * (s["x"] - target) - 2 * zeta * omega * s["v"]) * h
        return F.struct((s["x"] + speed * h).alias("x"), speed.alias("v"))

    return F.aggregate(steps, F.struct(x.cast("double").alias("x"), v.cast("double").alias("v")), step)


def fence(z: Column, x0: Column, x1: Column, y0: Column, y1: Column, w: float, h: float) -> Column:
    """struct(min_x, max_x, min_y, max_y) where the camera may rest."""
    empty = x0 > x1
    x0, x1, y0, y1 = (F.when(empty, F.lit(float(d))).otherwise(c) for c, d in ((x0, 0), (x1, w), (y0, 0), (y1, h)))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z - 1) / 1.5))

    def side(lo, hi, size, drift, edge, far):
        middle = (lo + hi) / 2 * (1 - z)
        return (middle + size * drift) * (1 - t) + (size * edge - far * z) * t

    return F.struct(side(x0, x1, w, -0.08, 0.32, x1).alias("min_x"), side(x0, x1, w, 0.08, 0.68, x0).alias("max_x"), side(y0, y1, h, -0.06, 0.3, y1).alias("min_y"), side(y0, y1, h, 0.06, 0.55, y0).alias("max_y"))


def face_normal(a: Column, b: Column, c: Column) -> Column:
    """struct(x, y, z): unit normal of a triangle of structs x, y, z, upwards; (0, 0, 1) if degenerate."""
    u, v = ({k: p[k] - a[k] for k in "xyz"} for p in (b, c))
    n = [u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    turn = F.when(n[2] < 0, -1.0).otherwise(1.0)
    return F.struct(*[F.when(size > 0, x * turn / size).otherwise(F.lit(d)).alias(k) for x, k, d in zip(n, "xyz", (0.0, 0.0, 1.0), strict=True)])


def lambert(n: Column, light: Column) -> Column:
    return F.lit(0.6) + 0.4 * F.greatest(F.lit(0.0), n["x"] * light["x"] + n["y"] * light["y"] + n["z"] * light["z"])


def bessel_i0e(x: Column) -> Column:
    """exp(-|x|) I0(x): power series to 30, asymptotic beyond."""
    a = F.abs(x)
    q = a * a / 4
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def term(s, k):
        t = s["t"] * q / (k * k)
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), zero, term)["s"] * F.exp(-a)
    r = 1 / (8 * a)
    return F.when(a <= 30, series).otherwise((1 + r + 4.5 * r * r + 37.5 * r * r * r) / F.sqrt(TAU * a))


def von_mises_density(theta: Column, mu: Column, kappa: Column) -> Column:
    return F.exp(kappa * (F.cos(theta - mu) - 1)) / (TAU * bessel_i0e(kappa))


def str_hash(s: Column) -> Column:
    """h = 31 h + unit, modulo 2^32, over the text's UTF-16 units."""
    units = F.hex(F.encode(s, "UTF-16BE"))
    places = F.when(F.length(units) > 0, F.sequence(F.lit(1), (F.length(units) - 3).cast("int"), F.lit(4))).otherwise(F.array().cast("array<int>"))
    code = lambda i: F.conv(F.substring(units, i, F.lit(4)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, i: F.pmod(h * 31 + code(i), F.lit(4294967296)))
