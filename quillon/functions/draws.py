"""Uniform draws of a linear congruential generator, each computed by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator.
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 2**32


def lcg(seed: Column, k: Column) -> Column:
    """The k-th draw (from 1) in [0, 1): the state jumps by the powers of two in k, so any
    draw costs 32 steps and rows need no order. Null seed or k: null."""
    a, c, jumps = MULTIPLIER, INCREMENT, []
    for j in range(32):
        jumps.append(F.struct(F.lit(1 << j).alias("bit"), F.lit(a >> 16).alias("hi"), F.lit(a & 0xFFFF).alias("lo"), F.lit(c).cast("long").alias("c")))
        a, c = a * a % MODULUS, (a * c + c) % MODULUS

    def step(s, x):
        # The multiplier is split in two as the product would not fit 64 signed bits.
        upper = F.pmod(x["hi"] * s, F.lit(65536)) * 65536
        jumped = F.pmod(upper + x["lo"] * s + x["c"], F.lit(MODULUS))
        return F.when(k.cast("long").bitwiseAND(x["bit"].cast("long")) != 0, jumped).otherwise(s)

    return F.aggregate(F.array(*jumps), F.pmod(seed.cast("long"), F.lit(MODULUS)), step) / float(MODULUS)


def stream(seed: int, skip: int, n: int) -> list[float]:
    """Draws skip + 1 .. skip + n of the generator; the first ones are jumped over."""
    a, c, s, k = MULTIPLIER, INCREMENT, int(seed) % MODULUS, skip
    while k:
        if k & 1:
            s = (a * s + c) % MODULUS
        a, c, k = a * a % MODULUS, (a * c + c) % MODULUS, k >> 1
    out = []
    for _ in range(n):
        s = (MULTIPLIER * s + INCREMENT) % MODULUS
        out.append(s / MODULUS)
    return out
