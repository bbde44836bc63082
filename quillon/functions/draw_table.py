"""The generator's draws as a table function, to be joined laterally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.draws import stream
from quillon.session import ship

NAME = "quillon_draws"


class Draws:
    """Draws skip + 1 .. skip + n of the generator for a seed, as rows (k, draw); none if an argument
    is null or n is not positive. Each row jumps to its own first draw."""

    def eval(self, seed: int, skip: int, n: int):
        if seed is None or skip is None or n is None or n <= 0 or skip < 0:
            return
        yield from ((skip + k, u) for k, u in enumerate(stream(seed, skip, n), 1))


def register(spark: SparkSession, name: str = NAME) -> None:
    """Make the table function known to the session's SQL as `name`(seed, skip, n)."""
    ship(spark)
    spark.udtf.register(name, F.udtf(Draws, returnType="k: bigint, draw: double"))


def with_draws(df: DataFrame, seed: str, skip: str, n: str) -> DataFrame:
    """Rows of `df`, each with its draws as columns k and draw: a lateral join with the table
    function. `seed`, `skip` and `n` are SQL expressions over columns of `df`."""
    spark = df.sparkSession
    register(spark)
    return spark.sql(f"select t.*, d.k, d.draw from {{df}} t, lateral {NAME}(cast({seed} as bigint), cast({skip} as bigint), cast({n} as bigint)) d", df=df)
