"""Series that grow: weekly sums with a watermark, and damped values that follow their targets.

An extension: each equals its batch form on the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillon.session import ship

WEEK = "7 days"


def read(spark: SparkSession, path: str, schema: StructType | str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files under `path`, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def weekly(events: DataFrame, late: str = "1 day", start: str = "1970-01-05") -> DataFrame:
    """(id, week, x) of a stream (id, ts, x): sums of tumbling weeks counted from the day `start`,
    as `signal.weekly` has them of days. A week is given once the watermark, `late` behind the
    latest event, has passed it; rows later than that do not count."""
    offset = f"{(pd.Timestamp(start) - pd.Timestamp(0)).days % 7} days"
    seen = events.select("id", F.col("ts").cast("timestamp").alias("ts"), "x").withWatermark("ts", late)
    sums = seen.groupBy("id", F.window("ts", WEEK, startTime=offset).alias("w")).agg(F.sum("x").alias("x"))
    return sums.select("id", F.floor(F.datediff(F.col("w.start"), F.lit(start).cast("date")) / 7).cast("long").alias("week"), "x")


class Follow(StatefulProcessor):
    """A value for each key that follows its targets: x += (target - x) (1 - exp(-dt / tau))."""

    def __init__(self, tau: float):
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("follow", "x double, ms double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["ms", "target"], kind="stable")
        x, at = self.state.get() if self.state.exists() else (None, None)
        out = []
        for ms, target in zip(some["ms"], some["target"], strict=True):
            x = float(target) if x is None else x + (target - x) * (1 - math.exp(-max(0.0, ms - at) / self.tau))
            at = float(ms) if at is None else max(at, float(ms))
            out.append((key[0], float(ms), x))
        self.state.update((x, at))
        yield pd.DataFrame(out, columns=["id", "ms", "x"])

    def close(self) -> None:
        pass


def follow(targets: DataFrame, tau: float) -> DataFrame:
    """(id, ms, x) of a stream (id long, ms double, target double): each key's value after each row,
    starting at its first target. Rows of a batch are taken in order of ms, then target; a row
    earlier than what a key has seen moves nothing."""
    ship(targets.sparkSession)
    rows = targets.select(F.col("id").cast("long").alias("id"), F.col("ms").cast("double").alias("ms"), F.col("target").cast("double").alias("target"))
    return rows.groupBy("id").transformWithStateInPandas(Follow(tau), "id long, ms double, x double", "append", "None")
