"""Joining rows to a table by a key that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one in `SHARE` of all rows refers to is hot; so there are fewer than `SHARE` of them.
SHARE = 1024


def look_up(rows: DataFrame, on: str, table: DataFrame, key: str, refs: str, total: int) -> DataFrame:
    """`rows` with the columns of the row of `table` whose `key` equals `on`, null where there is none.

    `refs` says how many of the `total` rows refer to a row of `table`. The rows of hot keys,
    fewer than `SHARE`, are broadcast, so the rows that refer to them stay where they are; the
    others meet by a shuffle. `refs` and `key` are left out.
    """
    least = max(1, total // SHARE)
    values = [c for c in table.columns if c not in (key, refs)]
    hot = table.where(F.col(refs) > least).select(F.col(key).alias("_hot"), F.struct(*values).alias("_hot_row"))
    cold = table.where(F.col(refs) <= least).select(F.col(key).alias("_cold"), F.struct(*values).alias("_cold_row"))
    met = rows.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")
    met = met.withColumn("_ask", F.when(F.col("_hot").isNull(), F.col(on))).drop("_hot")
    # Rows that need no second look-up do not meet in one task either: they bring no key.
    some = met.where("_ask is not null").join(cold, F.col("_ask") == F.col("_cold"), "left").drop("_cold")
    none = met.where("_ask is null").withColumn("_cold_row", F.lit(None).cast(cold.schema["_cold_row"].dataType))
    out = some.unionByName(none)
    row = F.coalesce("_hot_row", "_cold_row")
    return out.select(*rows.columns, *[row.getField(c).alias(c) for c in values])
