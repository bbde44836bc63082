"""Joins by order: each row with the last row of another table at or before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from quillon.session import materialise, partitions, ship


def _filled(by: list[str]):
    """Sorted rows of both sides -> left rows with the last right row of their key in this partition.

    A left row whose key's run reaches back to the partition's start without a right row is
    `_open`. Two rows more say what the partition's first key asks of the partitions before
    it, and what its last key leaves to those after it.
    """

    def row(batch, i):
        return batch.slice(i, 1)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = carry = None  # one-row batches
        opened = True  # the run at hand began with the partition
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for name in by:
                c = batch.column(name)
                if n > 1:
                    new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
                if last is not None:
                    new[0] |= last.column(name)[0].as_py() != c[0].as_py()
            if last is None:
                first = row(batch, 0)
                carry = pa.nulls(1, batch.column("_r").type)
            at = np.arange(n)
            run_start = np.maximum.accumulate(np.where(new, at, -1))  # -1: the run of the batch before
            right = np.asarray(batch.column("_is_right"))
            hit = np.maximum.accumulate(np.where(right, at, -1))
            hit = np.where(hit >= run_start, hit, -1)
            old = run_start < 0
            # Place 0 is what the batches before left to the run at hand.
            pool = pa.concat_arrays([carry, batch.column("_r")])
            left_over = carry.is_valid()[0].as_py()
            take = np.where(hit >= 0, hit + 1, 0)
            none = (hit < 0) & (~old | (not left_over))
            is_open = (hit < 0) & old & opened & (not left_over)
            some = np.flatnonzero(~right)
            picked = pool.take(pa.array(take[some], pa.int64(), mask=none[some]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(some)) for c in by] + [batch.column("_l").take(pa.array(some)), picked, pa.array(is_open[some]), pa.array(np.full(len(some), part, np.int32)), pa.array(np.zeros(len(some), np.int32))],
                names=[*by, "_l", "_r", "_open", "_part", "_kind"],
            )
            carry = pool.take(pa.array([None if none[-1] else int(take[-1])], pa.int64()))
            opened = bool(opened and old[-1])
            last = row(batch, n - 1)
        if last is not None:
            nothing = pa.nulls(1, last.column("_l").type), pa.nulls(1, last.column("_r").type)
            for key, r, kind in ((first, nothing[1], 1), (last, carry, 2)):
                yield pa.RecordBatch.from_arrays(
                    [key.column(c) for c in by] + [nothing[0], r, pa.array([False]), pa.array([part], pa.int32()), pa.array([kind], pa.int32())], names=[*by, "_l", "_r", "_open", "_part", "_kind"]
                )

    return run


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, exact: bool = True) -> DataFrame:
    """`left` with the columns of the last row of `right` whose columns `by` are equal and whose
    `right_on` (default: `on`) is at most `on`, or below it with `exact` false; null where there is none.

    Of right rows equal in `by` and `right_on` the last in the order of all its columns counts.
    Left rows with a null key or a null `on` stay, with nulls; such right rows match
    nothing. Repeated left rows stay repeated. Right columns other than `by` are added and must have
    names of their own; of a column `on` that both have, the right one is left out.

    Both sides meet in one exchange by ranges of (by, on), so a key may fill many partitions.
    What a partition leaves to the next, one row, goes through a window of two rows for each
    partition.
    """
    spark = left.sparkSession
    ship(spark)
    right_on = right_on or on
    added = [c for c in right.columns if c not in by and not (c == right_on == on)]
    clash = {c.lower() for c in added} & {c.lower() for c in left.columns}
    if clash:
        raise ValueError(f"right columns {sorted(clash)} clash with left ones")
    keys = [f"_by{i}" for i in range(len(by))]
    whole, known = [F.col(c) for c in by], lambda c: F.greatest(*[F.col(x).isNull().cast("int") for x in (*by, c)], F.lit(0)) == 0
    l_type, r_type = left.schema, StructType([right.schema[c] for c in added] + [StructField("_there", BooleanType())])
    r_row = F.struct(*[F.col(c) for c in added], F.lit(True).alias("_there"))
    a = left.where(known(on)).select(*[c.alias(k) for c, k in zip(whole, keys, strict=True)], F.col(on).alias("_on"), F.lit(False).alias("_is_right"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(r_type).alias("_r"))
    b = right.where(known(right_on)).select(*[c.alias(k) for c, k in zip(whole, keys, strict=True)], F.col(right_on).alias("_on"), F.lit(True).alias("_is_right"), F.lit(None).cast(l_type).alias("_l"), r_row.alias("_r"))
    side = F.when(F.col("_is_right"), 0 if exact else 1).otherwise(1 if exact else 0)
    both = a.unionByName(b).withColumns({"_side": side, "_tie": F.monotonically_increasing_id()})
    order = [*keys, "_on", "_side", "_r", "_tie"]
    dealt = both.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = StructType([both.schema[k] for k in keys] + [StructField("_l", l_type), StructField("_r", r_type), StructField("_open", BooleanType()), StructField("_part", IntegerType()), StructField("_kind", IntegerType())])
    met = materialise(dealt.select(*keys, "_is_right", "_l", "_r").mapInArrow(_filled(keys), schema), "asof")
    before = Window.partitionBy(*keys).orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    edges = met.where("_kind > 0").withColumn("_got", F.last("_r", True).over(before)).where("_kind = 1").select(F.col("_part").alias("_asks"), "_got")
    rows = met.where("_kind = 0")
    closed = rows.where("not _open").select("_l", "_r")
    opened = rows.where("_open").join(F.broadcast(edges), F.col("_part") == F.col("_asks"), "left").select("_l", F.col("_got").alias("_r"))
    out = closed.union(opened).select("_l.*", *[F.col("_r").getField(c).alias(c) for c in added])
    blank = left.where(~known(on)).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added])
    return out.union(blank)
