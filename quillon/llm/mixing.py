"""Mixing sources to target weights.

Every row gets a hash-random key; within each source rows are ordered by key in ranges
(the key's leading bits), word counts get prefix sums in two levels (ranges of a source,
then rows of a range), and each source is cut at its exact budget, after as many whole
epochs as the budget holds. No source is held in one task and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import materialise, partitions

#: Fixed values of the mix: weights of the sources in order, repeating; the share of all
#: words; the most epochs of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Most ranges (of all sources) that are broadcast.
BROADCAST_RANGES = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order (null last) take `weights` in turn and share `share` of
    all words; a target stops at `epochs` times its source and the excess is shared again
    by weight: the level of that filling is found from running sums over the sources in
    the order in which they fill up. The window runs over one row per source.
    """
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ws = F.array(*[F.lit(w) for w in weights])
    s = sizes.select(
        "source", "source_size", F.get(ws, (F.row_number().over(names) - 1) % len(weights)).alias("w")
    ).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, after, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"),
        F.sum("w").over(after).alias("open"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
    )
    # The level that the open sources reach, were all before them full; the first that stays below its cap has the true one.
    level = (F.col("budget") - F.col("full")) / F.col("open")
    s = s.select("*", level.alias("level")).withColumn(
        "true", F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("full"), F.col("level")))).over(whole)
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("true.level"), F.col("cap").cast("double")))
    return s.select("source", "source_size", (F.round(target, 6) + F.lit(0.0)).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, digits: int) -> list:
    """Columns of a row's place: source, words, key and range of the key."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return [F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), F.substring(key, 1, digits).alias("range")]


def _heads(rows: DataFrame, weights, share: float, epochs: int) -> DataFrame:
    """Per range of a source: words before it, the source's words and its target."""
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_key = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialise(ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(by_key), F.lit(0))), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    targets = targets.withColumnRenamed("source", "_source")
    return ranges.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select("_source", F.col("range").alias("_range"), "range_start", "source_size", "target")


def _plan(rows: DataFrame, heads: DataFrame, by: list) -> DataFrame:
    """rows (source, size, key, range, ...) with source_size, target, taken and copies; rows of
    equal keys are ordered by `by`."""
    inside = Window.partitionBy("source", "range").orderBy("key", *by).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    if heads.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        heads = F.broadcast(heads)
    placed = placed.join(heads, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    start = F.col("range_start") + F.col("inside")
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    cut = budget - rounds * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut - start))
    taken, copies = (rounds * F.col("size") + part).cast("long"), (rounds + F.when(start < cut, 1).otherwise(0)).cast("long")
    return placed.withColumns({"taken": taken, "copies": copies})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: what the mix takes of every row.

    `taken` counts words, repeats included: whole epochs of the source, then rows in key
    order up to the budget, the last one in part, so a source's words add up to its target
    rounded down. `copies` counts how often the row begins before that cut; it is how often
    a mix of whole rows holds it. A row without words takes none, and its copies follow its
    place. Null texts are empty, null sources are one source, last in order. Rows with equal
    ids have equal keys and are ordered by size, then arbitrarily. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    digits = max(1, len(f"{8 * partitions(docs.sparkSession):x}"))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), *_keyed(docs, id_col, text_col, source_col, digits)), "mix")
    return _plan(rows, _heads(rows, weights, share, epochs), ["size"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The rows of the mix, whole, each as often as its `copies` in `mix` says.

    A row goes through the plan itself and meets no other by its id, so repeated rows, equal
    ids and null ids each come out as often as their own place says; rows with equal ids are
    ordered by size, then by text. Texts shuffle once. Null texts are empty; null sources are
    one source; an empty table gives no rows. All columns are kept, whatever their names.
    """
    digits = max(1, len(f"{8 * partitions(docs.sparkSession):x}"))
    heads = _heads(docs.select(*_keyed(docs, id_col, text_col, source_col, digits)), weights, share, epochs)
    row = docs.select(F.struct(*docs.columns).alias("row"), *_keyed(docs, id_col, text_col, source_col, digits))
    heads = materialise(heads, "mix-heads")
    planned = _plan(row, heads, ["size", F.col("row").getField(text_col)]).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def op1_mix_sources(spark, sf_dir):
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


ORACLE = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3] as w, source_size * 2 as cap from s),
f as (select *, coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as full_,
        sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as open_, sum(source_size) over () * 1.5e0 as budget from w),
l as (select *, (budget - full_) / open_ as level from f),
t as (select source, source_size, cap, w, (select arg_min(level, full_) from l where w * level <= cap) as level from l),
g as (select source, source_size, round(least(cast(cap as double), coalesce(w * level, cast(cap as double))), 6) + 0e0 as target from t),
p as (select d.doc_id, d.size, g.source_size, g.target, coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0) as start_
      from d join g on d.source is not distinct from g.source),
c as (select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as rounds from p)
select doc_id, size, source_size, target, cast(rounds * size + greatest(0, least(size, cast(floor(target) as bigint) - rounds * source_size - start_)) as bigint) as taken from c
"""

QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES = {"op1_mix_sources": ORACLE}
