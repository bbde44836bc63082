"""An inverted index of texts in shards by a hash of the term.

A shard is a folder; inside it rows are sorted by term. Ids are numbered in order, and a
posting is such a number; a term's list is split by blocks of `BLOCK` numbers, so no list
grows with the corpus. A look-up names the shards of its terms as literals, or by a join
with their shards, so other folders are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import order
from quillon.session import materialise, new_path, partitions

WORD = r"[^\x20\x09-\x0D]+"
SHARDS, BLOCK = 64, 4096
_POSTINGS = "term string, block long, ids array<long>, shard int"


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: Column) -> Column:
    """The different words of a text with A-Z in lower case; none of a null text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(lowered(text), F.lit("")), F.lit(WORD), 0))


@dataclass
class TextIndex:
    """Folders of an index: `postings` (term, block, ids; by shard) and `ids` (pos, id)."""

    postings: str
    ids: str
    shards: int

    def shard(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.shards

    def shard_of(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.shards)).cast("int")

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.read.schema(_POSTINGS).parquet(self.postings), spark.read.parquet(self.ids)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> TextIndex:
    """Index the words of all whole texts, each document once a word.

    Null texts have no words; rows without an id are left out, rows of one id are one
    document. Ids are numbered in their order from 0. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms"))
    ids = materialise(order.numbered(rows.select("id").distinct(), ["id"], "pos").select("pos", "id"), "index-ids")
    index = TextIndex(new_path(spark, "index-postings"), ids._quillon_path, shards)
    each = rows.select("id", F.explode("terms").alias("term")).join(ids, "id").select("term", "pos")
    # A block holds few numbers, so no list is longer than it.
    lists = each.groupBy("term", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_set("pos")).alias("ids"))
    lists = lists.withColumn("shard", index.shard_of(F.col("term")))
    dealt = lists.repartitionByRange(partitions(spark), "shard", "term", "block").sortWithinPartitions("shard", "term", "block")
    dealt.write.partitionBy("shard").parquet(index.postings)
    return index


def look_up(spark: SparkSession, index: TextIndex, wanted: list[str] | DataFrame) -> DataFrame:
    """(term, id): the documents under each of the terms, a list or a table (term).

    The terms of a list become literals of the scan's filters by shard and term; those of a table join by
    shard and term. Repeated terms count once, null ones not at all.
    """
    postings, ids = index.read(spark)
    if isinstance(wanted, DataFrame):
        asked = wanted.where("term is not null").select("term").distinct().withColumn("shard", index.shard_of(F.col("term")))
        found = postings.join(asked, ["shard", "term"])
    else:
        some = sorted({t for t in wanted if t is not None})
        found = postings.where(F.col("shard").isin(sorted({index.shard(t) for t in some})) & F.col("term").isin(some)) if some else postings.limit(0)
    return found.select("term", F.explode("ids").alias("pos")).join(ids, "pos").select("term", "id")


def search(spark: SparkSession, index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query, id): the documents that hold all words of each query (query, text), by an equi-join of
    words and lists. A query without words finds nothing.

    Only blocks in which each of a query's words has a list are read for it, and the lists of a query in a block, of at
    most `BLOCK` ids each, meet in one row; so no task holds more than some words' lists of a block.
    """
    words = queries.where("query is not null").select("query", F.explode(terms(F.col("text"))).alias("term")).distinct()
    words = materialise(words, "index-words")
    need = words.groupBy("query").agg(F.count("*").alias("need"))
    postings, ids = index.read(spark)
    asked = words.withColumn("shard", index.shard_of(F.col("term")))
    hits = postings.join(asked, ["shard", "term"])
    full = hits.groupBy("query", "block").agg(F.count("*").alias("met")).join(need, "query").where("met = need").select("query", "block")
    full = materialise(full, "index-blocks")
    lists = hits.join(full, ["query", "block"]).groupBy("query", "block").agg(F.sort_array(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("l"))
    both = F.aggregate(F.slice("l", 2, F.greatest(F.lit(0), F.size("l") - 1)), F.get("l", F.lit(0))["ids"], lambda a, x: F.array_intersect(a, x["ids"]))
    return lists.select("query", F.explode(both).alias("pos")).join(ids, "pos").select("query", "id")
