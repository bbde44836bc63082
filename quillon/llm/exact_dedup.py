"""Exact de-duplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every normalised text once and sets `PROBES` bits of one 64-bit word of a
Bloom filter of about `BITS_PER_ROW` bits a row; only bits that two rows or more have set
matter, and those are kept as a sparse filter of words. Pass 2 looks up each row's word: a
row all of whose bits are set twice is possibly repeated. Only such rows shuffle by their
hash; all others go straight to the result. False positives merely shuffle, so results are
exact (texts are equal when their SHA-256 is).

The filter is broadcast up to `BROADCAST_WORDS` words. A larger one meets the compact hash
rows (never the texts) in one join by word; the rows of words that more than one row in 1,024 has,
so those of hot hashes, meet theirs in a broadcast instead.
Groups of more than `HOT` rows meet their result in a broadcast (there are at most rows /
`HOT` of them, and `HOT` grows with the rows beyond 2^22), so no task gets a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookup import look_up
from quillon.session import free_name, materialise

PROBES = 2
BITS_PER_ROW = 32
#: Most words of a filter that are broadcast.
BROADCAST_WORDS = 1 << 20
#: Rows of a group from which it is hot, while there are at most 2^16 times as many rows.
HOT = 64
#: Most rows that are broadcast to be dropped.
BROADCAST_GONE = 1 << 18
#: The characters that do not count, [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points of the original text), text_sha256, for every row."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n"),
        F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"),
    )


def _probes(slots: int) -> list[Column]:
    """The word of a row's hash, and the mask of its bits in it."""
    word = F.pmod(F.xxhash64("text_sha256", F.lit(0)), F.lit(max(1, slots // 64)))
    bits = F.xxhash64("text_sha256", F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return [word.alias("word"), mask.alias("mask")]


def repeated_words(rows: DataFrame) -> DataFrame:
    """The sparse filter: (word, bits, refs), the bits that two rows or more have set, and how often
    rows set them.

    rows: (word, mask). Equal pairs are counted before the shuffle.
    """
    each = rows.groupBy("word", "mask").agg(F.count("*").alias("c"))
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(mask, i) & 1L = 1L)")).alias("bit")
    twice = each.select("word", "c", bit).groupBy("word", "bit").agg(F.sum("c").alias("c")).where("c > 1")
    return twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("c").alias("refs"))


def _flagged(rows: DataFrame, slots: int, n: int) -> DataFrame:
    """The `n` rows (doc_id, n, text_sha256) with `maybe`: whether the filter holds them."""
    probed = rows.select("doc_id", "n", "text_sha256", *_probes(slots))
    filter_ = materialise(repeated_words(probed).withColumnRenamed("word", "_word"), "exact-filter")
    if filter_.count() <= BROADCAST_WORDS:
        met = probed.join(F.broadcast(filter_.drop("refs")), F.col("word") == F.col("_word"), "left")
    else:  # a row sets at most `PROBES` bits
        met = materialise(look_up(probed, "word", filter_, "_word", "refs", PROBES * n), "exact-flagged")
    return met.select("doc_id", "n", "text_sha256", F.expr("coalesce(bits & mask = mask, false)").alias("maybe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the
    one with the smallest id. Null texts are empty; a null id sorts before all others.
    Rows with the same id and the same text are one group; each of them is reported, and
    all of them are `kept` if their id is. An empty table gives no rows. Other columns of
    `docs` are ignored, whatever their names.
    """
    rows = materialise(hashed(docs, id_col, text_col), "exact-rows")
    n = rows.count()
    flagged = _flagged(rows, 1 << max(16, (n * BITS_PER_ROW).bit_length()), n)
    maybe = flagged.where("maybe").drop("maybe")
    group = maybe.groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").alias("keep_id"))).alias("best"), F.count("*").alias("group_size")
    )
    group = materialise(group.select("_sha", "best.keep_id", "group_size"), "exact-groups")
    hot = F.col("group_size") > max(HOT, n >> 16)
    known = maybe.join(F.broadcast(group.where(hot)), F.col("text_sha256") == F.col("_sha"), "left")
    many = known.where("group_size is not null").select("doc_id", "keep_id", "group_size", "text_sha256")
    rest = known.where("group_size is null").select("doc_id", "text_sha256")
    few = rest.join(group.where(~hot), F.col("text_sha256") == F.col("_sha")).select("doc_id", "keep_id", "group_size", "text_sha256")
    once = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return once.union(many).union(few).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def few(df: DataFrame, most: int = BROADCAST_GONE) -> DataFrame:
    """`df`, marked for broadcast where it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts: the one that `exact_groups` keeps.

    Rows are told apart by id and text, null ids included, so a row goes only for its own
    text; of rows equal in both, one stays. Null texts are empty. An empty table gives no
    rows; all columns are returned. Only rows that repeat shuffle with their texts.
    """
    groups = materialise(exact_groups(docs, id_col, text_col).where("group_size > 1"), "exact-copies")
    sha, gone_id, gone_sha = (free_name(docs, x) for x in ("_sha", "_gone_id", "_gone_sha"))
    own = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    keyed = docs.withColumn(sha, own)
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha))

    def keys(df):
        return few(df.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct())

    kept = keyed.join(keys(groups.where("not kept")), same, "left_anti")
    again = materialise(groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1"), "exact-repeats")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(keys(again), same, "left_anti")
    return once.union(kept.join(keys(again), same, "left_semi").dropDuplicates([id_col, sha])).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir):
    """Exact copies of all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with h as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
g as (select text_sha256, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from h group by text_sha256)
select h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id as kept, h.text_sha256 from h join g on h.text_sha256 = g.text_sha256
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": ORACLE}
