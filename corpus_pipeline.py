"""Five stages over `documents`: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage reads what its predecessor kept, written as Parquet in the shared folder; what
the stage before wrote is removed as soon as its reader has run. Rows are told apart by id
and text, so null ids, repeated ids and repeated rows pass every stage as rows of their own;
null texts are empty; an empty table gives no rows; extra columns pass through up to packing.
"""

from __future__ import annotations

from quillon.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from quillon.session import new_path, remove


def reject_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model does not reject; it learns from `labels`.

    Null and empty texts score as texts without a word; without labels of both kinds all
    texts have one score and none goes.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark, docs, sf_dir):
    """One row of each group of texts equal but for blanks, null texts being empty: the longest,
    then that of the smallest id (null first); of rows equal in id and text, one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One row of each class of near copies: that of the smallest id (null last). Rows without
    words are no copies and stay."""
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark, docs, sf_dir):
    """Whole rows of each source up to its target, repeated where that needs a second epoch. A
    null source is a source."""
    return mixing.mixed_rows(docs)


def pack(spark, docs, sf_dir):
    """Token pieces with their sequence and place; a null text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark, sf_dir):
    """All stages on the whole of `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the fitted toxicity stage; tests hold run() against a brute-force version.
ORACLE_SQL = None
