"""Best-fit packing of token pieces into sequences of fixed capacity.

Documents are encoded and cut into pieces; pieces are range-sorted by length, and each
gets its rank among the pieces of its length (distributed: ranks within a range partition
plus counts of the partitions before). Matching is bulk-synchronous over length classes
and gap classes, of which there are at most `capacity` each, however many pieces there
are: lengths are swept downwards; the successor of a length is the smallest gap class
that holds it; pieces that want the same gaps are told apart by rank, the first taking
the first gaps; gaps are updated and the sweep repeats until the class is placed, opening
sequences where no gap is left. A match is a run: pieces of ranks r.. of one length go to
sequences s.. at one offset. Ranks then place every piece without another shuffle.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import token_files, tokens, words
from quillon.session import drop, materialise, partitions, ship

CAPACITY = 4096
#: Bytes of texts encoded at once: four times as many take 38 MB more of a process and no less time.
SLICE = 1 << 19
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: only longer ones are cut, into whole sequences and a rest.

    A null or empty text is its end id alone; null and repeated ids and repeated rows are
    documents of their own; an empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    ship(docs.sparkSession)

    def cut(batches):
        encode = tokens.column_encoder(tokenizer)
        for batch in batches:
            for i, j in words.slices(batch.column(1), SLICE):
                some = batch.slice(i, j - i)
                out = ([], [], [], [], [])
                for doc_id, ids in zip(some.column(0).to_pylist(), token_files.encoded(some.column(1), encode), strict=True):
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        for to, x in zip(out, (doc_id, k, at, len(part), zlib.crc32(part)), strict=True):
                            to.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE)


def match(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int]]]:
    """Length -> runs (first rank, first sequence, offset), in rank order.

    counts: pieces of each length. Every run ends where the next begins.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    sequences = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        mine = runs.setdefault(length, [])
        while left:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                take = min(n, left)
                if take < n:
                    gaps[gap].append((first + take, n - take))
                elif not gaps[gap]:
                    del gaps[gap], open_gaps[at]
                mine.append((rank, first, capacity - gap))
                give(gap - length, first, take)
                rank, left = rank + take, left - take
                continue
            each = capacity // length
            full, rest = divmod(left, each)
            for j in range(each):
                n = full + (j < rest)
                if full:
                    mine.append((rank, sequences, j * length))
                    rank += full
            for j in range(rest):
                mine.append((rank, sequences + full, j * length))
                rank += 1
            give(capacity - each * length, sequences, full)
            give(capacity - rest * length, sequences + full, 1 if rest else 0)
            sequences, left = sequences + full + (1 if rest else 0), 0
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns as `pieces` gives them).

    Sequences have no gap between pieces and no piece over the capacity. Equal pieces,
    null ids and repeated rows are pieces of their own; an empty table gives no rows.
    """
    spark = cut.sparkSession
    ship(spark)

    def rank(batches):
        tokens.forget()  # all is encoded; what runs next needs the memory
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            new = np.flatnonzero(np.diff(length, prepend=last))
            begin = np.zeros(len(length), np.int64)
            begin[new] = new
            begin = np.maximum.accumulate(begin)
            local = np.arange(len(length)) - begin
            if not len(new) or new[0] > 0:
                local[: new[0] if len(new) else None] += seen
            last, seen = length[-1], local[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(local)], names=[*batch.schema.names, "part", "local"])

    order = ["length", "doc_id", "piece", "start", "ids_crc32"]
    sorted_ = cut.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranked = materialise(sorted_.mapInArrow(rank, f"{PIECE}, part int, local long"), "packing")
    start: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    # Bounded: one row for each partition, and one more for each length.
    for part, length, n in sorted(map(tuple, ranked.groupBy("part", "length").count().collect())):
        start[part, length] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    table = {n: np.array(r, np.int64) for n, r in match(counts, capacity).items()}
    known = spark.sparkContext.broadcast((start, table))

    def place(batches):
        tokens.forget()
        start, table = known.value
        for batch in batches:
            length, part, local = (batch.column(c).to_numpy() for c in ("length", "part", "local"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            group = length * (1 << 32) + part
            order = np.argsort(group, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if len(some):
                    r = local[some] + start[int(part[some[0]]), int(length[some[0]])]
                    runs = table[int(length[some[0]])]
                    at = np.searchsorted(runs[:, 0], r, side="right") - 1
                    seq[some], off[some] = runs[at, 1] + r - runs[at, 0], runs[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack all documents; null texts are empty (the end id alone)."""
    cut = materialise(pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    out = pack(cut, capacity)
    drop(cut)
    return out


def op9_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 4,096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES = {}
