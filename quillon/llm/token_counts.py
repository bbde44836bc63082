"""Edit-aware token counts: kept segment trees of pre-token runs.

A document is cut into segments of about `SEGMENT` characters at ends of pre-tokens: each
segment but the first begins with a space or line end, or with a stop after a letter, so a
text without spaces has segments too. No token crosses such a cut, so counts add up. A binary
tree over the segments holds sums of characters and tokens; trees are tables, so a later
batch of edits starts from the trees that an earlier one wrote. An edit finds the segments it
touches by descending the character sums, adds the neighbour on a side where it reaches a
cut (the cut's context may go), re-encodes that region alone, and updates the sums above.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import tokens, words
from quillon.session import new_path, ship

SEGMENT = 512
#: A segment grows to so many times `SEGMENT` before the tree gets more places.
LARGEST = 4
SLICE = 4 << 20
#: Most rows of edits that are broadcast.
BROADCAST_EDITS = 1 << 14
CUT = re.compile(r"[ \n]|(?<=[^\W\d_])(?=[.,;:!?。、，；：！？…])")
TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
OUT = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, segments long, reencoded_chars long"
EDITS = "array<struct<start:int,stop:int,new:string>>"


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Pieces that join to the text, cut where no token crosses."""
    cuts, at = [0], 0
    while found := CUT.search(text, at + size):
        at = found.start()
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class SegmentTree:
    """Counts of one document. `counts` are those of `pieces`, if known already.

    chars and tokens are heaps: place 1 is the root, the children of k are 2k and 2k + 1, and
    segments are the lower half.
    """

    def __init__(self, pieces: list[str], count, counts: list[int] | None = None):
        self.count, self.reencoded, self.text = count, 0, "".join(pieces)
        self._build([len(p) for p in pieces], counts if counts is not None else count(pieces))

    @classmethod
    def kept(cls, text: str, chars: list[int], tokens_: list[int], count) -> SegmentTree:
        """A tree from its table row."""
        tree = cls.__new__(cls)
        tree.count, tree.reencoded, tree.text = count, 0, text
        tree.chars, tree.tokens, tree.base = list(chars), list(tokens_), len(chars) // 2
        return tree

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        self.base = 1 << max(0, (len(sizes) - 1).bit_length())
        self.chars, self.tokens = (self._heap(x) for x in (sizes, counts))

    def _heap(self, leaves: list[int]) -> list[int]:
        out = np.zeros(2 * self.base, np.int64)
        out[self.base : self.base + len(leaves)] = leaves
        k = self.base
        while k > 1:
            out[k // 2 : k] = out[k : 2 * k].reshape(-1, 2).sum(1)
            k //= 2
        return out.tolist()

    def _put(self, leaf: int, chars: int, tokens_: int) -> None:
        k = leaf + self.base
        more, longer = tokens_ - self.tokens[k], chars - self.chars[k]
        while k:
            self.tokens[k] += more
            self.chars[k] += longer
            k //= 2

    def _find(self, at: int) -> tuple[int, int]:
        """Segment that holds character `at`, or the last one, and where it starts."""
        k, start = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while k < self.base:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.base, start

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start..end; returns the new count of tokens."""
        a, a0 = self._find(start)
        b, b0 = self._find(end - 1) if end > start else (a, a0)
        stop = b0 + self.chars[b + self.base]
        while a and start <= a0:
            a -= 1
            a0 -= self.chars[a + self.base]
        # A stop at the next segment's head ends a pre-token only after the letter before it.
        while end >= stop < len(self.text) and b + 1 < self.base and self.text[stop] not in " \n":
            b += 1
            stop += self.chars[b + self.base]
            if self.chars[b + self.base]:
                break
        region = self.text[a0:start] + new + self.text[end:stop]
        self.text = self.text[:a0] + region + self.text[stop:]
        parts = segments(region)
        counts = self.count(parts)
        self.reencoded += len(region)
        room = b + 1 - a
        sizes = [len(p) for p in parts]
        if len(parts) > room and sum(sizes[room - 1 :]) <= LARGEST * SEGMENT:
            sizes, counts = [*sizes[: room - 1], sum(sizes[room - 1 :])], [*counts[: room - 1], sum(counts[room - 1 :])]
        if len(sizes) <= room:
            for k in range(room):
                self._put(a + k, *((sizes[k], counts[k]) if k < len(sizes) else (0, 0)))
        else:
            held = [(c, t) for c, t in zip(self.chars[self.base :], self.tokens[self.base :], strict=True)]
            held[a : b + 1] = zip(sizes, counts, strict=True)
            held = [x for x in held if x[0]] or [(0, 0)]
            self._build([c for c, _ in held], [t for _, t in held])
        return self.tokens[1]


def standard_edits(n: int, text: str) -> list[tuple[int, int, str]]:
    """Three edits of a text of n characters, each on the outcome of those before: its first
    24 characters inserted in the middle, a twentieth deleted after the first quarter, and
    the last ten replaced."""
    longer = n + min(24, n)
    return [(n // 2, n // 2, text[:24]), (n // 4, n // 4 + n // 20, ""), (max(0, longer - n // 20 - 10), longer - n // 20, " an edited end")]


def standard_edit_column(text: str = "text") -> Column:
    """`standard_edits` as a column of edits."""
    edits = """array(named_struct('start', n div 2, 'stop', n div 2, 'new', substring({t}, 1, 24)), named_struct('start', n div 4, 'stop', n div 4 + n div 20, 'new', ''),
        named_struct('start', greatest(0, n + least(24, n) - n div 20 - 10), 'stop', n + least(24, n) - n div 20, 'new', ' an edited end'))"""
    return F.expr(edits.format(t=text).replace("n div", f"char_length({text}) div").replace("n + ", f"char_length({text}) + ").replace("24, n)", f"24, char_length({text}))")).cast(EDITS)


def _counter(tokenizer: str | None):
    encode = tokens.encoder(tokenizer)
    return lambda pieces: [len(b) // 4 for b in encode(pieces)]


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Trees (doc_id, text, chars, tokens) of every document, in one pass without shuffle.

    Null texts are empty; repeated rows and null ids are kept; an empty table gives no rows.
    Other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches):
        count = _counter(tokenizer)
        for batch in batches:
            for i, j in words.slices(batch.column(1), SLICE):
                some = batch.slice(i, j - i)
                pieces = [segments(t) for t in some.column(1).to_pylist()]
                counts, at, trees = count([p for ps in pieces for p in ps]), 0, []
                for ps in pieces:
                    trees.append(SegmentTree(ps, count, counts[at : at + len(ps)]))
                    at += len(ps)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind)], names=["doc_id", "text", "chars", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, TREE)


def keep_trees(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Write trees (compressed) and read them back, for later batches of edits."""
    spark = trees.sparkSession
    path = path or new_path(spark, "trees")
    trees.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TREE).parquet(path)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the column `edits`, from a batch of edits (doc_id, seq, start, stop, new), applied in
    order of seq to every row of their id. Up to `BROADCAST_EDITS` edits are broadcast. Edits of
    an id that no tree has are ignored; a null id has none."""
    lists = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.coalesce("new", F.lit("")).alias("new")))).alias("_l"))
    few = edits.limit(BROADCAST_EDITS + 1).count() <= BROADCAST_EDITS
    out = trees.join(F.broadcast(lists) if few else lists, F.col("doc_id") == F.col("_id"), "left")
    plain = F.transform("_l", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["new"].alias("new")))
    return out.select("doc_id", "text", "chars", "tokens", F.coalesce(plain, F.array().cast(EDITS)).cast(EDITS).alias("edits"))


def apply_edits(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Trees after their edits (column `edits`: places in characters, each on the outcome of those
    before; places beyond the text count as its end), with n_chars and n_tokens before, edited_chars
    and edited_tokens after, segments, and reencoded_chars, which is what the edits had to encode."""
    ship(trees.sparkSession)
    schema = f"{TREE}, n_chars long, n_tokens long, edited_chars long, edited_tokens long, segments long, reencoded_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        count = _counter(tokenizer)
        for batch in batches:
            for i, j in words.slices(batch.column(1), SLICE):
                rows = []
                for doc_id, text, chars, held, edits in zip(*(c.to_pylist() for c in batch.slice(i, j - i).columns), strict=True):
                    tree = SegmentTree.kept(text, chars, held, count)
                    before = (tree.chars[1], tree.tokens[1])
                    for e in edits:
                        start = min(max(0, e["start"]), len(tree.text))
                        tree.edit(start, min(max(start, e["stop"]), len(tree.text)), e["new"])
                    used = sum(c > 0 for c in tree.chars[tree.base :])
                    rows.append((doc_id, tree.text, tree.chars, tree.tokens, *before, tree.chars[1], tree.tokens[1], max(1, used), tree.reencoded))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return trees.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(run, schema)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Counts of every document before and after `standard_edits`: trees are built and kept, then the
    edits are applied to the kept trees. No row is shuffled. Null texts are empty; repeated rows
    and null ids are kept; an empty table gives no rows. Other columns are ignored."""
    trees = keep_trees(build_trees(docs, id_col, text_col, tokenizer))
    return apply_edits(trees.withColumn("edits", standard_edit_column()), tokenizer).select(*[x.split()[0] for x in OUT.split(", ")])


def op6_token_counts(spark, sf_dir):
    """Edit-aware counts of all documents."""
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES = {}
