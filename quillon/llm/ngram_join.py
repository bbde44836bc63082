"""N-gram Jaccard join by prefix filtering and prefix trees; classes of linked documents.

A document's set holds the 64-bit hashes of its distinct word n-grams. Steps:

1. One pass hashes all texts: set size, a hash of the set (equal sets are one node), and
   frequencies of n-grams in a table of fixed size, which gives a global order, rare first.
2. Sets that reach the threshold share one of their first n - ceil(t n) + 1 n-grams in
   any global order. Only those prefixes shuffle. A bitmap of fixed size marks the n-grams
   that two different sets or more have there; others stop here (the bitmap lets some more
   pass, which find no partner). The place of the first n-gram they share bounds the
   partner's size (what is left of both must hold the overlap); sets without a partner of
   fitting size under any n-gram are done.
3. Blocks of sets are joined in prefix trees: the sets, ordered by how many of the block
   hold an n-gram, form a trie with compressed paths; n-grams of one set only stay out of it.
   A subtree at the top is pruned when the remaining lengths cannot reach the overlap needed;
   in others a query counts the overlap of every path at once, a shared part once. Sets that shared n-grams
   connect are a cluster; one of more than `CLUSTER` n-grams is cut into bands of size,
   two neighbouring bands a block, as sets of other sizes cannot link. A block still larger
   is dealt over parts of about `CLUSTER` n-grams: each part is joined alone, then one set
   of each class over all parts, and only where classes are left that may still link, all
   pairs of parts. A block of more than `PARTS` parts takes three rounds by n-gram: each set
   under one n-gram; one set of each class under every n-gram that holds two classes; at
   last all sets under every such n-gram. So large groups collapse before they are compared
   in full, and no link between classes is lost.

Blocks of rounds above `BLOCK` n-grams are split: in the first rounds into parts, in the last into
all pairs of parts. Classes are connected components of the links found; nothing of them
is collected. Hashes of 64 bits stand for n-grams and sets.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import tokens, words
from quillon.llm.components import components
from quillon.session import drop, free_name, materialise, partitions, ship

SIZE = 5
PERCENT = 75
FREQUENCY_BITS = 24
CHUNK = 1 << 18
BLOCK = 1 << 21
CLUSTER = 1 << 20
PARTS = 8
#: Rows of an n-gram from which it is hot and its sets are told by sizes first.
HOT_KEY = 1 << 16
#: Most rows that are broadcast (of three numbers, about 25 MB in memory).
BROADCAST_ROWS = 1 << 18
#: Bits of a bitmap of keys, 16 MB whatever the input; a key sets two of them.
BITMAP_BITS = 27


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest overlap c of sets of a and b with 100 c >= percent (a + b - c)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Prefix length that sets reaching the threshold must share."""
    return n - -(-percent * n // 100) + 1


def largest_partner(n, place, percent: int = PERCENT):
    """Largest size of a set that can link with one of n and shares its n-gram at `place` first."""
    return (n - place) * (100 + percent) // percent - n


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (doc_id, th, n, sid) and, one set a task, of frequencies (chunk, counts)."""

    def run(batches):
        tokens.forget()
        counts = np.zeros(1 << FREQUENCY_BITS, np.int32)
        for batch in batches:
            n, sid = [], []
            for grams in words.shingles(batch.column(1), size):
                n.append(len(grams))
                sid.append(set_id(grams) if len(grams) else None)
                counts[grams >> np.uint64(64 - FREQUENCY_BITS)] += 1
            nulls = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), nulls, pa.nulls(len(n), pa.binary())], names=["doc_id", "th", "n", "sid", "chunk", "counts"])
        counts = np.minimum(counts, 255).astype(np.uint8)  # a task tells no more than 255 apart
        for k in range(len(counts) // CHUNK):
            one = [pa.nulls(1, pa.int64())] * 4 + [pa.array([k], pa.int32()), pa.array([zlib.compress(counts[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, names=["doc_id", "th", "n", "sid", "chunk", "counts"])

    return docs.mapInArrow(run, "doc_id long, th long, n long, sid long, chunk int, counts binary")


def _frequencies(profile: DataFrame) -> np.ndarray:
    """The summed table: 2^FREQUENCY_BITS counts, whatever the input, as 16 times the log of base 2
    of one more (255 at most)."""

    def add(batches):
        sums = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(c), np.uint8).astype(np.int64)
                sums[k] = sums[k] + c if k in sums else c
        if sums:
            logs = [np.minimum(255, np.round(16 * np.log2(1 + s))).astype(np.uint8) for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in logs], pa.binary())], names=["chunk", "counts"])

    chunks = (1 << FREQUENCY_BITS) // CHUNK
    rows = profile.where("chunk is not null").select("chunk", "counts").repartition(chunks, "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(1 << FREQUENCY_BITS, np.uint8)
    for k, c in rows:
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(c, np.uint8)
    return out


def _prefixes(docs: DataFrame, size: int, percent: int, known) -> DataFrame:
    """(key, sid, n, most): the rarest n-grams of every set, once a task for equal sets, and
    the largest partner by the n-gram's place. known: the frequencies, broadcast."""

    def run(batches):
        tokens.forget()
        counts, seen = known.value, set()
        for batch in batches:
            out = ([], [], [], [])
            for grams in words.shingles(batch.column(1), size):
                if len(grams) and (sid := set_id(grams)) not in seen:
                    seen.add(sid)
                    n, p = len(grams), prefix(len(grams), percent)
                    order = np.argsort(counts[grams >> np.uint64(64 - FREQUENCY_BITS)], kind="stable")[:p]
                    for to, x in zip(out, (grams[order].view(np.int64), np.full(p, sid, np.int64), np.full(p, n, np.int32), largest_partner(n, np.arange(p), percent).astype(np.int32)), strict=True):
                        to.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "sid", "n", "most"])

    return docs.mapInArrow(run, "key long, sid long, n int, most int")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the lowest and the next `BITMAP_BITS` of all keys (one column of longs), as bytes.

    Keys are dealt by bucket, each bucket is 4 KB, and the driver gets 16 MB at most.
    """
    key = F.col(keys.columns[0])
    low = keys.select(F.explode(F.array(*[F.shiftright(key, k * BITMAP_BITS).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) for k in (0, 1)])).alias("low"))
    low = low.select(F.shiftright("low", 15).cast("int").alias("bucket"), F.col("low").bitwiseAND(F.lit(32767)).alias("bit"))
    parts = low.repartition(partitions(keys.sparkSession), "bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for k, bits in parts.collect():
        out[k << 12 : (k + 1) << 12] = np.frombuffer(bits, np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for k in (0, 1):
        low = (keys >> (k * BITMAP_BITS)) & ((1 << BITMAP_BITS) - 1)
        out &= (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
    return out


def _only_marked(rows: DataFrame, known, column: int) -> DataFrame:
    """Rows whose key in that column may be in the (broadcast) bitmap."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_marked(known.value, batch.column(column).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _sets(docs: DataFrame, size: int, known) -> DataFrame:
    """(sid, grams) of documents (row, text) whose row may be in the (broadcast) bitmap of owners."""

    def run(batches):
        for batch in batches:
            some = batch.filter(pa.array(_marked(known.value, batch.column(0).to_numpy())))
            sids, sets = [], []
            for grams in words.shingles(some.column(1), size):
                if len(grams):
                    sids.append(set_id(grams))
                    sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "grams"])

    return docs.mapInArrow(run, "sid long, grams binary")


class Trie:
    """Sets as ascending ranks in a prefix tree with compressed paths, its nodes in the order of a
    walk (a subtree is a run of nodes), their parts one behind another.

    sizes: of the whole sets, where ranks without a second holder are left out.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        sizes = [len(s) for s in sets] if sizes is None else sizes
        self.held = np.zeros(1 + max((int(s[-1]) for s in sets if len(s)), default=0), np.int32)
        raw = [s.astype(">u4").tobytes() for s in sets]
        order = sorted((k for k in range(len(sets)) if len(sets[k])), key=raw.__getitem__)
        parts, leaf, after, tops = [], [], [], []
        stack = [(0, len(order), 0, True)] if order else []
        while stack:
            lo, hi, depth, top = stack.pop()
            if lo < 0:
                after[hi] = len(parts)
                continue
            first, last = sets[order[lo]], sets[order[hi - 1]]
            if hi - lo == 1:
                end = len(first)
            else:
                m = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:m] != last[depth:m])
                end = depth + int(differ[0]) if len(differ) else m
            if end > depth or hi - lo == 1:
                if top:
                    tops.append((len(parts), lo, hi))
                stack.append((-1, len(parts), 0, False))  # comes up once the subtree is done
                parts.append(first[depth:end])
                leaf.append(order[lo] if hi - lo == 1 else -1)
                after.append(0)
                top = False
            if hi - lo == 1:
                continue
            at = lo
            while at < hi:
                s = sets[order[at]]
                to = at + 1
                if len(s) > end:
                    while to < hi and sets[order[to]][end] == s[end]:
                        to += 1
                stack.append((at, to, end, top))
                at = to
        self.leaf, self.after = np.array(leaf, np.int64), np.array(after, np.int64)
        self.first = np.cumsum([0, *map(len, parts)])
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.sizes, self.alive = np.array(sizes, np.int64), np.ones(len(sets), bool)
        self.top, self.top_of = [t[0] for t in tops], np.full(len(sets), -1)
        self.top_alive = np.array([hi - lo for _, lo, hi in tops], np.int64)
        self.shortest, self.longest, self.deepest = np.zeros((3, len(tops)), np.int64)
        for k, (_, lo, hi) in enumerate(tops):
            below = order[lo:hi]
            self.top_of[below] = k
            self.shortest[k], self.longest[k] = self.sizes[below].min(), self.sizes[below].max()
            self.deepest[k] = max(len(sets[x]) for x in below)

    def retire(self, k: int) -> None:
        """Set k is no longer met by queries."""
        self.alive[k] = False
        if self.top_of[k] >= 0:
            self.top_alive[self.top_of[k]] -= 1

    def meet(self, q: np.ndarray, percent: int, same, size: int | None = None):
        """Sets k with `same(k)` false that reach the threshold with q (of `size` in all), as found. A
        subtree at the top is left out when what it and q have left cannot reach the overlap; in
        others, each part is met once, for all sets below it."""
        n = len(q) if size is None else size
        fits = (self.top_alive > 0) & (100 * self.longest >= percent * n) & (100 * n >= percent * self.shortest)
        if not len(q) or not fits.any():
            return
        self.held[q] = 1
        found = []
        for k in np.flatnonzero(fits).tolist():
            node = self.top[k]
            part = self.flat[self.first[node] : self.first[node + 1]]
            got, rest = int(self.held[part].sum()), len(q) - int(np.searchsorted(q, part[-1], side="right"))
            if got + min(rest, int(self.deepest[k]) - len(part)) < needed(n, int(self.shortest[k]), percent):
                continue
            to = int(self.after[node])
            first = self.first[node : to + 1]
            sums = np.zeros(first[-1] - first[0] + 1, np.int32)
            np.cumsum(self.held[self.flat[first[0] : first[-1]]], out=sums[1:])
            hits = np.diff(sums[first - first[0]])
            # What a node holds counts from it to the end of its subtree.
            path = np.cumsum(hits - np.bincount(self.after[node:to] - node, hits, to - node + 1)[:-1])
            leaf = self.leaf[node:to]
            at = np.flatnonzero(leaf >= 0)
            sets = leaf[at]
            links = self.alive[sets] & (path[at] * (100 + percent) >= percent * (n + self.sizes[sets]))
            found += sets[links].tolist()
        self.held[q] = 0
        for k in found:
            if not same(k):
                yield k


def join_block(sids: list[int], classes: list[int], sets: list[np.ndarray], percent: int = PERCENT):
    """Links (a, b) that connect all classes of the block which any of its links connects."""
    root = {c: c for c in classes}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    count = len(root)
    if count < 2:
        return
    grams, inverse, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-freq, kind="stable")] = np.arange(len(grams))
    shared = int(np.count_nonzero(freq > 1))  # n-grams of one set only are no overlap
    ranked = [np.sort(r[r < shared]) for r in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    trie = Trie(ranked, [len(s) for s in sets])
    members: dict[int, list[int]] = {}
    for k, c in enumerate(classes):
        members.setdefault(c, []).append(k)
    # Every pair of classes has a side in front of the last, the largest class.
    for c in sorted(members, key=lambda c: (len(members[c]), c))[:-1]:
        for k in members[c]:
            for x in trie.meet(ranked[k], percent, lambda x, c=c: find(classes[x]) == find(c), len(sets[k])):
                a, b = find(c), find(classes[x])
                root[max(a, b)] = min(a, b)
                count -= 1
                yield sids[k], sids[x]
            if count == 1:
                return
            trie.retire(k)


def _viable(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (key, sid, n, most, class) under keys of two classes or more that have, by size,
    a possible partner under their key: of sets in order of size, the next larger one is
    within `most`, or the next smaller one is large enough and some smaller one's `most`
    reaches this. Rows of one size count once, so a frequent key is no large group."""
    sizes = rows.groupBy("key", "n").agg(F.max("most").alias("most"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("c"))
    by_size = Window.partitionBy("key").orderBy("n")
    whole, before = Window.partitionBy("key"), by_size.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "key", "n", "c",
        (F.min("lo").over(whole) < F.max("hi").over(whole)).alias("mixed"),
        F.lead("n").over(by_size).alias("larger"), F.lag("n").over(by_size).alias("smaller"), F.max("most").over(before).alias("reach"),
    )
    below = (F.col("smaller") * 100 >= F.col("n") * percent) & (F.col("reach") >= F.col("n"))
    rows = rows.join(sizes.where("mixed").withColumnRenamed("key", "_key").withColumnRenamed("n", "_n"), F.expr("key = _key and n = _n"))
    return rows.where(((F.col("c") > 1) & (F.col("most") >= F.col("n"))) | (F.col("larger") <= F.col("most")) | below).select("key", "sid", "n", "most", "class")


def _viable_in_place(rows: DataFrame, percent: int) -> DataFrame:
    """What `_viable` gives for distinct rows (key, sid, n, most) whose sets are classes of their own, by
    one exchange for all: each n-gram's sets in order of size, in one task, so not for hot ones."""
    rows = rows.repartition("key").distinct()
    whole = Window.partitionBy("key")
    up, down = whole.orderBy("n"), whole.orderBy(F.col("n").desc())
    before, after = (w.rangeBetween(Window.unboundedPreceding, -1) for w in (up, down))
    rows = rows.select(
        "key", "sid", "n", "most",
        F.max("n").over(before).alias("smaller"), F.max("most").over(before).alias("reach"), F.count("*").over(up.rangeBetween(0, 0)).alias("c"),
        F.min("n").over(after).alias("larger"), (F.min("sid").over(whole) < F.max("sid").over(whole)).alias("mixed"),
    ).where("mixed")
    below = (F.col("smaller") * 100 >= F.col("n") * percent) & (F.col("reach") >= F.col("n"))
    return rows.where(((F.col("c") > 1) & (F.col("most") >= F.col("n"))) | (F.col("larger") <= F.col("most")) | below).select("key", "sid", "n", "most")


def _links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks (block, sid, class)."""
    spark = blocks.sparkSession

    def run(batches):
        now, sids, classes, arrays = None, [], [], []

        def close():
            if len(sids) > 1:
                found = list(join_block(sids, classes, arrays, percent))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for block, sid, cls, grams in zip(*(batch.column(c) for c in range(4)), strict=True):
                if block.as_py() != now:
                    yield from close()
                    now, sids, classes, arrays = block.as_py(), [], [], []
                if sid.as_py() not in sids[-1:]:
                    sids.append(sid.as_py())
                    classes.append(cls.as_py())
                    arrays.append(np.frombuffer(grams.as_buffer(), np.uint64).copy())
        yield from close()

    rows = sets.join(_broadcast_few(blocks), "sid").select("block", "sid", "class", "grams")
    return rows.repartition(2 * partitions(spark), "block").sortWithinPartitions("block", "sid").mapInArrow(run, "a long, b long")


def _split(rows: DataFrame, pairs: bool, most: int) -> DataFrame:
    """Blocks (block, sid, class) from rows (key, sid, n, class); a key of more than `most`
    n-grams in parts, or all pairs of parts."""
    parts = rows.groupBy("key").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts")).withColumnRenamed("key", "_key")
    out = rows.join(parts, F.col("key") == F.col("_key")).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    if pairs:
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        out = out.select("*", other).withColumn("part", F.least("part", "other") * 100000 + F.greatest("part", "other"))
    return out.select(F.xxhash64("key", "part").alias("block"), "sid", "class")


def _classes(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows (key, sid, n, most) with the class that the links give their set."""
    if links is None:
        return rows.withColumn("class", F.col("sid"))
    rows = rows.drop("class")
    return rows.join(components(links), F.col("sid") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "sid").alias("class"))


def _broadcast_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, ..., class) of keys that hold two classes or more."""
    keys = rows.groupBy("key").agg((F.min("class") < F.max("class")).alias("mixed")).where("mixed").select("key")
    return rows.join(keys, "key", "left_semi")


def _in_parts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in blocks (key, sid, n, class) of up to `PARTS` parts: each part alone; then, of
    blocks of several parts, one set of each class; then pairs of parts of blocks in which
    two classes are left."""
    found = materialise(_links(materialise(_split(members, False, CLUSTER), "ngram-blocks"), sets, percent), "ngram-links")
    many = members.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") > CLUSTER).select("key")
    many = materialise(members.join(many, "key", "left_semi"), "ngram-parts")
    if many.isEmpty():
        return found
    one = _classes(many, found).groupBy("key", "class").agg(F.min(F.struct("sid", "n")).alias("s")).select("key", "s.sid", "s.n", "class")
    more = materialise(_links(materialise(_split(_mixed(one), False, BLOCK), "ngram-blocks"), sets, percent), "ngram-links")
    found = found.union(more)
    left = materialise(_mixed(_classes(many, found)), "ngram-parts")
    if left.isEmpty():
        return found
    return found.union(materialise(_links(materialise(_split(left, True, CLUSTER), "ngram-blocks"), sets, percent), "ngram-links"))


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n, component_id, root (a class of linked or equal sets, null
    for a set of its own) for every row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    both = materialise(_profile(docs, size), "ngram-profile")
    profile = both.where("chunk is null").select("doc_id", "th", "n", "sid")
    known = spark.sparkContext.broadcast(_frequencies(both))
    pref = materialise(_prefixes(docs, size, percent, known), "ngram-prefixes")
    known.destroy()  # the workers of later stages need its memory
    shared = pref.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", "c")
    shared = materialise(shared, "ngram-shared")
    known = spark.sparkContext.broadcast(_bitmap(shared.select("key")))
    rows = _only_marked(pref, known, 0)
    hot = shared.where(F.col("c") > HOT_KEY).select("key")
    if hot.isEmpty():
        every = _viable_in_place(rows, percent)
    else:
        # At most one n-gram in `HOT_KEY` rows is hot.
        few = _viable_in_place(rows.join(_broadcast_few(hot), "key", "left_anti"), percent)
        every = few.union(_viable(_classes(rows.join(_broadcast_few(hot), "key", "left_semi").distinct(), None), percent).select(*few.columns))
    every = materialise(every, "ngram-viable")
    known.destroy()
    drop(pref)
    drop(shared)

    owner = profile.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("o"))
    owner = owner.join(every.select("sid").distinct(), "sid", "left_semi").select(F.xxhash64("o.doc_id", "o.th").alias("row"))
    known = spark.sparkContext.broadcast(_bitmap(owner))
    sets = materialise(_sets(docs.select(F.xxhash64("doc_id", "th").alias("row"), "text"), size, known), "ngram-sets")
    known.destroy()

    def find(rows, pairs=False):
        rows = materialise(rows, "ngram-round")
        if rows.isEmpty():
            return None
        blocks = materialise(_split(_distinct_keys(rows), pairs, BLOCK), "ngram-blocks")
        return materialise(_links(blocks, sets, percent), "ngram-links")

    low = every.groupBy("key").agg(F.min("sid").alias("low"))
    clusters = components(every.join(low, "key").select(F.col("sid").alias("a"), F.col("low").alias("b")).distinct())
    members = every.groupBy("sid").agg(F.first("n").alias("n")).join(clusters, F.col("sid") == F.col("node")).select("sid", "n", "component")
    total = members.groupBy("component").agg(F.sum("n").alias("total")).withColumnRenamed("component", "_component")
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    bands = F.when(F.col("total") <= CLUSTER, F.array(F.lit(-9))).otherwise(F.array(band, band - 1))
    members = members.join(total, F.col("component") == F.col("_component")).select("sid", "n", F.col("sid").alias("class"), "component", F.explode(bands).alias("band"))
    members = materialise(members.select(F.xxhash64("component", "band").alias("key"), "sid", "n", "class"), "ngram-members")
    huge = members.groupBy("key").agg(F.sum("n").alias("total")).where(F.col("total") > PARTS * CLUSTER).select("key")
    links = _in_parts(members.join(huge, "key", "left_anti"), sets, percent)
    every = materialise(every.join(members.join(huge, "key", "left_semi").select("sid").distinct(), "sid", "left_semi").select("key", "sid", "n", "most"), "ngram-large")
    if not every.isEmpty():
        found = None

        def add(rows, pairs=False):
            more = find(rows, pairs)
            return more if found is None else found if more is None else found.union(more)

        first = every.groupBy("sid").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key", "n", "most")).alias("k")).select("k.key", "sid", "k.n", "k.most")
        found = add(_viable(_classes(first, None), percent))
        one = _viable(_classes(every, found), percent).groupBy("key", "class").agg(F.min(F.struct("sid", "n", "most")).alias("s")).select("key", "s.sid", "s.n", "s.most", "class")
        found = add(_viable(one, percent))
        found = add(_viable(_classes(every, found), percent), True)
        if found is not None:
            links = links.union(found)
    classes = components(links)

    ids = profile.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("c"))
    ids = ids.join(classes, ids["sid"] == classes["node"], "left").where("c > 1 or component is not null").select("sid", "low", F.coalesce("component", "sid").alias("root"))
    ids = materialise(ids, "ngram-ids")
    least = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    member = ids.join(least, "root").select("sid", "component_id", "root")
    return profile.join(member, "sid", "left").select("doc_id", "th", "n", F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Null texts and texts without words have an empty set, link with nothing, and are their
    own class. With fewer words than `size` the whole sequence is the only n-gram. Rows
    with equal sets are one class; component_id is its smallest doc_id. Rows with a null id
    link like others and count for the smallest id only where no other is. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    return _linked(docs, id_col, text_col, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _distinct_keys(rows: DataFrame) -> DataFrame:
    """One key of those that hold the same sets."""
    held = rows.groupBy("key").agg(F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("c"))
    keep = held.groupBy("sum", "c").agg(F.min("key").alias("key")).select("key")
    return rows.join(keep, "key", "left_semi")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each class: that of the smallest id, then of the smallest hash of
    the text; rows without an id come last.

    Rows are told apart by id and text, so a row goes only for its own text; of rows equal
    in both, one stays. Rows without words are classes of their own and all stay.
    """
    row, th, gone_id, gone_th = (free_name(docs, x) for x in ("_class", "_th", "_gone_id", "_gone_th"))
    linked = materialise(_linked(docs, id_col, text_col, size, percent).where("root is not null").select("doc_id", "th", "root"), "ngram-linked")
    best = linked.groupBy(F.col("root").alias(row)).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    stays = F.col("k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k.th") == F.col("th"))
    of_class = materialise(linked.join(best, F.col("root") == F.col(row)).select("doc_id", "th", stays.alias("stays")), "ngram-kept")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(th) == F.col(gone_th))

    def keys(df):
        return _broadcast_few(df.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct())

    kept = docs.withColumn(th, F.xxhash64(text_col)).join(keys(of_class.where("!stays")), same, "left_anti")
    again = materialise(of_class.where("stays").groupBy("doc_id", "th").count().where("count > 1"), "ngram-repeats")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(keys(again), same, "left_anti")
    return once.union(kept.join(keys(again), same, "left_semi").dropDuplicates([id_col, th])).select(*docs.columns)


def op4_ngram_jaccard(spark, sf_dir):
    """Classes of linked documents."""
    return link_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p where 100 * c >= 75 * (na + nb - c)), y as (select a, b from l union all select b, a from l),
cc(node, root) using key (node) as (select doc_id, doc_id from documents union select y.b, min(cc.root) from cc join y on y.a = cc.node join recurring.cc r on r.node = y.b where cc.root < r.root group by y.b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, cc.root as component_id from s join cc on s.doc_id = cc.node
"""

QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLES = {"op4_ngram_jaccard": ORACLE}
