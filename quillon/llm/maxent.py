"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class). Classes: the `TOP` most frequent
words are a class each, so that features choose them as words; other words are put in
`GROUPS` groups by their ends, clustered by the documents they occur in, and each group has a
class of frequent words and one of rare and unseen words; the end is a class of its own.
The class softmax has hashed n-gram and skip features (the word before, the two before as a
pair, the words two and three before). It is trained by distributed gradient updates, in
`ROUNDS` rounds, each over all training documents: tasks sum how often each feature met each
class, which is the same in every round, and how often the model of the round before expects
it to (at weights of 0 that has a closed form); the difference of the two sums is the gradient
of the likelihood, and one step of iterative scaling from the smoothed sums updates the weights
for all. Sums do not depend on how documents lie in partitions, so neither do the weights, up
to rounding.
P(word | class) is the softmax of a bias for each word, whose optimum is the relative
count; rare classes keep an absolute discount for unseen words.

Counts cover all training documents. Frequent words live in a table of 2^`SLOT_BITS`
slots, the most frequent word of each slot, whatever the input; tokens of all other words
meet their exact counts in a join. All that a task or the driver holds has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words
from quillon.session import drop, materialise, ship

SLOT_BITS = 20
FREQUENT = 3
END_BITS = 11
PIVOTS = 64
GROUPS = 12
TOP = 40
END = 2 * GROUPS
CLASSES = END + 1 + TOP
FEATURE_BITS = 16
FEATURES = 4
#: Of the first round and of later ones: the share of a whole step, and documents a feature must
#: outweigh. One shard: a round takes all documents.
ROUNDS, SHARDS, RATES, SMOOTH = 2, 1, (0.5, 0.2), 10.0
STEP = 32768
#: Tokens whose weights are summed at once, so that they stay in the processor's cache.
ROWS = 1024
TURNS = 16
#: Tasks that send sums of fixed size (17 MB each); two a core where that is more.
SENDERS = 16
#: Partitions of the scan that one task sums up; senders whose sums one task adds up.
EACH, BRANCHES = 4, 64
DISCOUNT = 0.5
CHUNK = 1 << 10
#: Shares of a document's words are whole multiples of this, so that their sums are exact.
SHARE = 1 / 4096
END_HASH = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, FEATURES + 2, dtype=np.uint64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of `END_BITS` bits of the last three bytes of words, one closing mark put aside."""
    end = end - (_PUNCTUATION[data[end - 1]] & (end - start > 1))
    pack = np.zeros(len(start), np.uint64)
    for j in range(3):
        at = end - 1 - j
        pack |= np.where(at >= start, words._FOLD[data[np.maximum(at, 0)]].astype(np.uint64), np.uint64(0)) << np.uint64(8 * j)
    return (words.mix(pack + _SALTS[-1]) >> np.uint64(64 - END_BITS)).astype(np.int64)


def tokenise(column):
    """Hashes, documents and ends' hashes of the words of a slice."""
    data, offsets = words.utf8(column)
    parts = [(h, d, word_ends(data, s, e)) for h, d, s, e in words.words(data, offsets)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _merge(parts):
    """Sum counts of equal words over parts (hash, end, count)."""
    h, e, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, e[first], np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)


COUNTS = "hash long, word_end short, n long, chunk int, sums binary"


def _count(docs: DataFrame) -> DataFrame:
    """Rows of words (hash, word_end, n), and a task's sums of word ends by pivots."""

    def run(batches):
        sums = np.zeros((1 << END_BITS, PIVOTS))
        parts, held, n_docs = [], 0, 0

        def flush():
            h, e, c = _merge(parts)
            nulls = pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int16)), pa.array(c), *nulls], names=["hash", "word_end", "n", "chunk", "sums"])

        for batch in batches:
            for a, b in words.slices(batch.column(0)):
                n = b - a
                n_docs += n
                h, d, e = tokenise(batch.column(0).slice(a, n))
                if not len(h):
                    continue
                pivot = (h & np.uint64(PIVOTS - 1)).astype(np.int64)
                by_pivot = np.bincount(d * PIVOTS + pivot, minlength=n * PIVOTS).reshape(n, PIVOTS).astype(np.float64)
                by_pivot = np.floor(by_pivot / np.maximum(by_pivot.sum(1, keepdims=True), 1) / SHARE)
                for lo in range(0, n, 512):
                    some = (d >= lo) & (d < lo + 512)
                    rows = min(512, n - lo)
                    by_end = np.bincount((d[some] - lo << END_BITS) + e[some], minlength=rows << END_BITS).reshape(rows, -1).astype(np.float64)
                    sums += by_end.T @ by_pivot[lo : lo + rows]
                parts.append(_merge([(h, e, np.ones(len(h)))]))
                held += len(parts[-1][0])
                if held > 1 << 20:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 20:
                        yield flush()
                        parts, held = [], 0
        end = np.array([END_HASH]), np.array([0]), np.array([n_docs])
        parts.append(end)
        yield flush()
        one = [pa.nulls(1, t) for t in (pa.int64(), pa.int16(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*one, pa.array([0], pa.int32()), pa.array([sums.tobytes()])], names=["hash", "word_end", "n", "chunk", "sums"])

    return docs.select("text").mapInArrow(run, COUNTS)


def _add(rows: DataFrame, chunks: int) -> dict[int, np.ndarray]:
    """Sums over tasks of vectors (chunk, sums) of 64 bits; of fixed size in all."""

    def run(batches):
        sums = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, np.float64)
                sums[k] = sums[k] + c if k in sums else c
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()])], names=["chunk", "sums"])

    out: dict[int, np.ndarray] = {}
    for k, c in rows.select("chunk", "sums").repartition(chunks, "chunk").mapInArrow(run, "chunk int, sums binary").collect():
        out[k] = out.get(k, 0) + np.frombuffer(c, np.float64)
    return out


def cluster(sums: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each word end: weighted k-means of the roots of its shares of pivots."""
    weight = sums.sum(1)
    x = np.sqrt(sums / np.maximum(weight, 1e-9)[:, None])
    centre = [x[int(np.argmax(weight))]]
    for _ in range(groups - 1):
        far = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0) * weight
        centre.append(x[int(np.argmax(far))])
    centre = np.array(centre)
    for _ in range(25):
        own = np.argmin(((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)), axis=1)
        for g in range(groups):
            if weight[own == g].sum() > 0:
                centre[g] = np.average(x[own == g], axis=0, weights=weight[own == g])
    return own


class Table:
    """Frequent words by slot, groups of word ends, and what the counts give in all."""

    def __init__(self, hashes, counts, ends, group, rare_sum, rare_types, n, v, end_count):
        self.hash, self.count = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.hash[slot], self.count[slot] = hashes, counts
        self.group, self.n, self.v, self.end_count = group.astype(np.int64), n, v, end_count
        # The most frequent words, by count and then by hash, in order of their hashes.
        top = np.lexsort((hashes, -counts))[:TOP]
        top = top[np.argsort(hashes[top])]
        self.top = hashes[top]
        frequent = np.bincount(group[ends], weights=counts, minlength=GROUPS) - np.bincount(group[ends[top]], weights=counts[top], minlength=GROUPS)
        rare = np.bincount(group, weights=rare_sum, minlength=GROUPS)
        types = np.bincount(group, weights=rare_types, minlength=GROUPS)
        self.frequent = np.maximum(frequent, 1)
        self.rare = rare + 1
        self.unseen = (DISCOUNT * types + 1) / self.rare
        alone = np.zeros(TOP)
        alone[: len(top)] = counts[top]
        total = np.concatenate([frequent, rare, [end_count], alone]) + 1
        self.bias = np.log(total / total.sum()).astype(np.float32)

    @property
    def base(self) -> float:
        return self.n + 0.1 * (self.v + 1)

    def sequence(self, column):
        """Tokens of a slice, ends included: (hash, document, class, frequent?, count of a
        frequent word, group, one of the most frequent?), and the feature slots of each token."""
        h, d, e = tokenise(column)
        n_docs = len(column)
        first = np.searchsorted(d, np.arange(n_docs + 1))
        size = len(h) + n_docs
        at = np.arange(len(h)) + d
        closing = first[1:] + np.arange(n_docs)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = self.hash[slot] == h
        group = self.group[e]
        hashes, doc = np.full(size, END_HASH), np.empty(size, np.int64)
        hashes[at], doc[at], doc[closing] = h, d, np.arange(n_docs)
        often, count, groups = np.zeros(size, bool), np.zeros(size, np.int64), np.full(size, -1)
        often[at], count[at], groups[at] = known, np.where(known, self.count[slot], 0), group
        cls = np.full(size, END)
        cls[at] = np.where(known, group, GROUPS + group)
        alone = np.zeros(size, bool)
        if len(self.top):
            place = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
            alone[at] = self.top[place] == h
            cls[at] = np.where(alone[at], END + 1 + place, cls[at])
        seen = np.where(often, hashes, words.mix(groups.astype(np.uint64) + _SALTS[-2]))
        return hashes, doc, cls, often, count, groups, alone, self._features(seen, doc)

    @staticmethod
    def _features(seen: np.ndarray, doc: np.ndarray) -> np.ndarray:
        back = []
        for k in (1, 2, 3):
            w = np.zeros(len(seen), np.uint64)
            w[k:] = np.where(doc[k:] == doc[:-k], seen[:-k], np.uint64(0)) if len(seen) > k else w[k:]
            back.append(w)
        keys = [back[0] + _SALTS[0], back[0] * np.uint64(3) + words.mix(back[1] + _SALTS[1]), back[1] + _SALTS[2], back[2] + _SALTS[3]]
        out = np.empty((len(seen), FEATURES), np.int32)
        for k, key in enumerate(keys):
            out[:, k] = (words.mix(key) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        return out


def small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no sum of a token's weights is so large or so low that its exponential leaves 32 bits."""
    return FEATURES * max(weights.max(), -weights.min()) + np.abs(bias).max() < 80


def class_sums(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, safe: bool = False) -> np.ndarray:
    """Sums of weights of each token's features, one row for each token; the largest is 0 unless
    weights are known to be `small`."""
    z = np.empty((len(slots), CLASSES), np.float32)
    for i in range(0, len(slots), ROWS):
        some = slots[i : i + ROWS]
        part = weights.take(some[:, 0], axis=0)
        for k in range(1, FEATURES):
            part += weights.take(some[:, k], axis=0)
        np.add(part, bias, out=z[i : i + ROWS])
    if not safe:
        z -= z.max(1, keepdims=True)
    return z


def class_logs(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural logs of class probabilities, one row for each token."""
    z = class_sums(weights, bias, slots)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def own_logs(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, cls: np.ndarray, safe: bool = False) -> np.ndarray:
    """Natural logs of the probabilities of the tokens' own classes."""
    z = class_sums(weights, bias, slots, safe)
    own = z[np.arange(len(z)), cls]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(CLASSES, np.float32))


def expect(out: np.ndarray, weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> None:
    """Adds to `out` (features, classes) how often the model expects each, for tokens.

    A feature's tokens are added by turns: its first, its second and so on, each turn for all
    features that have one; from the `TURNS`-th on, feature by feature.
    """
    safe, ones = small(weights, bias), np.ones(CLASSES, np.float32)
    for i in range(0, len(slots), STEP):
        some = slots[i : i + STEP]
        p = class_sums(weights, bias, some, safe)
        np.exp(p, out=p)
        p *= (1 / (p @ ones))[:, None]
        flat = some.T.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat, token = flat[order], order % len(some)
        start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        count = np.diff(np.append(start, len(flat)))
        longest = np.argsort(-count, kind="stable")
        start, count = start[longest], count[longest]
        sums = p.take(token[start], axis=0)
        for k in range(1, TURNS):
            n = int(np.searchsorted(-count, -k))
            sums[:n] += p.take(token[start[:n] + k], axis=0)
        for j in range(int(np.searchsorted(-count, -TURNS))):
            sums[j] += p.take(token[start[j] + TURNS : start[j] + count[j]], axis=0).sum(0)
        rows = flat[start]
        total = out.take(rows, axis=0)
        total += sums
        out[rows] = total


def _sums(docs: DataFrame, table, weights: np.ndarray | None) -> np.ndarray:
    """Counts of features and classes over all tasks: observed ones, or with weights expected ones."""
    spark = docs.sparkSession
    now = spark.sparkContext.broadcast(weights)
    size = np.uint32 if weights is None else np.float32

    def run(batches):
        known, w = table.value, now.value
        sums = np.zeros((1 << FEATURE_BITS, CLASSES), np.int64 if w is None else np.float64)
        for batch in batches:
            for a, b in words.slices(batch.column(0)):
                _, _, cls, *_, slots = known.sequence(batch.column(0).slice(a, b - a))
                if w is None:
                    for k in range(FEATURES):
                        np.add.at(sums.reshape(-1), slots[:, k].astype(np.int64) * CLASSES + cls, 1)
                else:
                    expect(sums, w, known.bias, slots)
        for k in range((1 << FEATURE_BITS) // CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k * CHUNK : (k + 1) * CHUNK].astype(size).tobytes()])], names=["chunk", "sums"])

    def add(batches, kind):
        sums = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, kind)
                if k not in sums:
                    sums[k] = np.zeros(len(c), np.int64 if kind is np.uint32 else np.float64)
                sums[k] += c
        for k, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c.astype(np.float64).tobytes()])], names=["chunk", "sums"])

    chunks = (1 << FEATURE_BITS) // CHUNK
    senders = max(SENDERS, 2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // EACH)
    sent = docs.select("text").coalesce(senders).mapInArrow(run, "chunk int, sums binary")
    kind = size
    if senders > BRANCHES:  # sums of some senders first, so that no task adds up those of all
        some = -(-senders // BRANCHES)
        dealt = sent.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(some))).repartition(chunks * some, "chunk", "branch").select("chunk", "sums")
        sent, kind = dealt.mapInArrow(lambda it: add(it, size), "chunk int, sums binary"), np.float64
    rows = sent.repartition(chunks, "chunk").mapInArrow(lambda it: add(it, kind), "chunk int, sums binary")
    out = np.zeros((1 << FEATURE_BITS, CLASSES))
    for k, c in rows.toLocalIterator():
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(c, np.float64).reshape(CHUNK, CLASSES)
    now.destroy()
    return out


def scaled(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray | None, bias: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one step. Without expectations, weights are 0 and each token of a feature
    expects the classes by their shares."""
    share = np.exp(bias.astype(np.float64))
    share = share / share.sum()
    if expected is None:
        expected = observed.sum(1, keepdims=True) * share
    return (weights + rate * np.log((observed + SMOOTH * share) / (expected + SMOOTH * share))).astype(np.float32)


class Model:
    """A trained model: table of words, class weights, and exact counts of all words."""

    def __init__(self, table: Table, weights: np.ndarray, vocabulary: DataFrame):
        self.table, self.weights, self.vocabulary = table, weights, vocabulary


def train(docs: DataFrame, text_col: str = "text", key_col: str | None = None) -> Model:
    """Train on every row of `docs`, in every round. Null texts are empty: their end is a token too.

    key_col is not read: no round leaves documents out, so none are dealt.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(text_col).alias("text"))
    raw = materialise(_count(docs), "lm-counts")
    vocabulary = materialise(raw.where("chunk is null").groupBy("hash").agg(F.sum("n").alias("c"), F.min("word_end").alias("word_end")).where("c > 0"), "lm-words")
    group = cluster(_add(raw.where("chunk is not null"), 1).get(0, np.zeros(PIVOTS << END_BITS)).reshape(-1, PIVOTS))
    drop(raw)
    end_hash = int(END_HASH.view(np.int64))
    n, v, end = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("hash") == end_hash, F.col("c"))), F.lit(0))).first()
    real = vocabulary.where(F.col("hash") != end_hash)
    often = real.where(F.col("c") >= FREQUENT).groupBy(F.shiftrightunsigned("hash", 64 - SLOT_BITS)).agg(F.max(F.struct("c", "hash", "word_end")).alias("w")).select("w.c", "w.hash", "w.word_end")
    top = often.toArrow()
    h, c, e = top["hash"].to_numpy().view(np.uint64), top["c"].to_numpy(), top["word_end"].to_numpy().astype(np.int64)
    ends = real.groupBy("word_end").agg(F.sum("c").alias("c"), F.count("*").alias("t")).collect()
    rare_sum, rare_types = np.zeros(1 << END_BITS), np.zeros(1 << END_BITS)
    for k, s, t in ends:
        rare_sum[k], rare_types[k] = s, t
    rare_sum -= np.bincount(e, weights=c, minlength=len(rare_sum))
    rare_types -= np.bincount(e, minlength=len(rare_types))
    made = Table(h, c, e, group, rare_sum, rare_types, n, v, end)
    table = spark.sparkContext.broadcast(made)
    weights = np.zeros((1 << FEATURE_BITS, CLASSES), np.float32)
    observed = _sums(docs, table, None)
    for k in range(ROUNDS):
        weights = scaled(weights, observed, _sums(docs, table, weights) if k else None, made.bias, RATES[min(k, 1)])
    table.unpersist()
    return Model(made, weights, vocabulary)


SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, hash long, tf long, grp int"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    Whole texts in one pass; tokens outside the table of frequent words then meet their
    counts in a join by word, and are summed by row. Null texts are empty and consist of
    their end; repeated rows and null ids are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast((model.table, model.weights))
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches):
        table, weights = known.value
        row = TaskContext.get().partitionId() << 40
        log_base = np.log10(table.base)
        log_in = np.log10(table.frequent)
        safe = small(weights, table.bias)
        for batch in batches:
            for a, b in words.slices(batch.column(1)):
                n = b - a
                some = batch.slice(a, n)
                hashes, doc, cls, often, count, groups, alone, slots = table.sequence(some.column(1))
                logs = np.empty(len(cls))
                for i in range(0, len(cls), STEP):
                    logs[i : i + STEP] = own_logs(weights, table.bias, slots[i : i + STEP], cls[i : i + STEP], safe)
                logs /= np.log(10)
                inside = often & ~alone  # a class of one word holds it with certainty
                logs[inside] += np.log10(count[inside]) - log_in[groups[inside]]
                base = np.zeros(len(cls))
                base[often] = np.log10(count[often] + 0.1) - log_base
                closing = groups < 0
                base[closing] = np.log10(table.end_count + 0.1) - log_base
                sure = often | (closing & (table.end_count > 0))
                rows = row + np.arange(n)
                per_doc = [np.bincount(doc, minlength=n), np.bincount(doc, weights=sure, minlength=n).astype(np.int64), np.bincount(doc, weights=base, minlength=n), np.bincount(doc, weights=logs, minlength=n)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), some.column(0), *map(pa.array, per_doc), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32()))], names=names)
                rest = np.flatnonzero(~often & ~closing)
                if len(rest):
                    order = rest[np.lexsort((hashes[rest], doc[rest]))]
                    new = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.append(True, hashes[order][1:] != hashes[order][:-1])))
                    k, m = order[new], len(new)
                    tf = np.diff(np.append(new, len(order)))
                    empty = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(row + doc[k]), *empty, pa.array(hashes[k].view(np.int64)), pa.array(tf), pa.array(groups[k].astype(np.int32))], names=names)
                row += n

    table = model.table
    made = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED), "lm-scores")
    rest = made.where("hash is not null").select("row", "hash", "tf", "grp").join(model.vocabulary.select("hash", "c"), "hash", "left")
    rare, unseen = (F.get(F.array(*[F.lit(float(x)) for x in xs]), F.col("grp")) for xs in (table.rare, table.unseen))
    share = F.coalesce((F.col("c") - DISCOUNT) / rare, unseen)
    sums = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("r_known"),
        F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(table.base)))).alias("r_base"),
        F.sum(F.col("tf") * F.log10(share)).alias("r_score"),
    )
    rows = made.where("hash is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    zero = F.lit(0)
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("r_known", zero)).alias("n_known"), F.lit(int(table.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("r_score", zero)).alias("score"),
    )


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 10, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op8_maxent_scores(spark, sf_dir):
    """Scores of all documents, by a model of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, train(docs.where(~held_out()), key_col="doc_id"))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_maxent_scores": op8_maxent_scores}
ORACLES = {}
