"""Toxic spans by a linear-chain conditional random field over words.

Words are runs of letters, digits and non-ASCII bytes, A-Z folded. A chain of two states
(clean, toxic) has emission weights of hashed features: the word, its first 3 to 6 bytes,
its last 3, and the words before and after; and transition weights. It is fitted on a
sample of at most `SAMPLE` labelled documents of `FIT_BYTES` bytes in all: tokens get labels from document labels (a
feature that at least `SUPPORT` toxic documents hold, and of whose documents at least
`PURITY` are toxic, marks its tokens in toxic documents); toxic documents without such a
token are left out of the chain's fit. Forward-backward marginals of a document's words
give the expected number of toxic words and the largest marginal, which a logistic
function fitted on the same documents turns into a score; runs of words with a marginal
of 0.5 or more are the offending spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import tokens, words
from quillon.session import ship

SAMPLE = 6000
FIT_BYTES = 64 << 20
BITS = 18
SUPPORT = 4
PURITY = 0.9
ROUNDS = 40
BLOCK = 256
FIT_RUN = 1 << 18
SPACE = np.ones(256, bool)
SPACE[128:] = False
SPACE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_SALTS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, 8, dtype=np.uint64)
KINDS = 6  # of features of a word alone
OUT = "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Feature hashes (64 bits) of words, one column for each of `KINDS`."""
    n = end - start
    out = np.empty((len(h), KINDS), np.uint64)
    out[:, 0] = h
    pack = np.zeros(len(h), np.uint64)
    for j in range(6):
        at = np.minimum(start + j, len(data) - 1)
        pack |= np.where(j < n, _FOLD[data[at]], np.uint64(0)) << np.uint64(8 * j)
        if j >= 2:
            out[:, j - 1] = words.mix(pack ^ _SALTS[j])
    tail = np.zeros(len(h), np.uint64)
    for j in range(3):
        tail |= np.where(j < n, _FOLD[data[np.maximum(end - 1 - j, 0)]], np.uint64(0)) << np.uint64(8 * j)
    out[:, 5] = words.mix(tail ^ _SALTS[0])
    return out


def tokenise(column):
    """Words of a batch: hashes, documents, starts, ends (bytes of the batch), the bytes and offsets."""
    data, offsets = words.utf8(column)
    parts = list(words.words(data, offsets, True, SPACE))
    if not parts:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e, data, offsets
    return (*(np.concatenate([p[k] for p in parts]) for k in range(4)), data, offsets)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def neighbours(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the words before and after, 0 at a document's ends."""
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    before[1:], after[:-1] = words.mix(h[:-1] ^ _SALTS[6]), words.mix(h[1:] ^ _SALTS[7])
    before[first], after[last] = 0, 0
    return before, after


def _scan(num, den, start):
    """r_t = (num0 + num1 r_{t-1}) / (den0 + den1 r_{t-1}) along one long chain, blocked.

    num, den: arrays (2, n). Blocks' maps are composed side by side, chained, and replayed.
    """
    n = num.shape[1]
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    c, d = (np.pad(x, (0, pad)).reshape(rows, BLOCK).T.copy() for x in num)
    a, b = (np.pad(x, (0, pad), constant_values=1).reshape(rows, BLOCK).T.copy() for x in den)
    # Map r -> (p + q r) / (s + t r), at first the identity.
    p, q, s, t = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)
    for k in range(BLOCK):
        p, q, s, t = c[k] * s + d[k] * p, c[k] * t + d[k] * q, a[k] * s + b[k] * p, a[k] * t + b[k] * q
        scale = 1 / (s + t + p + q)
        p, q, s, t = p * scale, q * scale, s * scale, t * scale
    into, r = np.empty(rows), start
    for k in range(rows):
        into[k] = r
        r = (p[k] + q[k] * r) / (s[k] + t[k] * r)
    out = np.empty((BLOCK, rows))
    r = into
    for k in range(BLOCK):
        r = (c[k] + d[k] * r) / (a[k] + b[k] * r)
        out[k] = r
    return out.T.reshape(-1)[:n]


def marginals(u: np.ndarray, first: np.ndarray, last: np.ndarray, move: np.ndarray, begin: float):
    """(marginals of the toxic state, pair marginals n x 4 between a word and the one before).

    u: log-odds of emissions; first, last: each document's first and last word; move: 2 x 2
    transition weights; begin: log-odds of the first state. All documents are one chain in
    which a first word forgets what is before it and a last word what is after it.
    """
    n = len(u)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    e = np.exp(np.clip(u, -30, 30))
    w = np.exp(move)
    num, den = np.stack([e * w[0, 1], e * w[1, 1]]), np.stack([np.full(n, w[0, 0]), np.full(n, w[1, 0])])
    num[0, first], num[1, first], den[0, first], den[1, first] = e[first] * np.exp(begin), 0, 1, 0
    forward = _scan(num, den, 1.0)
    following = np.append(e[1:], 1.0)
    num, den = np.stack([np.full(n, w[1, 0]), w[1, 1] * following]), np.stack([np.full(n, w[0, 0]), w[0, 1] * following])
    num[0, last], num[1, last], den[0, last], den[1, last] = 1, 0, 1, 0
    backward = _scan(num[:, ::-1], den[:, ::-1], 1.0)[::-1]
    odds = forward * backward
    before = np.append(1.0, forward[:-1])
    pair = np.stack([np.full(n, w[0, 0]), w[0, 1] * e * backward, before * w[1, 0], before * w[1, 1] * e * backward], 1)
    pair /= pair.sum(1, keepdims=True)
    pair[first] = 0
    return odds / (1 + odds), pair


def aggregates(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: log of the expected number of toxic words, largest marginal as log-odds."""
    total = np.bincount(doc, weights=p, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.log(total + 1e-3), np.log(most / (1 - most))], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias, scaled columns) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
    return w


def _types(texts):
    """Different words (hashes) of a string column and their features; of all words the type and
    the document, 32 bits each."""
    data, offsets = words.utf8(texts)
    parts = []
    for h, doc, start, end in words.words(data, offsets, True, SPACE):
        some, rep, which = np.unique(h, return_index=True, return_inverse=True)
        parts.append((some, start[rep], end[rep], which.astype(np.int32), doc.astype(np.int32)))
    if not parts:
        e = np.zeros(0, np.int32)
        return np.zeros(0, np.uint64), np.zeros((0, KINDS), np.uint64), e, e
    types, rep = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
    start, end = (np.concatenate([p[k] for p in parts])[rep] for k in (1, 2))
    kind = np.concatenate([np.searchsorted(types, p[0]).astype(np.int32)[p[3]] for p in parts])
    return types, features(data, start, end, types), kind, np.concatenate([p[4] for p in parts])


def fit_model(texts, toxic: np.ndarray) -> dict:
    """The chain's weights and the score's, from texts (a string column) and 0/1 labels."""
    n = len(texts)
    toxic = np.asarray(toxic, np.float64)
    model = {"word": np.zeros(1 << BITS, np.float32), "before": np.zeros(1 << BITS, np.float32), "after": np.zeros(1 << BITS, np.float32), "move": np.array([[0.0, -3.0], [0.0, 0.0]]), "begin": -3.0, "bias": -4.0, "score": np.array([-4.0, 0.0, 0.0])}
    types, tf, kind, doc = _types(texts)
    if not len(kind) or not toxic.any() or toxic.all():
        model["score"][0] = 6.0 if n and toxic.all() else -6.0
        return model
    first = np.flatnonzero(np.diff(doc, prepend=np.int32(-1)))
    size = len(kind)
    last = np.append(first[1:], size) - 1
    # Runs of whole documents, so that a step's memory does not follow the sample.
    cuts = [0, *(int(k) for k in first[np.flatnonzero(np.diff(first // FIT_RUN)) + 1]), size]
    runs = list(zip(cuts[:-1], cuts[1:], strict=True))
    # Documents that hold a feature, toxic and not.
    marked = np.zeros(len(types), bool)
    for k in range(5):
        if k in (1, 2):
            continue  # three or four bytes are too short to tell
        groups, of_type = np.unique(tf[:, k], return_inverse=True)
        bad, seen = np.zeros(len(groups)), np.zeros(len(groups))
        for i, j in runs:
            pairs = np.unique(of_type[kind[i:j]].astype(np.int64) * n + doc[i:j])
            bad += np.bincount(pairs // n, weights=toxic[pairs % n], minlength=len(groups))
            seen += np.bincount(pairs // n, minlength=len(groups))
        marked |= ((bad >= SUPPORT) & (bad >= PURITY * seen))[of_type]
    y = marked[kind] & (toxic > 0)[doc]
    told = np.bincount(doc, weights=y, minlength=n)
    use = ((toxic == 0) | (told > 0))[doc]
    slots = _slot(tf)
    # Neighbours' features by type; 0 at a document's ends.
    bslot, aslot = np.zeros(size, np.int32), np.zeros(size, np.int32)
    bslot[1:], aslot[:-1] = _slot(words.mix(types ^ _SALTS[6]))[kind[:-1]], _slot(words.mix(types ^ _SALTS[7]))[kind[1:]]
    bslot[first], aslot[last] = 0, 0
    n_types = len(types)
    del tf, types
    moves = 2 * np.append(False, y[:-1]).astype(np.int8) + y
    moves[first] = -1
    told_moves = np.bincount(moves[use & (moves >= 0)], minlength=4).astype(np.float64)
    del moves

    def step(keep: np.ndarray | None = None):
        """Gaps of all words and sums of pairs; marginals go to `keep`."""
        gap, pairs = np.empty(size), np.zeros(4)
        emit = model["word"][slots].sum(1) + model["bias"]
        for i, j in runs:
            u = emit[kind[i:j]] + model["before"][bslot[i:j]] + model["after"][aslot[i:j]]
            in_run = (first >= i) & (first < j)
            p, pair = marginals(u, first[in_run] - i, last[in_run] - i, model["move"], model["begin"])
            gap[i:j] = np.where(use[i:j], p - y[i:j], 0.0)
            pairs += pair[use[i:j]].sum(0)
            if keep is not None:
                keep[i:j] = p
        return gap, pairs

    squares = {k: np.full(1 << BITS, 1e-8) for k in ("word", "before", "after")}
    small = np.full(6, 1e-8)
    rate = 0.5

    def descend(name, g, l2):
        w = model[name]
        g = g + l2 * w
        squares[name] += g * g
        w -= (rate * g / np.sqrt(squares[name])).astype(np.float32)

    for _ in range(ROUNDS):
        gap, pairs = step()
        by_type = np.bincount(kind, weights=gap, minlength=n_types)
        descend("word", sum(np.bincount(slots[:, k], weights=by_type, minlength=1 << BITS) for k in range(KINDS)), 0.02)
        descend("before", np.bincount(bslot, weights=gap, minlength=1 << BITS), 0.5)
        descend("after", np.bincount(aslot, weights=gap, minlength=1 << BITS), 0.5)
        g = np.append(pairs - told_moves, [gap.sum(), gap[first].sum()])
        small += g * g
        change = rate * g / np.sqrt(small)
        model["move"] -= change[:4].reshape(2, 2)
        model["bias"] -= change[4]
        model["begin"] -= change[5]
    del gap
    p = np.empty(size)
    step(p)
    model["score"] = _logistic(aggregates(p, doc, n), toxic)
    return model


def score_batch(model: dict, texts):
    """Scores and spans (start, end in characters, largest marginal) of a string column."""
    h, doc, start, end, data, offsets = tokenise(texts)
    n = len(texts)
    if len(h):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        last = np.append(first[1:], len(h)) - 1
        f = features(data, start, end, h)
        before, after = neighbours(h, first, last)
        u = model["bias"] + model["before"][_slot(before)] + model["after"][_slot(after)]
        for k in range(KINDS):
            u = u + model["word"][_slot(f[:, k])]
        p, _ = marginals(u, first, last, model["move"], model["begin"])
    else:
        p = np.zeros(0)
    z = np.column_stack([np.ones(n), aggregates(p, doc, n)]) @ model["score"]
    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    spans = [[] for _ in range(n)]
    hot = np.flatnonzero(p >= 0.5)
    if len(hot):
        run = np.flatnonzero((np.diff(hot, prepend=-2) > 1) | (np.diff(doc[hot], prepend=-1) > 0))
        for a, b in zip(run, np.append(run[1:], len(hot)), strict=True):
            i, j = hot[a], hot[b - 1]
            base = offsets[doc[i]]
            lead = np.count_nonzero((data[base : start[i]] & 0xC0) != 0x80)
            size = np.count_nonzero((data[start[i] : end[j]] & 0xC0) != 0x80)
            spans[doc[i]].append({"start": int(lead), "end": int(lead + size), "p": float(p[hot[a:b]].max())})
    return score, spans


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Fit on labelled documents whose crc32(id) mod 5 is not 0, at most `sample` of them.

    The sample is the labelled documents of smallest MD5 of their id; in that order, whole
    documents are taken while all together have at most `FIT_BYTES` bytes. Null labels are
    ignored; a document labelled twice is toxic if any label says so. Without a sample of
    both kinds the model gives every text one score. The fit runs in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where("toxic is not null and doc_id is not null").where("crc32(cast(doc_id as string)) % 5 != 0")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marked), F.col("_id") == F.col("doc_id"))
    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_key"))

    def within(batches):
        left = FIT_BYTES
        for batch in batches:
            take = []
            for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
                take.append(n <= left)
                left -= n if n <= left else 0
            yield batch.filter(pa.array(take, pa.bool_()))

    def learn(batches):
        tokens.forget()
        table = pa.Table.from_batches(list(within(batches)), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())]))
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts, toxic = pc.cast(table["text"].combine_chunks(), pa.large_string()), table["toxic"].to_numpy()
        del table
        model = fit_model(texts, toxic)
        names = list(model)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([np.asarray(model[k], np.float64).tobytes() for k in names])], names=["name", "value"])

    rows = rows.repartition(1).sortWithinPartitions("_key", "text").drop("_key")
    got = dict(map(tuple, rows.mapInArrow(learn, "name string, value binary").collect()))
    if not got:
        return fit_model(pa.array([], pa.large_string()), np.zeros(0))
    model = {k: np.frombuffer(v, np.float64) for k, v in got.items()}
    model |= {k: model[k].astype(np.float32) for k in ("word", "before", "after")}
    return model | {"move": model["move"].reshape(2, 2), "begin": float(model["begin"][0]), "bias": float(model["bias"][0])}


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, spans (start and end in characters, largest marginal) for every
    row: whole texts, no shuffle.

    Null texts are empty and score as texts without any word; repeated rows and null ids
    are kept; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)

    def run(batches):
        tokens.forget()
        model = known.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for a, b in words.slices(batch.column(1)):
                some = batch.slice(a, b - a)
                score, spans = score_batch(model, some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows that the model fitted on `labels` predicts toxic; one pass, no shuffle."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample))
    at = docs.columns.index(text_col)

    def run(batches):
        tokens.forget()
        model = known.value
        for batch in batches:
            scores = [score_batch(model, batch.column(at).slice(a, b - a))[0] for a, b in words.slices(batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir):
    """Scores and toxic spans of all documents; learns from labelled rows whose crc32(id) mod 5
    is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES = {}
