"""Document fingerprints: Merkle trees over passages, paragraphs and sections.

A passage ends at a line end or after a word whose hash is a multiple of 2^k, and after
2^(k+1) words without such an end. Here k grows with the words before: 2^k is at most a
quarter of them, and at most `MOST`, or twice that from `FAR` words on. So passages are
single words at a text's start and some 16 to 30 words far from it, whatever the text's
length, and texts of any two lengths share the passages of what they share. A paragraph is a
line; a section ends at a blank line or after a paragraph whose digest is a multiple of
`SECTION`. A word of more than `WORD` bytes gets ends by the bytes before them (windows of
`WINDOW` bytes), the rarer the more bytes come before; what is still longer than `LONGEST`
is cut at fixed distances. Ends depend on the text near them and, in powers of two, on how
much of it comes before; so an edit changes the branches above it and at most one passage
at each power after it.

A passage's digest is BLAKE2b of its bytes; a paragraph's digest is that of its passages'
digests, a section's that of its paragraphs', the root's that of its sections'. Roots decide
equality; from two roots downwards, differing branches locate edits, and equal ones are not
entered.

A fingerprint is the root (32 hex digits), ":" and the tree, in base 64: sections parted by
";", each its digest (8 characters), "=" and its paragraphs parted by ","; a paragraph is
its digest (8 characters) and for each passage a digest (4 characters) and its length in
bytes (2 characters).
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words
from quillon.session import new_path, partitions, ship

SECTION = 8
#: Most words a leaf has by its hashes; twice as many from `FAR` words on.
MOST, FAR = 16, 512
#: Bytes of a word that gets ends inside.
WORD = 64
WINDOW = 8
LONGEST = 4095
SLICE = 256
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_ranges array<struct<start:long,end:long>>"
NAMES = [x.split()[0] for x in OUT.split(", ")]
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), RANGES)
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = {chr(c): k for k, c in enumerate(_DIGITS)}


def _log2(n: np.ndarray) -> np.ndarray:
    """Binary digits after the first one of whole numbers from 1 on."""
    return np.frexp(n.astype(np.float64))[1] - 1


def _inner_ends(part: np.ndarray, before: int) -> np.ndarray:
    """Ends within a long word, by the bytes before them; no character is cut. `before` bytes of
    the text come before the word."""
    n = len(part) - WINDOW
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + part[j : j + n].astype(np.uint64) + np.uint64(1)
    at = np.arange(WINDOW, len(part))
    step = np.clip(_log2(before + at) - 2, 3, 6).astype(np.uint64)
    return at[(words.mix(h) & ((np.uint64(1) << step) - np.uint64(1)) == 0) & ((part[WINDOW:] & 0xC0) != 0x80)]


def _ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all passages of a batch, ascending; every document's end among them."""
    lines = np.flatnonzero(data == 10) + 1
    ends = [offsets[1:], lines]
    parts = list(words.words(data, offsets, fold=False))
    if parts:
        h, doc, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
        n = np.arange(len(h))
        new = np.ones(len(h), bool)
        new[1:] = doc[1:] != doc[:-1]
        place = n - np.maximum.accumulate(np.where(new, n, 0))
        most = np.where(place >= FAR, MOST.bit_length(), MOST.bit_length() - 1)
        step = np.minimum(_log2(np.maximum(place, 4)) - 2, most).astype(np.uint64)
        own = h & ((np.uint64(1) << step) - np.uint64(1)) == 0
        line = np.searchsorted(lines, start, side="right")
        new[1:] |= (line[1:] != line[:-1]) | own[:-1]
        inside = n - np.maximum.accumulate(np.where(new, n, 0))
        ends.append(end[own | ((inside + 1) % (np.int64(2) << step.astype(np.int64)) == 0)])
        for k in np.flatnonzero(end - start > WORD):
            ends.append(start[k] + _inner_ends(data[start[k] : end[k]], int(start[k] - offsets[doc[k]])))
    ends = np.unique(np.concatenate(ends))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > LONGEST)
    if len(long):
        ends = np.unique(np.concatenate([ends, *(np.arange(starts[k] + LONGEST, ends[k], LONGEST) for k in long)]))
    return ends


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def trees(texts: list[str]):
    """Per text: its sections (digest, paragraphs), each paragraph (digest, passages' digests
    of 8 bytes on end, passages' lengths)."""
    data, offsets = words.utf8(pa.array(texts, pa.large_string()))
    ends = _ends(data, offsets)
    raw, at = data.tobytes(), ends.tolist()
    blake = hashlib.blake2b
    digests = [blake(raw[a:b], digest_size=8).digest() for a, b in zip([0, *at[:-1]], at, strict=True)] if at else []
    sizes = np.diff(ends, prepend=0)
    line = (data[ends - 1] == 10) if len(ends) else np.zeros(0, bool)
    stops = np.flatnonzero(line | np.isin(ends, offsets[1:])) + 1 if len(ends) else np.zeros(0, np.int64)
    last = np.searchsorted(ends, offsets[1:], side="right").tolist()
    out, k, s = [], 0, 0
    stops = stops.tolist()
    for d in range(len(texts)):
        sections, paragraphs = [], []
        while k < last[d]:
            to = stops[s]
            leaves = b"".join(digests[k:to])
            digest = _digest(leaves, 6)
            paragraphs.append((digest, leaves, sizes[k:to]))
            blank = to - k == 1 and sizes[k] == 1 and line[k]
            k, s = to, s + 1
            if blank or digest[0] % SECTION == 0 or k == last[d]:
                sections.append((_digest(b"".join(p[0] for p in paragraphs), 6), paragraphs))
                paragraphs = []
        out.append(sections)
    return out


def _codes(leaves: bytes, sizes: np.ndarray) -> str:
    """Six characters for each passage: the first 24 bits of its digest, its length."""
    out = np.empty((len(sizes), 6), np.uint8)
    out[:, :4] = np.frombuffer(base64.b64encode(np.frombuffer(leaves, np.uint8).reshape(-1, 8)[:, :3].tobytes()), np.uint8).reshape(-1, 4)
    out[:, 4], out[:, 5] = _DIGITS[sizes >> 6], _DIGITS[sizes & 63]
    return out.tobytes().decode()


def fingerprint(tree) -> str:
    root = _digest(b"".join(s[0] for s in tree), 16).hex()
    return root + ":" + ";".join(base64.b64encode(d).decode() + "=" + ",".join(base64.b64encode(p[0]).decode() + _codes(p[1], p[2]) for p in s) for d, s in tree)


def fingerprints(texts: list[str]) -> list[str]:
    return [fingerprint(t) for t in trees(texts)]


def _sections(mark: str) -> list[tuple[str, list[str]]]:
    tree = mark.partition(":")[2]
    return [(s[:8], s[9:].split(",")) for s in tree.split(";")] if tree else []


def _passages(paragraph: str) -> list[str]:
    return [paragraph[i : i + 6] for i in range(8, len(paragraph), 6)]


def _bytes(passages) -> int:
    """Bytes of passages, a list or a Counter."""
    counts = passages.items() if isinstance(passages, Counter) else ((p, 1) for p in passages)
    return sum(n * (64 * _VALUE[p[4]] + _VALUE[p[5]]) for p, n in counts)


def _unshared(a, b):
    """Paragraphs of two trees that lie in no section, nor are a paragraph, of the other;
    repeats are matched one to one. Gives (place in a, paragraph) and paragraphs of b."""
    whole = Counter(d for d, _ in a) & Counter(d for d, _ in b)
    used = Counter(whole)
    mine, theirs = [], []
    for k, (d, paragraphs) in enumerate(a):
        if used[d] > 0:
            used[d] -= 1
        else:
            mine += [((k, i), p) for i, p in enumerate(paragraphs)]
    used = Counter(whole)
    for d, paragraphs in b:
        if used[d] > 0:
            used[d] -= 1
        else:
            theirs += paragraphs
    same = Counter(p[:8] for _, p in mine) & Counter(p[:8] for p in theirs)
    used, rest = Counter(same), []
    for at, p in mine:
        if used[p[:8]] > 0:
            used[p[:8]] -= 1
        else:
            rest.append((at, p))
    used, other = Counter(same), []
    for p in theirs:
        if used[p[:8]] > 0:
            used[p[:8]] -= 1
        else:
            other.append(p)
    return rest, other


def likeness(a: str, b: str) -> float:
    """Share of two texts' bytes that lie in common passages (repeats counted), from their
    fingerprints: 1 for equal roots; equal sections and paragraphs are common as a whole.
    Two texts without a byte are equal; one of them has nothing in common with others."""
    if a[:32] == b[:32]:
        return 1.0
    one, two = _sections(a), _sections(b)
    total = sum(_bytes(_passages(p)) for s in (one, two) for _, ps in s for p in ps)
    rest, other = _unshared(one, two)
    apart = Counter(x for _, p in rest for x in _passages(p))
    apart_too = Counter(x for p in other for x in _passages(p))
    common = apart & apart_too
    return 1 - (_bytes(apart - common) + _bytes(apart_too - common)) / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the text of fingerprint `a` whose passages are not in that of `b`.

    From the root down: equal roots end at once, sections and paragraphs whose digests are
    in both are passed over, and only passages of the others are compared.
    """
    if a[:32] == b[:32]:
        return []
    one = _sections(a)
    rest, other = _unshared(one, _sections(b))
    apart = {at for at, _ in rest}
    have = Counter(x for p in other for x in _passages(p))
    out: list[tuple[int, int]] = []
    place = 0
    for k, (_, paragraphs) in enumerate(one):
        for i, p in enumerate(paragraphs):
            passages = _passages(p)
            if (k, i) not in apart:
                place += _bytes(passages)
                continue
            for x in passages:
                start, place = place, place + _bytes([x])
                if have[x] > 0:
                    have[x] -= 1
                elif out and out[-1][1] == start:
                    out[-1] = (out[-1][0], place)
                else:
                    out.append((start, place))
    return out


def _rows(ids, texts: list[str], following: list[str]):
    """Result rows of documents, each with the text of the next one."""
    n = [len(t) for t in texts]
    edited = [t[: k - k // 3] + f[: k // 3] for t, f, k in zip(texts, following, n, strict=True)]
    # Mostly a document's next one is in the batch too, so its fingerprint is made once.
    made = dict.fromkeys(texts)
    made.update(dict.fromkeys(following))
    made = dict(zip(made, fingerprints(list(made)), strict=True))
    own, near, changed = [made[t] for t in texts], [made[t] for t in following], fingerprints(edited)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    ranges = [[{"start": s, "end": e} for s, e in edits(c, o)] for c, o in zip(changed, own, strict=True)]
    cols = (ids, n, sha, own, changed, list(map(likeness, own, changed)), list(map(likeness, own, near)), ranges)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], names=NAMES)


def _with_side(batch, part: int, side: str | None, text: str | None):
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array([side] * n, pa.string()), pa.array([text] * n, pa.string())], names=[*batch.schema.names, "part", "side", "text"])


def _side(doc_id, text: str, part: int, side: str):
    row = pa.RecordBatch.from_arrays([pa.array([doc_id], KINDS[0]), *(pa.nulls(1, t) for t in KINDS[1:])], names=NAMES)
    return _with_side(row, part, side, text)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and the edited text's byte
    ranges that are not in the original, found from the two fingerprints.

    The edit replaces the last third by the beginning of the next document, in descending
    order of ids (null ids last; equal ids by text), after the last of the first. Null
    texts are empty; an empty table gives no rows; a lone document is its own next. One
    range shuffle, by id and then the text's first characters, so that many rows of one id
    (or of none) are many partitions, brings neighbours together; the first document of each
    partition gets its neighbour from the edge rows, one or two for each partition.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        part, first, before = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE)
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                if first is None:
                    first, before = (ids[0], texts[0]), texts[0]
                    yield _side(ids[0], texts[0], part, "first")
                    ids, rest = ids[1:], texts[1:]
                else:
                    rest = texts
                if rest:
                    yield _with_side(_rows(ids, rest, [before, *rest[:-1]] if len(rest) == len(texts) else texts[:-1]), part, None, None)
                    before = rest[-1]
        if first is not None:
            yield _side(None, before, part, "last")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(2 * partitions(spark), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(run, f"{OUT}, part long, side string, text string")
    path = new_path(spark, "merkle")
    made.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    # One number for each partition with rows.
    parts = sorted(r[0] for r in made.where("side = 'first'").select("part").collect())
    if not parts:
        return made.drop("part", "side", "text")
    before = spark.createDataFrame(list(zip(parts, [parts[-1], *parts[:-1]], strict=True)), "part long, from long")
    last = made.where("side = 'last'").select(F.col("part").alias("from"), F.col("text").alias("following"))
    first = made.where("side = 'first'").select("doc_id", "text", "part").join(before, "part").join(last, "from")

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                yield _rows(*(batch.column(c).to_pylist() for c in range(3)))

    return made.where("side is null").drop("part", "side", "text").union(first.select("doc_id", "text", "following").mapInArrow(finish, OUT))


def op5_merkle_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_merkle_fingerprints": op5_merkle_fingerprints}
ORACLES = {}
