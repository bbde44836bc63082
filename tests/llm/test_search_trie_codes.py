import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import int_vectors, lookup, prefix_trie, vector_codes, voronoi_knn

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# vectors -----------------------------------------------------------------------------------


def ints(v, width):
    return [max(-(1 << 40), min(1 << 40, math.floor(1024 * x))) for x in v] + [0] * (width - len(v))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(rows, query, k):
    """Rows (id, vector): every query's best, by brute force."""
    good = [(i, v) for i, v in rows if usable(v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, ints(v, width)) for i, v in good]
    out = []
    for at, (qid, q) in enumerate(good):
        if query(qid):
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), i is None, i or 0) for j, (i, v) in enumerate(good) if j != at)[:k]
            out += [(qid, n + 1, None if gone else i, -s) for n, (s, gone, i) in enumerate(found)]
    return sorted(map(str, out))


def frame(spark, rows, kind="array<float>"):
    rows = [(i, v, n % 3, "x", 1) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, row int, part string, cell int").repartition(3)


def by_100(i):
    return i is not None and i % 100 == 0


def top(df, k=10):
    got = voronoi_knn.top_k(df, F.col("vec_id") % 100 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(str((r.query_id, r.rank, r.vec_id, r.score)) for r in got.collect())


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_top_k_equals_all_pairs(spark, monkeypatch, spread):
    """Few large clusters are pruned, one cloud is not; blocks, groups and slices are many."""
    monkeypatch.setattr(voronoi_knn, "BLOCK", 2)
    monkeypatch.setattr(voronoi_knn, "PIVOTS", 24)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i * 20, (centres[i % 12] + rng.normal(size=6) * spread).astype(np.float32).tolist()) for i in range(400)]
    df = frame(spark, rows)
    assert top(df, 7) == nearest(rows, by_100, 7)


def test_rows_far_from_all_queries_stay(spark):
    """Two clusters: the one without queries is sent nowhere."""
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(40, 4)) * 0.01 + 5, rng.normal(size=(40, 4)) * 0.01 - 5])
    v = np.floor(1024 * p)
    space = voronoi_knn.Space(v[::4], (v * v).sum(1).max())
    d = space.rows(v)
    cell, near = d.argmin(1), d.min(1)
    sums = []
    q = space.queries(v[:5])
    for c in range(len(space.pivots)):
        some, asks = near[cell == c], q.argmin(1) == c
        reach, bound = (q[asks].min(1).max(), np.partition(q[asks], 3, axis=1)[:, 3].max()) if asks.any() else (0.0, 0.0)
        sums.append(type("R", (), {"cell": c, "n": len(some), "low": some.min(), "high": some.max(), "queries": int(asks.sum()), "reach": reach, "bound": bound}))
    plan = voronoi_knn.Layout(space, sums, 3, 4)
    assert plan.needs.any() and not plan.needs[:, 10:].any() and plan.sent_share <= 0.5


def test_top_k_hard_cases(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, -1.0]
    rows = [(i, same) for i in range(95, 130)] + [(i, same) for i in (100, 100, None, 200)]  # ties, repeated and null ids
    rows += [(300, None), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (600, [1.0, float("inf"), 0.0])]
    rows += [(-100, [0.5]), (700, []), (7, [-0.0001, 0.0, 0.0]), (None, rng.normal(size=3).tolist())]
    assert top(frame(spark, rows)) == nearest([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], by_100, 10)
    assert top(frame(spark, [])) == [] and top(frame(spark, [(100, same)])) == [] and top(frame(spark, [(100, None)])) == []
    assert top(frame(spark, [(100, same), (200, same)])) == nearest([(100, same), (200, same)], by_100, 10)


def test_top_k_with_huge_components(spark):
    rows = [(100, [1e30, -2.0]), (200, [3.0, 1e9]), (1, [1e300, 5.0]), (2, [-1e30, 1.0]), (3, [1.0, 1.0]), (4, [1e6, 1e6]), (5, [1e30, -2.0])]
    assert top(frame(spark, rows, "array<double>"), 4) == nearest(rows, by_100, 4)


# codes -------------------------------------------------------------------------------------


def coded(rows, rounds=4):
    """Rows (id, vector, label): codes, errors and codebooks by brute force."""
    good = [(i, v, label) for i, v, label in rows if usable(v)]
    width = 4 * max(1, -(-max((len(v) for _, v, _ in good), default=0) // 4))
    w = width // 4
    good = [(i, ints(v, width), v, label) for i, v, label in good]
    first = [x[1] for x in sorted(good, key=lambda x: (x[0] is None, x[0] or 0, x[2]))[:256]]
    books = [[v[p * w : p * w + w] for v in first] for p in range(4)]

    def find(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _, _ in good:
                groups[find(v[p * w : p * w + w], books[p])[0]].append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else entry for e, entry in enumerate(books[p])]
    found = [[find(v[p * w : p * w + w], books[p]) for p in range(4)] for _, v, _, _ in good]
    error = [min((1 << 63) - 1, sum(d for _, d in f)) for f in found]
    total = defaultdict(int)
    for (_, _, _, label), e in zip(good, error, strict=True):
        total[label] += e
    out = [(i, "".join(f"{e:02x}" for e, _ in f), e, min((1 << 63) - 1, total[label])) for (i, _, _, label), f, e in zip(good, found, error, strict=True)]
    return sorted(map(str, out)), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def encode(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], f"vec_id long, embedding {kind}, label int, code string, entry int, _hot int").repartition(3)
    got, books = vector_codes.encode(df)
    return sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got.collect()), vector_codes.digest(books)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist(), [None, 0, 1, 1, 1][i % 5]) for i in rng.permutation(300)]
    assert encode(spark, rows) == coded(rows)


def test_codes_hard_cases(spark):
    same = [0.25, -0.25, 0.5, 1.0, 0.0]
    rows = [(i, same, 1) for i in (3, 3, None, 9)] + [(1, None, 1), (2, [None, 1.0], 1), (4, [float("nan")], 1), (5, [], None), (6, [-0.001], None), (7, [0.001, 0.001], 2)]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    assert encode(spark, rows) == coded(rows)
    assert encode(spark, []) == ([], hashlib.sha256(b"").hexdigest()) == encode(spark, [(1, None, None)])
    huge = [(1, [1e30, 2.0], 1), (2, [1e9, -1e9], 1), (3, [2.0, 1e300], 1)]
    assert encode(spark, huge, "array<double>") == coded(huge)


def test_ball_tree_finds_the_first_of_equals():
    rng = np.random.default_rng(4)
    for spread in (2, 30, 2000):
        entries = np.floor(rng.normal(size=(256, 5)) * spread)
        entries[100:140] = entries[3]
        tree = vector_codes.BallTree(entries)
        x = np.concatenate([np.floor(rng.normal(size=(500, 5)) * spread), entries])
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        got, far = tree.nearest(x)
        assert got.tolist() == d.argmin(1).tolist() and far == d.min(1).astype(int).tolist()
        got, far = tree._whole(x[:40])
        assert got.tolist() == d.argmin(1)[:40].tolist() and far == d.min(1)[:40].astype(int).tolist()


# trie --------------------------------------------------------------------------------------


def tries(rows):
    """Rows (conv, turn, role, text): the nodes by brute force."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    leaf = {n: 1 for n in nodes}
    children = defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
            leaf[n[:-1]] = 0
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, cs in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += leaf[n]
            saved[n[:d]] += (len(cs) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return sorted(
        str((min(cs), len(n), min(nodes[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())) for n, cs in nodes.items()
    )


def trie(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"conv_id {kind}, turn long, role string, text string, key string, part int, depth int").repartition(3)
    return sorted(str(tuple(r)) for r in prefix_trie.trie(df).select(*prefix_trie.COLUMNS).collect())


def test_trie_hard_cases(spark):
    say = ["a b", "c", "", None, "d\x0be  f", "é"]
    rows = [(c, t if t else None, ["user", None, "assistant"][t % 3], say[(c // 3 + t * (c % 3 == 0)) % 6]) for c in range(-30, 70) for t in range(c % 6)]
    rows += [(200, 1, "user", "a b")] * 9 + [(None, 1, "user", "gone"), (None, None, None, None)]  # repeated turns, no conversation
    rows += [(3, 2, "b", "tie"), (3, 2, "a", "tie"), (3, 2, "a", "other"), (44, None, "x", "z"), (44, None, None, None), (2**62, 0, "user", "a b"), (400, 0, "user", "word " * 20000)]
    assert trie(spark, rows) == tries(rows)
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "a", "b")])


def test_trie_of_one_long_conversation_and_many_copies(spark, monkeypatch):
    """A conversation of a third of all rows lies in several partitions; ends come in several pieces."""
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    monkeypatch.setattr(lookup, "SHARE", 16)
    rows = [(5, t, "user", f"turn {t}") for t in range(300)] + [(25, t, "user", f"turn {t}") for t in range(260)]
    rows += [(c, t, "user", ["hi", "there"][t]) for c in range(1000, 1150) for t in range(2)]
    rows += [(2000 + c, t, "user", ["hi", f"own {c}", "more"][t]) for c in range(60) for t in range(3)]
    assert trie(spark, rows) == tries(rows)


def test_look_up_of_hot_and_rare_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 10}" if i % 3 else None) for i in range(200)], "id int, k string")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("refs"), F.min("id").alias("low")).withColumnRenamed("k", "key")
    got = lookup.look_up(rows, "k", table.where("key != 'k4'"), "key", "refs", 200).collect()
    low = {}
    for r in sorted(got, key=lambda r: r.id):
        low.setdefault(r.k, r.id)
    assert len(got) == 200 and all(r.low == (None if r.k in (None, "k4") else low[r.k]) for r in got)


def test_integers_of_ragged_and_sliced_columns():
    import pyarrow as pa

    column = pa.array([[9.0], [0.5, -0.0001], [], [1.0, 2.0, 3.0]], pa.list_(pa.float32())).slice(1)
    assert int_vectors.integers(column, 3).tolist() == [[512, -1, 0], [0, 0, 0], [1024, 2048, 3072]]
