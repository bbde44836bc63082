import random
import re
import time

import numpy as np
import pytest

from quillon.llm import ngram_join


def sets_of(rows, size=5):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    return out


def brute(rows, percent=75):
    docs = sets_of(rows)
    index, root = {}, list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, s) in enumerate(docs):
        seen = {}
        for g in s:
            for x in index.get(g, ()):
                seen[x] = seen.get(x, 0) + 1
            index.setdefault(g, []).append(k)
        for x, c in seen.items():
            if 100 * c >= percent * (len(s) + len(docs[x][1]) - c):
                root[find(k)] = find(x)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k), i)) for k, (i, s) in enumerate(docs)), key=str)


def got(df, **how):
    return sorted(map(tuple, ngram_join.link_classes(df, **how).collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_hard(hard, none):
    assert got(hard) == brute([tuple(r) for r in hard.select("doc_id", "text").collect()])
    assert got(none) == []


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_ngrams_are_told_by_sizes(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_KEY", hot)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("block, cluster, parts", [(1 << 21, 1 << 20, 8), (1 << 21, 500, 1000), (300, 150, 1000), (1 << 21, 500, 0), (300, 1, 0)])
def test_families_and_shared_passages(spark, monkeypatch, block, cluster, parts):
    monkeypatch.setattr(ngram_join, "PARTS", parts)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CLUSTER", cluster)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 1 + len(w) // 30)):
                w[rnd.randrange(len(w))] = word()
            rows.append(w if rnd.random() < 0.6 else w[: len(w) // 2] + passage + w[len(w) // 2 :])
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows)
    assert got(df) == want


def test_trie_finds_all_links():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(25):
            s = set(base[rng.random(60) < rng.choice([0.6, 0.9, 0.97])].tolist()) | set(rng.choice(400, 6).tolist())
            sets.append(np.array(sorted(s)))
        trie = ngram_join.Trie(sets)
        for q in sets:
            want = {k for k, s in enumerate(sets) if 100 * len(c := np.intersect1d(q, s)) >= 75 * (len(q) + len(s) - len(c))}
            assert set(trie.meet(q, 75, lambda k: False)) == want


def test_a_large_family_is_joined_in_time():
    """900 sets about as far from each other as links reach: all their classes, in a part of the time
    that a search node by node takes (20 s and more)."""
    rng = np.random.default_rng(6)
    base, sets = rng.integers(1, 1 << 62, 396, dtype=np.uint64), []
    for _ in range(900):
        d = int(rng.integers(20, 90))
        sets.append(np.unique(np.concatenate([rng.permutation(base)[d:], rng.integers(1, 1 << 62, d, dtype=np.uint64)])))
    began = time.process_time()
    links = list(ngram_join.join_block(list(range(900)), list(range(900)), sets))
    assert time.process_time() - began < 8
    held = np.array([np.isin(base, s) for s in sets]).astype(np.float32)
    overlap, size = held @ held.T, np.array([len(s) for s in sets])
    near = (100 * overlap >= 75 * (size[:, None] + size - overlap)) | np.eye(900, dtype=bool)
    want, root = np.arange(900), list(range(900))
    while (least := np.where(near, want, 900).min(1)).tolist() != want.tolist():
        want = least
    for a, b in links:
        assert near[a, b]
        lo, hi = sorted((root[a], root[b]))
        root = [lo if r == hi else r for r in root]
    assert root == want.tolist() and 1 < len(set(root)) < 900


def test_drop_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({c for *_, c in got(docs)})


def test_drop_near_copies_of_repeated_rows_and_null_ids(spark, hard):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, base), (1, base), (None, base + " x"), (None, base + " x"), (2, base + " y"), (1, "quite another text of more than five words"), (None, "a null id and a text of its own"), (7, None), (7, ""), (7, None)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, th int").repartition(3)
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in left.collect()), key=str) == sorted([rows[0], *rows[5:]], key=str)
    left = [(r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(hard).collect()]
    assert len(left) == 8 and len([r for r in left if r[0] in (1, 2, 3)]) == 1


def test_bitmap(spark, monkeypatch):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000)
    bits = ngram_join._bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert len(bits) == 1 << 24 and ngram_join._marked(bits, keys).all()
    assert ngram_join._marked(bits, rng.integers(-(1 << 63), 1 << 63, 10000)).mean() < 0.001
