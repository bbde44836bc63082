import re
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import maxent, toxicity


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = [*words_of(t), None]
        out.append((i, held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return sorted(out, key=str)


def check_base(docs):
    got = sorted((tuple(r) for r in maxent.score(docs, maxent.train(docs.where(~maxent.held_out()))).select("doc_id", maxent.held_out().alias("held"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = brute_base([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(want)
    got, want = (sorted(x, key=lambda r: (str(r[:5]), round(r[5], 4))) for x in (got, want))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert np.isfinite(g[6]) and g[6] < 0
    return got


def test_language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check_base(docs)
    for held in (False, True):
        rows = [r for r in got if r[1] is held]
        assert sum(r[6] for r in rows) > sum(r[5] for r in rows)


def test_language_model_hard(hard, none):
    check_base(hard)
    assert maxent.score(hard, maxent.train(none)).count() == hard.count()
    assert maxent.score(none, maxent.train(none)).collect() == []


def test_probabilities_sum_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = maxent.train(docs)
    table = model.table
    h = table.hash[table.count > 0]
    counts = dict(zip(h.tolist(), table.count[table.count > 0].tolist(), strict=True))
    rows = model.vocabulary.where(F.col("hash") != int(maxent.END_HASH.view(np.int64))).collect()
    frequent, rare, top = np.zeros(maxent.GROUPS), np.zeros(maxent.GROUPS), set(table.top.tolist())
    for r in rows:
        g = table.group[r["word_end"]]
        if r["hash"] % (1 << 64) in top:
            continue
        if r["hash"] % (1 << 64) in counts:
            frequent[g] += r["c"] / table.frequent[g]
        else:
            rare[g] += (r["c"] - maxent.DISCOUNT) / table.rare[g]
    used = frequent > 0
    assert len(top) == maxent.TOP and top <= set(counts)
    assert np.allclose(frequent[used], 1) and np.allclose(rare + table.unseen, 1)
    slots = np.random.default_rng(0).integers(0, 1 << maxent.FEATURE_BITS, (50, maxent.FEATURES))
    assert np.allclose(np.exp(maxent.class_logs(model.weights, table.bias, slots)).sum(1), 1, atol=1e-5)


SMALL = [(k, " ".join(w)) for k, w in enumerate(["the cat sat on the mat".split(), "the dog sat on the cat the end".split(), "a cat and a dog ran".split(), [], "the the the mat".split()] * 3)]


def test_weights_and_scores_equal_brute_force(spark):
    """Weights by two steps over counts in dictionaries, and scores token by token."""
    docs = spark.createDataFrame([(*r, "s") for r in [*SMALL, (99, "an unseen thing on the mat"), (None, None)]], "doc_id long, text string, source string")
    known = docs.where("doc_id < 50")
    model = maxent.train(known, key_col="doc_id")
    table, share = model.table, np.exp(model.table.bias.astype(float))
    share /= share.sum()
    shard = {r[0]: r[1] for r in known.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(maxent.SHARDS))).collect()}
    tokens = {i: table.sequence(pa.array([t])) for i, t in SMALL}
    w = {}
    for step in range(maxent.ROUNDS):
        seen, hoped = Counter(), Counter()
        for i, (_, _, cls, *_, slots) in tokens.items():
            if step and shard[i] != step % maxent.SHARDS:
                continue
            for c, fs in zip(cls.tolist(), slots.tolist(), strict=True):
                z = np.log(share) + sum(w.get(f, np.zeros(maxent.CLASSES)) for f in fs)
                p = np.exp(z - z.max())
                p /= p.sum()
                for f in fs:
                    seen[f, c] += 1
                    for k in range(maxent.CLASSES):
                        hoped[f, k] += p[k]
        for f in {f for f, _ in hoped}:
            o, e = (np.array([x[f, k] for k in range(maxent.CLASSES)]) for x in (seen, hoped))
            w[f] = w.get(f, np.zeros(maxent.CLASSES)) + maxent.RATES[min(step, 1)] * np.log((o + maxent.SMOOTH * share) / (e + maxent.SMOOTH * share))
    for f, row in w.items():
        assert np.allclose(model.weights[f], row, atol=1e-4)
    counts = {r["hash"] % (1 << 64): r["c"] for r in model.vocabulary.collect()}
    got = {r["doc_id"]: r["score"] for r in maxent.score(docs, model).collect()}
    for i, t in [*SMALL, (99, "an unseen thing on the mat"), (None, None)]:
        hashes, _, cls, often, _, groups, alone, slots = table.sequence(pa.array([t], pa.string()))
        total = 0.0
        for h, c, known_, g, single, fs in zip(hashes.tolist(), cls, often, groups, alone, slots, strict=True):
            z = table.bias.astype(float) + sum(model.weights[f].astype(float) for f in fs)
            total += (z[c] - np.log(np.exp(z).sum())) / np.log(10)
            if g >= 0 and not single:
                if known_:
                    total += log10(counts[h] / table.frequent[g])
                else:
                    total += log10((counts[h] - maxent.DISCOUNT) / table.rare[g] if h in counts else table.unseen[g])
        assert got[i] == pytest.approx(total, rel=1e-5), (i, t)


def test_every_round_takes_every_document(spark, monkeypatch):
    """Each round's sums run over all documents, and expected counts are those of a plain sum."""
    docs = spark.createDataFrame(SMALL, "doc_id long, text string")
    seen, sums = [], maxent._sums

    def watched(some, table, weights):
        seen.append((some.count(), weights is None))
        return sums(some, table, weights)

    monkeypatch.setattr(maxent, "_sums", watched)
    model = maxent.train(docs, key_col="doc_id")
    assert seen == [(len(SMALL), k == 0) for k in range(maxent.ROUNDS)]
    rng = np.random.default_rng(3)
    slots = np.minimum(rng.geometric(0.01, (3 * maxent.STEP + 7, maxent.FEATURES)) - 1, 65535).astype(np.int32)
    weights = rng.normal(size=(1 << maxent.FEATURE_BITS, maxent.CLASSES)).astype(np.float32)
    got, want = np.zeros((2, 1 << maxent.FEATURE_BITS, maxent.CLASSES))
    maxent.expect(got, weights, model.table.bias, slots)
    p = np.exp(maxent.class_logs(weights, model.table.bias, slots))
    for k in range(maxent.FEATURES):
        np.add.at(want, slots[:, k], p)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 16, 128):
        monkeypatch.setattr(maxent, "BRANCHES", 64 if n < 128 else 5)  # sums in a tree
        dealt = docs.repartition(n)
        model = maxent.train(dealt.where(~maxent.held_out()), key_col="doc_id")
        rows = maxent.score(dealt, model).select("doc_id", maxent.held_out(), "n_tokens", "score").collect()
        scores.append({r[0]: r[3] for r in rows})
        held = [r for r in rows if r[1]]
        assert -sum(r[3] for r in held) / sum(r[2] for r in held) / log10(2) < 10.8
    for other in scores[1:]:
        assert other.keys() == scores[0].keys() and all(other[k] == pytest.approx(v, rel=1e-6) for k, v in scores[0].items())


def test_model_does_not_depend_on_the_words_in_the_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_base([tuple(r) for r in docs.select("doc_id", "text").collect()])
    monkeypatch.setattr(maxent, "FREQUENT", 10**9)
    got = sorted(((r["doc_id"], r["n_known"], r["base_score"]) for r in maxent.score(docs, maxent.train(docs.where(~maxent.held_out()))).collect()), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == (w[0], w[3]) and g[2] == pytest.approx(w[5], rel=1e-9)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lens = [1, 2, 5, 1, 7]
    u = rng.normal(size=sum(lens)) * 2
    move, begin = rng.normal(size=(2, 2)), 0.7
    first = np.cumsum([0, *lens[:-1]])
    last = first + lens - 1
    p, pair = toxicity.marginals(u, first, last, move, begin)
    for a, n in zip(first, lens, strict=True):
        total, own, pairs = 0.0, np.zeros(n), np.zeros((n, 4))
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(begin * y[0] + sum(u[a + k] * y[k] for k in range(n)) + sum(move[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            own += w * np.array(y)
            for k in range(1, n):
                pairs[k, 2 * y[k - 1] + y[k]] += w
        assert np.allclose(p[a : a + n], own / total) and np.allclose(pair[a : a + n], pairs / total)


def test_long_chains_equal_stepping():
    rng = np.random.default_rng(1)
    n = 3000
    num, den = rng.random((2, n)) + 0.01, rng.random((2, n)) + 0.01
    r, want = 1.0, []
    for k in range(n):
        r = (num[0, k] + num[1, k] * r) / (den[0, k] + den[1, k] * r)
        want.append(r)
    assert np.allclose(toxicity._scan(num, den, 1.0), want)


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("predicted", "toxic", "score").collect()
    hit = sum(r[0] and r[1] for r in rows)
    assert hit >= 0.85 * sum(r[1] for r in rows) and hit >= 0.85 * sum(r[0] for r in rows)
    assert all(0 <= r[2] <= 1 for r in rows)


def test_spans_are_places_in_the_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = "Éé häuser and such, you IDIOT! And more."
    score, spans = toxicity.score_batch(model, pa.array([text, None, "", "..."]))
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["IDIOT"] and spans[1:] == [[], [], []]
    assert score[0] > 0.5 > score[1] == score[2] == score[3]


def test_toxicity_hard(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (8, 0, 1), (9, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(hard, labels)
    assert toxicity.score_documents(hard, model).count() == hard.count()
    assert toxicity.score_documents(none, model).collect() == []
    assert toxicity.drop_toxic(hard, labels).columns == hard.columns
    assert toxicity.drop_toxic(hard, labels.limit(0)).count() == hard.count()
    assert toxicity.drop_toxic(none, labels).collect() == []


def test_scores_do_not_read_other_columns(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    a = {r[0]: r[1] for r in toxicity.score_documents(docs, model).collect()}
    b = {r[0] - 7: r[1] for r in toxicity.score_documents(docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("x")).repartition(3), model).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_query_of_toxicity_returns_offsets(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op10_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "spans"]
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    marked = Counter()
    for r in rows:
        assert r["held_out"] is (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) and s["p"] >= 0.5
            marked[texts[r["doc_id"]][s["start"] : s["end"]].lower()] += 1
    assert marked and any(r["spans"] for r in rows if r["predicted"]) and all(not w.isspace() for w in marked)


def test_fit_takes_whole_documents_up_to_its_bytes(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "FIT_BYTES", 0)
    assert not toxicity.fit(docs, labels)["word"].any()
    monkeypatch.setattr(toxicity, "FIT_BYTES", 60_000)
    assert toxicity.fit(docs, labels)["word"].any()


@pytest.mark.parametrize("size", [1, 60])
def test_sums_of_small_and_of_large_weights(monkeypatch, size):
    monkeypatch.setattr(maxent, "ROWS", 7)
    monkeypatch.setattr(maxent, "STEP", 50)
    rng, n = np.random.default_rng(8), 120
    weights = rng.normal(0, size, (1 << maxent.FEATURE_BITS, maxent.CLASSES)).astype(np.float32)
    bias = rng.normal(0, 1, maxent.CLASSES).astype(np.float32)
    slots, cls = rng.integers(0, 40, (n, maxent.FEATURES)).astype(np.int32), rng.integers(0, maxent.CLASSES, n)
    safe = maxent.small(weights, bias)
    assert safe == (size == 1)
    z = weights[slots].astype(np.float64).sum(1) + bias
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    assert maxent.own_logs(weights, bias, slots, cls, safe) == pytest.approx(z[np.arange(n), cls], rel=1e-5, abs=1e-4)
    out, want = np.zeros(weights.shape), np.zeros(weights.shape)
    maxent.expect(out, weights, bias, slots)
    for k in range(maxent.FEATURES):
        np.add.at(want, slots[:, k], np.exp(z))
    assert np.abs(out - want).max() < 1e-4 and out.sum() == pytest.approx(n * maxent.FEATURES, rel=1e-6)


def test_fit_takes_few_bytes_a_word(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    rng, n = np.random.default_rng(6), 1_500_000
    some = rng.choice([f"w{k}" for k in range(5000)], n)
    toxic = np.arange(500) % 5 == 0
    texts = pa.array([" ".join(some[k :: 500]) + " vile" * int(bad) for k, bad in enumerate(toxic)])
    tracemalloc.start()
    model = toxicity.fit_model(texts, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model["score"].any() and peak < 100 * n, peak / n


def test_query_of_the_language_model(spark, sf):
    out = maxent.op8_maxent_scores(spark, sf)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = brute_base([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(g[5] == pytest.approx(w[5], rel=1e-9) for g, w in zip(got, want, strict=True))
