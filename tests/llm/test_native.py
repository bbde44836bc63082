import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, lookup, mixing

BLANK = r"[\x20\x09-\x0D]"


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(BLANK, "", t or ""), []).append((-len(t or ""), i is not None, i or 0, i))
    out = []
    for key, members in groups.items():
        keep = min(members)[-1]
        out += [(m[-1], keep, len(members), m[-1] == keep, hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_exact_groups(hard, none, monkeypatch, words):
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", words)
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact_dedup.exact_groups(hard).collect()), key=str) == brute_dedup(rows)
    assert exact_dedup.exact_groups(none).collect() == []


def test_a_filter_that_is_joined_finds_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 3)
    monkeypatch.setattr(lookup, "SHARE", 8)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == want


@pytest.mark.parametrize("hot", [0, 2, 64])
def test_exact_groups_survive_a_full_filter(hard, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    monkeypatch.setattr(exact_dedup, "_probes", lambda slots: [F.pmod(F.xxhash64("text_sha256"), F.lit(2)).alias("word"), F.lit(5).cast("long").alias("mask")])
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact_dedup.exact_groups(hard).collect()), key=str) == brute_dedup(rows)


def test_drop_exact_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == docs.select(exact_dedup.normalised(F.col("text"))).distinct().count()


def left_by_brute_force(rows):
    """(id, text) rows that stay: one of each text without blanks."""
    best = {}
    for i, t in rows:
        key = re.sub(BLANK, "", t or "")
        best[key] = min(best.get(key, (1, False, 0, None, None)), (-len(t or ""), i is not None, i or 0, i, t), key=lambda r: r[:3])
    return sorted(((b[3], b[4]) for b in best.values()), key=str)


def test_drop_exact_copies_of_repeated_rows_and_null_ids(spark, hard):
    rows = [(1, "a b"), (1, "a b"), (None, "x y"), (None, "x y"), (5, "xy"), (1, "other"), (0, "a  b "), (7, None), (7, ""), (None, "z"), (1, "q"), (1, "q")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, _sha int").repartition(3)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    strip = lambda rs: sorted(((i, re.sub(BLANK, "", t or "")) for i, t in rs), key=str)
    assert strip(tuple(r)[:2] for r in left.collect()) == strip(left_by_brute_force(rows))
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(hard).collect()]
    assert strip(got) == strip(left_by_brute_force([tuple(r) for r in hard.select("doc_id", "text").collect()]))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    cap, budget, target, open_ = {s: 2 * sizes[s] for s in names}, 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left, w = budget - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap[s]}
        target.update({s: cap[s] for s in over} if over else {s: left * weights[s] / w for s in open_})
        if not over:
            break
        open_ -= over
    return target


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    texts = docs.select("text", "source").collect()
    sizes = {}
    for r in texts:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = brute_targets(sizes), {}
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-5 and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["taken"] - r["copies"] * r["size"]) <= r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(rows) == len(texts)
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-6)
    return rows


def test_mix(spark, sf, hard, none):
    rows = check_mix(spark.read.parquet(f"{sf}/documents.parquet"))
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    check_mix(hard)
    assert mixing.mix(none).collect() == []


def test_mixed_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_id", F.lit(1)).withColumn("copies", F.lit(1))
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_mixed_rows_of_repeated_rows_and_null_ids(spark, hard, monkeypatch):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "z"), (2, "q w e r t y"), (3, None), (4, "one"), (2, "q w")]
    small = spark.createDataFrame([(i, t, "s", "row", 2) for i, t in rows], "doc_id long, text string, source string, row string, copies int")
    for most in (1 << 17, 0):
        monkeypatch.setattr(mixing, "BROADCAST_RANGES", most)
        for docs in (small, hard):
            out = mixing.mixed_rows(docs)
            assert out.columns == docs.columns
            got = {}
            for r in out.collect():
                got[r["doc_id"], r["text"], r["source"]] = got.get((r["doc_id"], r["text"], r["source"]), 0) + 1
            there = {}
            for r in docs.select("doc_id", "text", "source").collect():
                there[tuple(r)] = there.get(tuple(r), 0) + 1
            assert set(got) <= set(there) and all(n <= 2 * there[k] for k, n in got.items())
            assert sum(got.values()) == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_rows(hard.limit(0)).collect() == []
