import base64
import hashlib
import sys
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import packing, token_files, tokens, warc


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_the_library(spark, sf, tokenizer, hard):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() + hard.select("text").collect()]
    texts += ["I'LL don't we've", "a\x1cb \x85c", "é ́e x́", "<|startoftext|>a b", "ΑΣ ΣΑΣ", "a,b c!? (d)", "日本 語", "a\x00b"]
    encode = tokens.encoder()
    for t, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    texts += ["a\tb\x0bc\x0cd\re", "<|", "x <| y", "  ", "\n"]
    for _ in range(2):
        for t, got in zip([*texts, None], tokens.column_encoder()(pa.array([*texts, None])), strict=True):
            assert got.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert tokens.column_encoder()(pa.array([], pa.string())) == [] and [x.tolist() for x in tokens.column_encoder()(pa.array(["", None]))] == [[], []]


def test_encoder_forgets_rare_words(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    w = tokens.Words(None)
    for t in ["a b c", "d e f g", "a d e", "h i"]:
        assert np.frombuffer(w.encode([t])[0], "<u4").tolist() == w.encode_column(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(w.cache) <= 8


def test_runs_hold_what_finds_room():
    rng = np.random.default_rng(3)
    runs, told = tokens.Runs(500, np.uint16), {}

    def make(some):
        sizes = np.array([told[int(x)][0] for x in h[some]])
        return np.concatenate([np.full(n, told[int(x)][1], np.uint16) for n, x in zip(sizes, h[some], strict=True)]), sizes

    pool = rng.integers(1, 1 << 63, 2000, dtype=np.uint64) << np.uint64(1)
    pool[:300] >>= np.uint64(12)  # these meet in few places
    for x in pool.tolist():
        told[x] = int(rng.integers(0, 300 if x % 97 == 0 else 6)), int(rng.integers(1, 1 << 16))
    for _ in range(60):
        h = rng.choice(pool[: rng.integers(1, 2000)], 200)
        at, size = runs.where(h, make)
        for x, a, n in zip(h.tolist(), at.tolist(), size.tolist(), strict=True):
            assert (n, set(runs.ids[a : a + n].tolist())) == (told[x][0], {told[x][1]} if told[x][0] else set())
    assert 300 < runs.count == np.count_nonzero(runs.find(pool) >= 0) <= 500 and len(runs.ids) <= 500 * tokens.KEPT_IDS + 60000


def test_columns_of_odd_words_equal_the_library(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    monkeypatch.setattr(tokens, "KEPT_PARTS", 8)
    monkeypatch.setattr(tokens, "FRESH_BYTES", 64)
    rng, signs = np.random.default_rng(4), list("aZéÀÞß×÷ÿ.,;:!?'1é日") + ["Łł", "x" * 300, "É" * 150]
    texts = [" ".join("".join(rng.choice(signs, rng.integers(1, 6))) for _ in range(n)) for n in rng.integers(0, 60, 80)]
    w = tokens.Words(None)
    for _ in range(2):
        for t, got in zip(texts, w.encode_column(pa.array(texts)), strict=True):
            assert got.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_many_words_are_encoded_once(tokenizer):
    class Counted:
        calls = 0

        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, *a, **b):
            Counted.calls += 1
            return self.inner.encode_batch_fast(*a, **b)

    w = tokens.Words(None)
    w.plain, w.full = Counted(w.plain), Counted(w.full)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = ["".join(letters[k // 26**j % 26] for j in range(4)) for k in range(450_000)]
    column = pa.array([" ".join(some[k : k + 1000]) for k in range(0, len(some), 1000)])
    first = w.encode_column(column)
    assert first[449].tolist() == tokenizer.encode(column[449].as_py(), add_special_tokens=False).ids
    before = Counted.calls
    # At most what a full place of the tables turned away is encoded again.
    again = w.encode_column(column)
    assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
    assert Counted.calls - before <= 1 and np.count_nonzero(w.words.hash) > 440_000


def expected_token_rows(rows, tokenizer):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(tokenizer, text)
        out.append((doc_id, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [7, 2048])
def test_token_files_round_trip(spark, hard, tokenizer, length):
    folder, manifest = token_files.write_tokens(hard, length=length)
    got = sorted(map(tuple, token_files.read_tokens(spark, folder, manifest).collect()), key=str)
    assert got == expected_token_rows([tuple(r) for r in hard.select("doc_id", "text").collect()], tokenizer)


def test_token_files_of_real_documents(spark, sf, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, token_files.op7_token_files(spark, sf).collect()), key=str)
    assert got == expected_token_rows(docs, tokenizer)


def test_sequences_are_views(spark, sf):
    folder, manifest = token_files.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"))
    part = next(p for p, n, _ in manifest if n)
    ids, mask = token_files.sequence(token_files.name(folder, part).removeprefix("file://"), 0)
    assert len(ids) == len(mask) == token_files.LENGTH and not ids.flags.owndata and mask.true_count > 0


def test_token_files_of_nothing(spark, none):
    folder, manifest = token_files.write_tokens(none)
    assert token_files.read_tokens(spark, folder, manifest).collect() == []


def check_packing(rows, docs, tokenizer, capacity):
    seqs, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append(r)
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc_id].append((k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity])))
    assert {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    return len(seqs)


@pytest.mark.parametrize("capacity", [5, 100, 4096])
def test_packing_places_everything(hard, tokenizer, capacity):
    rows = packing.pack_documents(hard, capacity=capacity).collect()
    check_packing(rows, [tuple(r) for r in hard.select("doc_id", "text").collect()], tokenizer, capacity)


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing_is_best_fit(spark, sf, tokenizer):
    rows = packing.op9_best_fit_packing(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(rows, docs, tokenizer, 4096) == best_fit([r["length"] for r in rows], 4096)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).collect() == []


def test_packing_frees_the_encoder_when_all_is_encoded(spark, monkeypatch):
    made, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, *a, whole=frame.mapInArrow: made.append(f) or whole(df, f, *a))
    assert packing.pack(spark.createDataFrame([(1, 0, 0, 5, 7)], packing.PIECE)).count() == 1
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    assert len(made) == 2
    for run in made:
        tokens.column_encoder()
        assert "_quillon_tokens" in sys.__dict__
        assert list(run(iter([]))) == [] and "_quillon_tokens" not in sys.__dict__


def test_match_equals_best_fit_by_hand():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 300)).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.match(counts, 100)
        ends = max(first + (runs[n][i + 1][0] if i + 1 < len(runs[n]) else counts[n]) - rank for n in runs for i, (rank, first, _) in enumerate(runs[n]))
        assert ends == best_fit(lengths, 100)


def test_warc_round_trip(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    got = {r["page_id"]: r for r in warc.op2_warc(spark, sf).collect()}
    check_captures(pages, got)


def check_captures(pages, got):
    best = {}
    for i, html in pages:
        best[html or ""] = max(best.get(html or "", -1), i)
    assert len(got) == len(pages)
    for i, html in pages:
        data, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if best[html or ""] == i else ("revisit", best[html or ""]))


def test_warc_hard_cases(spark):
    rows = [(1, "http://A.b.com:80/X?q=1", "<p>hi</p>\r\n\r\nWARC/1.1"), (2, None, "<p>hi</p>\r\n\r\nWARC/1.1"), (3, "http://a.b.com/", None), (4, "bad url \n é", ""), (5, "http://a.b.com/", "ü" * 2_000_000), (6, "http://[", "z")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, best int")
    out = warc.archive_pages(pages).collect()
    check_captures([(r[0], r[2]) for r in rows], {r["page_id"]: r for r in out})
    assert [r["url_key"] for r in out] == sorted(r["url_key"] for r in out)
    assert warc.archive_pages(pages.limit(0)).collect() == []
    small = {r["page_id"]: r["record_type"] for r in warc.archive_pages(pages, min_bytes=10**6).collect()}
    assert set(small.values()) == {"response"}


def test_warc_repeated_and_null_ids(spark):
    pages = spark.createDataFrame([(7, "u", "same"), (7, "u", "same"), (None, "u", "same")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=str)
    assert got == [(7, "response", None), (7, "response", None), (None, "revisit", 7)]


def test_loser_tree_and_many_runs(spark, sf, monkeypatch):
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "GROUP_ROWS", 5)
    out = warc.archive_pages(spark.read.parquet(f"{sf}/pages.parquet").repartition(7)).collect()
    assert len(out) == spark.read.parquet(f"{sf}/pages.parquet").count()
    keys = [warc.order(tuple(r)) for r in out]
    assert keys == sorted(keys)


def test_passes_merge_by_ranges(spark, monkeypatch):
    """One URL of many captures, in more runs than a pass merges at once."""
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "GROUP_ROWS", 3)
    pages = spark.range(90).selectExpr("id as page_id", "if(id % 3 = 0, concat('http://b.c/', id), 'http://a.b/') as url", "cast(id % 40 as string) as html").repartition(9)
    spans = []
    real = warc._cuts
    monkeypatch.setattr(warc, "_cuts", lambda places, n: spans.append((n, len(real(places, n)))) or real(places, n))
    out = warc.archive_pages(pages)
    rows = out.collect()
    keys = [warc.order(tuple(r)) for r in rows]
    assert keys == sorted(keys) and sorted(r["page_id"] for r in rows) == list(range(90))
    assert len(spans) == 4 and [n for n, _ in spans] == [1, 2, 2, 4] and spans[-1][1] == 3
    assert len({r["p"] for r in out.selectExpr("url_key", "spark_partition_id() as p").where("url_key = 'b,a)/'").collect()}) > 1
