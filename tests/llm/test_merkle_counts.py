import hashlib
import random

import pyarrow as pa
import pytest

from quillon.llm import merkle, token_counts, tokens, words


def check(rows, docs):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = {}
    for k, (i, text) in enumerate(order):
        t, f = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        e = t[: n - n // 3] + f[: n // 3]
        own, changed, near = merkle.fingerprints([t])[0], merkle.fingerprints([e])[0], merkle.fingerprints([f])[0]
        want.setdefault(i, []).append((n, hashlib.sha256(e.encode()).hexdigest(), own, changed, merkle.likeness(own, changed), merkle.likeness(own, near)))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(tuple(r[1:7]))
        assert [tuple(x) for x in r["edited_ranges"]] == merkle.edits(r["edited_fingerprint"], r["fingerprint"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_documents(spark, sf):
    rows = merkle.op5_merkle_fingerprints(spark, sf).collect()
    check(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    long = [r for r in rows if r["n_chars"] > 1000]
    assert sum(r["near_edited"] > 0.4 for r in long) > 0.9 * len(long)
    assert sum(r["near_next"] < 0.2 for r in long) > 0.9 * len(long)


def test_hard(spark, hard, none):
    check(merkle.fingerprint_edits(hard).collect(), [tuple(r) for r in hard.select("doc_id", "text").collect()])
    assert merkle.fingerprint_edits(none).collect() == []
    lone = spark.createDataFrame([(4, "abc def")], "doc_id long, text string")
    check(merkle.fingerprint_edits(lone).collect(), [(4, "abc def")])


def _edited(text: str, following: str) -> str:
    n = len(text)
    return text[: n - n // 3] + following[: n // 3]


def test_texts_of_every_length_are_near_their_edits(spark, sf):
    """Cuts of real texts from 1 to 1,000 characters and beyond, their next ones short, long or none."""
    rnd = random.Random(11)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0]]
    bands = {}
    for n in [*range(60, 1001, 4), *range(1000, 4000, 50)]:
        for _ in range(3):
            t = rnd.choice([t for t in texts if len(t) > 300])
            at = rnd.randrange(len(t))
            t = (t[at:] + " " + t + " " + rnd.choice(texts) + " " + rnd.choice(texts))[:n]
            for f in ("", rnd.choice(texts)[: rnd.randint(1, 40)], rnd.choice(texts)):
                a, b, c = merkle.fingerprints([t, _edited(t, f), f])
                bands.setdefault(min(n // 100, 10), []).append((merkle.likeness(a, b), merkle.likeness(a, c)))
    for band, found in bands.items():
        assert sum(x > 0.4 for x, _ in found) >= 0.9 * len(found), band
        assert sum(x < 0.3 for _, x in found) >= 0.9 * len(found), band
    for n in range(1, 60):
        t = texts[0][:n]
        one, two = merkle.fingerprints([t, _edited(t, texts[1])])
        assert 0 <= merkle.likeness(one, two) <= 1 and merkle.likeness(one, one) == 1


@pytest.mark.parametrize("word", ["a", "word", "zweiundzwanzig", "漢字", "x" * 90])
def test_repeated_words_are_near_their_edits(word):
    for n in (30, 100, 401, 450, 620, 3000, 9000):
        t = " ".join([word] * n)
        for f in ("", "other words here", "other words here " * n):
            assert merkle.likeness(*merkle.fingerprints([t, _edited(t, f)])) > 0.4


def test_a_text_shares_leaves_with_its_beginning(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0] and len(r[0]) > 500]
    far = [merkle.likeness(*merkle.fingerprints([t[:450], t[:400]])) for t in texts]
    assert sum(x > 0.6 for x in far) >= 0.95 * len(far) and sum(x > 0.75 for x in far) >= 0.8 * len(far)
    shifted = [merkle.likeness(*merkle.fingerprints([t[:3000], "some new words before " + t[:3000]])) for t in texts if len(t) > 3000]
    assert sum(x > 0.75 for x in shifted) >= 0.9 * len(shifted)


def _rebuilt(text: str):
    """A tree by another way: from the fingerprint's own lengths, digests of the bytes."""
    mark, data, at = merkle.fingerprints([text])[0], text.encode(), 0
    sections = []
    for digest, paragraphs in merkle._sections(mark):
        inner = []
        for p in paragraphs:
            leaves = []
            for x in merkle._passages(p):
                n = merkle._bytes([x])
                leaf = hashlib.blake2b(data[at : at + n], digest_size=8).digest()
                assert merkle.base64.b64encode(leaf[:3]).decode() == x[:4]
                leaves.append(leaf)
                at += n
            inner.append(hashlib.blake2b(b"".join(leaves), digest_size=6).digest())
            assert merkle.base64.b64encode(inner[-1]).decode() == p[:8]
        sections.append(hashlib.blake2b(b"".join(inner), digest_size=6).digest())
        assert merkle.base64.b64encode(sections[-1]).decode() == digest
    assert at == len(data) and mark[:32] == hashlib.blake2b(b"".join(sections), digest_size=16).hexdigest()


def test_digests_of_all_levels(hard):
    rnd = random.Random(8)
    texts = [r[0] or "" for r in hard.select("text").collect()]
    texts += ["".join(rnd.choices("ab é\n漢", k=n)) for n in (1, 30, 399, 401, 3000)] + ["漢" * 9000, "".join(rnd.choices("漢字仮名交文", k=20000))]
    for t in texts:
        _rebuilt(t)


def test_words_that_repeat_a_pattern_differ():
    word = "a"
    while len(word) < 1 << 13:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    for k in range(10, 14):
        a, b = word[: 1 << k], other[: 1 << k]
        one, two = merkle.fingerprints([a, b])
        assert one[:32] != two[:32] and merkle.likeness(one, two) < 1  # long ones share pieces
        h, _, _ = words.all_words(pa.array([a, b]))
        assert h[0] != h[1]
        sets = list(words.shingles(pa.array([a + " x y z w", b + " x y z w"]), 5))
        assert not set(sets[0].tolist()) & set(sets[1].tolist())


def test_insertion_moves_no_later_branch():
    rnd = random.Random(3)
    text = "".join(rnd.choices("漢字仮名交文学生大小中国日本人", k=60000))
    one, two = merkle.fingerprints([text, "新" + text])
    assert merkle.likeness(one, two) > 0.97
    assert sum(e - s for s, e in merkle.edits(two, one)) < 4000


def test_random_edits_lie_in_the_ranges_found():
    rnd = random.Random(6)
    for _ in range(30):
        words_ = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(rnd.randint(80, 900))]
        text = "".join(w + rnd.choice("     \n") for w in words_)
        at = rnd.randrange(len(text))
        new = text[:at] + "#" + text[at + 1 :]
        one, two = merkle.fingerprints([text, new])
        found = merkle.edits(two, one)
        assert any(s <= at < e for s, e in found) and sum(e - s for s, e in found) < 1500
        assert merkle.edits(one, one) == []


def test_equality_and_location():
    rnd = random.Random(1)
    lines = [" ".join("".join(rnd.choices("abcdef", k=5)) for _ in range(40)) for _ in range(60)]
    a = "\n".join(lines)
    lines[30] = "something else"
    b = "\n".join(lines)
    fa, fb, again = merkle.fingerprints([a, b, str(a)])
    assert fa == again and fa != fb and merkle.likeness(fa, fb) > 0.9
    spans = merkle.edits(fb, fa)
    assert [b.encode()[s:e] for s, e in spans] == [b"something else\n"]
    assert merkle.edits(fa, fa) == []
    one = "x" * 500_000
    assert merkle.likeness(*merkle.fingerprints([one, one[:-1]])) > 0.8
    assert len(set(merkle.fingerprints(["", " ", "\n", "a", "a\n", "\na", "A"]))) == 7


@pytest.fixture(scope="module")
def count():
    encode = tokens.encoder()
    return lambda pieces: [len(b) // 4 for b in encode(pieces)]


def check_tree(tree):
    for k in range(1, tree.base):
        assert tree.chars[k] == tree.chars[2 * k] + tree.chars[2 * k + 1] and tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1]
    assert tree.chars[1] == len(tree.text)


@pytest.mark.parametrize("letters", ["abé ,.'\ń<|I", "漢字。、中国ab\n", "ab.,!", "x"])
def test_random_edits(count, letters, monkeypatch):
    from tokenizers import Tokenizer
    import public_tokenizers

    monkeypatch.setattr(token_counts, "SEGMENT", 40)
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(4)
    for _ in range(20):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 3000)))
        tree = token_counts.SegmentTree(token_counts.segments(text, 40), count)
        for _ in range(12):
            a = rnd.randint(0, len(text))
            b = min(len(text), a + rnd.choice([0, 0, 1, 3, 50, 700]))
            new = rnd.choice(["", " ", "x", "\u0301", "don't ", "<|endoftext|>", "word " * 200, ".", "。", "<", "|endoftext|>", "!?"])
            text = text[:a] + new + text[b:]
            assert tree.edit(a, b, new) == len(full.encode(text, add_special_tokens=False).ids)
            assert tree.text == text
            check_tree(tree)
            tree = token_counts.SegmentTree.kept(tree.text, tree.chars, tree.tokens, count)


def test_texts_without_spaces_have_segments(count):
    for text in ("漢字仮名。" * 4000, "line\n" * 4000, "word,word." * 3000):
        pieces = token_counts.segments(text)
        tree = token_counts.SegmentTree(pieces, count)
        assert len(pieces) > len(text) // 700
        tree.edit(len(text) // 2, len(text) // 2, "x")
        assert tree.reencoded < 3000


def test_later_edits_start_from_kept_trees(spark, hard, count, tmp_path, monkeypatch):
    for most in (1 << 14, 0):
        monkeypatch.setattr(token_counts, "BROADCAST_EDITS", most)
        trees = token_counts.keep_trees(token_counts.build_trees(hard), f"{tmp_path}/first-{most}")
        first = spark.createDataFrame([(7, 0, 100, 120, "new words"), (7, 1, 0, 5, ""), (2, 0, 50, 90, " end"), (77, 0, 0, 0, "x"), (None, 0, 0, 3, "y")], "doc_id long, seq int, start int, stop int, new string")
        edited = token_counts.keep_trees(token_counts.apply_edits(token_counts.with_edits(trees, first)).select("doc_id", "text", "chars", "tokens"), f"{tmp_path}/second-{most}")
        later = spark.createDataFrame([(7, 5, 1000, 1001, None), (2, 0, 0, 0, "start ")], "doc_id long, seq int, start int, stop int, new string")
        rows = token_counts.apply_edits(token_counts.with_edits(edited, later)).collect()
        want = {7: ("word " * 30000), 2: "a b c d e f g"}
        w = want[7][:100] + "new words" + want[7][120:]
        w = w[5:]
        want = {7: w[:1000] + w[1001:], 2: "start " + want[2] + " end"}
        assert len(rows) == hard.count()
        for r in rows:
            assert r["edited_tokens"] == count([r["text"]])[0] and r["edited_chars"] == len(r["text"])
            if r["doc_id"] in want:
                assert r["text"] == want[r["doc_id"]] and (r["doc_id"] != 7 or r["reencoded_chars"] < 3000)


def test_counts(spark, sf, hard, none, count):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), hard):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r[0], []).append(r[1] or "")
        want = []
        for i, ts in texts.items():
            for t in ts:
                e = t
                for a, b, new in token_counts.standard_edits(len(t), t):
                    e = e[:a] + new + e[b:]
                want.append((i, len(t), *count([t]), len(e), *count([e])))
        got = [tuple(r)[:5] for r in token_counts.counted(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.counted(none).collect() == []
    big = [r for r in token_counts.op6_token_counts(spark, sf).collect() if r["n_chars"] > 8000]
    assert big and all(r["reencoded_chars"] < r["n_chars"] / 2 for r in big)
