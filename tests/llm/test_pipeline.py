import re

import corpus_pipeline
from quillon.llm import packing, toxicity
from test_files import check_packing
from test_ngram_join import brute


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r[0] for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if r[0] not in toxic]
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        best[key] = min(best.get(key, r), r, key=lambda r: (-len(r[1] or ""), r[0]))
    rows = list(best.values())
    keep = {i for i, _, c in brute([r[:2] for r in rows]) if i == c}
    rows = {r[0]: r for r in rows if r[0] in keep}
    out = corpus_pipeline.run(spark, sf).collect()
    # What the mix takes: whole documents, each at most twice, near the sources' targets.
    taken = {}
    for r in out:
        if r["piece"] == 0:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert set(taken) <= set(rows) and max(taken.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in rows.items()}
    from test_native import brute_targets

    sizes, got = {}, {}
    for i, r in rows.items():
        sizes[r[2]] = sizes.get(r[2], 0) + size[i]
        got[r[2]] = got.get(r[2], 0) + taken.get(i, 0) * size[i]
    want, most = brute_targets(sizes), {s: max(size[i] for i in rows if rows[i][2] == s) for s in sizes}
    assert all(want[s] - 1 <= got[s] <= want[s] + most[s] for s in sizes)
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(out, [(i, rows[i][1]) for i, n in taken.items() for _ in range(n)], tokenizer, packing.CAPACITY)


def test_stage_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_repeated_rows_and_null_ids_through_all_stages(spark, hard, tmp_path):
    extra = [(None, "another text without an id but six words"), (None, "another text without an id but six words"), (1, "a second text of id one, quite its own"), (None, "a b c d e f g")]
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    best = {}
    for i, t, s in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, ((1,), None)), ((-len(t or ""), i is not None, i or 0), (i, t, s)), key=lambda r: r[0])
    rows = [r for _, r in best.values()]
    # The rows 1, 2, 3 and one without an id have equal words; "one two" and "ONE two" have equal sets.
    def words_of(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    classes = {}
    for r in rows:
        key = tuple(words_of(r[1])) or ("", r[0], r[1])
        classes.setdefault(key, []).append(r)
    rows = [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    most = {}
    for i, t, _ in rows:
        most[i] = most.get(i, 0) + 2 * (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    assert set(got) <= set(most) and all(n <= most[i] for i, n in got.items())
    from test_native import brute_targets

    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    total = sum(brute_targets(sizes).values())
    begun = [r for r in out if r["start"] == 0]
    assert len(begun) <= 2 * len(rows) and total <= sum(sizes.values()) * 2
    # Copies of rows in all, as the mix of the rows that are left has it.
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from quillon.llm import mixing

    assert len(begun) == mixing.mix(left).agg({"copies": "sum"}).first()[0]


def _written(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return sorted(map(str, corpus_pipeline.run(spark, str(folder)).drop("sequence_id", "offset").collect()))


def test_an_empty_table_passes_all_stages(spark, none, tmp_path):
    assert _written(spark, none, tmp_path) == []


def test_extra_columns_with_clashing_names_change_nothing(spark, hard, tmp_path):
    plain = hard.select("doc_id", "text", "lang", "source", "n_chars")
    assert _written(spark, hard, tmp_path / "a") == _written(spark, plain, tmp_path / "b") != []
