import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import feeds


@pytest.fixture(scope="module")
def clean(spark):
    def run(feed, *docs, extra=()):
        texts = [d if isinstance(d, str) or d is None else json.dumps(d) for d in docs]
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string")
        rows = df.select("k", feed(F.col("j"), *extra).alias("f")).orderBy("k").collect()
        out = [r.asDict(True)["f"] for r in rows]
        return out[0] if len(out) == 1 else out

    return run


JUNK = (None, "", "null", "3", '"x"', "{bad", "[]", "{}")


def test_junk_gives_empty_feeds(clean):
    for feed in feeds.FEEDS.values():
        for out in clean(feed, *JUNK):
            assert out is not None
            flat = out if not isinstance(out, dict) or set(out) <= set() else [x for x in out.values() if isinstance(x, list)]
            assert all(not x for x in (flat or [[]]))
    assert clean(feeds.text_shard, *JUNK, extra=(5,)) == [{}] * len(JUNK)


def test_graph(clean):
    doc = {"nodes": [None, "s", {"id": "a", "label": 3, "week": "2", "tags": ["x", 1, None]}, {"id": "b", "week": None, "html": "h"}, {"id": "c", "week": "two"}, [1]], "edges": [["a", "b"], {"from": "b", "to": "a"}, ["a", "ghost"], ["a"], "ab", None, ["c", "c", "c"], [1, 2]]}
    out = clean(feeds.graph, doc)
    assert [(n["id"], n["label"], n["week"], n["tags"], n["html"]) for n in out["nodes"]] == [("a", "", 2.0, ["x"], ""), ("b", "", None, [], "h"), ("c", "", 0.0, [], ""), ("", "", None, [], "")]
    assert [(e["a"], e["b"]) for e in out["edges"]] == [("a", "b"), ("b", "a"), ("c", "c")]
    many = clean(feeds.graph, {"nodes": [{"id": f"n{k}"} for k in range(3000)], "edges": [["n0", f"n{k}"] for k in range(3000)] * 5})
    assert len(many["nodes"]) == 2000 and len(many["edges"]) == 8000


def test_days(clean):
    doc = [
        {"date": "2024-01-31", "level": "2", "count": " 0x10 ", "d": {"c": [["ok.name", "3"], ["<b>", 1], ["(private)", 2], "x", [5, 1]], "p": "no", "x": "7", "pl": {"Go": "5", "__proto__": 2, "l" * 61: 1}}},
        {"date": "2024-1-31"}, {"date": "2024-01-31\n"}, {"date": 20240131}, None, {"date": "9999-99-99", "level": None, "count": True, "d": None},
    ]
    one, two = clean(feeds.days, doc)
    assert (one["level"], one["count"]) == (2.0, 16.0) and [(x["name"], x["n"]) for x in one["d"]["c"]] == [("ok.name", 3.0), ("(private)", 2.0)]
    assert one["d"]["p"] is None and one["d"]["x"] == 7.0 and one["d"]["pl"] == {"Go": 5.0, "__proto__": 2.0}
    assert (two["date"], two["level"], two["count"], two["d"]) == ("9999-99-99", 0.0, 1.0, None)


def test_numbers(clean):
    doc = [["1", " 2.5 ", "", "1e3", ".5", "5.", "abc", "1 2", True, False, None, [], [4], ["6"], [1, 2], {}, 1e308, "1e999", "-0x1", "Infinity", -7]]
    assert clean(feeds.ghosts, doc) == [[1, 2.5, 0, 1000, 0.5, 5, 0, 0, 1, 0, 0, 0, 4, 6, 0, 0, 1e308, 0, 0, 0, -7]]
    rows = clean(feeds.ghosts, [[1] * 500, 3, [2], [3], [4]])
    assert [len(r) for r in rows] == [400, 1, 1]


def test_languages(clean):
    assert clean(feeds.repo_languages, {"a.b": "Go", "(private)": "C", "<i>": "x", "n": 3, "__proto__": "P", "constructor": "Q"}) == {"a.b": "Go", "(private)": "C", "__proto__": "P", "constructor": "Q"}
    many = clean(feeds.repo_languages, {**{f"r{k}": "x" for k in range(400)}, "7": "seven"})
    assert len(many) == 300 and "7" in many and "r298" in many and "r299" not in many
    assert clean(feeds.language_bytes, {"a": {"Go": "12", "x" * 61: 1, "C": None}, "(private)": {"Go": 1}, "b": 3, "c": [5]}) == {"a": {"Go": 12.0, "C": 0.0}, "c": {"0": 5.0}}


def test_repos_and_recents(clean):
    doc = [{"name": "ok", "lang": "Go", "desc": 3, "rel": {"at": "now"}, "fork": 1, "archived": "", "more": 1}, {"name": "not ok"}, {"name": "x" * 101}, {"name": "b", "rel": {"tag": "v1"}, "fork": 0, "archived": True}]
    one, two = clean(feeds.repos, doc)
    assert one == {"name": "ok", "lang": "Go", "desc": None, "rel": {"tag": "", "at": "now"}, "fork": True, "archived": None}
    assert two == {"name": "b", "lang": None, "desc": None, "rel": None, "fork": None, "archived": True}
    rows = clean(feeds.recents, [{"path": "/p"}, {"href": "", "path": "/q"}, {"href": "/r", "title": "t", "course": 5}, None, *({"href": f"/{k}"} for k in range(9))])
    assert [r["href"] for r in rows] == ["/p", "/r", "/0", "/1", "/2"] and rows[1] == {"href": "/r", "course": "", "title": "t"}


def test_semantic(clean):
    good = {"html": "a", "v": [1, 2.5]}
    notes = [good, {"html": "a", "v": [3, 4]}, {"html": "", "v": [1, 2]}, {"html": "h" * 301, "v": [1, 2]}, {"html": "b", "v": [1]}, {"html": "c", "v": [1, "2"]}, {"html": "d", "v": [1, None]}, {"html": "e", "v": [0, -1]}]
    out = clean(feeds.semantic, {"dim": 2, "model": "m", "explained": 0.4, "notes": notes})
    assert out == {"dim": 2, "model": "m", "explained": 0.4, "notes": [{"html": "a", "v": [1.0, 2.5]}, {"html": "e", "v": [0.0, -1.0]}]}
    for dim in (65, -1, 1.5, "2", None):
        assert clean(feeds.semantic, {"dim": dim, "notes": notes, "model": "m" * 101, "explained": 2}) == {"dim": 0, "model": None, "explained": None, "notes": []}
    assert clean(feeds.semantic, {"dim": 2.0, "notes": [good]})["dim"] == 2
    assert len(clean(feeds.semantic, {"dim": 1, "notes": [{"html": str(k), "v": [k]} for k in range(2100)]})["notes"]) == 2000


def test_excerpts(clean):
    notes = [{"html": "a", "ex": " ﻿ \n"}, {"html": "a", "ex": "second of a"}, {"html": "b", "ex": " x y "}, {"html": "c", "ex": "z" * 300}, {"html": "d", "ex": 3}, {"html": "e", "ex": "😀" * 150}, {"html": "f", "ex": "y" + "😀" * 150}]
    out = clean(feeds.excerpts, {"notes": notes})
    assert out["v"] == 1 and [(n["html"], n["ex"]) for n in out["notes"]] == [("b", "x y"), ("c", "z" * 200), ("e", "😀" * 100), ("f", "y" + "😀" * 99)]


def test_text_index(clean):
    good = {"n": 2, "shards": ["0123abcd.json", "f" * 64 + ".json"], "ids": ["/a", "", 3, "/b"]}
    assert clean(feeds.text_index, good) == {"v": 1, "n": 2, "shards": good["shards"], "ids": ["/a", "/b"]}
    empty = {"v": 1, "n": 0, "shards": [], "ids": []}
    for change in ({"n": 3}, {"n": 0}, {"n": 65}, {"n": "2"}, {"shards": ["../0123abcd.json", "0123abcd.json"]}, {"shards": ["0123ABCD.json", "0123abcd.json"]}, {"shards": ["0123abcd.json\n", "0123abcd.json"]}, {"shards": [1, "0123abcd.json"]}, {"ids": []}, {"ids": [1]}):
        assert clean(feeds.text_index, good | change) == empty


def test_text_shard(clean):
    doc = {"word": [3, 1, 1, 9, -1, 2.5, "2", 4.0], "__proto__": [0], "": [1], "t" * 65: [1], "none": [99], "x": 3}
    assert clean(feeds.text_shard, doc, extra=(5,)) == {"word": [1, 3, 4], "__proto__": [0]}
    many = clean(feeds.text_shard, {**{f"w{k}": [0] for k in range(5100)}, "10": [1]}, extra=(5,))
    assert len(many) == 5000 and many["10"] == [1] and "w4998" in many and "w4999" not in many
    assert clean(feeds.text_shard, {"w": list(range(2500, 0, -1))}, extra=(9999,))["w"] == list(range(501, 2501))


def test_flow(clean):
    doc = {"nodes": ["a", "b", "", 3, "c"], "edges": [[0, 1, 2.5], [1, 1, 1], [0, 3, 1], [0, 2, 0], [0, 2, "1"], [0, 2], [2, 0, 1], [0.5, 1, 1]], "steps": 3, "eps": -1, "cut": 1.5, "q": 2, "clusters": 4, "parted": 5}
    out = clean(feeds.flow, doc)
    assert out["nodes"] == ["a", "b", "c"] and [tuple(e.values()) for e in out["edges"]] == [(0, 1, 2.5), (2, 0, 1.0)]
    assert (out["steps"], out["eps"], out["cut"], out["q"], out["clusters"], out["parted"]) == (3, 0.0, 1.5, 0.0, 4, None)
    assert clean(feeds.flow, doc | {"parted": 4, "q": -0.25})["parted"] == 4


def test_files_and_lookup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"nodes": [{"id": "x"}],\n "edges": []}')
    (tmp_path / "in" / "b.json").write_text("broken")
    got = {r["path"].rsplit("/", 1)[1]: len(r["feed"]["nodes"]) for r in feeds.read_feed(spark, f"{tmp_path}/in", "graph").collect()}
    assert got == {"a.json": 1, "b.json": 0}
    feeds.write_feed(feeds.read_feed(spark, f"{tmp_path}/in", "graph"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2
    postings = spark.createDataFrame([("tea", [0, 2]), ("cup", [1])], "term string, ids array<int>")
    ids = spark.createDataFrame([(0, "/a"), (1, "/b"), (2, "/c")], "id int, html string")
    rows = feeds.look_up(postings, ids, spark.createDataFrame([("tea",), ("tea",), ("pot",)], "term string"))
    assert sorted(map(tuple, rows.collect())) == [("tea", 0, "/a"), ("tea", 1, "/c")]
