"""Feeds of untrusted JSON text read into columns of fixed types.

Every function takes a column of JSON text and returns a column that is never null and never
fails: what does not fit is left out, numbers that are none read as 0, texts that are none as
"", and lists end at a cap, in the order stated. Text that is no JSON object (or list, where
one is expected) gives the empty feed; so does text in which an object repeats a key.

Lengths of texts count UTF-16 units. A number in text is read as a number, true as 1, false,
null and lists without items as 0, a list of one item as that item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a project may be called, a private one's name, dates and shards' names.
NAME, PRIVATE, DATE, SHARD = r"\A[A-Za-z0-9._-]{1,100}\z", "(private)", r"\A\d{4}-\d{2}-\d{2}\z", r"\A[a-f0-9]{8,64}\.json\z"
#: Caps of lists.
NODES, EDGES, NOTES, PROJECTS, GHOST_ROWS, GHOST_CELLS, RECENTS, TERMS, POSTINGS, SHARDS = 2000, 8000, 2000, 300, 3, 400, 5, 5000, 2000, 64
#: Caps of texts and directions.
HTML, LANGUAGE, EXCERPT, TERM, MODEL, DIRECTIONS = 300, 60, 200, 64, 100, 64
#: White space that is trimmed.
BLANK = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NUMBER = rf"\A{BLANK}*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?){BLANK}*\z"
_HEX = rf"\A{BLANK}*0[xX][0-9a-fA-F]{{1,15}}{BLANK}*\z"
NODE = "struct<id:string,label:string,course:string,week:double,tags:array<string>,html:string>"
COUNTS = "array<struct<name:string,n:double>>"
DAY = f"struct<date:string,level:double,count:double,d:struct<c:{COUNTS},p:{COUNTS},i:{COUNTS},r:{COUNTS},x:double,pl:map<string,double>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def is_number(v: Column) -> Column:
    k = _kind(v)
    return (k == "BIGINT") | (k == "DOUBLE") | (k == "FLOAT") | k.startswith("DECIMAL")


def is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def is_object(v: Column) -> Column:
    """An object or a list."""
    return _kind(v).startswith("OBJECT") | is_list(v)


def is_null(v: Column) -> Column:
    return _kind(v) == "VOID"


def part(v: Column, name: str) -> Column:
    """A field of an object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def raw_text(v: Column) -> Column:
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def text(v: Column) -> Column:
    """The text, "" for anything else."""
    return F.coalesce(raw_text(v), F.lit(""))


def finite(v: Column) -> Column:
    """The number, null for anything else."""
    n = F.try_variant_get(v, "$", "double")
    return F.when(is_number(v) & (F.abs(n) < float("inf")), n)


def _read(s: Column) -> Column:
    """The number that a text spells, 0 for others."""
    n = F.when(s.rlike(_NUMBER), F.regexp_replace(s, BLANK, "").try_cast("double")).when(s.rlike(_HEX), F.conv(F.substring(F.regexp_replace(s, BLANK, ""), 3, 99), 16, 10).try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def number(v: Column) -> Column:
    """The number that a value reads as, 0 if none."""
    one = lambda x: F.coalesce(finite(x), _read(raw_text(x)), F.when(_kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")))
    only = let(items(v), lambda a: F.when(F.size(a) == 1, let(F.get(a, F.lit(0)), lambda x: F.coalesce(finite(x), _read(raw_text(x))))))
    return F.coalesce(one(v), only, F.lit(0.0))


def whole(v: Column) -> Column:
    """The whole number, null for anything else."""
    n = finite(v)
    return F.when(n == F.floor(n), n)


def units(s: Column) -> Column:
    """Length of a text in UTF-16 units."""
    return F.char_length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def cut(s: Column, n: int) -> Column:
    """The text's first n units; a character of two units that does not fit whole is left out."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    return F.when(units(s) <= n, s).otherwise(F.aggregate(F.split(F.substring(s, 1, n), ""), start, lambda a, c: _append(a, c, n))["s"])


def _append(a: Column, c: Column, n: int) -> Column:
    more = a["n"] + units(c)
    full = a["full"] | (more > n)
    return F.struct(F.when(full, a["s"]).otherwise(F.concat(a["s"], c)).alias("s"), F.when(full, a["n"]).otherwise(more).alias("n"), full.alias("full"))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{BLANK}+|{BLANK}+\z", "")


def items(v: Column) -> Column:
    """The items of a list; none of anything else."""
    return F.coalesce(F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def ok_name(s: Column) -> Column:
    """Whether a text may be a project's name."""
    return sure(s.rlike(NAME))


def entries(json: Column, v: Column) -> Column:
    """Keys and values of an object (array of structs k, v) in the order of the text, but keys that
    are whole numbers first, ascending; of a list, its places and items."""
    keys = F.coalesce(F.array_distinct(F.json_object_keys(json)), F.array().cast("array<string>"))
    index = lambda k: k.rlike(r"\A(0|[1-9]\d{0,9})\z") & (k.try_cast("long") < 4294967295)
    first = F.transform(F.array_sort(F.transform(F.filter(keys, index), lambda k: k.cast("long"))), lambda k: k.cast("string"))
    ordered = F.concat(first, F.filter(keys, lambda k: ~index(k)))
    held = F.try_variant_get(v, "$", "map<string,variant>")
    named = let(held, lambda m: F.transform(ordered, lambda k: F.struct(k.alias("k"), F.try_element_at(m, k).alias("v"))))
    placed = F.transform(items(v), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))
    none = F.array().cast("array<struct<k:string,v:variant>>")
    return F.coalesce(F.when(is_list(v), placed).when(_kind(v).startswith("OBJECT"), named), none)


def _inner(v: Column) -> Column:
    """Entries of an object below the top, in any order."""
    held = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = F.transform(held, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    placed = F.transform(items(v), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))
    return F.coalesce(F.when(is_list(v), placed).when(_kind(v).startswith("OBJECT"), named), F.array().cast("array<struct<k:string,v:variant>>"))


def _map(pairs: Column, value: Callable[[Column], Column], kind: str) -> Column:
    out = F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["k"].alias("key"), value(e["v"]).alias("value"))))
    return F.coalesce(out, F.create_map().cast(f"map<string,{kind}>"))


def _first(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Rows whose key no row before has."""
    return let(F.struct(rows.alias("r"), F.transform(rows, key).alias("k")), lambda s: F.filter(s["r"], lambda x, i: F.array_position(s["k"], key(x)) == i + 1))


def _up_to(rows: Column, most: int | None) -> Column:
    """The first rows; all, if there is no cap."""
    return rows if most is None else F.slice(rows, 1, most)


def _parsed(json: Column, body: Callable[[Column], Column]) -> Column:
    return let(F.try_parse_json(json), body)


def graph(json: Column, most_nodes: int | None = NODES, most_edges: int | None = EDGES) -> Column:
    """Notes and links: the first `NODES` items that are objects, and the first `EDGES` links, given
    as pairs or as objects with from and to, whose ends are notes. A cap of None takes all."""

    def node(n):
        week = part(n, "week")
        tags = F.transform(F.filter(items(part(n, "tags")), is_text), text)
        return F.struct(*[text(part(n, c)).alias(c) for c in ("id", "label", "course")], F.when(~is_null(week), number(week)).alias("week"), tags.alias("tags"), text(part(n, "html")).alias("html"))

    def ends(e):
        pair, named = items(e), is_list(e)
        return F.struct(raw_text(F.when(named, F.get(pair, F.lit(0))).otherwise(part(e, "from"))).alias("a"), raw_text(F.when(named, F.get(pair, F.lit(1))).otherwise(part(e, "to"))).alias("b"))

    def body(v):
        nodes = F.transform(F.filter(_up_to(items(part(v, "nodes")), most_nodes), is_object), node)

        def linked(ns):
            known = F.map_from_entries(F.transform(F.array_distinct(F.transform(ns, lambda n: n["id"])), lambda i: F.struct(i.alias("key"), F.lit(True).alias("value"))))
            return let(known, lambda ids: _up_to(F.filter(F.transform(items(part(v, "edges")), ends), lambda e: sure(F.try_element_at(ids, e["a"])) & sure(F.try_element_at(ids, e["b"]))), most_edges))

        return let(nodes, lambda ns: F.struct(ns.cast(f"array<{NODE}>").alias("nodes"), linked(ns).alias("edges")))

    return _parsed(json, body)


def days(json: Column) -> Column:
    """Days with a date like 2024-01-31 (no calendar is asked), with counts by project."""

    def counts(v):
        kept = F.filter(items(v), lambda e: is_list(e) & let(raw_text(F.get(items(e), F.lit(0))), lambda n: sure(n == PRIVATE) | ok_name(n)))
        return F.when(is_list(v), F.transform(kept, lambda e: F.struct(text(F.get(items(e), F.lit(0))).alias("name"), number(F.get(items(e), F.lit(1))).alias("n"))))

    def detail(d):
        x, pl = part(d, "x"), part(d, "pl")
        by_language = _map(F.filter(_inner(pl), lambda e: units(e["k"]) <= LANGUAGE), number, "double")
        return F.struct(*[counts(part(d, c)).alias(c) for c in "cpir"], F.when(~is_null(x), number(x)).alias("x"), F.when(is_object(pl), by_language).alias("pl"))

    def day(v):
        d = part(v, "d")
        return F.struct(text(part(v, "date")).alias("date"), number(part(v, "level")).alias("level"), number(part(v, "count")).alias("count"), F.when(is_object(d), detail(d)).alias("d"))

    return _parsed(json, lambda v: F.transform(F.filter(items(v), lambda d: is_object(d) & sure(raw_text(part(d, "date")).rlike(DATE))), day).cast(f"array<{DAY}>"))


def repo_languages(json: Column) -> Column:
    """A text for each of the first `PROJECTS` projects that have one."""
    kept = lambda e: ((e["k"] == PRIVATE) | ok_name(e["k"])) & is_text(e["v"])
    return _parsed(json, lambda v: _map(F.slice(F.filter(entries(json, v), kept), 1, PROJECTS), text, "string"))


def language_bytes(json: Column) -> Column:
    """Numbers by language for each of the first `PROJECTS` projects that are objects."""
    inner = lambda v: _map(F.filter(_inner(v), lambda e: units(e["k"]) <= LANGUAGE), number, "double")
    return _parsed(json, lambda v: _map(F.slice(F.filter(entries(json, v), lambda e: ok_name(e["k"]) & is_object(e["v"])), 1, PROJECTS), inner, "map<string,double>"))


def ghosts(json: Column) -> Column:
    """The first `GHOST_ROWS` lists, each of `GHOST_CELLS` numbers at most."""
    return _parsed(json, lambda v: F.transform(F.slice(F.filter(items(v), is_list), 1, GHOST_ROWS), lambda a: F.transform(F.slice(items(a), 1, GHOST_CELLS), number)).cast("array<array<double>>"))


def repos(json: Column) -> Column:
    """The first `PROJECTS` objects with a project's name; flags are true or null."""

    def flag(v):
        return F.when(is_object(v) | sure(raw_text(v) != "") | sure(finite(v) != 0) | sure((_kind(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean")), True)

    def repo(v):
        rel = part(v, "rel")
        release = F.when(is_object(rel) & is_text(part(rel, "at")), F.struct(text(part(rel, "tag")).alias("tag"), text(part(rel, "at")).alias("at")))
        return F.struct(text(part(v, "name")).alias("name"), raw_text(part(v, "lang")).alias("lang"), raw_text(part(v, "desc")).alias("desc"), release.alias("rel"), flag(part(v, "fork")).alias("fork"), flag(part(v, "archived")).alias("archived"))

    return _parsed(json, lambda v: F.transform(F.slice(F.filter(items(v), lambda r: is_object(r) & ok_name(raw_text(part(r, "name")))), 1, PROJECTS), repo))


def recents(json: Column) -> Column:
    """The first `RECENTS` objects with a link, given as href or, without it, as path."""
    link = lambda r: text(F.when(is_null(part(r, "href")), part(r, "path")).otherwise(part(r, "href")))
    row = lambda r: F.struct(link(r).alias("href"), text(part(r, "course")).alias("course"), text(part(r, "title")).alias("title"))
    return _parsed(json, lambda v: F.slice(F.filter(F.transform(F.filter(items(v), is_object), row), lambda r: r["href"] != ""), 1, RECENTS))


def _page(n: Column) -> Column:
    """Whether an item is an object with a link of a fitting length."""
    return is_object(n) & sure(units(raw_text(part(n, "html"))).between(1, HTML))


def semantic(json: Column, most_notes: int | None = NOTES) -> Column:
    """Vectors of one length up to `DIRECTIONS`: of notes with exactly as many finite numbers, the
    first of each link, up to `NOTES` (or another cap; None: all); dim is 0 if none is left."""

    def body(v):
        dim = whole(part(v, "dim"))
        dim = F.coalesce(F.when(dim.between(0, DIRECTIONS), dim.cast("int")), F.lit(0))
        fits = lambda n: _page(n) & is_list(part(n, "v")) & (F.size(items(part(n, "v"))) == dim) & F.forall(items(part(n, "v")), lambda x: finite(x).isNotNull())
        note = lambda n: F.struct(text(part(n, "html")).alias("html"), F.transform(items(part(n, "v")), finite).alias("v"))
        notes = F.transform(F.filter(F.when(dim > 0, items(part(v, "notes"))).otherwise(F.array().cast("array<variant>")), fits), note)
        model, share = raw_text(part(v, "model")), finite(part(v, "explained"))
        return let(_up_to(_first(notes, lambda n: n["html"]), most_notes), lambda ns: F.struct(F.when(F.size(ns) > 0, dim).otherwise(0).alias("dim"), F.when(units(model) <= MODEL, model).alias("model"), F.when(share.between(0, 1), share).alias("explained"), ns.alias("notes")))

    return _parsed(json, body)


def excerpts(json: Column) -> Column:
    """Lines of notes, trimmed and cut at `EXCERPT`: the first of each link, then those that are not
    empty, up to `NOTES`."""

    def body(v):
        kept = F.filter(items(part(v, "notes")), lambda n: _page(n) & is_text(part(n, "ex")))
        rows = _first(F.transform(kept, lambda n: F.struct(text(part(n, "html")).alias("html"), text(part(n, "ex")).alias("ex"))), lambda n: n["html"])
        lines = F.transform(rows, lambda n: F.struct(n["html"].alias("html"), cut(trim(n["ex"]), EXCERPT).alias("ex")))
        return F.struct(F.lit(1).alias("v"), F.slice(F.filter(lines, lambda n: n["ex"] != ""), 1, NOTES).alias("notes"))

    return _parsed(json, body)


def text_index(json: Column, most_ids: int | None = NOTES) -> Column:
    """The manifest of a text index: n shards, exactly n names of files, and ids, the first `NOTES`
    (or another cap; None: all); all or nothing."""

    def body(v):
        n = whole(part(v, "n"))
        names = F.transform(items(part(v, "shards")), raw_text)
        ids = _up_to(F.transform(F.filter(items(part(v, "ids")), lambda h: sure(units(raw_text(h)).between(1, HTML))), text), most_ids)
        good = sure(n.between(1, SHARDS) & (F.size(names) == n)) & F.forall(names, lambda s: sure(s.rlike(SHARD))) & (F.size(ids) > 0)
        none = F.array().cast("array<string>")
        return let(good, lambda ok: F.struct(F.lit(1).alias("v"), F.when(ok, n.cast("int")).otherwise(0).alias("n"), F.when(ok, names).otherwise(none).alias("shards"), F.when(ok, ids).otherwise(none).alias("ids")))

    return _parsed(json, body)


def text_shard(json: Column, id_count: Column | int) -> Column:
    """Ids by term: the first `TERMS` terms of a fitting length with any id; of ids below `id_count`
    the first `POSTINGS` different ones, ascending."""
    most = id_count if isinstance(id_count, Column) else F.lit(id_count)

    def ids(v):
        known = F.filter(F.transform(items(v), whole), lambda x: sure((x >= 0) & (x < most)))
        return F.array_sort(F.slice(F.array_distinct(F.transform(known, lambda x: x.cast("int"))), 1, POSTINGS))

    def body(v):
        fits = F.filter(entries(json, v), lambda e: units(e["k"]).between(1, TERM) & is_list(e["v"]))
        rows = F.filter(F.transform(fits, lambda e: F.struct(e["k"].alias("key"), ids(e["v"]).alias("value"))), lambda e: F.size(e["value"]) > 0)
        kept = F.map_from_entries(F.slice(rows, 1, TERMS))
        return F.coalesce(F.when(~is_list(v), kept), F.create_map().cast("map<string,array<int>>"))

    return _parsed(json, body)


def flow(json: Column, most_nodes: int | None = NODES, most_edges: int | None = EDGES) -> Column:
    """A flow's outcome: the first `NODES` notes, the first `EDGES` links of two of them with a length
    above 0, and its numbers; `parted` only up to the number of clusters. A cap of None takes all."""

    def body(v):
        nodes = _up_to(F.transform(F.filter(items(part(v, "nodes")), lambda n: sure(units(raw_text(n)).between(1, HTML))), text), most_nodes)

        def feed(ns):
            link = lambda e: F.struct(*[whole(F.get(items(e), F.lit(k))).alias(c) for k, c in enumerate("ij")], finite(F.get(items(e), F.lit(2))).alias("len"))
            good = lambda e: sure(e["i"].between(0, F.size(ns) - 1) & e["j"].between(0, F.size(ns) - 1) & (e["i"] != e["j"]) & (e["len"] > 0))
            links = F.filter(F.transform(F.filter(items(part(v, "edges")), lambda e: is_list(e) & (F.size(items(e)) == 3)), link), good)
            links = F.transform(_up_to(links, most_edges), lambda e: F.struct(e["i"].cast("int").alias("i"), e["j"].cast("int").alias("j"), e["len"].alias("len")))
            count = lambda c: F.coalesce(F.when(whole(part(v, c)) >= 0, whole(part(v, c))), F.lit(0.0)).cast("long")
            size = lambda c: F.coalesce(F.when(finite(part(v, c)) >= 0, finite(part(v, c))), F.lit(0.0))
            q, parted = finite(part(v, "q")), whole(part(v, "parted"))
            return F.struct(
                count("steps").alias("steps"), size("eps").alias("eps"), size("cut").alias("cut"), F.coalesce(F.when(q.between(-1, 1), q), F.lit(0.0)).alias("q"),
                count("clusters").alias("clusters"), F.when((parted >= 0) & (parted <= count("clusters")), parted.cast("long")).alias("parted"), ns.alias("nodes"), links.alias("edges"),
            )

        return let(nodes, feed)

    return _parsed(json, body)


FEEDS = {f.__name__: f for f in (graph, days, repo_languages, language_bytes, ghosts, repos, recents, semantic, excerpts, text_index, flow)}


def read_feed(spark: SparkSession, path: str, feed: str | Callable[[Column], Column]) -> DataFrame:
    """(path, feed): one row for each JSON file under `path`, read whole and cleaned."""
    clean = FEEDS[feed] if isinstance(feed, str) else feed
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), clean(F.col("value")).alias("feed"))


def write_feed(df: DataFrame, path: str, column: str = "feed") -> None:
    """Write a column of feeds as JSON lines."""
    df.select(F.to_json(column).alias("value")).write.text(path)


def look_up(postings: DataFrame, ids: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, pos, html): the notes under each term of `terms` (term), by an equi-join.

    postings: (term, ids array) of all shards; ids: (id, html). Shards only divide the terms,
    so a table partitioned by a hash of the term reads one of them for a term.
    """
    found = postings.join(terms.select("term").distinct(), "term", "left_semi").select("term", F.posexplode("ids").alias("pos", "id"))
    return found.join(ids, "id").select("term", "pos", "html")
