"""The trie of conversation prefixes, rolled up by pointer jumping.

Turns are range-sorted over all conversations, so no conversation is one task. A prefix is
named by a polynomial digest of its turns' digests (SHA-256 cut to 128 bits, modulo the prime
2^127 - 1): digests of pieces join into those of the whole, so each partition digests its own
stretch and a second level, one row for each stretch, joins them. An edge leads from a
prefix's digest to that without its last turn. Then rounds of doubling: in round k each node
of depth 2^k or more gives its sums to its ancestor 2^k above, and takes that ancestor's own
pointer; so sums reach all ancestors in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.lookup import look_up
from quillon.session import materialise, partitions, ship

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of a block share the first turns of the block's first one.
FAMILY, SHARED = 20, 4
#: The prime and the base of prefix digests.
PRIME = (1 << 127) - 1
BASE = 0x5BD1E9955BD1E9952545F4914F6CDD1D % PRIME
_BACK = pow(BASE, -1, PRIME)
#: Ids of one text that are hashed at a time.
ENDS = 1 << 15
_ROOT = b"\x00" * 15 + b"\x01"
_TURNS = "conv_id long, part int, place long, digest binary, turn_digest binary, words long"
_RUN = "part int, before long, start binary"
_HEADS = f"conv_id long, n long, heads array<struct<digest:binary,words:long>>, runs array<struct<{_RUN.replace(' ', ':').replace(',:', ',')}>>"
_MEMBER = "conv_id long, key binary, parent binary, depth long, words long"


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _bytes(n: int) -> bytes:
    return n.to_bytes(16, "big")


def _stretches(batches):
    """Sorted turns -> each with its place and prefix digest inside its conversation's stretch of this partition."""
    from pyspark import TaskContext

    part, conv, place, h = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        texts = batch.column("turn_digest").to_pylist()
        places, digests = [], []
        for c, t in zip(ids, texts, strict=True):
            if c != conv:
                conv, place, h = c, 0, 0
            h = (h * BASE + _number(t)) % PRIME
            places.append(place)
            digests.append(_bytes(h))
            place += 1
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(digests, pa.binary()), batch.column("turn_digest"), batch.column("words")],
            names=["conv_id", "part", "place", "digest", "turn_digest", "words"],
        )


def _joined(batches):
    """A conversation's stretches in order -> what lies before each, and its first turns' digests."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("words", pa.int64())]))
    run = pa.list_(pa.struct([("part", pa.int32()), ("before", pa.int64()), ("start", pa.binary())]))
    for batch in batches:
        out_n, out_heads, out_runs = [], [], []
        for runs in batch.column("runs").to_pylist():
            n, h, heads, starts = 0, 0, [], []
            for r in runs:
                starts.append({"part": r["part"], "before": n, "start": _bytes(h)})
                for k in range(SHARED - 1):
                    if len(heads) < SHARED - 1 and k < r["n"]:
                        heads.append({"digest": _bytes((h * pow(BASE, k + 1, PRIME) + _number(r["digests"][k])) % PRIME), "words": r["words"][k]})
                h = (h * pow(BASE, r["n"], PRIME) + _number(r["last"])) % PRIME
                n += r["n"]
            out_n.append(n)
            out_heads.append(heads)
            out_runs.append(starts)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out_n, pa.int64()), pa.array(out_heads, kind), pa.array(out_runs, run)], names=["conv_id", "n", "heads", "runs"])


def _named(batches):
    """Own turns with what their rebuilt conversation shares -> their prefixes' digests and those before them.

    A rebuilt prefix is `h` digits of a number to the base: 1, the shared turns, the own ones.
    """
    names = ["conv_id", "place", "digest", "turn_digest", "words", "before", "start", "own_h", "own_head", "base_h", "base_head"]
    powers = [1]
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in names]
        keys, parents, depths = [], [], []
        for _, place, digest, turn, _, before, start, h, own, shared, base in zip(*cols, strict=True):
            most = max(place + 1, before + place + 1 - h, shared)
            if most >= len(powers) and most < 4096:
                while len(powers) <= most:
                    powers.append(powers[-1] * BASE % PRIME)
            power = lambda n: powers[n] if n < len(powers) else pow(BASE, n, PRIME)
            whole = (_number(start) * power(place + 1) + _number(digest)) % PRIME
            since = before + place + 1 - h
            tail = (whole - _number(own) * power(since)) % PRIME
            key = ((power(shared) + _number(base)) * power(since) + tail) % PRIME
            keys.append(_bytes(key))
            parents.append(_bytes((key - _number(turn)) * _BACK % PRIME))
            depths.append(shared + since)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(depths, pa.int64()), batch.column("words")], names=["conv_id", "key", "parent", "depth", "words"]
        )


def _shared(batches):
    """Conversations with the shared first turns -> these prefixes' digests."""
    for batch in batches:
        conv, key, parent, depth, words = [], [], [], [], []
        for c, heads in zip(batch.column("conv_id").to_pylist(), batch.column("heads").to_pylist(), strict=True):
            last = _ROOT
            for i, head in enumerate(heads):
                k = _bytes((pow(BASE, i + 1, PRIME) + _number(head["digest"])) % PRIME)
                conv.append(c), key.append(k), parent.append(last), depth.append(i + 1), words.append(head["words"])
                last = k
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(key, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int64()), pa.array(words, pa.int64())], names=["conv_id", "key", "parent", "depth", "words"]
        )


def _pieces(batches):
    """Sorted (key, conv_id) -> texts of up to `ENDS` ids of one key, commas between."""
    key, first, ids = None, None, []
    names = ["key", "first", "ids"]
    for batch in batches:
        done = ([], [], [])
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or len(ids) == ENDS:
                if ids:
                    done[0].append(key), done[1].append(first), done[2].append(",".join(ids))
                key, first, ids = k, c, []
            ids.append(str(c))
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=names)


def _hashed(batches):
    """Sorted pieces -> SHA-256 of each key's joined text; only the hash's state is held."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    keys.append(key), hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def crc_shared(conv: Column) -> Column:
    """How many first turns a conversation takes from its block's first one."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED))


def memberships(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, key, parent, depth, words) for each prefix of each rebuilt conversation but the
    root, and (conv_id, length) of each rebuilt one; both written."""
    spark = conversations.sparkSession
    ship(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.where("conv_id is not null").withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, 16)
    turns = dealt.select("conv_id", digest.alias("turn_digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = materialise(turns.mapInArrow(_stretches, _TURNS), "trie-turns")

    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    runs = turns.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), F.max_by("digest", "place").alias("last"),
        F.array(*[at("digest", k) for k in range(SHARED - 1)]).alias("digests"), F.array(*[at("words", k) for k in range(SHARED - 1)]).alias("words"),
    )
    # A conversation has at most one stretch in a partition.
    runs = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "last", "digests", "words"))).alias("runs"))
    convs = materialise(runs.mapInArrow(_joined, _HEADS), "trie-convs")

    h, block = crc_shared(F.col("conv_id")), F.col("conv_id") - F.col("conv_id") % FAMILY
    bases = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_block"), F.col("heads").alias("base_heads"))
    wide = convs.withColumns({"h": h, "_ask": block}).join(bases, F.col("_ask") == F.col("_block"), "left")
    empty, zero = F.array().cast("array<struct<digest:binary,words:long>>"), F.unhex(F.lit("00" * 16))
    wide = wide.withColumn("shared", F.slice(F.coalesce("base_heads", empty), 1, F.col("h").cast("int")))
    own_h, base_h = F.least("h", "n"), F.size("shared").cast("long")
    digest_of = lambda heads, n: F.coalesce(F.get(heads, n.cast("int") - 1).getField("digest"), zero)
    wide = materialise(
        wide.select("conv_id", "n", "runs", "shared", own_h.alias("own_h"), base_h.alias("base_h"), digest_of(F.col("heads"), own_h).alias("own_head"), digest_of(F.col("shared"), base_h).alias("base_head")), "trie-wide"
    )
    stretch = wide.select(F.col("conv_id").alias("_conv"), F.explode("runs").alias("run"), "own_h", "own_head", "base_h", "base_head")
    stretch = stretch.select("_conv", F.col("run.part").alias("_part"), F.col("run.before").alias("before"), F.col("run.start").alias("start"), "own_h", "own_head", "base_h", "base_head")
    own = turns.join(stretch, (F.col("conv_id") == F.col("_conv")) & (F.col("part") == F.col("_part"))).where("before + place >= own_h")
    own = own.select("conv_id", "place", "digest", "turn_digest", "words", "before", "start", "own_h", "own_head", "base_h", "base_head").mapInArrow(_named, _MEMBER)
    first = wide.select("conv_id", F.col("shared").alias("heads")).mapInArrow(_shared, _MEMBER)
    members = materialise(own.unionByName(first), "trie-members")
    return members, wide.select("conv_id", (F.col("n") - F.col("own_h") + F.col("base_h")).alias("length"))


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, *values): what each node's whole subtree holds, the node included, of the sums that
    `nodes` (key, parent, depth, n_children, *values; the root has depth 0) name; written.

    Only the nodes of depth 2^k or more are in round k, as sources and as pointers' targets.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = nodes.where("depth >= 1").select("key", F.col("parent").alias("up"), "depth", *values)
    given, k = [], 0
    while 1 << k <= deepest:
        sums = active.groupBy("up").agg(F.count("*").alias("refs"), *[F.sum(v).alias(f"add_{v}") for v in values])
        sums = materialise(sums, "trie-sums")
        given.append(sums)
        if 2 << k <= deepest:
            total = sums.agg(F.sum("refs")).first()[0]
            table = active.select(F.col("key").alias("_key"), F.col("up").alias("next")).join(sums.select(F.col("up").alias("_up"), "refs"), F.col("_key") == F.col("_up")).select("_key", "next", "refs")
            deep = active.where(F.col("depth") >= 2 << k)
            met = look_up(deep, "up", table, "_key", "refs", total).drop("up").withColumnRenamed("next", "up")
            more = sums.select(F.col("up").alias("_up"), *[f"add_{v}" for v in values])
            met = met.join(more, F.col("key") == F.col("_up"), "left")
            active = materialise(met.select("key", "up", "depth", *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]), "trie-active")
        k += 1
    out = nodes.select("key", *values)
    for sums in given:
        out = out.unionByName(sums.select(F.col("up").alias("key"), *[F.col(f"add_{v}").alias(v) for v in values]))
    return materialise(out.groupBy("key").agg(*[F.sum(v).alias(v) for v in values]), "trie-totals")


def _ends(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which rebuilt conversations end."""
    spark = members.sparkSession
    last = members.select("conv_id", "key", "depth").join(lengths.select(F.col("conv_id").alias("_conv"), "length"), (F.col("conv_id") == F.col("_conv")) & (F.col("depth") == F.col("length")))
    ends = last.select("key", "conv_id").unionByName(lengths.where("length = 0").select(F.lit(_ROOT).alias("key"), "conv_id"))
    dealt = ends.repartitionByRange(partitions(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: key, parent, conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role, then text by code point; null role and text are
    empty; repeated rows are turns of their own. Rows without a conv_id belong to none
    and are left out. `conv_id % 20` keeps the sign of conv_id. A conversation that only shares
    turns or has none still counts. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    members, lengths = memberships(conversations)
    lengths = materialise(lengths, "trie-lengths")
    nodes = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(_ROOT).alias("key"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"))
    nodes = materialise(nodes.unionByName(root), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("_parent")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, F.col("key") == F.col("_parent"), "left").select(
        "key", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    counted = materialise(counted.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(0)), "trie-counted")
    totals = roll_up(counted, ["saved_tokens", "n_leaves"])
    above = counted.where("n_children > 0").select(F.col("key").alias("_above"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    base = counted.select("key", "parent", "depth", "conv_id", "n_convs", F.col("n_children").alias("children"))
    met = look_up(base, "parent", above, "_above", "n_children", counted.count()).withColumnRenamed("children", "n_children")
    met = met.join(totals.withColumnRenamed("key", "_total"), F.col("key") == F.col("_total")).drop("_total")
    ends = _ends(members, lengths).withColumnRenamed("key", "_end")
    met = met.join(ends, F.col("key") == F.col("_end"), "left").drop("_end")
    return met.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def op12_prefix_trie(spark, sf_dir):
    """The trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(*COLUMNS)


ORACLE = r"""
with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place,
        {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said from conversations where conv_id is not null),
s as (select conv_id, list(said order by place) as own from t group by conv_id),
c as (select conv_id, own, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, cast(len(cast(conv_id as varchar)) + 1 as bigint)),
        lambda i: [cast(ascii(substr(cast(conv_id as varchar), i, 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end) as r from s),
h as (select conv_id, own, cast(xor(r, 4294967295) % 4 as bigint) as h from c),
r as (select h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) as seq from h left join h as b on b.conv_id = h.conv_id - h.conv_id % 20),
m as (select conv_id, d as depth, seq[1:d] as node, len(seq) as n from r, unnest(range(0, cast(len(seq) + 1 as bigint))) as u(d)),
n as (select node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from m group by node),
k as (select node[1:depth - 1] as node, count(*) as n_children from n where depth > 0 group by 1),
v as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(n.node[depth].text, '[^\x20\x09-\x0D]+')) end as saved from n left join k on n.node = k.node),
a as (select v.node[1:d] as node, sum(saved) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves from v, unnest(range(0, cast(depth + 1 as bigint))) as u(d) group by 1)
select v.conv_id, cast(v.depth as bigint) as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, cast(a.n_leaves as bigint) as n_leaves, cast(a.saved_tokens as bigint) as saved_tokens, v.ends_sha256
from v join a on a.node = v.node left join v as p on v.depth > 0 and p.depth = v.depth - 1 and p.node = v.node[1:v.depth - 1]
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": ORACLE}
