"""Exact top-k by inner product: a Voronoi join of queries and vectors.

The inner product becomes a distance by one more component, sqrt(M^2 - |x|^2) for a vector
and 0 for a query, where M is the largest norm: then d^2 = |q|^2 + M^2 - 2 q.x. Pivots, which
are rows of the data, cut this space into cells. One pass sums each cell up: how many rows,
their least and largest distance to the pivot, the queries' largest distance and bound. A
query's bound is its (k+1)-th nearest pivot. Queries of near cells make a group; a row is
sent to a group only if its distance to its pivot lies where the triangle inequality lets it
be among the k nearest of a query there. Groups are cut into blocks of queries and slices of
rows, so the memory and the time of a task do not depend on how many rows a cell has; a task
holds its queries, reads its rows as a stream and keeps k of them a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.int_vectors import LONG, exact_products, integers, usable
from quillon.session import materialise, partitions, ship

#: Most pivots, the rows they are drawn from, most groups, most queries of a block, rows of one product.
PIVOTS, SAMPLE, GROUPS, BLOCK, ROWS = 256, 2048, 1024, 8192, 2048
#: Distances are doubles of integers; bounds give way by this share.
SLACK = 1e-6
#: Products up to here fit a double together with a place of 13 bits.
PLAIN = float(1 << 39)
_KEPT = "row long, vec_id long, is_query boolean, v array<double>, norm2 double"
_SUMS = "cell int, n long, low double, high double, queries long, reach double, bound double"
_SENT = "part long, of int, row long, vec_id long, cell int, bound double, v array<double>"
_BEST = "query_row long, query_id long, row long, vec_id long, score long"


def _lists(m: np.ndarray) -> pa.Array:
    n, w = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(m).reshape(-1)))


def _matrix(column) -> np.ndarray:
    values = np.asarray(column.flatten())
    return values.reshape(len(column), len(values) // max(1, len(column)))


class Space:
    """Pivots and distances to them."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots, top
        norm2 = (pivots * pivots).sum(1)
        self.norm2, self.lift = norm2, np.sqrt(np.maximum(0.0, top - norm2))
        d2 = norm2[:, None] + norm2[None, :] - 2 * (pivots @ pivots.T + 0.0) + (self.lift[:, None] - self.lift[None, :]) ** 2
        self.between = np.sqrt(np.maximum(0.0, d2))
        np.fill_diagonal(self.between, 0.0)

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Distance of every row to every pivot."""
        n2 = (v * v).sum(1)
        d2 = n2[:, None] + self.norm2[None, :] - 2 * (v @ self.pivots.T) + (np.sqrt(np.maximum(0.0, self.top - n2))[:, None] - self.lift[None, :]) ** 2
        return np.sqrt(np.maximum(0.0, d2))

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Distance of every query to every pivot."""
        d2 = (v * v).sum(1)[:, None] + self.top - 2 * (v @ self.pivots.T)
        return np.sqrt(np.maximum(0.0, d2))

    def slack(self, norm2=0.0):
        return SLACK * np.sqrt(self.top + norm2) + SLACK


def _summaries(space: Space, k: int):
    """Batches of rows -> sums of each cell."""

    def run(batches):
        p = len(space.pivots)
        n, queries = np.zeros(p, np.int64), np.zeros(p, np.int64)
        low, high, reach, bound = np.full(p, np.inf), np.zeros(p), np.zeros(p), np.zeros(p)
        for batch in batches:
            v = _matrix(batch.column("v"))
            d = space.rows(v)
            cell = d.argmin(1)
            near = d[np.arange(len(v)), cell]
            np.add.at(n, cell, 1)
            np.minimum.at(low, cell, near)
            np.maximum.at(high, cell, near)
            asks = np.asarray(batch.column("is_query"))
            if asks.any():
                d = space.queries(v[asks])
                cell = d.argmin(1)
                np.add.at(queries, cell, 1)
                np.maximum.at(reach, cell, d[np.arange(len(d)), cell])
                np.maximum.at(bound, cell, np.partition(d, k, axis=1)[:, k] if p > k else np.inf)
        some = np.flatnonzero(n + queries)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *(pa.array(a[some]) for a in (n, low, high, queries, reach, bound))], names=["cell", "n", "low", "high", "queries", "reach", "bound"]
        )

    return run


class Layout:
    """Groups of query cells, the interval of distances that each needs of each cell, blocks and slices."""

    def __init__(self, space: Space, sums: list, k: int, tasks: int):
        p = len(space.pivots)
        n, queries = np.zeros(p, np.int64), np.zeros(p, np.int64)
        self.low, self.high, reach, bound = np.zeros(p), np.zeros(p), np.zeros(p), np.zeros(p)
        for r in sums:
            n[r.cell], self.low[r.cell], self.high[r.cell] = r.n, r.low, r.high
            queries[r.cell], reach[r.cell], bound[r.cell] = r.queries, r.reach, r.bound
        size = max(BLOCK, -(-int(queries.sum()) // GROUPS))
        self.group, at, held = np.full(p, -1), 0, 0
        left, here = set(np.flatnonzero(queries).tolist()), None
        while left:  # the next cell is the nearest to the last one
            here = min(left) if here is None else min(left, key=lambda j: (space.between[here, j], j))
            left.remove(here)
            if held and held + queries[here] > size:
                at, held = at + 1, 0
            self.group[here], held = at, held + int(queries[here])
        groups = at + 1 if len(np.flatnonzero(queries)) else 0
        self.least, self.most = np.full((groups, p), np.inf), np.full((groups, p), -np.inf)
        for i in np.flatnonzero(queries):
            g, wide = self.group[i], reach[i] + bound[i]
            extra = space.slack(reach[i] ** 2 if np.isfinite(reach[i]) else 0.0)
            self.least[g] = np.fmin(self.least[g], space.between[i] - wide - extra)
            self.most[g] = np.fmax(self.most[g], space.between[i] + wide + extra)
        asked = np.array([queries[self.group == g].sum() for g in range(groups)], np.int64)
        self.needs = (self.least <= self.high[None, :]) & (self.most >= self.low[None, :]) & (n > 0)[None, :]
        sent = np.array([n[x].sum() for x in self.needs], np.int64)
        self.blocks = np.maximum(1, -(-asked // BLOCK))
        even = max(1, int((sent * self.blocks).sum()) // (4 * tasks))
        rows = np.maximum(max(1024, even), 2 * k * np.minimum(asked, BLOCK))
        self.slices = np.maximum(1, -(-sent // rows))
        self.first = np.cumsum(self.blocks * self.slices) - self.blocks * self.slices
        self.sent_share = float((sent * self.blocks).sum()) / max(1, int(n.sum()) * int(self.blocks.sum()))


def _mixed(row: np.ndarray) -> np.ndarray:
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _send(space: Space, plan: Layout, k: int):
    """Batches of rows -> queries (`of` 0) and rows (`of` 1) of each part, a slice of rows against a block of queries."""

    def out(part, of, batch, take, cell, bound, v):
        return pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(np.full(len(part), of, np.int32)), batch.column("row").take(pa.array(take)), batch.column("vec_id").take(pa.array(take)), pa.array(cell.astype(np.int32)), pa.array(bound), _lists(v[take])],
            names=["part", "of", "row", "vec_id", "cell", "bound", "v"],
        )

    def run(batches):
        for batch in batches:
            v, row = _matrix(batch.column("v")), np.asarray(batch.column("row"))
            mixed = _mixed(row)
            asks = np.flatnonzero(np.asarray(batch.column("is_query")))
            if len(asks):
                d = space.queries(v[asks])
                cell = d.argmin(1)
                bound = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(d), np.inf)
                g = plan.group[cell]
                base = plan.first[g] + (mixed[asks] % plan.blocks[g].astype(np.uint64)).astype(np.int64) * plan.slices[g]
                often = plan.slices[g]
                again = np.repeat(np.arange(len(asks)), often)
                step = np.arange(len(again)) - np.repeat(np.cumsum(often) - often, often)
                for a in range(0, len(again), ROWS):
                    i = again[a : a + ROWS]
                    yield out(base[i] + step[a : a + ROWS], 0, batch, asks[i], cell[i], bound[i], v)
            d = space.rows(v)
            cell = d.argmin(1)
            near = d[np.arange(len(v)), cell]
            for g in range(len(plan.blocks)):
                need = np.flatnonzero((near >= plan.least[g][cell]) & (near <= plan.most[g][cell]))
                slot = (mixed[need] % np.uint64(plan.slices[g])).astype(np.int64)
                for b in range(plan.blocks[g] if len(need) else 0):
                    yield out(plan.first[g] + b * plan.slices[g] + slot, 1, batch, need, cell[need], near[need], v)

    return run


class _Block:
    """The queries of a part and the best rows met so far."""

    def __init__(self, batches: list, space: Space, k: int):
        table = pa.Table.from_batches(batches)
        self.space, self.k = space, k
        self.row, self.ids = np.asarray(table["row"].combine_chunks()), table["vec_id"].combine_chunks()
        self.q = np.concatenate([_matrix(b.column("v")) for b in batches])
        self.norm = np.sqrt((self.q * self.q).sum(1))
        self.to_pivot = space.queries(self.q).astype(np.float32)
        self.kth = np.asarray(table["bound"].combine_chunks()) + space.slack(self.norm**2)
        self.score, self.at, self.best_id = (np.zeros((len(self.row), k), np.int64) for _ in range(3))
        self.there = np.zeros((len(self.row), k), bool)

    def meet(self, row, vec_id, known, v, cell, near):
        """Rows against all queries that may need one of them."""
        cells = np.unique(cell)
        low = np.array([near[cell == c].min() for c in cells])
        high = np.array([near[cell == c].max() for c in cells])
        to = self.to_pivot[:, cells].astype(np.float64)
        slack = self.space.slack(self.norm**2)[:, None]
        need = np.maximum(to - high, low - to) <= self.kth[:, None] + slack + 1e-5 * to
        some, kept = np.flatnonzero(need.any(1)), np.isin(cell, cells[need.any(0)])
        if not len(some) or not kept.any():
            return
        row, vec_id, known, v = row[kept], vec_id[kept], known[kept], v[kept]
        order = np.lexsort((vec_id, ~known))
        row, vec_id, known, v = row[order], vec_id[order], known[order], v[order]
        norm = np.sqrt((v * v).sum(1))
        for a in range(0, len(some), ROWS):
            self._block(some[a : a + ROWS], row, vec_id, known, v, norm)

    def _block(self, some, row, vec_id, known, v, norm):
        if self.norm[some].max() * norm.max() < PLAIN:
            s = self.q[some] @ v.T
        else:  # huge components: whole numbers of any size
            s = exact_products(self.q[some], v)
        own = self.row[some][:, None] == row[None, :]
        m = min(self.k, len(row))
        if s.dtype == np.float64:
            place = s * 8192.0 - np.arange(len(row))
            place[own] = -np.inf
            best = np.argpartition(place, len(row) - m, axis=1)[:, len(row) - m :] if m < len(row) else np.broadcast_to(np.arange(m), s.shape)
        else:
            best = np.lexsort((np.broadcast_to(np.arange(len(row)), s.shape), ~s, own), axis=1)[:, :m]
        r = np.arange(len(some))[:, None]
        score = np.concatenate([self.score[some], s[r, best].astype(np.int64)], axis=1)
        at = np.concatenate([self.at[some], row[best]], axis=1)
        ids = np.concatenate([self.best_id[some], np.where(known[best], vec_id[best], LONG)], axis=1)
        there = np.concatenate([self.there[some], ~own[r, best]], axis=1)
        order = np.lexsort((at, ids, ~score, ~there), axis=1)[:, : self.k]
        self.score[some], self.at[some], self.best_id[some], self.there[some] = score[r, order], at[r, order], ids[r, order], there[r, order]
        worst = np.where(self.there[some][:, -1], self.score[some][:, -1].astype(np.float64), -np.inf)
        with np.errstate(invalid="ignore"):
            far = np.sqrt(np.maximum(0.0, self.norm[some] ** 2 + self.space.top - 2 * worst))
        self.kth[some] = np.minimum(self.kth[some], far + self.space.slack(self.norm[some] ** 2))

    def result(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.there)
        ids = self.best_id[q, j]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[q]), self.ids.take(pa.array(q)), pa.array(self.at[q, j]), pa.array(ids, pa.int64(), mask=ids == LONG), pa.array(self.score[q, j])],
            names=["query_row", "query_id", "row", "vec_id", "score"],
        )


def _solve(space: Space, k: int):
    """Batches sorted by part, queries first -> the best rows of every query in each part."""

    def run(batches):
        part, asked, block = None, [], None
        for batch in batches:
            parts, of = np.asarray(batch.column("part")), np.asarray(batch.column("of"))
            edges = np.flatnonzero(np.diff(parts) | np.diff(of)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    if block is not None:
                        yield block.result()
                    part, asked, block = parts[a], [], None
                if of[a] == 0:
                    asked.append(piece)
                elif asked:
                    block = block or _Block(asked, space, k)
                    ids = piece.column("vec_id")
                    known = np.asarray(ids.is_valid())
                    cols = np.asarray(piece.column("row")), np.asarray(ids.fill_null(0)), known, _matrix(piece.column("v")), np.asarray(piece.column("cell")), np.asarray(piece.column("bound"))
                    for i in range(0, len(known), ROWS):
                        block.meet(*(c[i : i + ROWS] for c in cols))
        if block is not None:
            yield block.result()

    return run


def _clean(width: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                v = integers(part.column("vector"), width)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("vec_id"), part.column("is_query"), _lists(v), pa.array((v * v).sum(1))], names=["row", "vec_id", "is_query", "v", "norm2"])

    return run


def top_k(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of every query.

    `query` marks the rows that ask (null: no). Components x count as floor(1024 * x), beyond
    2^40 as 2^40; scores beyond 64 bits take the last value there. Vectors that are null or hold null or
    non-finite components take no part; shorter vectors end in zeros, empty ones are all zero.
    Candidates are all rows but the query's own; repeated rows are rows of their own. Equal
    scores go to the smaller id, null ids last. A query with fewer candidates than k gets all;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    there = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), F.col(vector_col).alias("vector")).where(usable("vector"))
    width = max(1, there.agg(F.max(F.size("vector"))).first()[0] or 0)
    kept = materialise(there.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_clean(width), _KEPT), "knn")
    top = kept.agg(F.max("norm2")).first()[0]
    sample = kept.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").collect()
    seen = {}
    for r in sample:
        seen.setdefault(tuple(r.v), None)
    pivots = np.array(list(seen)[:PIVOTS]).reshape(-1, width)
    space = Space(pivots, float(top or 0.0))
    sums = kept.select("is_query", "v").mapInArrow(_summaries(space, k), _SUMS).groupBy("cell").agg(
        *(F.sum(c).alias(c) for c in ("n", "queries")), F.min("low").alias("low"), *(F.max(c).alias(c) for c in ("high", "reach", "bound"))
    )
    plan = Layout(space, sums.collect() if len(pivots) else [], k, partitions(spark))
    sent = kept.select("row", "vec_id", "is_query", "v").mapInArrow(_send(space, plan, k), _SENT)
    parts = sent.repartition("part").sortWithinPartitions("part", "of", "cell")
    best = parts.mapInArrow(_solve(space, k), _BEST)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_voronoi_knn(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 100, among all embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.v, v.v) as bigint) as score from v as q join v on q.vec_id % 100 = 0 and q.vec_id != v.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p)
select * from r where rank <= 10
"""

QUERIES = {"op11_voronoi_knn": op11_voronoi_knn}
ORACLES = {"op11_voronoi_knn": ORACLE}
