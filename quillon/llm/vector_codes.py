"""Product codes of vectors: a codebook for each of four part positions, searched by ball trees.

Vectors become integers and are cut into four parts. Each round assigns every part to its
codebook's nearest entry and replaces each entry by the floor of its parts' mean; sums are
gathered per task, then over all tasks, and only the entries (at most 256 for each position)
come to the driver. A ball tree over a codebook's entries is searched by branch and bound
for many parts at once: radii are rounded up, a ball is visited also where its bound equals
the best distance, and distances at the leaves are whole numbers, so ties go to the lower
index for certain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.int_vectors import LONG, integers, usable
from quillon.llm.lookup import look_up
from quillon.session import materialise, ship

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries of a leaf; parts searched at a time.
LEAF, ROWS = 16, 8192
#: A ball's radius and a bound give way by this share.
SLACK = 1e-9
#: Whole numbers up to here are exact in doubles.
PLAIN = float(1 << 52)
_SUMS = "part int, entry int, place int, total string, n long"
_CODES = "vec_id long, label string, code string, error long"


class BallTree:
    """Nearest entry of a codebook (n, w) of whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.most = np.abs(entries).max(initial=0.0)
        self.norm2 = (entries * entries).sum(1)
        self.root = self._ball(np.arange(len(entries)))

    def _ball(self, index: np.ndarray):
        points = self.entries[index]
        centre = points.mean(0)
        radius = np.sqrt(((points - centre) ** 2).sum(1).max()) * (1 + SLACK) + SLACK
        if len(index) <= LEAF:
            return centre, radius, np.sort(index), None, None
        wide = np.ptp(points, axis=0).argmax()
        order = index[np.lexsort((index, points[:, wide]))]
        half = len(order) // 2
        return centre, radius, None, self._ball(order[:half]), self._ball(order[half:])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Index of the nearest entry of every row of x, the lower of equals, and the squared distances."""
        w = self.entries.shape[1]
        if 4 * w * max(self.most, np.abs(x).max(initial=0.0)) ** 2 >= PLAIN:
            return self._whole(x)
        n = len(x)
        best, entry = np.full(n, np.inf), np.full(n, len(self.entries))
        norm2 = (x * x).sum(1)
        self._visit(self.root, np.arange(n), x, norm2, best, entry)
        return entry, best.astype(np.int64).tolist()

    def _gap(self, ball, x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - ball[0]) ** 2).sum(1))

    def _visit(self, ball, some, x, norm2, best, entry):
        _, _, index, left, right = ball
        if index is not None:
            d = norm2[some][:, None] + self.norm2[index][None, :] - 2.0 * (x[some] @ self.entries[index].T)
            j = d.argmin(1)  # the first of equals is the lower index
            d, e = d[np.arange(len(some)), j], index[j]
            better = (d < best[some]) | ((d == best[some]) & (e < entry[some]))
            best[some[better]], entry[some[better]] = d[better], e[better]
            return
        part = x[some]
        gaps = self._gap(left, part), self._gap(right, part)
        near_left = gaps[0] <= gaps[1]
        for first, second, here in ((0, 1, near_left), (1, 0, ~near_left)):
            for side in (first, second):
                child = ball[3 + side]
                # The best so far may have shrunk since; a bound equal to it is visited, for ties.
                bound = gaps[side] * (1 - SLACK) - child[1] - SLACK
                go = here & (bound <= np.sqrt(best[some]))
                if go.any():
                    self._visit(child, some[go], x, norm2, best, entry)

    def _whole(self, x):
        """The same with integers of any size, for huge components."""
        e = self.entries.astype(np.int64).astype(object)
        entry, best = [], []
        for row in x.astype(np.int64).astype(object):
            d = ((e - row) ** 2).sum(1).tolist()
            best.append(min(d)), entry.append(d.index(min(d)))
        return np.array(entry, np.int64), best


def _parts(column, width: int):
    """Slices of a column of vectors as (first row, matrix of whole numbers)."""
    for i in range(0, len(column), ROWS):
        yield i, integers(column.slice(i, ROWS), width)


def _assign(books: list, width: int):
    """Batches -> sums of the components and numbers of the parts of each entry in this task."""
    w = width // PARTS

    def run(batches):
        trees = [BallTree(b) for b in books]
        size = len(books[0])
        total, huge = np.zeros((PARTS, size, w), np.int64), {}
        n = np.zeros((PARTS, size), np.int64)
        for batch in batches:
            for _, v in _parts(batch.column("vector"), width):
                for p in range(PARTS):
                    x = v[:, p * w : (p + 1) * w]
                    entry, _ = trees[p].nearest(x)
                    n[p] += np.bincount(entry, minlength=size)
                    order = np.argsort(entry, kind="stable")
                    first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                    total[p][entry[order[first]]] += np.add.reduceat(x[order].astype(np.int64), first)
                if np.abs(total).max(initial=0) > 1 << 61:  # 64 bits may overflow: keep whole numbers aside
                    for at in np.argwhere(total):
                        huge[tuple(at)] = huge.get(tuple(at), 0) + int(total[tuple(at)])
                    total[:] = 0
        p, e = np.nonzero(n)
        p, e, k = np.repeat(p, w), np.repeat(e, w), np.tile(np.arange(w), len(p))
        text = [str(int(total[a, b, c]) + huge.get((a, b, c), 0)) for a, b, c in zip(p, e, k, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(text, pa.string()), pa.array(n[p, e])], names=["part", "entry", "place", "total", "n"]
        )

    return run


def _codes(books: list, width: int):
    w = width // PARTS

    def run(batches):
        trees = [BallTree(b) for b in books]
        for batch in batches:
            for i, v in _parts(batch.column("vector"), width):
                found = [trees[p].nearest(v[:, p * w : (p + 1) * w]) for p in range(PARTS)]
                code = ["".join(f"{e:02x}" for e in es) for es in zip(*(f[0].tolist() for f in found), strict=True)]
                error = [min(LONG, sum(ds)) for ds in zip(*(f[1] for f in found), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(i, len(v)), batch.column("label").slice(i, len(v)), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"]
                )

    return run


def train(kept: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of each part position from `kept` (vec_id, vector)."""
    w = width // PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    books = [start[:, p * w : (p + 1) * w] for p in range(PARTS)]
    for _ in range(rounds if first else 0):
        sums = kept.select("vector").mapInArrow(_assign(books, width), _SUMS)
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = [b.copy() for b in books]
        for r in sums:
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, code, error, label, label_error) of every usable row, and the codebooks.

    Components x count as floor(1024 * x), beyond 2^40 as 2^40; errors beyond 64 bits take the last
    value there. Rows whose vector is null or holds null or non-finite components are left
    out. The width is the longest vector's, up to the next multiple of four (four at least); shorter ones
    end in zeros. Entries start from the first 256 rows by id (null last), then vector; with
    fewer rows there are fewer entries. Repeated rows count as often as they come. Null labels
    are equal. An empty table gives no rows and empty codebooks. Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")).where(usable("vector"))
    kept = materialise(kept, "codes-kept")
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = PARTS * max(1, -(-longest // PARTS))
    books = train(kept, width)
    if not len(books[0]):
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label", F.lit(0).cast("long").alias("label_error")), books
    coded = materialise(kept.mapInArrow(_codes(books, width), _CODES), "codes")
    labels = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("refs"))
    # A null label has a key of its own: no text of a label begins with "-".
    name = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    labels = materialise(labels.select(name("label").alias("_label"), F.least("label_error", F.lit(LONG)).cast("long").alias("label_error"), "refs"), "codes-labels")
    met = look_up(coded.withColumn("_name", name("label")), "_name", labels, "_label", "refs", coded.count())
    return met.drop("_name"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry, position, commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir):
    """Codes of all embeddings."""
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as SQL: each part meets every entry of its position."""
    rounds = []
    near = """n{i} as materialized (select p.vec_id, p.part, any_value(p.v) as v, min((list_inner_product(p.v, p.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(p.v, b.v)) * 256 + b.entry) as best
      from p join b{i} as b using (part) group by 1, 2)"""
    book = """b{j} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{i} as b left join
      (select part, entry, list(mean order by place) as v from (select part, cast(best % 256 as integer) as entry, place, floor(sum(v[place]) / count(*)) as mean from n{i}, unnest(range(1, len(v) + 1)) as u(place) group by 1, 2, 3) group by 1, 2) as m using (part, entry))"""
    for i in range(ROUNDS):
        rounds += [near.format(i=i), book.format(i=i, j=i + 1)]
    rounds.append(near.format(i=ROUNDS))
    return """
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] as v from k, unnest(range(4)) as u(part)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k order by vec_id limit 256),
b0 as materialized (select part, cast(entry as integer) as entry, v from p join f using (vec_id)),
""" + ",\n".join(rounds) + """,
c as (select vec_id, string_agg(printf('%02x', cast(best % 256 as integer)), '' order by part) as code, cast(sum(floor(best / 256)) as bigint) as error from n{n} group by 1),
s as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: cast(cast(x as bigint) as varchar)), ','), ',' order by part, entry)) as codebooks_sha256 from b{n})
select c.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from c join k using (vec_id), s
""".replace("{n}", str(ROUNDS))


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _sql()}
