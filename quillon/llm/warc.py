"""WARC archives and their capture index.

Every partition of pages becomes one archive of gzip members, one for each record. Of
equal payloads one record holds the payload (response), the others refer to it (revisit).
Archives are read back task by task; each gives a locally sorted run of captures. Runs
are merged by URL key and time in a loser tree, `FAN_IN` at a time and in every pass by
ranges of that order, so that each pass has as many tasks as the session has partitions or
more; the last pass gives globally ordered capture histories. Ranges are cut at places of the
whole order, so one URL of many captures is several ranges. Files have names by pass, run and
range, so the driver holds a few numbers and at most `CUTS` sampled captures.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import storage
from quillon.session import materialise, new_path, partitions, ship

MIN_BYTES = 0
FAN_IN = 64
GROUP_ROWS = 2048
SAMPLES = 16
CUTS = 4096
BROADCAST_GROUPS = 1 << 18
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
CAPTURE = pa.schema(
    [("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
DDL = "url_key string, captured_at string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: the host's labels reversed, then path and query, lower case."""
    try:
        u = urlsplit((url or "").strip())
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return (url or "").lower()
    return f"{host}){(u.path or '/').lower()}" + (f"?{u.query.lower()}" if u.query else "")


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, sha1, refers_to (null for responses), for every row.

    Of payloads of at least `min_bytes` bytes that are equal (by SHA-1), that with the
    largest id is the response; rows that repeat this id are responses too. Smaller ones
    all are. A null payload is empty. A null id refers to others and is never referred to.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= min_bytes
    best = rows.where(large).groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("_sha1"), "best")
    few = best.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    out = rows.join(F.broadcast(best) if few else best, (F.col("sha1") == F.col("_sha1")) & large, "left")
    return out.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record, uncompressed. The page ids are extension fields."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    when = EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**8)
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", f"{when:%Y-%m-%dT%H:%M:%SZ}"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to)]
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive_name(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.warc.gz"


def write_archives(rows: DataFrame) -> tuple[str, int]:
    """Write what `classify` gives; returns the folder and one more than its last archive's number."""
    spark = rows.sparkSession
    ship(spark)
    folder = new_path(spark, "warc")

    def write(batches):
        part, n = TaskContext.get().partitionId(), 0
        with storage.new_file(archive_name(folder, part)) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    out.write(z.compress(record(row["page_id"], row["url"], row["payload"].encode(), row["refers_to"])) + z.flush())
                    n += 1
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]})

    made = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "part long, n long")
    last = made.agg(F.max("part")).first()[0]
    return folder, 0 if last is None else last + 1


def read_records(f):
    """(offset, compressed length, header fields, block) of an archive of gzip members."""
    start, z, got, tail = 0, zlib.decompressobj(31), [], b""
    at = 0
    while True:
        data = tail or f.read(1 << 20)
        if not data:
            return
        at += 0 if tail else len(data)
        got.append(z.decompress(data))
        tail = b""
        if z.eof:
            tail = z.unused_data
            end = at - len(tail)
            raw = b"".join(got)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield start, end - start, fields, rest[: int(fields["Content-Length"])]
            start, z, got = end, zlib.decompressobj(31), []


def captures(f, archive: str):
    """Captures of an archive; a response's payload must have the digest that it states."""
    for offset, length, fields, block in read_records(f):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
            raise ValueError(f"{archive}: wrong payload digest at {offset}")
        size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
        ids = [int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
        uri = fields["WARC-Target-URI"]
        yield (url_key(uri), fields["WARC-Date"], ids[0], uri, kind, size, stated, ids[1], archive, offset, length)


def order(row) -> tuple:
    """Captures are ordered by URL key, time, page id (null first) and place."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9])


class LoserTree:
    """k-way merge: inner nodes keep the losers of their matches, so that a new head is
    played along one path only."""

    def __init__(self, runs, key=order):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head[2]
            self.heads[w] = self._next(w)
            node, winner = (w + self.k) // 2, w
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def _write_run(uri: str, rows) -> int:
    """A sorted run as Parquet, row groups of `GROUP_ROWS` so that key ranges can be read."""
    n, some = 0, []
    with storage.new_file(uri) as out, pq.ParquetWriter(out, CAPTURE) as w:
        for row in rows:
            some.append(row)
            if len(some) == GROUP_ROWS:
                w.write_table(_table(some))
                n, some = n + len(some), []
        if some:
            w.write_table(_table(some))
            n += len(some)
    return n


def _table(rows):
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CAPTURE.types, strict=True)], schema=CAPTURE)


def _read_run(uri: str, low: tuple | None, high: tuple | None):
    """Captures of a run with low <= their order < high, read by row group."""
    with storage.read_file(uri) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            s = file.metadata.row_group(g).column(0).statistics
            if s is not None and s.has_min_max and (high is not None and s.min > high[0] or low is not None and s.max < low[0]):
                continue
            for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns), strict=True):
                at = order(row)
                if high is not None and at >= high:
                    return
                if low is None or at >= low:
                    yield row


class Runs:
    """Sorted runs of one pass: `n` of them, each in as many files as the cuts divide the order into."""

    def __init__(self, folder: str, level: int, n: int, cuts: list[tuple]):
        self.folder, self.level, self.n, self.cuts = folder, level, n, cuts

    def name(self, run: int, part: int) -> str:
        return f"{self.folder}/run-{self.level}-{run:06d}-{part:06d}.parquet"

    def bounds(self) -> list[tuple[tuple | None, tuple | None]]:
        return list(zip([None, *self.cuts], [*self.cuts, None], strict=True))

    def read(self, run: int, low: tuple | None, high: tuple | None):
        """Captures of a run in a range, from those of its files that reach into it."""
        for part, (first, last) in enumerate(self.bounds()):
            if (high is None or first is None or first < high) and (low is None or last is None or low < last) and storage.exists(self.name(run, part)):
                yield from _read_run(self.name(run, part), low, high)

    def merged(self, group: int, low: tuple | None, high: tuple | None):
        """Captures of `FAN_IN` runs in a range, merged."""
        return LoserTree([self.read(k, low, high) for k in range(group * FAN_IN, min(self.n, (group + 1) * FAN_IN))])


def capture_runs(spark, folder: str, archives: int) -> tuple[Runs, list[tuple]]:
    """Read archives back into sorted runs; also at most `CUTS` of their captures' places, sorted."""
    ship(spark)
    runs = Runs(new_path(spark, "captures"), 0, archives, [])
    if not archives:
        return runs, []

    def read(batches):
        for which in batches:
            for k in which.column(0).to_pylist():
                archive = archive_name(folder, k)
                if not storage.exists(archive):  # of a partition without rows
                    continue
                with storage.read_file(archive) as f:
                    rows = sorted(captures(f, archive.rpartition("/")[2]), key=order)
                _write_run(runs.name(k, 0), rows)
                some = [order(r) for r in rows[:: max(1, len(rows) // SAMPLES)]]
                if some:
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=list("abcdef"))

    made = materialise(spark.range(0, archives, 1, archives).mapInArrow(read, "a string, b string, c boolean, d long, e string, f long"), "captures-sample")
    taken = made.orderBy(F.xxhash64(*"abcdef")).limit(CUTS).collect()
    return runs, sorted(map(tuple, taken))


def _cuts(places: list[tuple], n: int) -> list[tuple]:
    """Places that cut the order into n ranges or fewer."""
    n = min(n, max(1, len(places)))
    return sorted({places[len(places) * i // n] for i in range(1, n)})


def merge_runs(spark, runs: Runs, places: list[tuple]) -> DataFrame:
    """Captures in global order by URL key and time, over all partitions."""
    ship(spark)
    while runs.n > FAN_IN:
        groups = -(-runs.n // FAN_IN)
        after = Runs(runs.folder, runs.level + 1, groups, _cuts(places, -(-partitions(spark) // groups)))
        ranges = after.bounds()

        def join(batches, runs=runs, after=after, ranges=ranges):
            for which in batches:
                for k in which.column(0).to_pylist():
                    group, part = divmod(k, len(ranges))
                    _write_run(after.name(group, part), runs.merged(group, *ranges[part]))
                    yield pa.RecordBatch.from_pydict({"k": [k]})

        tasks = groups * len(ranges)
        spark.range(0, tasks, 1, tasks).mapInArrow(join, "k long").agg(F.count("*")).collect()
        runs = after
    if not runs.n:
        return spark.createDataFrame([], DDL)
    last = Runs(runs.folder, runs.level + 1, 1, _cuts(places, partitions(spark))).bounds()

    def merge(batches):
        for which in batches:
            for k in which.column(0).to_pylist():
                some = []
                for row in runs.merged(0, *last[k]):
                    some.append(row)
                    if len(some) == GROUP_ROWS:
                        yield from _table(some).to_batches()
                        some = []
                if some:
                    yield from _table(some).to_batches()

    return spark.range(0, len(last), 1, len(last)).mapInArrow(merge, DDL)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages as archives, read them back, and return the merged capture history.

    Null URLs are empty; an empty table gives no captures; repeated rows are captures each.
    """
    spark = pages.sparkSession
    folder, archives = write_archives(classify(pages, id_col, url_col, payload_col, min_bytes))
    return merge_runs(spark, *capture_runs(spark, folder, archives))


def op2_warc(spark, sf_dir):
    """All pages through archives and the merged index, in its order."""
    out = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


#: Digests: 40 hexadecimal digits are eight fives, each four digits of base 32.
ORACLE = r"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, octet_length(encode(html)) as payload_bytes, sha1(html) as sha, max(page_id) over (partition by sha1(html)) as best from p),
h as (select *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(sha, 1 + cast(i // 4 as integer) * 5, 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31 as integer), 1)) as b from d),
u as (select *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host, regexp_replace(url, '^[^:/?#]*://[^/?#]*', '') as rest from h),
k as (select *, regexp_extract(rest, '^([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from u)
select page_id, cast(payload_bytes as bigint) as payload_bytes, array_to_string(b, '') as payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to,
array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(case when path = '' then '/' else path end) || case when query <> '' then '?' || lower(query) else '' end as url_key,
strftime(timestamp '2024-01-01' + to_seconds(page_id % 100000000), '%Y-%m-%dT%H:%M:%SZ') as captured_at from k
""".replace("\\\\", "\\")

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE}
