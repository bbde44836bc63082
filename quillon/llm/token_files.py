"""Token-id output in Arrow files of equal-length sequences.

Format: an Arrow IPC file (random access by record batch) with four columns.
``ids``: fixed-size list of `LENGTH` uint16 (uint32 for tokenizers of more than 65,536 ids),
the documents' ids on end. ``mask``: fixed-size list of `LENGTH` bits: true for an id, false
for padding after the file's last document. ``doc_ids`` and ``ends``: lists of the documents
that end in the sequence and of the places after their last ids.
Every batch but the last has `BATCH` rows, so sequence k is row k % BATCH of batch
k // BATCH, and its ids and mask are views of the mapped file. Files follow each other in
ascending document id, one for each range partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import storage, tokens, words
from quillon.session import new_path, partitions, ship

LENGTH = 2048
BATCH = 128
SLICE = 1 << 21
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _schema(length: int, wide: bool = False):
    fixed = [("ids", pa.list_(pa.field("item", pa.uint32() if wide else pa.uint16(), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))]
    return pa.schema([*fixed, ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))])


def name(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.arrow"


class Writer:
    """Appends documents to one file; holds one batch of sequences in memory."""

    def __init__(self, out, length: int = LENGTH, wide: bool = False):
        self.length, self.room, self.schema = length, length * BATCH, _schema(length, wide)
        self.file = pa.ipc.new_file(out, self.schema)
        self.ids = np.zeros(self.room, np.uint32 if wide else np.uint16)
        self.used = self.docs = self.total = 0
        self._clear()

    def _clear(self) -> None:
        self.used, self.names, self.ends = 0, [[] for _ in range(BATCH)], [[] for _ in range(BATCH)]

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.room - self.used)
            self.ids[self.used : self.used + n] = ids[at : at + n]
            at, self.used = at + n, self.used + n
            if at == len(ids):
                row = (self.used - 1) // self.length
                self.names[row].append(doc_id)
                self.ends[row].append(self.used - row * self.length)
            if self.used == self.room:
                self._flush()
        self.docs, self.total = self.docs + 1, self.total + len(ids)

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        if rows:
            n = rows * self.length
            self.ids[self.used : n] = 0
            mask = np.arange(n) < self.used
            fixed = [pa.FixedSizeListArray.from_arrays(pa.array(a), type=t) for a, t in ((self.ids[:n], self.schema.types[0]), (mask, self.schema.types[1]))]
            lists = [pa.array(x[:rows], t) for x, t in ((self.names, self.schema.types[2]), (self.ends, self.schema.types[3]))]
            self.file.write_batch(pa.record_batch([*fixed, *lists], schema=self.schema))
        self._clear()

    def close(self) -> None:
        self._flush()
        self.file.close()


def sequence(path: str, k: int):
    """(ids, mask) of sequence k of a local file: views of the mapped file, not copies; ids
    as a numpy array, the mask as an Arrow array of bits."""
    with pa.memory_map(path) as source:
        batch = pa.ipc.open_file(source).get_batch(k // BATCH)
    ids, mask = (batch.column(c)[k % BATCH].values for c in ("ids", "mask"))
    return ids.to_numpy(zero_copy_only=True), mask


def encoded(texts, encode) -> list[np.ndarray]:
    """Ids of a column of texts with the end id; null is empty."""
    end = np.array([tokens.END_ID], "<u4")
    return [np.concatenate([ids, end]) for ids in encode(texts)]


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH):
    """Write all documents; returns (folder, manifest rows (part, docs, tokens) in order).

    Null texts are empty documents (the end id alone); null ids come first; rows with equal
    ids follow each other in the order of their texts. An empty table writes nothing.
    A task that is run again writes the same file.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = new_path(spark, "tokens")

    def write(batches):
        part = TaskContext.get().partitionId()
        encode = tokens.column_encoder(tokenizer)
        wide = tokens.vocabulary(tokenizer) > 1 << 16
        with storage.new_file(name(folder, part)) as out:
            writer = Writer(out, length, wide)
            for batch in batches:
                for i, j in words.slices(batch.column(1), SLICE):
                    some = batch.slice(i, j - i)
                    for doc_id, ids in zip(some.column(0).to_pylist(), encoded(some.column(1), encode), strict=True):
                        writer.add(doc_id, ids)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [writer.docs], "tokens": [writer.total]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # By the text's first characters too, so that many rows of one id (or of none) are many partitions.
    rows = rows.repartitionByRange(2 * partitions(spark), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(write, "part long, docs long, tokens long").collect()
    return folder, sorted(map(tuple, manifest))


def read_tokens(spark, folder: str, manifest) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    ship(spark)
    base, starts = 0, {}
    for part, _, n in manifest:
        starts[part] = base
        base += n
    parts = [p for p, docs, _ in manifest if docs]
    if not parts:
        return spark.createDataFrame([], SCHEMA)

    def read(batches):
        for which in batches:
            for k in which.column(0).to_pylist():
                with storage.read_file(name(folder, parts[k])) as f:
                    file = pa.ipc.open_file(f)
                    start, crc, n = starts[parts[k]], 0, 0
                    for b in range(file.num_record_batches):
                        batch = file.get_batch(b)
                        length = batch.schema.types[0].list_size
                        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True).astype("<u4")
                        used = batch.column(1).flatten().true_count
                        row = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
                        rows, at = ([], [], []), 0
                        for end in (row * length + batch.column(3).flatten().to_numpy()).tolist():
                            crc, n = zlib.crc32(ids[at:end], crc), n + end - at
                            for to, x in zip(rows, (start, n, crc), strict=True):
                                to.append(x)
                            start, at, crc, n = start + n, end, 0, 0
                        crc, n = zlib.crc32(ids[at:used], crc), n + used - at
                        yield pa.RecordBatch.from_arrays([batch.column(2).flatten(), *(pa.array(x, pa.int64()) for x in rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, SCHEMA)


def op7_token_files(spark, sf_dir):
    """Write all documents as token files and read them back."""
    folder, manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_tokens(spark, folder, manifest)


QUERIES = {"op7_token_files": op7_token_files}
ORACLES = {}
