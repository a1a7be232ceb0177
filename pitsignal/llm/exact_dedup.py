"""Exact duplicates by Grace hashing.

Texts are equal when identical after lower-casing A-Z. Equal texts meet in two rounds of the same
table: in each input task, so that a text with many copies leaves a task once, and after a shuffle
by content hash. A table holds distinct contents only, found by open addressing on 64-bit hashes
with a comparison of the complete content; where its contents outgrow ``table_bytes`` it spills
to files by further hash bits, and each file is worked off the same way, recursively. A single text
larger than that is a table of its own.

Nulls and edge cases: a null text is an empty text, and empty texts are equal. Of a group the row
with the largest id stays; rows with a null id stay only where the group has no other. Repeated rows
(same id, same text) all count in the group size; ``distinct_documents`` leaves one of them, and
``copy_groups``, which tells documents by their id, marks each as kept. Columns other than id and text
may have any names.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.llm.common import id_and_text, mix, shuffle_partitions

TABLE_BYTES = 24 << 20
FANOUT = 16


def content_hashes(contents: pa.Array, level: int) -> np.ndarray:
    import xxhash

    return np.fromiter(
        (xxhash.xxh3_64_intdigest(v.as_buffer(), seed=level) for v in contents), np.uint64, len(contents)
    )


def open_addressing(contents: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """For each row the number of the first row found with the same complete content.

    All rows probe at once: an empty slot is claimed, a slot of equal content is the answer, and
    every other row goes on to the next slot.
    """
    n = len(contents)
    size = 1 << max(4, int(2 * n - 1).bit_length())
    slots = np.full(size, -1, dtype=np.int64)
    owner = np.full(n, -1, dtype=np.int64)
    at = (hashes & np.uint64(size - 1)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        free = left[slots[at[left]] < 0]
        slots[at[free]] = free
        there = slots[at[left]]
        same = hashes[left] == hashes[there]
        maybe = np.flatnonzero(same)
        if len(maybe):
            other = maybe[left[maybe] != there[maybe]]
            if len(other):
                equal = pc.equal(contents.take(pa.array(left[other])), contents.take(pa.array(there[other])))
                same[other] = equal.to_numpy(zero_copy_only=False)
        owner[left[same]] = there[same]
        left = left[~same]
        at[left] = (at[left] + 1) & (size - 1)
    return owner


def contents_of(texts: pa.Array) -> pa.Array:
    """What is compared: the text in UTF-8 with A-Z in lower case, empty for null."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())


def merged(rows: pa.Table, level: int, text: str) -> tuple[pa.Table, np.ndarray]:
    """One row per content: the winner's columns and the summed counts; and hashes of the contents for this level.

    A row carries its text once, in the column ``text``, and the hash of its content in ``__bucket``.
    """
    rows = rows.combine_chunks()
    contents = contents_of(rows[text].chunk(0) if rows.num_rows else pa.array([], pa.string()))
    hashes = mix(rows["__bucket"].to_numpy().view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    owner = open_addressing(contents, hashes)
    known = rows["__id"].is_valid().to_numpy()
    ids = pc.fill_null(rows["__id"], 0).to_numpy()
    order = np.lexsort((ids, known, owner))
    last = np.flatnonzero(np.diff(owner[order], append=-1))
    keep = order[last]
    counts = np.add.reduceat(rows["__count"].to_numpy()[order], np.concatenate([[0], last[:-1] + 1]))
    out = rows.take(pa.array(keep))
    place = out.schema.get_field_index("__count")
    return out.set_column(place, "__count", pa.array(counts)), hashes[keep]


class GraceTable:
    """Distinct contents of a stream of rows within ``limit`` bytes of memory."""

    def __init__(self, text: str, limit: int = TABLE_BYTES, level: int = 1):
        self.text, self.limit, self.level = text, limit, level
        self.pending: list[pa.Table] = []
        self.size = self.base = 0
        self.files: list[tuple[str, pa.OSFile, pa.ipc.RecordBatchFileWriter]] | None = None
        self.folder: tempfile.TemporaryDirectory | None = None

    def add(self, rows: pa.Table) -> None:
        self.pending.append(rows)
        self.size += rows.nbytes
        if self.size > max(self.limit, 2 * self.base):
            self._reduce()

    def _reduce(self) -> None:
        table, hashes = merged(pa.concat_tables(self.pending), self.level, self.text)
        self.pending, self.size = [table], table.nbytes
        self.base = table.nbytes
        if self.files is not None or (self.size > self.limit and table.num_rows > 1):
            self._spill(table, hashes)
            self.pending, self.size, self.base = [], 0, 0

    def _spill(self, table: pa.Table, hashes: np.ndarray) -> None:
        if self.files is None:
            self.folder = tempfile.TemporaryDirectory(prefix="grace-")
            self.files = []
            for k in range(FANOUT):
                path = os.path.join(self.folder.name, f"{self.level}-{k}.arrow")
                sink = pa.OSFile(path, "wb")
                self.files.append((path, sink, pa.ipc.new_stream(sink, table.schema)))
        part = (hashes >> np.uint64(60)).astype(np.int64)
        for k, (_, _, writer) in enumerate(self.files):
            rows = np.flatnonzero(part == k)
            if len(rows):
                writer.write_table(table.take(pa.array(rows)), max_chunksize=1024)

    def results(self) -> Iterator[pa.Table]:
        if self.pending:
            if self.files is None:
                yield merged(pa.concat_tables(self.pending), self.level, self.text)[0]
            else:
                self._reduce()
        self.pending = []
        if self.files is None:
            return
        try:
            for _, sink, writer in self.files:
                writer.close()
                sink.close()
            for path, _, _ in self.files:
                inner = GraceTable(self.text, self.limit, self.level + 1)
                with pa.OSFile(path, "rb") as source:
                    for batch in pa.ipc.open_stream(source):
                        inner.add(pa.Table.from_batches([batch]))
                os.unlink(path)
                yield from inner.results()
        finally:
            self.folder.cleanup()


def _emit(grace: GraceTable, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for found in grace.results():
        yield from found.select(columns).to_batches(max_chunksize=512)


def _survivors(docs: DataFrame, id_col: str, text_col: str, table_bytes: int) -> DataFrame:
    """One row per distinct content: all columns of the row that stays, its hash and its group."""
    names = docs.columns
    fields = docs.schema.fields
    work = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = names.index(id_col), names.index(text_col)
    extra = [T.StructField("__id", T.LongType()), T.StructField("__count", T.LongType()), T.StructField("__bucket", T.LongType())]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + extra)
    columns = [f.name for f in schema.fields]

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace = GraceTable(f"c{text_at}", table_bytes)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.append_column("__id", batch.column(id_at).cast(pa.int64()))
            rows = rows.append_column("__count", pa.array(np.ones(batch.num_rows, np.int64)))
            bucket = content_hashes(contents_of(batch.column(text_at)), 0).view(np.int64)
            grace.add(rows.append_column("__bucket", pa.array(bucket)))
        yield from _emit(grace, columns)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace = GraceTable(f"c{text_at}", table_bytes)
        for batch in batches:
            grace.add(pa.Table.from_batches([batch]))
        yield from _emit(grace, columns)

    parts = shuffle_partitions(docs.sparkSession)
    return work.mapInArrow(local, schema).repartition(parts, "__bucket").mapInArrow(final, schema)


def distinct_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = _survivors(docs, id_col, text_col, table_bytes)
    return found.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """A row per document, dropped ones included: who stays, group size, and the text's digest."""
    slim = id_and_text(docs, id_col, text_col)
    stays = _survivors(slim, "doc_id", "text", table_bytes)
    stays = stays.select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"), F.col("__count").alias("group_size"))
    groups = digests(stays, "group_size").withColumnRenamed("doc_id", "keep_id")
    joined = digests(slim).join(groups, "text_sha256", "left")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def digests(rows: DataFrame, *more: str) -> DataFrame:
    """The id and the hex SHA-256 of the normalised text."""
    schema = T.StructType([rows.schema["doc_id"], *[rows.schema[m] for m in more], T.StructField("text_sha256", T.StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            lowered = pc.ascii_lower(batch.column("text"))
            found = pa.array([sha256(v.as_buffer()).hexdigest() for v in lowered], pa.string())
            arrays = [batch.column(n) for n in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([*arrays, found], names=["doc_id", *more, "text_sha256"])

    return rows.select("doc_id", *more, "text").mapInArrow(work, schema)
