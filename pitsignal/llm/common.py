"""What the operators of this subpackage share: reading, batches, and word arrays in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.session import configure

#: Bytes of text that travel to a Python task at once, and that numpy works on at once.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: UTC, adaptive plans, and batches bounded in bytes."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, nothing else; a null text counts as empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row is a run of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two rounds of multiply and shift), elementwise."""
    high = x >> np.uint64(32)
    x = x ^ high
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(x, np.uint64(32), out=high)
        x ^= high
    return x


_MULTIPLIER = 0x9E3779B97F4A7C55
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
# Positions that are hashed at once.
_BLOCK = 1 << 13


def byte_codes(seed: int = 7) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def lower_table() -> np.ndarray:
    """Bytes with A-Z, and only these, made lower case."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z made lower case."""
    return np.frombuffer(data.tobytes().translate(lower_table().tobytes()), np.uint8)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class SpanHasher:
    """64-bit hashes of byte spans, by differences of one running sum over all bytes."""

    def __init__(self, data: np.ndarray):
        if len(data) > SLICE_BYTES * 2:
            up, self.down = powers(len(data), _MULTIPLIER), powers(len(data) + 1, _INVERSE)
        else:
            up, self.down = _kept_powers()
            up = up[: len(data)]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = byte_codes().take(data)
        terms *= up
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.down[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each position on, and zeros where the data ends before; in blocks that stay in the cache."""
        out = np.zeros(len(self.sums) - 1, dtype=np.uint64)
        n = max(len(self.sums) - width, 0)
        for a in range(0, n, _BLOCK):
            b = min(a + _BLOCK, n)
            raw = self.sums[a + width : b + width] - self.sums[a:b]
            raw *= self.down[a:b]
            raw += np.uint64(width * 0xA24BAED4963EE407 & (1 << 64) - 1)
            out[a:b] = mix(raw)
        return out


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        n = SLICE_BYTES * 2
        _POWERS.append((powers(n, _MULTIPLIER), powers(n + 1, _INVERSE)))
    return _POWERS[0]


def is_space() -> np.ndarray:
    """The separators of words: blank and the bytes 9 to 13."""
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each word; a row's end ends a word."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~is_space()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` items within each row, and the windows' offsets.

    A row of fewer items, but one at least, has one window: the whole row.
    """
    lengths = np.diff(bounds)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(lengths)), counts)
    begin = bounds[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    size = np.minimum(lengths[row], width)
    out = np.zeros(at[-1], dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        factor = mix(np.array([k + 1], dtype=np.uint64))[0] | np.uint64(1)
        out += np.where(k < size, padded[begin + k] * factor, np.uint64(0))
    return mix(out + size.astype(np.uint64)), at


def row_sets(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def word_shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted hashes of its distinct ``width``-word shingles, A-Z lower-cased."""
    data = lower_table()[data]
    start, stop, row = word_spans(data, offsets)
    hashes = SpanHasher(data)(start, stop)
    return row_sets(*windows(hashes, row_bounds(row, len(offsets) - 1), width))


def byte_windows(hasher: SpanHasher, start: np.ndarray, stop: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-byte windows of each span, and the spans' offsets into them.

    A shorter span, of one byte at least, has one window.
    """
    counts = np.where(stop - start >= width, stop - start - width + 1, np.minimum(stop - start, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    begin = np.arange(at[-1]) + np.repeat(start - at[:-1], counts)
    if 4 * len(begin) < len(hasher.sums):
        return hasher(begin, np.minimum(begin + width, np.repeat(stop, counts))), at
    # Of most positions a window is asked for: all are hashed in a row, which saves the lookups by position.
    found = hasher.windows(width)[begin]
    short = np.flatnonzero((stop - start < width) & (counts > 0))
    found[at[short]] = hasher(start[short], stop[short])
    return found, at


def char_shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted hashes of its distinct ``width``-byte shingles, A-Z lower-cased."""
    return row_sets(*byte_windows(SpanHasher(lowered(data)), offsets[:-1], offsets[1:], width))


def text_names(column: pa.Array) -> np.ndarray:
    """A 64-bit name of each text, A-Z lower-cased."""
    data, offsets = text_bytes(column)
    found = [
        SpanHasher(lower_table()[data[offsets[a] : offsets[b]]])(offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a])
        for a, b in slices(offsets)
    ]
    return np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)


def sets_of(column: pa.Array, kind: str, width: int) -> list[np.ndarray]:
    """Shingle sets of a column of texts, slice by slice; ``kind`` is words or chars."""
    make = {"words": word_shingle_sets, "chars": char_shingle_sets}[kind]
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in slices(offsets):
        at = offsets[a : b + 1]
        out += make(data[at[0] : at[-1]], at - at[0], width)
    return out
