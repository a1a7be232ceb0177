"""Byte-level BPE by recursive queries: ids of texts, and texts of ids.

A rank file lists byte strings in order of rank; the rank is the id. A text is split by the pattern, and each match is encoded for
itself: a match that is listed is one id, any other starts as its bytes, of which the leftmost pair of least rank is
contracted until no two neighbours join to a listed string. In each task DuckDB does so for all matches at once that its worker
has not met: rows of (word, pos, pair of ids) join the table of merges, each word's leftmost pair of least rank is contracted, and a
word that no longer changes leaves the recursion.

A match above ``WINDOW`` bytes is put together from windows of that size. Neighbouring ids of an encoding always are the encoding of their own
bytes, and a sequence of which this holds for all neighbours is the encoding of the whole: up to the first contraction across a border both
sides go through the same steps as alone. So two encodings that share a token are joined there. Where
neighbouring windows share none, a window that starts at a known token is made longer until it begins with that token.

Decoding joins ids with the listed strings and aggregates them in order.

Nulls and edge cases: a null or empty text has no ids and decodes to nothing. Repeated rows and null ids of documents need no care, since each row is
encoded for itself. Columns other than id and text are not looked at. An id that is not listed, or a null one, is an
error in ``decode``. Marks such as ``<|endoftext|>`` inside a text are plain text.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import id_and_text

#: Bytes of a match that is encoded in one piece.
WINDOW = 64
#: Matches that a worker keeps the ids of.
KEPT = 1 << 19
#: Bytes of the words of one recursive query, and tokens of one decoding query.
LETTER_ROWS = 200_000
QUERY_ROWS = 1 << 20

# A step takes the words that the step before it wrote, lays each out as rows (word, pos, pair), and writes the words again whose best
# pair it has contracted; ``place`` orders the pairs of a word by rank, then position.
ENCODE = """
WITH RECURSIVE piece(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM letters
  UNION
  SELECT word, list_concat(list_concat(ids[:(place & 4294967295) - 1], [(place >> 32)::INTEGER]), ids[(place & 4294967295) + 2:])
  FROM piece JOIN (
    SELECT word, min(joined::BIGINT * 4294967296 + pos) AS place
    FROM (
      SELECT word, generate_subscripts(ids, 1) AS pos, unnest(ids)::BIGINT * 4294967296 + unnest(ids[2:]) AS pair FROM piece
    ) AS pairs JOIN merges USING (pair)
    GROUP BY word
  ) AS best USING (word)
)
SELECT word, ids FROM piece ORDER BY word
"""

DECODE = """
SELECT place, unhex(list_aggregate(list(digits ORDER BY pos), 'string_agg', '')) AS bytes, count(*) AS known
FROM tokens JOIN vocabulary USING (id) GROUP BY place ORDER BY place
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(text): int(rank) for text, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to join two listed strings to a listed one: ``pair``, the two ranks in one number, and ``joined``."""
    rows = [
        (ranks[text[:k]] << 32 | ranks[text[k:]], rank)
        for text, rank in ranks.items()
        for k in range(1, len(text))
        if text[:k] in ranks and text[k:] in ranks
    ]
    columns = np.array(rows, dtype=np.int64).reshape(-1, 2)
    return pa.table({"pair": pa.array(columns[:, 0]), "joined": pa.array(columns[:, 1].astype(np.int32))})


class BytePairs:
    """Encoding and decoding in one task, with the tables in a DuckDB of its own."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} does not list all single bytes")
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        for text, rank in self.ranks.items():
            self.sizes[rank] = len(text)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.made: set[str] = set()
        self._forget()
        self.pieces: dict[bytes, tuple[int, ...]] = {}

    def _table(self, name: str) -> None:
        """Make one of the two tables, if it is not there: ``merges`` to encode, ``vocabulary`` to decode."""
        if name in self.made:
            return
        if name == "merges":
            rows = merge_table(self.ranks)
        else:
            digits = [text.hex() for text in self.ranks]
            rows = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "digits": pa.array(digits)})
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")
        self.made.add(name)

    def _forget(self) -> None:
        """No match is known: numbers of matches, their ids one after the other, and where those of each begin and end."""
        self.words: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, offsets = self.encode_flat(texts)
        flat, at = ids.tolist(), offsets.tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the texts' offsets into them."""
        if len(self.words) > KEPT:
            self._forget()
        split = [self.split(text) for text in texts]
        self._learn(set().union(*split) - self.words.keys())
        counts = np.array([len(words) for words in split], dtype=np.int64)
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        begin = self.bounds[number]
        ends = np.concatenate([[0], np.cumsum(self.bounds[number + 1] - begin)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], np.diff(ends))]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def _learn(self, words: Iterable[str]) -> None:
        listed, ranks, short, long = [], [], [], []
        pieces = []
        for word in words:
            piece = word.encode()
            rank = self.ranks.get(piece)
            if rank is not None:
                listed.append(word)
                ranks.append(rank)
            elif len(piece) <= WINDOW:
                short.append(word)
                pieces.append(piece)
            else:
                long.append((word, piece))
        contracted, at = self._contract(pieces)
        joined: list[tuple[int, ...]] = []
        if long:
            if len(self.pieces) > KEPT:
                self.pieces.clear()
            half = WINDOW // 2
            self._windows(p[at : at + WINDOW] for _, p in long for at in range(0, len(p), half))
            joined = [self._joined(piece) for _, piece in long]
        found = [*listed, *short, *(word for word, _ in long)]
        lengths = np.fromiter(map(len, joined), np.int64, len(joined))
        sizes = np.concatenate([np.ones(len(listed), np.int64), np.diff(at), lengths])
        self.words.update(zip(found, range(len(self.words), len(self.words) + len(found)), strict=True))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        rest = np.fromiter(chain.from_iterable(joined), np.int32, int(lengths.sum()))
        self.ids = np.concatenate([self.ids, np.array(ranks, dtype=np.int32), contracted, rest])

    def _contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct pieces by contraction alone, end to end, and the pieces' offsets.

        Pieces of like size share a query, so that few of its steps are about few words.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int64)), *self._in_steps([pieces[i] for i in order.tolist()], sizes[order])]
        flat, counts = (np.concatenate(c) for c in zip(*found, strict=True))
        begin, own = np.empty_like(counts), np.empty_like(counts)
        begin[order], own[order] = np.cumsum(counts) - counts, counts
        ends = np.concatenate([[0], np.cumsum(own)])
        return flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], own)], ends

    def _in_steps(self, pieces: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of runs of pieces, end to end, and how many each piece has."""
        self._table("merges")
        ends = np.cumsum(sizes)
        start = 0
        while start < len(pieces):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + LETTER_ROWS, side="right")))
            n = sizes[start:stop]
            flat = np.frombuffer(b"".join(pieces[start:stop]), np.uint8)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            letters = pa.table({
                "word": pa.array(np.arange(len(n), dtype=np.int32)),
                "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(self.bytes[flat])),
            })
            self.con.register("letters", letters)
            found = self.con.sql(ENCODE).to_arrow_table()["ids"].combine_chunks()
            self.con.unregister("letters")
            yield found.flatten().to_numpy(), np.diff(found.offsets.to_numpy()).astype(np.int64)
            start = stop

    def _windows(self, pieces: Iterable[bytes]) -> None:
        """Encode pieces of long matches that are not known yet."""
        new = sorted({p for p in pieces if p not in self.pieces})
        ids, at = self._contract(new)
        flat, bounds = ids.tolist(), at.tolist()
        self.pieces.update((p, tuple(flat[a:b])) for p, a, b in zip(new, bounds[:-1], bounds[1:], strict=True))

    def _joined(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a long match, from windows that overlap by half."""
        half = WINDOW // 2
        ids, ends = self._at(piece, 0, WINDOW)
        covered = min(WINDOW, len(piece))
        while covered < len(piece):
            at = (covered - 1) // half * half
            more, stops = self._at(piece, at, WINDOW)
            shared = self._shared(ids, ends, more, stops, at) if at + WINDOW > covered else None
            if shared is None:
                shared, more, stops = self._longer(piece, ids, ends, covered)
            left, right = shared
            del ids[left:], ends[left:]
            ids += more[right:]
            ends += stops[right:]
            covered = ends[-1]
        return tuple(ids)

    def _at(self, piece: bytes, start: int, size: int) -> tuple[list[int], list[int]]:
        window = piece[start : start + size]
        if window not in self.pieces:
            self._windows([window])
        ids = self.pieces[window]
        return list(ids), (start + np.cumsum(self.sizes[list(ids)])).tolist()

    @staticmethod
    def _shared(ids: list[int], ends: list[int], more: list[int], stops: list[int], at: int) -> tuple[int, int] | None:
        """Places of a token of equal bytes and place in both."""
        place = {(stop, i): k for k, (stop, i) in enumerate(zip(stops, more, strict=True))}
        k = len(ids) - 1
        while k >= 0 and ends[k] > at:
            # Equal ids that end at one place start at one place, too.
            if (ends[k], ids[k]) in place:
                return k, place[ends[k], ids[k]]
            k -= 1
        return None

    def _longer(self, piece: bytes, ids: list[int], ends: list[int], covered: int) -> tuple[tuple[int, int], list[int], list[int]]:
        """A window that begins with a known token some way back, and the places where both meet."""
        size = WINDOW
        back = covered - WINDOW // 2
        while True:
            k = bisect_right(ends, back)
            start = ends[k - 1] if k else 0
            more, stops = self._at(piece, start, max(size, covered - start + size // 2))
            if not k or more[0] == ids[k]:
                return (k, 0), more, stops
            size *= 2
            back -= size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids between two offsets."""
        self._table("vocabulary")
        out: list[bytes] = []
        rows, start = len(offsets) - 1, 0
        while start < rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + QUERY_ROWS, side="right")) - 1)
            part = ids[offsets[start] : offsets[stop]]
            counts = np.diff(offsets[start : stop + 1])
            tokens = pa.table({
                "place": pa.array(np.repeat(np.arange(stop - start), counts)),
                "pos": pa.array(np.arange(len(part))),
                "id": pa.array(part),
            })
            self.con.register("tokens", tokens)
            found = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("tokens")
            if sum(found["known"].to_pylist()) != len(part):
                raise ValueError("an id is not in the vocabulary")
            texts = [b""] * (stop - start)
            for place, text in zip(found["place"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                texts[place] = text
            out += texts
            start = stop
        return out


@lru_cache(maxsize=2)
def _opened(path: str, pattern: str, changed: int, size: int) -> BytePairs:
    return BytePairs(path, pattern)


def coder_of(path: str, pattern: str) -> BytePairs:
    """The coder of a file and pattern in this process: a Python worker serves many tasks, which share its tables and the at most
    about ``KEPT`` matches that it knows. A file that has changed is read anew."""
    state = os.stat(path)
    return _opened(path, pattern, state.st_mtime_ns, state.st_size)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of each row."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, pattern)
        for batch in batches:
            ids, offsets = coder.encode_flat(batch.column(1).to_pylist())
            found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and their ``decoded`` bytes of rows with doc_id and ids."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            if ids.null_count:
                raise ValueError("an id is null")
            texts = coder.decode(ids.to_numpy(), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, and the digests of ids and of decoded bytes."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
