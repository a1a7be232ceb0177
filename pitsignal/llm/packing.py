"""Harmonic packing of token sequences.

A document is its token ids and a closing id. It is cut into full sequences of ``capacity`` ids, then
into pieces of capacity/2, /4, ... down to ``least``, and a tail shorter than ``least``. A piece of
length n belongs to the class k = capacity // n, whose sequences take k pieces each: the cut pieces fill
theirs exactly, and a tail's class leaves less than 1/(k+1) empty. Each task fills its sequences on its
own. What is left of all classes when a task ends, fewer than k pieces each, goes longest first into
shared sequences, and of the last of these, where it is not full, into sequences of a power of two.

Nulls and edge cases: a null or empty text has the closing id only. Equal, repeated and null ids need no
care, since every row is packed for itself. Columns other than id and text are not looked at. A sequence
id is made of the number of the task and a number within the task; it is the same when the task is repeated.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitsignal.llm.common import id_and_text

CAPACITY = 1024
LEAST = 64
END_ID = 0
#: How byte-level vocabularies of this kind split a text; the pattern is a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space that the faster encoder is given at most, far below what it can take.
LONG_SPACE = 50_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "ids array<int>"
)


class ByteLevelEncoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file, two to four times as fast.

    The file's vocabulary, whose ids follow the order of its merges, is given to ``tiktoken`` as
    ranks; both then merge alike. A text that spells a token added to the vocabulary, such as an
    end mark, goes to ``tokenizers`` itself, and so does one with a run of white space longer than ``LONG_SPACE``, in which the
    other's search for the end of the run would outgrow its stack. Files of another kind (another model, a normalizer, another
    way to split) are refused, since the split pattern is that of plain byte-level files.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        plain = kind["model"]["type"] == "BPE" and kind["normalizer"] is None and split.get("type") == "ByteLevel"
        if not plain or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_space = re.compile(rf"\s{{{LONG_SPACE}}}")

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        """The ids of a text that spells no added token, or in which such a token is plain text."""
        if len(text) >= LONG_SPACE and self.long_space.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the letters from U+0100 on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cut(tokens: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= least and rest >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """Sequences of one task. ``place`` gives a piece its sequence and offset, perhaps later."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.next, self.capacity = task << 32, capacity
        self.open: dict[int, list[tuple[int, object]]] = {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int, piece: object) -> Iterator[tuple[object, int, int]]:
        k = self.capacity // length
        waiting = self.open.setdefault(k, [])
        waiting.append((length, piece))
        if len(waiting) == k:
            yield from self._close(waiting)
            self.open[k] = []

    def _close(self, pieces: list[tuple[int, object]]) -> Iterator[tuple[object, int, int]]:
        sequence, at = self._new(), 0
        for length, piece in pieces:
            yield piece, sequence, at
            at += length

    def rest(self) -> Iterator[tuple[object, int, int]]:
        """Pieces left over: longest first, each to the first shared sequence that has room."""
        left = sorted((p for w in self.open.values() for p in w), key=lambda p: -p[0])
        shared: list[list[tuple[int, object]]] = []
        room: list[int] = []
        for p in left:
            at = next((i for i, r in enumerate(room) if r >= p[0]), None)
            if at is None:
                shared.append([])
                room.append(self.capacity)
                at = len(room) - 1
            shared[at].append(p)
            room[at] -= p[0]
        self.open = {}
        for pieces, free in zip(shared, room, strict=True):
            yield from self._close(pieces) if free < self.capacity // 8 else self._halves(pieces)

    def _halves(self, pieces: list[tuple[int, object]]) -> Iterator[tuple[object, int, int]]:
        """Split a part-filled sequence where its pieces add up to powers of two."""
        group: list[tuple[int, object]] = []
        for p in pieces:
            total = sum(n for n, _ in group)
            if group and total & (total - 1) == 0 and total >= p[0] and total + p[0] & (total + p[0] - 1):
                yield from self._close(group)
                group = []
            group.append(p)
        yield from self._close(group)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """A row per piece, with the ids it holds and its place in a sequence."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = ByteLevelEncoder(tokenizer_path)
        bins = Bins(TaskContext.get().partitionId(), capacity)
        done: list[tuple] = []
        held = 0

        def ready(placed: Iterable[tuple]) -> None:
            nonlocal held
            for (doc_id, start, ids, total), sequence, offset in placed:
                done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, ids.view(np.int32)))
                held += len(ids)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), END_ID], dtype=np.uint32)
                at = 0
                for length in cut(len(ids), capacity, least):
                    ready(bins.place(length, (doc_id, at, ids[at : at + length], len(ids))))
                    at += length
                if held > 1 << 20:
                    yield _batch(done)
                    done, held = [], 0
        ready(bins.rest())
        if done:
            yield _batch(done)

    return id_and_text(docs, id_col, text_col).mapInArrow(work, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    lengths = np.concatenate([[0], np.cumsum([len(v) for v in columns[7]])]).astype(np.int32)
    flat = pa.array(np.concatenate(columns[7]), pa.int32())
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(lengths), flat)], names=[*names, "ids"])
