"""Alignment of the tokens of two tokenizers by the bytes they stand for.

Side A is a byte-level BPE file, which gets the text with a blank before it; side B is a piece model, which adds that blank itself. Each token covers a
range of bytes of that text. Per batch, with its texts laid end to end, ``pandas.merge_asof`` finds for the start of each token the token of the other side
that covers it; both directions together give all overlapping pairs, since of two overlapping ranges one starts inside the other. Pairs
whose ends are equal close a group: the tokens up to there, back to the group before, stand for the same bytes. They are the links.

Counts of linked id pairs are summed over the corpus. The bytes of one of two linked tokens end with those of the other, so
an id pair can only be linked if one string is an ending of the other. There are at most as many such pairs as both vocabularies
have bytes. ``possible_links`` lists them, so a table of counts has a bound that the files prove, whatever the corpus, and is sent to all tasks.

Nulls and edge cases: a null or empty text has no tokens, nor has one whose tokens of either side do not give back its bytes (a text with
U+2581, which side B turns into a blank). Repeated rows count in the corpus each by itself; null ids stay null. Special tokens inside a text are
plain text. Columns other than id and text are not looked at. Texts are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import id_and_text, slices, text_bytes
from pitsignal.llm.packing import ByteLevelEncoder, byte_letters
from pitsignal.session import land

#: Bytes of text that are aligned at once.
SLICE = 1 << 19

GROUP_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<struct<a: int, b: int>>"


class Side:
    """What both sides share: strings of ids, as one run of bytes, and their sizes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, end to end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.at[ids] - (ends - sizes), sizes)
        return self.data[shift + np.arange(len(shift))]


class ByteLevelSide(Side):
    """Ids as ``tokenizers`` gives them with special tokens as plain text, by the faster encoder of :mod:`pitsignal.llm.packing`."""

    def __init__(self, path: str):
        self.encoder = ByteLevelEncoder(path)
        self.encoder.tokenizer.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        strings = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            strings[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(strings)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.plain(" " + text) for text in texts]


class PieceSide(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        strings = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            single = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece) if self.model.is_byte(i) else None
            strings.append(bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode())
        super().__init__(strings)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """The two tokenizers."""
    return ByteLevelSide(path_a), PieceSide(path_b)


@lru_cache(maxsize=2)
def _opened(path_a: str, path_b: str, state: tuple[int, ...]) -> tuple[Side, Side, np.ndarray]:
    a, b = sides(path_a, path_b)
    return a, b, shown_ids(a, b)


def opened(path_a: str, path_b: str) -> tuple[Side, Side, np.ndarray]:
    """The tokenizers and their ids as text in this process: a Python worker serves many tasks. Files that have changed are read anew."""
    stats = [os.stat(path) for path in (path_a, path_b)]
    return _opened(path_a, path_b, tuple(n for s in stats for n in (s.st_mtime_ns, s.st_size)))


def token_table(ids: np.ndarray, counts: np.ndarray, side: Side) -> pd.DataFrame:
    """``row``, ``id``, ``start`` and ``end`` of all tokens, by row and start, from the ids of all rows and how many each has."""
    ends = np.cumsum(side.sizes[ids])
    firsts = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
    row = np.repeat(np.arange(len(counts)), counts)
    ends = ends - firsts[row]
    return pd.DataFrame({"row": row, "id": ids, "start": ends - side.sizes[ids], "end": ends}, copy=False)


def given_back(ids: np.ndarray, counts: np.ndarray, side: Side, whole: list[bytes]) -> np.ndarray:
    """Whether the tokens of each row are its bytes."""
    sizes = np.concatenate([[0], np.cumsum(side.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    data = side.joined(ids).tobytes()
    if data == b"".join(whole) and (np.diff(sizes) == [len(w) for w in whole]).all():
        return np.ones(len(whole), dtype=bool)
    return np.array([data[i:j] == w for i, j, w in zip(sizes[:-1].tolist(), sizes[1:].tolist(), whole, strict=True)], dtype=bool)


def overlaps(a: pd.DataFrame, b: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
    """Numbers of all overlapping tokens ``a`` and ``b`` of equal rows, with their ends, in no order.

    ``first`` is where the bytes of each row begin when the rows are laid end to end: a place there stands for row and start, and
    the tokens are in order. The tokens of a row cover its bytes on both sides or there are none, so none reaches into another row.
    """

    def laid(tokens: pd.DataFrame, side: str) -> pd.DataFrame:
        by = first[tokens["row"].to_numpy()]
        columns = {"start": tokens["start"].to_numpy() + by, f"end_{side}": tokens["end"].to_numpy() + by, side: np.arange(len(tokens))}
        return pd.DataFrame(columns, copy=False)

    left, right = laid(a, "a"), laid(b, "b")
    covering_b = pd.merge_asof(left, right, on="start")
    # Equal starts are found by the first direction; a token that ends where the other starts does not cover it.
    covering_a = pd.merge_asof(right[right["start"] > left["start"].min()], left, on="start", allow_exact_matches=False)
    covering_a = covering_a[(covering_a["end_a"] > covering_a["start"]).to_numpy()]
    columns = ["a", "b", "end_a", "end_b"]
    parts = [np.concatenate([found[c].to_numpy(np.int64) for found in (covering_b, covering_a)]) for c in columns]
    return pd.DataFrame(dict(zip(columns, parts, strict=True)), copy=False)


def shown_ids(*sides: Side) -> np.ndarray:
    """Each id as text, followed by a comma, a bar, a semicolon, or nothing."""
    most = max(len(side.strings) for side in sides)
    return np.array([f"{i}{end}" for i in range(most) for end in (",", "|", ";", "")], dtype=object)


def written_groups(
    a: pd.DataFrame, b: pd.DataFrame, link_a: np.ndarray, link_b: np.ndarray, rows: int, shown: np.ndarray
) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each row: the ids of a group on both sides, groups apart by semicolons.

    ``link_a`` and ``link_b`` are the numbers of the tokens that close the groups, in order; ``shown`` is made by ``shown_ids``.
    """
    closed_a, closed_b = (np.bincount(links, minlength=len(side)) for links, side in ((link_a, a), (link_b, b)))
    group_a, group_b = np.cumsum(closed_a) - closed_a, np.cumsum(closed_b) - closed_b
    groups = max(len(link_a), len(link_b)) + 1
    ends_a, ends_b = (np.cumsum(np.bincount(group, minlength=groups)) for group in (group_a, group_b))
    # A token of A comes after the tokens of B of earlier groups, one of B after those of A of its own group, too.
    place_a = np.arange(len(a)) + np.concatenate([[0], ends_b])[group_a]
    place_b = np.arange(len(b)) + ends_a[group_b]
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[place_a], ids[place_b] = a["id"], b["id"]
    mark = np.zeros(len(ids), dtype=np.int64)
    mark[place_a[link_a]], mark[place_b[link_b]] = 1, 2
    counts = np.bincount(a["row"], minlength=rows) + np.bincount(b["row"], minlength=rows)
    stops = np.cumsum(counts)
    mark[stops[counts > 0] - 1] = 3
    parts = shown[ids * 4 + mark]
    return ["".join(parts[stop - n : stop].tolist()) for n, stop in zip(counts.tolist(), stops.tolist(), strict=True)]


def closing(pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of overlapping pairs those whose ends are equal, in order."""
    links = pairs[pairs["end_a"] == pairs["end_b"]]
    a = links["a"].to_numpy()
    order = np.argsort(a)
    return a[order], links["b"].to_numpy()[order]


def aligned(texts: list[str], a: Side, b: Side, shown: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, list[str]]:
    """Tokens of both sides, their overlaps, and the groups of each text."""
    whole = [(" " + text).encode() for text in texts]
    good = np.array([bool(text) for text in texts], dtype=bool)
    found = []
    for side in (a, b):
        lists = side.encode(texts)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        found.append((np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts))
        good &= given_back(*found[-1], side, whole)
    if not good.all():
        found = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in found]
    table_a, table_b = token_table(*found[0], a), token_table(*found[1], b)
    lengths = np.array([len(w) for w in whole], dtype=np.int64)
    pairs = overlaps(table_a, table_b, np.cumsum(lengths) - lengths)
    return table_a, table_b, pairs, written_groups(table_a, table_b, *closing(pairs), len(texts), shown)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: numbers of tokens and groups, the ``groups`` as text, and the ``links`` as id pairs in order."""

    def as_pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> pa.Array:
        pairs = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (a, b)], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs)

    return _aligned_rows(docs, path_a, path_b, id_col, text_col, lambda groups: groups, as_pairs, GROUP_SCHEMA)


def _aligned_rows(
    docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, write_groups: Callable[[list[str]], list[str]],
    write_links: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array], schema: str,
) -> DataFrame:
    """Rows of the aligned documents; the links of row i are those from ``at[i]`` to ``at[i + 1]``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, shown = opened(path_a, path_b)
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for start, stop in slices(offsets, SLICE):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                n = len(texts)
                left, right, pairs, groups = aligned(texts, a, b, shown)
                links = closing(pairs)
                row = left["row"].to_numpy()[links[0]]
                ids = [t["id"].to_numpy()[k] for k, t in zip(links, (left, right), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(np.bincount(left["row"], minlength=n)),
                     pa.array(np.bincount(right["row"], minlength=n)), pa.array(np.bincount(row, minlength=n)),
                     pa.array(write_groups(groups), pa.string()), write_links(*ids, np.searchsorted(row, np.arange(n + 1)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(work, schema)


def possible_links(a: Side, b: Side) -> np.ndarray:
    """Sorted codes (id of B, then id of A) of all id pairs of which one string is an ending of the other."""
    out = set()
    for one, two, code in ((a, b, lambda i, j: j << 32 | i), (b, a, lambda i, j: i << 32 | j)):
        known: dict[bytes, list[int]] = {}
        for j, text in enumerate(two.strings):
            if text:
                known.setdefault(text, []).append(j)
        out.update(code(i, j) for i, text in enumerate(one.strings) for k in range(len(text)) for j in known.get(text[k:], ()))
    return np.array(sorted(out), dtype=np.int64)


def _places(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places among the possible links that rows of bytes hold, and the rows' offsets."""
    data, offsets = text_bytes(links)
    return np.frombuffer(data.tobytes(), np.int32), offsets // 4


def link_counts(found: DataFrame, possible: int) -> DataFrame:
    """``place`` and ``n`` of the linked id pairs, counted in each task before the shuffle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(possible, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_places(batch.column(0))[0], minlength=possible)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["place", "n"])

    return found.select("links").mapInArrow(work, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, the digest of the aligned groups and how its links fare in the corpus.

    ``n_best`` counts links whose id pair is the most frequent of its B id, ties included; ``count_sum`` adds up the counts of
    the pairs over the links.
    """
    spark = docs.sparkSession
    possible = possible_links(*sides(path_a, path_b))
    known = spark.sparkContext.broadcast(possible)

    def as_places(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> pa.Array:
        codes = b << 32 | a
        order = np.argsort(codes)
        place = np.empty(len(codes), dtype=np.int32)
        place[order] = np.searchsorted(known.value, codes[order])
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(place)])

    def as_digests(groups: list[str]) -> list[str]:
        return [sha256(g.encode()).hexdigest() if g else "" for g in groups]

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"
    found = land(_aligned_rows(docs, path_a, path_b, id_col, text_col, as_digests, as_places, schema), "aligned")
    counted = link_counts(found, len(possible)).toArrow()
    counts = np.zeros(len(possible), dtype=np.int64)
    counts[counted["place"].to_numpy()] = counted["n"].to_numpy()
    first = np.diff(possible >> 32, prepend=-1) > 0  # of each B id
    best = counts == np.maximum.reduceat(counts, np.flatnonzero(first))[np.cumsum(first) - 1]
    sent = spark.sparkContext.broadcast((counts, best.astype(np.int64)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = sent.value
        for batch in batches:
            place, at = _places(batch.column("links"))
            sums = [np.concatenate([[0], np.cumsum(v[place])]) for v in (top, count)]
            arrays = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
            arrays |= {"n_links": pa.array(np.diff(at)), "n_best": pa.array(sums[0][at[1:]] - sums[0][at[:-1]])}
            arrays |= {"count_sum": pa.array(sums[1][at[1:]] - sums[1][at[:-1]]), "groups_sha256": batch.column("groups")}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.mapInArrow(work, schema)
