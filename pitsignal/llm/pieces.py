"""Sampled SentencePiece encoding, and lossless decoding.

A text is a blank and the text itself, with blanks written as U+2581. Its lattice has an edge for every piece of the
vocabulary that matches, and for a character that no piece spells an edge of its byte pieces. A piece of rank r weighs
``(r + RANK_SHIFT) ** -ALPHA``; a segmentation is drawn in proportion to the product of its pieces' weights. Weights are summed
forward over the lattice, and pieces drawn backward from the end: forward filtering, backward sampling.
Where no piece of the vocabulary goes from letters to other characters, or from another character to a blank, the
lattice falls apart at such places, and each distinct unit is filtered once per batch. The draws of a row come from a counter seeded by its key: the same
key and text give the same pieces, in any partitioning and on any retry.

Nulls and edge cases: a null or empty text has no pieces and decodes to an empty text. A literal U+2581, which would
decode to a blank, is spelled by its bytes. Repeated rows get the same pieces; a null key counts as 0. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitsignal.llm.common import id_and_text, mix, powers, slices, text_bytes

BLANK = "▁"
ALPHA = 1.0
RANK_SHIFT = 2.0
FILTER_BITS = 20
PART_BYTES = 4 << 20
LITERAL = "\ud800"
MULTIPLIER = 0x9E3779B97F4A7C55
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
# Units that end before a blank, and those that end between letters and other characters as well.
WIDE_UNIT = f"{BLANK}*[^{BLANK}]+|{BLANK}+"
# Raised figures and fractions of Latin-1 are not letters here.
_OTHER = r"\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be"
FINE_UNIT = rf"{BLANK}*[^{_OTHER}]+|{BLANK}*(?:(?!{BLANK})[{_OTHER}])+|{BLANK}+"


class Vocabulary:
    """Pieces and log weights of a SentencePiece model with byte fallback, by length and hash."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, dtype=np.int64)
        self.texts: list[bytes] = [b""] * model.vocab_size()
        by_length: dict[int, list[tuple[str, int, float]]] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                weight = -alpha * float(np.log(RANK_SHIFT - model.get_score(i)))
                by_length.setdefault(len(piece), []).append((piece, i, weight))
                self.texts[i] = piece.replace(BLANK, " ").encode()
        fine = re.compile(FINE_UNIT)
        whole = all(fine.fullmatch(p) for found in by_length.values() for p, _, _ in found)
        self.unit = fine if whole else re.compile(WIDE_UNIT)
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.least = min(w for found in by_length.values() for _, _, w in found)
        self.tables = {}
        for length, found in by_length.items():
            flat = Flat("".join(p for p, _, _ in found))
            hashes = flat.hashes(np.arange(len(found)) * length, length)
            order = np.argsort(hashes)
            self.maybe[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.tables[length] = (
                hashes[order], np.array([i for _, i, _ in found])[order], np.array([w for _, _, w in found])[order]
            )

    def look_up(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are those of a piece, and the pieces and log weights of these."""
        known, pieces, weights = self.tables[length]
        hit = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(known, hashes[hit]), len(known) - 1)
        true = known[at] == hashes[hit]
        return hit[true], pieces[at[true]], weights[at[true]]


class Flat:
    """The code points of a string, with hashes of its substrings of a given length."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.up, self.down = powers(len(self.points), MULTIPLIER), powers(len(self.points) + 1, INVERSE)
        self.sums = np.zeros(len(self.points) + 1, dtype=np.uint64)
        np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(0x1F)) * self.up, out=self.sums[1:])

    def hashes(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(length))


class Lattices:
    """Forward sums and backward choices of a set of distinct units.

    A cell is an end place in a unit. Cells are numbered place by place, the longest unit first, so all edges into
    one place of all units stand together and the forward sums of a place are one step. For each cell the edges that end
    there are listed with the running sum of their probabilities; a uniform number picks the first that exceeds it.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(units), dtype=np.int64)
        self.rank[order] = np.arange(len(units))
        self.length = lengths
        ranked = lengths[order]
        longest = int(ranked[0])
        reaching = np.searchsorted(-ranked, -np.arange(longest + 1), side="right")  # units that have the place
        self.first = np.concatenate([[0], np.cumsum(reaching)])
        flat = Flat("".join(units[i] for i in order))
        begin = np.concatenate([[0], np.cumsum(ranked)])
        unit = np.repeat(np.arange(len(units)), ranked)
        place = np.arange(begin[-1]) - begin[:-1][unit]
        room = ranked[unit] - place
        ends, starts, pieces, weights = [], [], [], []

        def add(at: np.ndarray, length: int, piece: np.ndarray, weight: np.ndarray) -> None:
            ends.append(self.first[place[at] + length] + unit[at])
            starts.append(place[at])
            pieces.append(piece)
            weights.append(weight)

        for length in sorted(vocabulary.tables, reverse=True):  # long pieces, which are likelier, come first
            at = np.flatnonzero(room >= length)
            hit, piece, weight = vocabulary.look_up(flat.hashes(at, length), length)
            add(at[hit], length, piece, weight)
            if length == 1:
                rest = np.ones(len(unit), dtype=bool)
                rest[at[hit]] = False
                at = np.flatnonzero(rest)
                add(at, 1, np.full(len(at), -1), np.full(len(at), vocabulary.least))
        end, start = np.concatenate(ends), np.concatenate(starts)
        piece, weight = np.concatenate(pieces), np.concatenate(weights)
        by_cell = np.argsort(end, kind="stable")
        self.end, self.start, self.piece, weight = end[by_cell], start[by_cell], piece[by_cell], weight[by_cell]
        self.at = np.searchsorted(self.end, np.arange(self.first[-1] + 1))
        own = self.end - self.first[np.searchsorted(self.first, self.end, side="right") - 1]
        source = self.first[self.start] + own
        forward = np.zeros(self.first[-1])
        share = np.zeros(len(self.end))
        for j in range(1, longest + 1):
            low, high = self.first[j], self.first[j + 1]
            a, b = self.at[low], self.at[high]
            value = forward[source[a:b]] + weight[a:b]
            cells = self.at[low:high] - a
            top = np.maximum.reduceat(value, cells)
            size = np.diff(np.append(cells, b - a))
            value = np.exp(value - np.repeat(top, size))
            total = np.add.reduceat(value, cells)
            forward[low:high] = top + np.log(total)
            share[a:b] = value / np.repeat(total, size)
        running = np.concatenate([[0.0], np.cumsum(share)])
        self.upto = running[1:] - running[self.at[self.end]]

    def draw(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrence, end and piece of the edges drawn for each occurrence of a unit; ``seed`` is one per occurrence."""
        left, end, rank = np.arange(len(unit)), self.length[unit], self.rank[unit]
        seen, ends, found = [], [], []
        while len(left):
            cell = self.first[end] + rank
            noise = mix(seed[left] + end.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = (noise >> np.uint64(12)).astype(np.float64) * 2.0**-52
            edge, last = self.at[cell], self.at[cell + 1] - 1
            going = np.flatnonzero((self.upto[edge] <= u) & (edge < last))
            while len(going):
                edge[going] += 1
                going = going[(self.upto[edge[going]] <= u[going]) & (edge[going] < last[going])]
            seen.append(left)
            ends.append(end)
            found.append(self.piece[edge])
            end = self.start[edge]
            on = end > 0
            left, end, rank = left[on], end[on], rank[on]
        return np.concatenate(seen), np.concatenate(ends), np.concatenate(found)


def units_of(text: str, unit: re.Pattern) -> list[str]:
    """The units of a text; a literal U+2581 is written as ``LITERAL``, which no text holds."""
    if not text:
        return []
    return unit.findall(BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK))


def seeds(keys: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """A number for each unit of each row, from the row's key and the unit's place."""
    base = mix(keys.view(np.uint64) + np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1))
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(base, counts) + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def spelled(char: str) -> bytes:
    """The bytes of a character that no piece spells."""
    return {BLANK: b" ", LITERAL: BLANK.encode()}.get(char) or char.encode()


def encode_rows(vocabulary: Vocabulary, keys: np.ndarray, texts: list[str], seed: int) -> list[np.ndarray]:
    """The sampled piece ids of each text."""
    known: dict[str, int] = {}
    per_row = [[known.setdefault(u, len(known)) for u in units_of(t, vocabulary.unit)] for t in texts]
    counts = np.array([len(r) for r in per_row], dtype=np.int64)
    if not counts.sum():
        return [np.zeros(0, np.int32) for _ in texts]
    unit = np.fromiter(itertools.chain.from_iterable(per_row), np.int64, counts.sum())
    names = list(known)
    occurrence, end, piece = Lattices(vocabulary, names).draw(unit, seeds(keys, counts, seed))
    order = np.lexsort((end, occurrence))
    occurrence, end, piece = occurrence[order], end[order], piece[order]
    # A character spelled by bytes becomes as many pieces as it has bytes.
    by_bytes = np.flatnonzero(piece < 0)
    written = [spelled(names[unit[occurrence[k]]][end[k] - 1]) for k in by_bytes]
    size = np.ones(len(piece), dtype=np.int64)
    size[by_bytes] = [len(b) for b in written]
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.repeat(piece, size)
    for k, b in zip(by_bytes, written, strict=True):
        ids[at[k] : at[k + 1]] = vocabulary.byte[list(b)]
    row_of_unit = np.repeat(np.arange(len(texts)), counts)
    pieces_per_row = np.bincount(row_of_unit[occurrence], size, len(texts)).astype(np.int64)
    return np.split(ids.astype(np.int32), np.cumsum(pieces_per_row)[:-1])


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of piece ids, without the blank that encoding puts in front."""
    return b"".join(map(vocabulary.texts.__getitem__, ids.tolist()))[1:].decode()


def encode(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = ALPHA,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the sampled ``ids`` of each document."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_path, alpha)
        for part, keys, texts in _parts(batches):
            ids = encode_rows(vocabulary, keys, texts, seed)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, ids array<int>")


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[str]]]:
    for batch in batches:
        for a, b in slices(text_bytes(batch.column(1))[1], PART_BYTES):
            part = batch.slice(a, b - a)
            yield part, part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids), pa.int32()))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id`` and ``text`` of encoded documents."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_path)
        for batch in batches:
            texts = [decoded(vocabulary, np.asarray(v.values)) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str, seed: int = 0) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_sha256`` (little-endian 32-bit ids), ``text_sha256`` of the decoded text, and whether it
    is the text again. Pieces are drawn, and decoded, in one pass."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_path)
        for part, keys, texts in _parts(batches):
            rows = []
            for text, ids in zip(texts, encode_rows(vocabulary, keys, texts, seed), strict=True):
                back = decoded(vocabulary, ids)
                rows.append((len(ids), sha256(ids.astype("<i4").tobytes()).hexdigest(), sha256(back.encode()).hexdigest(), back == text))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "n_pieces", "ids_sha256", "text_sha256", "lossless"]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)

    schema = "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, lossless boolean"
    return id_and_text(docs).mapInArrow(work, schema)
