"""Quality rules: base measures, and a classifier on hashed word and character n-grams.

Features are hashed into ``1 << BITS`` weights: words, word pairs, and runs of three and four bytes, each
kind as its share of the text. The classifier is a logistic regression fitted on at most ``2 * PER_CLASS``
labelled documents; its scores are made probabilities by a second logistic fit on a fifth of them that
was left out, weighted to the class shares of all labels. All texts are scored in Arrow batches against the
fixed ``THRESHOLD``.

The driver gets the features of the sampled documents a few documents at a time, keeps them in a temporary file of its own and
reads that file in each round, so its memory does not grow with the length of the texts; the file and the time do, up to
2 ** BITS features of 8 bytes a document.

Words are the runs between blanks and the bytes 9 to 13; windows and words are compared by 64-bit hashes.
Nulls and edge cases: a null text is an empty text; it has no word and fails. Rows are judged one by one, so
repeated rows, null ids and ties need no care. Without labels of both classes every verdict is the base's.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import (
    SpanHasher, id_and_text, mix, row_bounds, slices, text_bytes, windows, word_spans,
)
from pitsignal.llm.sampling import class_shares, labelled_sample
from pitsignal.session import land

BITS = 18
PER_CLASS = 1000
THRESHOLD = 0.3
EVIDENCE = 150
#: Sampled documents that the driver gets at once, about, and features that it works on at once, if one document has not more.
PART_ROWS = 64
RUN_FEATURES = 1 << 19
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Slice:
    """The words of a run of rows."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self):
        self.rows = len(self.offsets) - 1
        self.start, self.stop, row = word_spans(self.data, self.offsets)
        self.words = SpanHasher(self.data)(self.start, self.stop)
        self.bounds = row_bounds(row, self.rows)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(s: Slice) -> np.ndarray:
    """Per row the words that lie in a window found twice or more."""
    lengths = np.diff(s.bounds)
    found, at = windows(s.words, s.bounds, WINDOW)
    row = np.repeat(np.arange(s.rows), np.diff(at))
    found = found ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = np.zeros(len(found) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = order[same[1:] | same[:-1]]
    twice = twice[lengths[row[twice]] >= WINDOW]
    begin = s.bounds[:-1][row[twice]] + (twice - at[:-1][row[twice]])
    edge = np.zeros(len(s.words) + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    return row_sums(np.cumsum(edge[:-1]) > 0, s.bounds).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measures(s: Slice) -> list[np.ndarray]:
    lead = (s.data & 0xC0) != 0x80  # the first byte of each code point
    chars = np.concatenate([[0], np.cumsum(lead)])
    word_chars = row_sums(chars[s.stop] - chars[s.start], s.bounds).astype(np.int64)
    mark = np.zeros(256, dtype=bool)
    mark[list(SYMBOLS)] = True
    symbols = row_sums(mark[s.data], s.offsets).astype(np.int64)
    whole = s.data.tobytes()
    lines = [repeated_lines(whole[a:b]) for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
    return [np.diff(s.bounds), word_chars, symbols, np.array(lines, np.int64), repeated_words(s)]


def byte_runs(data: np.ndarray, width: int) -> np.ndarray:
    """A feature number for the run of ``width`` bytes from each position that has one."""
    n = max(0, len(data) - width + 1)
    out = np.full(n, 0x9E3779B1 * width & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(width):
        out *= np.uint32(0x01000193)
        out += data[k : k + n]
        out ^= out >> np.uint32(15)
    return (out * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def features(s: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: numbers in row order, and the rows' offsets into them."""
    shift = np.uint64(64 - BITS)
    yield (s.words >> shift).astype(np.int64), s.bounds
    pairs, at = windows(s.words, s.bounds, 2)
    yield (pairs >> shift).astype(np.int64), at
    for width in (3, 4):
        runs = byte_runs(s.data, width)
        # A run that starts in one row and ends in the next is no feature: rows end width - 1 earlier.
        stop = np.maximum(s.offsets[:-1], s.offsets[1:] - width + 1)
        yield runs, np.stack([s.offsets[:-1], stop])


def linear(s: Slice, weights: np.ndarray) -> np.ndarray:
    score = np.zeros(s.rows)
    for numbers, at in features(s):
        start, stop = at if at.ndim == 2 else (at[:-1], at[1:])
        total = np.concatenate([[0.0], np.cumsum(weights[numbers], dtype=np.float64)])
        start, stop = np.minimum(start, len(numbers)), np.minimum(stop, len(numbers))
        score += (total[stop] - total[start]) / np.maximum(1, stop - start)
    return score


def sparse_rows(s: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row the distinct feature numbers and their values, as :func:`linear` weighs them."""
    kinds = [(n, at if at.ndim == 2 else np.stack([at[:-1], at[1:]])) for n, at in features(s)]
    for i in range(s.rows):
        numbers, values = [], []
        for found, (start, stop) in kinds:
            own = found[min(start[i], len(found)) : min(stop[i], len(found))]
            if len(own):
                numbers.append(own.astype(np.int64))
                values.append(np.full(len(own), 1.0 / len(own)))
        if numbers:
            distinct, inverse = np.unique(np.concatenate(numbers), return_inverse=True)
            yield distinct, np.bincount(inverse, np.concatenate(values))
        else:
            yield np.zeros(0, np.int64), np.zeros(0)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    base: float
    prior: float

    def probability(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of label 1. A short text says little: the log-odds go from those of the prior, for an empty
        text, to the fitted ones as its bytes outgrow ``EVIDENCE``."""
        share = size / (size + EVIDENCE)
        odds = share * (self.slope * score + self.base) + (1 - share) * self.prior
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


def plain(model: Model | None) -> tuple | None:
    """The model as built-in and numpy values, which workers can read without this package."""
    return model and (model.weights, model.slope, model.base, model.prior)


class FeatureFile:
    """Labels, numbers and shares of sampled rows; the latter two in a temporary file, read in runs of whole rows."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes, bytes]]):
        self.file, found = tempfile.TemporaryFile(), []
        for doc_id, y, numbers, shares in rows:
            found.append((doc_id, y, self.file.tell(), len(numbers) // 4))
            self.file.write(numbers)
            self.file.write(shares)
        self.rows = sorted(found)
        self.y = np.array([r[1] for r in self.rows], dtype=np.float64)

    def runs(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First and last row of each run, its numbers and shares, and the rows' offsets into them."""
        start = 0
        while start < len(self.rows):
            stop, at = start, [0]
            while stop < len(self.rows) and (stop == start or at[-1] + self.rows[stop][3] <= RUN_FEATURES):
                at.append(at[-1] + self.rows[stop][3])
                stop += 1
            index, value = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32)
            for (_, _, place, n), a in zip(self.rows[start:stop], at, strict=False):
                self.file.seek(place)
                index[a : a + n] = np.frombuffer(self.file.read(4 * n), np.int32)
                value[a : a + n] = np.frombuffer(self.file.read(4 * n), np.float32)
            yield start, stop, index, value, np.array(at)
            start = stop


def fit(rows: FeatureFile, shares: tuple[float, float], rounds: int = 80) -> Model | None:
    """Logistic regression by Adam on four fifths, then slope and base on the rest by Newton steps."""
    y = rows.y
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    train = ~held
    balance = train * np.where(y == 1, 0.5 / max(1, (train & (y == 1)).sum()), 0.5 / max(1, (train & (y == 0)).sum()))
    size = 1 << BITS
    w, first, second = np.zeros(size, np.float32), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        gradient = 1e-7 * w.astype(np.float64)
        for a, b, index, value, at in rows.runs():
            score = row_sums(w[index] * value, at)
            pull = balance[a:b] * (1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))) - y[a:b])
            gradient += np.bincount(index, np.repeat(pull.astype(np.float32), np.diff(at)) * value, minlength=size)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= (0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    score = np.concatenate([row_sums(w[index] * value, at) for _, _, index, value, at in rows.runs()])
    on = held if held.any() else train
    weight = np.where(y == 1, shares[1] / max(1, (on & (y == 1)).sum()), shares[0] / max(1, (on & (y == 0)).sum()))[on]
    slope, base = logistic_line(score[on], y[on], weight)
    prior = float(np.log((shares[1] + 1e-6) / (shares[0] + 1e-6)))
    return Model(w.astype(np.float32), slope, base, prior)


def logistic_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and base of the weighted logistic fit of ``y`` on ``x``; the ridge pulls the slope to 1."""
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * (beta - [1.0, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -2, 2)
    return float(max(beta[0], 0.05)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Fit on a bounded sample; the driver receives hashed features, some documents at a time, never texts."""

    def featurize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, ys = batch.column(0), batch.column(2)
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                found = list(sparse_rows(Slice(data[at[0] : at[-1]], at - at[0])))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), ys.slice(a, b - a), pa.array([n.astype(np.int32).tobytes() for n, _ in found], pa.binary()),
                     pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                    names=["doc_id", "y", "numbers", "shares"],
                )

    sample = labelled_sample(docs, labels, label, per_class)
    found = land(sample.mapInArrow(featurize, "doc_id long, y int, numbers binary, shares binary"), "features")
    # A few documents in each part, and the driver holds one part at a time.
    parts = found.repartition(max(1, -(-2 * per_class // PART_ROWS)), "doc_id", "y")
    rows = FeatureFile((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in parts.toLocalIterator())
    return fit(rows, class_shares(labels, label))


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: id, measures, ``base_failed``, ``score`` and ``kept``."""
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))  # 1 MB of weights, whatever the data
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, score double, kept boolean"
    names = ["doc_id", *MEASURES, "base_failed", "score", "kept"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value and Model(*sent.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                s = Slice(data[at[0] : at[-1]], at - at[0])
                found = measures(s)
                failed = (found[0] < MIN_WORDS) | (100 * found[4] > MAX_REPEAT_SHARE * found[0])
                score = np.ones(s.rows) if fitted is None else fitted.probability(linear(s, fitted.weights), np.diff(s.offsets))
                kept = ~failed & (score >= threshold)
                arrays = [pa.array(x) for x in (*found, failed, score, kept)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(work, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that pass the rules.

    The verdict is computed in the same pass that carries the row, so nothing is joined back.
    """
    model = train(id_and_text(docs, id_col, text_col), labels)
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))
    text_at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        fitted = sent.value and Model(*sent.value)
        for batch in batches:
            data, offsets = text_bytes(pc.fill_null(batch.column(text_at).cast(pa.string()), ""))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                s = Slice(data[at[0] : at[-1]], at - at[0])
                words, _, _, _, repeats = measures(s)
                keep = (words >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_SHARE * words)
                if fitted is not None:
                    keep &= fitted.probability(linear(s, fitted.weights), np.diff(s.offsets)) >= THRESHOLD
                yield batch.slice(a, b - a).filter(pa.array(keep))

    unnamed = docs.toDF(*names)
    return unnamed.mapInArrow(work, unnamed.schema).select(*[F.col(n) for n in names]).toDF(*docs.columns)
