"""Quality classifier: random-indexing token vectors, pooled per document, and a two-layer network.

Every token (a run of letters, of digits or of other marks) is hashed to one of ``BUCKETS``. Each bucket has a fixed
sparse index vector of ``NONZERO`` signs in ``DIMENSIONS``; the context vector of a bucket is the sum of the index
vectors of all its neighbours up to ``REACH`` places away, over all texts. A document is the mean and the spread of
its tokens' vectors, how alike neighbours are, and the logarithm of its length. The network is fitted in numpy on at most ``2 * PER_CLASS`` labelled
documents; one temperature, chosen on a fifth of them that was left out, calibrates its probabilities.

Nulls and edge cases: a null text is empty; an empty text is pooled to zeros and has a score too. Rows are scored one by one,
so repeated rows and ties need no care. A null id is not held out and never learned from. Without labels of both
classes every score is 1/2. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import SpanHasher, id_and_text, mix, remainder, row_bounds, slices, text_bytes
from pitsignal.llm.sampling import class_shares, labelled_sample

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 32
NONZERO = 2
REACH = 2
HIDDEN = 32
PER_CLASS = 2000
FOLDS = 3
HELD_OUT = 1


def byte_kinds() -> np.ndarray:
    """0 white space, 1 letters and all bytes beyond ASCII, 2 digits, 3 other marks."""
    out = np.full(256, 3, dtype=np.uint8)
    out[:33] = 0
    out[48:58] = 2
    out[65:91] = out[97:123] = out[128:] = 1
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens in order, and the rows' offsets into them."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    kind = byte_kinds()[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, stop = at[:-1], at[1:]
    real = kind[start] != 0
    start, stop = start[real], stop[real]
    found = SpanHasher(data)(start, stop)
    row = np.searchsorted(offsets, start, side="right") - 1
    return (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), row_bounds(row, rows)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero entries."""
    drawn = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0x51)).reshape(BUCKETS, NONZERO)
    return (drawn >> np.uint64(40)).astype(np.int64) % DIMENSIONS, np.where(drawn & np.uint64(1), 1.0, -1.0)


def add_contexts(total: np.ndarray, bucket: np.ndarray, bounds: np.ndarray) -> None:
    """Add to ``total`` the index vectors of each token's neighbours in its row."""
    place, sign = index_vectors()
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for reach in range(1, REACH + 1):
        near = row[reach:] == row[:-reach]
        left, right = bucket[:-reach][near], bucket[reach:][near]
        for own, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(own * DIMENSIONS + place[other, k], sign[other, k], BUCKETS * DIMENSIONS)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of every bucket, from all texts.

    A task adds up its texts before anything is sent, a bucket is then a row of sums, and the driver gets ``BUCKETS`` rows.
    """
    names = [f"c{i}" for i in range(DIMENSIONS)]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                at = offsets[a : b + 1]
                add_contexts(total, *tokens(data[at[0] : at[-1]], at - at[0]))
        matrix = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(matrix.any(axis=1))
        columns = [pa.array(used)] + [pa.array(matrix[used, i].astype(np.float32)) for i in range(DIMENSIONS)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *names])

    schema = "bucket long, " + ", ".join(f"{n} float" for n in names)
    # Entries are whole numbers, so the sums are exact and do not depend on their order.
    sums = docs.mapInArrow(work, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((BUCKETS, DIMENSIONS))
    if sums.num_rows:
        out[sums["bucket"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    unit = out / np.maximum(length, 1e-9)
    used = length[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    return unit.astype(np.float32)


def pooled(bucket: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each row's vectors, the mean product of neighbours' vectors, the share of tokens
    followed by themselves, and the log length."""
    rows, count = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((rows, 2 * DIMENSIONS + 3))
    full = np.flatnonzero(count)
    if len(full):
        own = vectors[bucket].astype(np.float64)
        starts = bounds[:-1][full]
        mean = np.add.reduceat(own, starts, axis=0) / count[full, None]
        square = np.add.reduceat(own * own, starts, axis=0) / count[full, None]
        out[full, :DIMENSIONS] = mean
        out[full, DIMENSIONS:-3] = np.sqrt(np.maximum(square - mean * mean, 0))
        alike = np.zeros((2, len(bucket)))
        alike[0, :-1] = np.einsum("ij,ij->i", own[:-1], own[1:])
        alike[1, :-1] = bucket[:-1] == bucket[1:]
        alike[:, bounds[1:][full] - 1] = 0  # the last token of a row has no neighbour
        out[full, -3:-1] = (np.add.reduceat(alike, starts, axis=1) / count[full]).T
    out[:, -1] = np.log1p(count)
    return out


def pooled_slices(column: pa.Array, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, 1 << 20):
        at = offsets[a : b + 1]
        yield a, b, pooled(*tokens(data[at[0] : at[-1]], at - at[0]), vectors)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logits(x: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    z = np.clip((x - net["centre"]) / net["scale"], -8, 8)
    return np.maximum(z @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]


def fit(x: np.ndarray, y: np.ndarray, shares: tuple[float, float], rounds: int = 400) -> dict | None:
    """The network, by Adam on four fifths with a weight penalty, and its temperature from the rest."""
    if len(y) < 2 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 5 == 4
    if any(len(set(y[part].tolist())) < 2 for part in (held, ~held)):
        held[:] = False
    on = ~held
    weight = np.where(y == 1, shares[1] / max(1, (on & (y == 1)).sum()), shares[0] / max(1, (on & (y == 0)).sum())) * on
    draw = np.random.default_rng(11)
    net = {"centre": x[on].mean(axis=0), "scale": x[on].std(axis=0) + 1e-6,
           "w1": draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
           "w2": draw.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.array(0.0)}
    z = np.clip((x - net["centre"]) / net["scale"], -8, 8)
    names = ["w1", "b1", "w2", "b2"]
    first, second = ({n: np.zeros_like(net[n]) for n in names} for _ in range(2))
    for step in range(1, rounds + 1):
        hidden = np.maximum(z @ net["w1"] + net["b1"], 0)
        pull = weight * (sigmoid(hidden @ net["w2"] + net["b2"]) - y)
        back = np.outer(pull, net["w2"]) * (hidden > 0)
        slope = {"w1": z.T @ back + 1e-4 * net["w1"], "b1": back.sum(axis=0),
                 "w2": hidden.T @ pull + 1e-4 * net["w2"], "b2": np.array(pull.sum())}
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * slope[n]
            second[n] = 0.999 * second[n] + 0.001 * slope[n] ** 2
            net[n] = net[n] - 0.02 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    part = held if held.any() else on
    raw, truth = logits(x[part], net), y[part]
    share = np.where(truth == 1, shares[1] / max(1, (truth == 1).sum()), shares[0] / max(1, (truth == 0).sum()))
    steps = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
    loss = [-(share * np.log(np.where(truth == 1, sigmoid(raw / t), sigmoid(-raw / t)) + 1e-12)).sum() for t in steps]
    net["temperature"] = steps[int(np.argmin(loss))]
    return net


def learned_from(id_col: Column) -> Column:
    return remainder(id_col, FOLDS) != HELD_OUT


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", per_class: int = PER_CLASS) -> dict | None:
    """Fit on a bounded sample of the labelled rows that are not held out; the driver gets pooled vectors only."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in pooled_slices(batch.column(1), sent.value):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"]
                )

    where = learned_from(F.col("doc_id"))
    sample = labelled_sample(docs, labels, label, per_class, where)
    rows = sample.mapInArrow(work, "doc_id long, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "y").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows["x"].combine_chunks().values).reshape(rows.num_rows, -1)
    return fit(x, rows["y"].to_numpy().astype(np.float64), class_shares(labels, label, where))


def score(docs: DataFrame, vectors: np.ndarray, net: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))  # 4 MB, whatever the data

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = sent.value
        for batch in batches:
            for a, b, x in pooled_slices(batch.column(1), known):
                p = np.full(len(x), 0.5) if fitted is None else sigmoid(logits(x, fitted) / fitted["temperature"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], names=["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
