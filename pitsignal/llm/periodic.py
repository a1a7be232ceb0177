"""Runs of a repeated stretch of words: seeds on diagonals, extended once per lag.

A run is a stretch of consecutive words with smallest period q, of ``least`` words and ``times`` periods or more, that no neighbouring
word extends. In a run, the words at a lag of q are equal over ``length - q`` places. Lags are dealt to classes
k/2 <= q < k (the first class takes all q < 16), and every run of a class has k or more such places (so the index holds k-grams,
k = 16, 32, 64, ..., named by sorting pairs of names of half the width).

At the start of a run the next place of the same k-gram is exactly q words on: were it nearer, both
distances would be periods of the words between, hence so would their common divisor, and q would not be the smallest period of the run. So
only neighbouring places of a k-gram in the same document are pairs, at most one per word and class, however often a passage occurs. Pairs are
worked off in order of lag and place. A table of how far each lag has been covered passes over a pair inside
the stretch last extended; any other is extended word by word to both ends and is a run if long enough.

Nulls and edge cases: a null or empty text has no words and no runs. Repeated rows and documents of one id are looked at one
by one. Words are compared by their bytes. Columns other than id and text are not looked at. Long texts are whole; the work is
n log n in the words of a batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from pitsignal.llm.common import id_and_text, slices, text_bytes

#: Words of the shortest run, and periods of the shortest run.
LEAST = 24
TIMES = 3
#: Width of the first grams: the fewest equal places of any run of at most this period.
FIRST = 16

SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def names_of(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


def doubled(names: np.ndarray, place: np.ndarray, width: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and places of windows of twice the width.

    ``place`` are the sorted places of known windows, those whose name occurs again in their document; ``stop`` is the end of
    the document at each place. A window of twice the width can only repeat if both halves do.
    """
    second = np.searchsorted(place, place + width)
    inside = np.flatnonzero(second < len(place))
    inside = inside[place[second[inside]] == place[inside] + width]
    inside = inside[place[inside] + 2 * width <= stop[place[inside]]]
    codes = names[inside] * (names.max(initial=0) + 1) + names[second[inside]]
    return repeated(names_of(codes), place[inside])


def repeated(names: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bincount(names)[names] > 1 if len(names) else np.zeros(0, bool)
    return names[keep], place[keep]


def seeds(names: np.ndarray, place: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lag and first place of neighbouring equal windows, with low <= lag < high, by lag and place."""
    order = np.argsort(names, kind="stable")
    ranked, at = names[order], place[order]
    lag = np.diff(at)
    keep = np.flatnonzero((ranked[1:] == ranked[:-1]) & (lag >= low) & (lag < high))
    lag, at = lag[keep], at[keep]
    order = np.lexsort((at, lag))
    return lag[order], at[order]


def extended(words: np.ndarray, at: int, lag: int, begin: int, end: int) -> tuple[int, int]:
    """The widest [left, right) around ``at`` in [begin, end - lag) where each word equals the one ``lag`` further on."""
    left, step = at, 64
    while left > begin:
        low = max(begin, left - step)
        differ = np.flatnonzero(words[low:left] != words[low + lag : left + lag])
        if len(differ):
            left = low + int(differ[-1]) + 1
            break
        left, step = low, step * 2
    right, step = at, 64
    while right < end - lag:
        high = min(end - lag, right + step)
        differ = np.flatnonzero(words[right:high] != words[right + lag : high + lag])
        if len(differ):
            right += int(differ[0])
            break
        right, step = high, step * 2
    return left, right


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs, in order; ``words`` are numbers, documents end to end."""
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    stop = np.repeat(bounds[1:], lengths)
    longest = int(lengths.max(initial=0))
    if longest < LEAST:
        return []
    # A word that stands once in its document is in no run.
    names, place = repeated(names_of(doc * (int(words.max()) + 1) + words), np.arange(len(words)))
    width, found = 1, []
    while 2 * width <= longest and len(place):
        names, place = doubled(names, place, width, stop)
        width *= 2
        if width < FIRST:
            continue
        low = 1 if width == FIRST else width // 2
        lags, starts = seeds(names, place, low, width)
        covered: dict[tuple[int, int], int] = {}
        # Inside a stretch of pairs at following places only the first can be uncovered.
        fresh = np.ones(len(lags), dtype=bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (starts[1:] != starts[:-1] + 1)
        for lag, at in zip(lags[fresh].tolist(), starts[fresh].tolist(), strict=True):
            d = int(doc[at])
            if covered.get((d, lag), -1) > at:
                continue
            begin = int(bounds[d])
            left, right = extended(words, at, lag, begin, int(bounds[d + 1]))
            covered[d, lag] = right
            length = right - left + lag
            if length >= max(LEAST, TIMES * lag):
                found.append((d, left - begin, length, lag))
    return sorted(set(found), key=lambda run: (run[0], run[1], run[3]))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original word that each place shows, for the ids that get a periodic end; None for the others.

    The end begins at word a and has period p, both taken from the id's checksum.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """A row per document: ``doc_id``, ``n_words``, ``runs`` by start and period, and the ``collapsed`` text.

    The collapsed text has the words joined by blanks, without those that a run holds after its first period. With ``plant``, the words of
    every tenth document, by the checksum of its id, are made periodic first.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                lists = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(a, b)]
                yield _batch(ids[a:b], lists, plant)

    return id_and_text(docs, id_col, text_col).mapInArrow(work, SCHEMA)


def _batch(ids: list[int | None], lists: list[list[bytes]], plant: bool) -> pa.RecordBatch:
    """Rows of some documents, given their words."""
    shown = [planted(len(words), i) if plant else None for i, words in zip(ids, lists, strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in lists])]).astype(np.int64)
    flat = np.empty(bounds[-1], dtype=object)
    flat[:] = [w for words in lists for w in words]
    words = pd.factorize(flat)[0].astype(np.int64)
    for i, order in enumerate(shown):
        if order is not None:
            words[bounds[i] : bounds[i + 1]] = words[bounds[i] : bounds[i + 1]][order]
    runs: list[list[dict[str, int]]] = [[] for _ in lists]
    for d, start, length, period in find_runs(words, bounds):
        runs[d].append({"start": start, "length": length, "period": period})
    collapsed = []
    for i, own in enumerate(lists):
        keep = np.arange(len(own)) if shown[i] is None else shown[i]
        if runs[i]:
            edges = np.zeros(len(own) + 1, dtype=np.int64)
            for run in runs[i]:
                edges[run["start"] + run["period"]] += 1
                edges[run["start"] + run["length"]] -= 1
            keep = keep[np.cumsum(edges[:-1]) == 0]
            own = [own[k] for k in keep.tolist()]
        elif shown[i] is not None:
            own = [own[k] for k in keep.tolist()]
        collapsed.append(b" ".join(own).decode())
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(runs, kind), pa.array(collapsed, pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


DIGEST = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length / period, and digests of all runs and of the collapsed text."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, runs, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "runs", "collapsed")), strict=True):
                best = min(runs, key=lambda r: (Fraction(-r["length"], r["period"]), r["start"], r["period"]), default=None)
                top = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                rows.append((doc_id, len(runs), *top, sha256(lines.encode()).hexdigest(), sha256(text.encode()).hexdigest()))
            names = [part.split()[0] for part in DIGEST.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            arrays = [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return found.select("doc_id", "runs", "collapsed").mapInArrow(work, DIGEST)
