"""N-gram Jaccard join of documents.

Two documents link when 100 * intersection >= percent * union of their distinct word shingles. Linkable sizes
lie within a factor of 100 / percent, so sizes are cut into bands and documents meet only in the band of
the smaller. In a band, two linked sets differ in at most d shingles, for a d that follows from the band's upper end.
The hashes are dealt to d + 1 parts and some spare ones. At least one more part than there are spare ones is then
the same in both, so one of these is not empty, or both sets have more empty parts than there are spare ones. A set with so many is
dealt anew with another seed, up to ``DEALS`` times; the last time it shows its empty parts, too.
Shingles that many documents share stay out of the parts where the others suffice. Where d is 1, the signatures are the
set itself and the set without each of its shingles. Nothing is missed, and documents that share a
passage only do not meet. Candidates go to size-ordered tiles with bitmaps and exact intersections
(:mod:`pitsignal.llm.linking`).

Nulls and edge cases: a null text is empty; a text without words has an empty set and links with nothing; fewer
words than a shingle has are one shingle. Documents of equal sets are linked, repeated rows included. Columns other than
id and text are not looked at. Shingles, sets and the texts of one id are compared by 64-bit hashes.
``link_documents`` counts rows with a null id, but they take no part: their component is null. In ``drop_near_copies`` they
take part and come last in their group. It decides by id and text: one id may stand on rows of different texts, each with
a group of its own, and of linked rows of one id one text stays. Rows equal in id and text are one document and stay
or go together; where the id is null, one of them stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.common import id_and_text, mix, slices, text_bytes, word_shingle_sets
from pitsignal.llm.linking import FAMILY, bitmap, components, groups, node_names, possible_pairs, selective_pairs
from pitsignal.session import land

#: Share of the documents from which on a shingle counts as common, and share of rare shingles from which on they suffice.
COMMON_SHARE = 0.001
RARE = 0.75
DEALS = 8

@dataclass
class Bands:
    """Size bands for a similarity, and the number of parts of each."""

    percent: int
    starts: list[int] = field(default_factory=lambda: [1])
    spares: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 10_000 // self.percent**2)))

    def differing(self, band: int) -> int:
        """Most shingles in which two linked sets differ, the smaller of them in the band."""
        small = self.starts[band + 1] - 1
        large = small * 100 // self.percent
        return (small + large) * (100 - self.percent) // (100 + self.percent)

    def spare(self, band: int) -> int:
        """Spare parts: what a set of the band's lower end leaves empty, as a rule."""
        if band not in self.spares:
            extra = 0
            while True:
                parts = self.differing(band) + 1 + extra
                empty = parts * np.exp(-self.starts[band] / parts)
                # Beyond what stays empty, a fourth of d: so many more parts are the same in both of two linked sets.
                if extra >= empty + 1.3 * np.sqrt(empty) + self.differing(band) // 4 or extra > parts // 2:
                    break
                extra += 1
            self.spares[band] = extra
        return self.spares[band]

    def of(self, size: int) -> list[int]:
        """The band of a size, and the one below if a partner can be in it."""
        band = int(np.searchsorted(self.starts, size, side="right")) - 1
        below = band > 0 and 100 * (self.starts[band] - 1) >= self.percent * size
        return [band, band - 1] if below else [band]


def signatures(sets: list[np.ndarray], bands: Bands, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each set its signatures and their rules (see ``selective_pairs``). ``common`` are sorted shingle hashes that many documents share.

    Two linked sets differ in at most d of their rare shingles, too, so parts are made of the rare ones alone where
    these are at least ``RARE`` of the set, and of all shingles where they are fewer. Near that limit a set shows both, since its
    partner may be on the other side of it.
    """
    for s in sets:
        if not len(s):
            yield np.zeros(0, np.uint64), np.zeros(0, np.int32)
            continue
        own = bands.of(len(s))
        rare = s[np.take(common, np.searchsorted(common, s), mode="clip") != s] if len(common) else s
        above = len(rare) - RARE * len(s)
        out = []
        if above >= 0:
            out += [_parts(mix(rare), band, bands, 1) for band in own]
        if above < RARE * max(bands.differing(band) for band in own):
            out += [_parts(mix(s), band, bands, 2) for band in own]
        yield np.concatenate([sig for sig, _ in out]), np.concatenate([rule for _, rule in out])


def _parts(members: np.ndarray, band: int, bands: Bands, variant: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and rules of a set for one band; each deal is a family."""
    most = bands.differing(band)
    salt = mix(np.array([2 * band + variant], dtype=np.uint64))[0]
    family = (2 * band + variant) * DEALS
    if most == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if most == 1:
        whole = np.sum(members, dtype=np.uint64)
        found = mix(np.append(whole - members, whole) ^ salt)
        return found, np.full(len(found), family * FAMILY + 1, np.int32)
    spare = bands.spare(band)
    parts = most + 1 + spare
    out, rules = [], []
    for deal in range(DEALS):
        dealt = mix(members + np.uint64(deal))
        part = ((dealt >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        low = np.bincount(part, (dealt & np.uint64(0xFFFFFFFF)).astype(np.float64), parts)
        high = np.bincount(part, (dealt >> np.uint64(32)).astype(np.float64), parts)
        sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
        empty = np.bincount(part, minlength=parts) == 0
        enough = empty.sum() <= spare
        shown = np.arange(parts) if deal == DEALS - 1 and not enough else np.flatnonzero(~empty)
        number = shown.astype(np.uint64) + np.uint64(1 + (deal << 48))
        out.append(mix(sums[shown] + number * np.uint64(0xC2B2AE3D27D4EB4F) ^ salt))
        # Of the parts that are the same in both, spare + 1 or more, no more are empty than this set has empty ones.
        alike = int(np.clip(spare + 1 - empty.sum(), 1, FAMILY - 1))
        rules.append(np.full(len(shown), (family + deal) * FAMILY + alike, np.int32))
        if enough:
            break
    return np.concatenate(out), np.concatenate(rules)


def common_shingles(docs: DataFrame, width: int, share: float = COMMON_SHARE) -> np.ndarray:
    """Sorted hashes of shingles that about ``share`` of all documents or more have.

    Each task counts its own documents and reports what reaches the share there. A document of n shingles adds to n
    counts, so at most the mean n divided by the share can be reported, however many documents there are. Which
    shingles are found decides the cost of the join, never its result.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            found = [s for _, _, sets in _set_slices(batch.column(1), width) for s in sets]
            rows += len(found)
            values, times = np.unique(np.concatenate([known, *found]), return_counts=True)
            times[np.searchsorted(values, known)] += counts - 1
            known, counts = values[times > 1], times[times > 1]
        often = counts >= max(4, share * rows)
        yield pa.RecordBatch.from_arrays([pa.array(known[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"])

    total = docs.count()
    found = docs.mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= share * total / 2).select("shingle").toArrow()
    return np.sort(rows["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def _set_slices(texts: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        at = offsets[a : b + 1]
        yield a, b, word_shingle_sets(data[at[0] : at[-1]], at - at[0], width)


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``mark``, ``n_shingles``, ``node`` and the ``map`` of bits of its set."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _set_slices(batch.column(1), width):
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), sizes, pa.array(node_names(sets)),
                     pa.array([bitmap(s) for s in sets], pa.binary())],
                    names=["doc_id", "mark", "n_shingles", "node", "map"],
                )

    return docs.mapInArrow(work, "doc_id long, mark long, n_shingles long, node long, map binary")


def _signature_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(sig, node, rule)`` rows; a set met again in a task is not shown again."""
    bands = Bands(percent)
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _set_slices(batch.column(1), width):
                names = node_names(sets)
                fresh = [i for i in np.unique(names, return_index=True)[1] if int(names[i]) not in seen]
                if len(seen) < 1 << 20:
                    seen.update(int(names[i]) for i in fresh)
                found = list(signatures([sets[i] for i in fresh], bands, sent.value))
                if found:
                    node = np.repeat(names[fresh], [len(f) for f, _ in found])
                    sig = np.concatenate([f for f, _ in found]).view(np.int64)
                    rule = np.concatenate([r for _, r in found])
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(rule)], names=["sig", "node", "rule"])

    return docs.mapInArrow(work, "sig long, node long, rule int")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and the ``mark`` of the text; id and mark together name a document."""
    return id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def _placed(rows: DataFrame, taking_part: str, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``mark``, ``n_shingles`` and ``label`` of each marked row.

    Rows have one label if their sets are equal or a chain of links joins them, of rows that ``taking_part`` admits.
    """
    named = rows.filter(taking_part)
    profile = land(_profile(rows, width), "profile")
    maps = profile.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("map").alias("map"))
    pairs = selective_pairs(_signature_rows(named.select("doc_id", "text"), width, percent))
    candidates = land(components(possible_pairs(pairs, maps, percent)), "candidates")
    # Each node is shown by one document. An id alone would bring the texts of all its rows to each of its nodes.
    shown = profile.filter(taking_part).join(candidates, "node").groupBy("comp", "node").agg(F.min(F.struct("doc_id", "mark")).alias("one"))
    shown = shown.select("comp", "node", F.col("one.doc_id").alias("shown_id"), F.col("one.mark").alias("shown_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("shown_id")) & (F.col("mark") == F.col("shown_mark"))
    members = named.join(shown, same).select("comp", "node", "text")
    found = groups(members, "words", width, percent)
    return profile.join(found.distinct(), "node", "left").select(
        "doc_id", "mark", "n_shingles", F.coalesce("label", "node").alias("label")
    )


def link_documents(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    placed = _placed(_marked(docs, id_col, text_col), "doc_id is not null", width, percent)
    linked = F.col("n_shingles") > 0
    least = placed.filter(linked).groupBy("label").agg(F.min("doc_id").alias("least"))
    joined = placed.join(least, "label", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(linked, F.col("least")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those linked to one before them: of smaller id, nulls last, then of smaller mark."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = _marked(docs, id_col, text_col)
    placed = land(_placed(key, "true", width, percent).filter("n_shingles > 0").drop("n_shingles"), "placed")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    ends = placed.groupBy("label").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    ends = ends.select("label", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    gone = placed.join(ends, "label").filter(~stays).select("doc_id", "mark").distinct()
    repeats = placed.filter("doc_id is null").groupBy("mark").count().filter("count > 1").select(F.lit(None).cast("bigint").alias("doc_id"), "mark")
    gone = land(gone.withColumn("again", F.lit(False)).unionByName(repeats.withColumn("again", F.lit(True))), "gone")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "again")

    source = docs.toDF(*names)
    where, what = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    tagged = source.select(
        *names, F.col(where).cast("bigint").alias("own_id"), F.xxhash64(F.coalesce(F.col(what).cast("string"), F.lit(""))).alias("own_mark")
    )
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_mark") == F.col("gone_mark"))
    kept = tagged.join(gone, same, "left_anti").select(*names)
    again = gone.filter("again").join(gone.filter("not again").select("gone_mark", "gone_id").filter("gone_id is null"), "gone_mark", "left_anti")
    if not again.isEmpty():
        one = tagged.join(again.select("gone_id", "gone_mark"), same, "left_semi").dropDuplicates(["own_mark"])
        kept = kept.unionByName(one.select(*names))
    return kept.toDF(*docs.columns)
