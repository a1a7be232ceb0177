"""Groups of similar texts, exactly, from candidate signatures.

A node of documents is a distinct set of word shingles, a node of lines a distinct line, either named by a 64-bit
hash. Nodes that share a signature are candidates. The route from there to groups never emits the pairs of a signature:

1. ``star_edges``: each node of a signature is tied to the smallest node of it, but of a few nodes only those whose sketches
   are close. ``candidate_pairs`` ties signatures of many nodes and gives all pairs of the others, of which
   ``possible_pairs`` drops those whose bitmaps leave no room for a link.
2. ``components``: distributed union-find over those ties. Similar nodes always end in one component.
3. ``groups``: inside each component, tiles of bounded size are compared exactly in memory: sets in order of
   size, bitmaps whose bit counts bound the overlap from above, then sorted arrays. Nodes already in one
   group are not compared again, so a tile of mutual near copies costs little more than one row of it.
   Components larger than a tile are dealt to several; their groups are then joined through one member
   each, and what is still apart from the largest group is compared with all others, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.llm.common import mix, sets_of, shuffle_partitions, text_names
from pitsignal.operators.keyed import spread_join
from pitsignal.session import checkpoint_root, land

#: Nodes of a tile, and bytes of text in it.
TILE_NODES = 2048
TILE_BYTES = 16 << 20
#: Nodes of a signature of which all pairs are looked at.
SMALL_RUN = 8
#: Bits out of 64 that the sketches of a tie may differ in. Each bit agrees with a probability of (1 + similarity) / 2, so a pair
#: at 0.8 is passed over with one of less than a millionth; a pair that shares nothing gets through with one of 0.002.
SKETCH_BITS = 20
#: Signatures that a task holds before it deals them out, and the columns of what it deals.
HELD_ROWS = 1 << 20
DEALT = "sig long, kind int, x binary, y binary, z binary"


def node_names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set: the mixed sum of its mixed members; 0 for the empty set."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    sums = np.array([int(np.sum(mix(s), dtype=np.uint64)) for s in sets], dtype=np.uint64)
    return np.where(lengths == 0, np.uint64(0), mix(sums + lengths.astype(np.uint64))).view(np.int64)


def shares(spark: SparkSession) -> int:
    """Into how many shares signatures are dealt by their upper bits: several to a partition, so that a task holds one of them."""
    parts = shuffle_partitions(spark)
    return max(parts, min(32 * parts, 4096))


def dealt_signatures(rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> Iterator[pa.RecordBatch]:
    """Arrays of signatures, nodes and sketches as a few rows ``DEALT`` that hold many of them.

    ``sig`` is the share out of ``count``. Of a signature that many nodes have here the nodes are tied at once (kind 2, ties x to
    y), and only the smallest goes on (kind 1), so a frequent signature is no larger share. Kind 0 are the others.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for some in chain(rows, [None]):
        if some is not None and len(some[0]):
            held.append(some)
        if held and (some is None or sum(len(h[0]) for h in held) >= HELD_ROWS):
            sig, node, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
            held = []
            yield from _dealt(mix(sig.view(np.uint64)), node.view(np.uint64), sketch, count)


def _dealt(sig: np.ndarray, node: np.ndarray, sketch: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(sig)
    sig, node, sketch = sig[order], node[order], sketch[order]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lengths = np.diff(starts, append=len(sig))
    long = lengths > SMALL_RUN
    if long.any():
        far = np.repeat(long, lengths)
        least = np.minimum.reduceat(node.view(np.int64), starts)
        a, b = np.repeat(least[long], lengths[long]), node[far].view(np.int64)
        a, b = _distinct_ties(a[a != b], b[a != b])
        for i in range(0, len(a), HELD_ROWS >> 4):
            some = a[i : i + (HELD_ROWS >> 4)].view(np.uint64), b[i : i + (HELD_ROWS >> 4)].view(np.uint64)
            yield _dealt_batch(mix(some[0][:1]), (*some, some[0][:0]), 2, count)
        heads = sig[starts[long]], least[long].view(np.uint64), sketch[starts[long]]
        yield _dealt_batch(heads[0], heads, 1, count)
        sig, node, sketch = sig[~far], node[~far], sketch[~far]
    if len(sig):
        yield _dealt_batch(sig, (sig, node, sketch), 0, count)


def _dealt_batch(sig: np.ndarray, columns: tuple[np.ndarray, ...], kind: int, count: int) -> pa.RecordBatch:
    """Rows of the shares that ``sig``, in order, falls in; all of the columns go to one share if it is a single one."""
    share = (sig >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]]))
    blobs = []
    for c in columns:
        at = np.append(np.minimum(first, len(c)), len(c)).astype(np.int32) * np.int32(8)
        blobs.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(c))]))
    shown = pa.array(share[first].astype(np.int64))
    return pa.RecordBatch.from_arrays([shown, pa.array(np.full(len(first), kind, np.int32)), *blobs], names=["sig", "kind", "x", "y", "z"])


def _distinct_ties(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _share_ties(sig: np.ndarray, node: np.ndarray, sketch: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ties (a, b) from the rows of a share; ``long`` rows stand for many nodes."""
    order = np.argsort(sig)
    same = sig[order[1:]] == sig[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    sig, node, sketch, long = sig[order], node[order].view(np.int64), sketch[order], long[order]
    order = np.lexsort((~long, node, sig))
    sig, node, sketch, long = sig[order], node[order], sketch[order], long[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, sketch, long = sig[new], node[new], sketch[new], long[new]
    if not len(sig):
        return node, node
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lengths = np.diff(starts, append=len(sig))
    run = np.repeat(np.arange(len(starts)), lengths)
    close = np.bitwise_count(sketch ^ sketch[starts[run]]) <= SKETCH_BITS
    star = (lengths > SMALL_RUN) | np.logical_or.reduceat(long, starts) | np.logical_and.reduceat(close, starts)
    tied = star[run]
    a, b = [node[starts[run[tied]]]], [node[tied]]
    for k in range(1, SMALL_RUN):
        at = np.flatnonzero((run[k:] == run[:-k]) & ~tied[k:])
        at = at[np.bitwise_count(sketch[at] ^ sketch[at + k]) <= SKETCH_BITS]
        a.append(node[at])
        b.append(node[at + k])
    left, right = np.concatenate(a), np.concatenate(b)
    return _distinct_ties(left[left != right], right[left != right])


def star_edges(signatures: DataFrame) -> DataFrame:
    """Distinct ties (a, b) of nodes that share a signature, a below b, from (sig, node) rows or rows of ``dealt_signatures``.

    Of up to ``SMALL_RUN`` nodes of a signature those are tied whose sketches are close; without sketches, and of more nodes, each
    is tied to the smallest. Many signatures travel in one row; rows are sorted by the share alone, one long, which Spark does by radix.
    """
    count = shares(signatures.sparkSession)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([c.to_numpy() for c in batch.columns] for batch in batches)
        return dealt_signatures(((sig, node, np.zeros(len(sig), np.uint64)) for sig, node in columns), count)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(blob: pa.BinaryScalar) -> np.ndarray:
            return np.frombuffer(blob.as_buffer(), np.uint64)

        def rows() -> Iterator[tuple[int, int, list[np.ndarray]]]:
            for batch in batches:
                sig, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, (s, k) in enumerate(zip(sig, kind, strict=True)):
                    yield s, k, [numbers(batch.column(j)[i]) for j in (2, 3, 4)]

        for _, share in groupby(rows(), key=itemgetter(0)):
            held = []
            for _, kind, (x, y, z) in share:
                if kind == 2:
                    yield _tie_batch(x.view(np.int64), y.view(np.int64))
                else:
                    held.append((x, y, z, np.full(len(x), kind == 1)))
            if held:
                a, b = _share_ties(*(np.concatenate(c) for c in zip(*held, strict=True)))
                if len(a):
                    yield _tie_batch(a, b)

    if "kind" not in signatures.columns:
        signatures = signatures.select("sig", "node").mapInArrow(deal, DEALT)
    placed = signatures.repartition(shuffle_partitions(signatures.sparkSession), "sig").sortWithinPartitions("sig")
    return placed.mapInArrow(work, "a long, b long").distinct()


def _tie_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidate_pairs(signatures: DataFrame, most: int = SMALL_RUN) -> DataFrame:
    """From (sig, node) rows, distinct (a, b, tied).

    A signature of up to ``most`` nodes gives all its pairs, which may be tested one by one. A larger one
    gives ties of each node to its smallest; ``tied`` pairs stand for the whole signature and must stay.
    """
    ruled = signatures.select("sig", "node", F.lit(0).alias("rule"))
    found = _run_pairs(ruled, most, ties=True).filter("a <> b")
    return found.groupBy("a", "b").agg(F.max(F.col("rule").isNotNull()).alias("tied"))


#: What the number of a family is multiplied by in a rule; the rest is the number of signatures that a linked pair shares.
FAMILY = 1 << 17


def selective_pairs(signatures: DataFrame, most: int = SMALL_RUN) -> DataFrame:
    """From (sig, node, rule) rows, distinct (a, b, tied), with far fewer ties.

    A node's signatures belong to families; ``rule`` is the family times ``FAMILY`` plus the number k of signatures of that family that the node
    shares with whatever it links to. Signatures of up to ``most`` nodes give their pairs. A link that none of these shows rests on k or more larger
    signatures, so each node leaves out its k - 1 most frequent ones: the rarest that two linked nodes share is left in by
    both. Nodes that share a passage only have fewer than k larger signatures and leave out all.
    """
    found = land(_run_pairs(signatures, most, ties=False), "pairs")
    small = found.filter("rule is null").select("a", "b").distinct().withColumn("tied", F.lit(False))
    large = found.filter("rule is not null").select(F.col("a").alias("sig"), F.col("b").alias("node"), "rule").distinct()
    counts = large.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    frequent_first = Window.partitionBy("node", "family").orderBy(F.desc("n"), "sig")
    ranked = spread_join(large, counts, ["sig"], ["node"]).withColumn("family", F.floor(F.col("rule") / FAMILY))
    kept = ranked.withColumn("place", F.row_number().over(frequent_first)).filter(F.col("place") >= F.col("rule") % FAMILY)
    both = small.unionByName(candidate_pairs(kept.select("sig", "node"), most))
    return both.groupBy("a", "b").agg(F.max("tied").alias("tied"))


def _run_pairs(signatures: DataFrame, most: int, ties: bool) -> DataFrame:
    """``(a, b, rule)`` from the runs of equal signatures in (sig, node, rule) rows.

    Runs of up to ``most`` nodes give all their pairs, with no rule. Of a larger run each node is shown with its rule, as ``b``; ``a`` is
    the smallest node of the run with ``ties`` and the signature without.
    """

    def pairs(sig: np.ndarray, node: np.ndarray, rule: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        run, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        small = np.bincount(run)[run] <= most
        a, b = [], []
        for k in range(1, most):
            at = np.flatnonzero((run[k:] == run[:-k]) & small[k:])
            a.append(node[at])
            b.append(node[at + k])
        far = np.flatnonzero(~small)
        a.append(node[starts[run[far]]] if ties else sig[far])
        b.append(node[far])
        plain = sum(map(len, a[:-1]))
        return _pair_batch(np.concatenate(a), np.concatenate(b), np.concatenate([np.full(plain, -1), rule[far]]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        # The run that the last batch ended in; of a large one its first row and the last node shown.
        sig, node, rule, large, shown = none, none, none, False, None
        for batch in batches:
            new = [c.to_numpy().astype(np.int64) for c in batch.columns]
            if not len(new[0]):
                continue
            again = np.zeros(len(new[0]), dtype=bool)
            again[1:] = (new[0][1:] == new[0][:-1]) & (new[1][1:] == new[1][:-1])
            end = (sig[-1], shown if large else node[-1]) if len(sig) else None
            again[0] = end == (new[0][0], new[1][0])
            new = [c[~again] for c in new]
            if large:
                more = int(np.searchsorted(new[0], sig[0], side="right"))
                if more:
                    yield _pair_batch(np.full(more, node[0] if ties else sig[0]), new[1][:more], new[2][:more])
                    shown = new[1][more - 1]
                new = [c[more:] for c in new]
                if not len(new[0]):
                    continue
                sig, node, rule, large = none, none, none, False
            if not len(new[0]):
                continue
            sig, node, rule = (np.concatenate(x) for x in zip((sig, node, rule), new, strict=True))
            last = int(np.searchsorted(sig, sig[-1]))
            if last:
                yield pairs(sig[:last], node[:last], rule[:last])
            sig, node, rule = sig[last:], node[last:], rule[last:]
            if len(sig) > most:
                yield _pair_batch(np.full(len(node), node[0] if ties else sig[0]), node, rule)
                shown = node[-1]
                sig, node, rule, large = sig[:1], node[:1], rule[:1], True
        if len(sig) and not large:
            yield pairs(sig, node, rule)

    parts = shuffle_partitions(signatures.sparkSession)
    placed = signatures.repartition(parts, "sig").sortWithinPartitions("sig", "node")
    return placed.mapInArrow(work, "a long, b long, rule int")


def _pair_batch(a: np.ndarray, b: np.ndarray, rule: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of a batch; a rule below 0 is none."""
    order = np.lexsort((-rule, b, a))
    a, b, rule = a[order], b[order], rule[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, rule = a[new], b[new], rule[new]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(rule, pa.int32(), mask=rule < 0)], names=["a", "b", "rule"])


def bitmap(s: np.ndarray) -> bytes:
    """Bits of a set, two or more per member."""
    width = max(256, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 256
    flags = np.zeros(width, dtype=np.uint8)
    flags[(s >> np.uint64(24)) & np.uint64(width - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def may_link(size_a: int, map_a: bytes, size_b: int, map_b: bytes, percent: int) -> bool:
    """Whether the bit counts leave room for a link; the wider map is folded to the other's width."""
    a, b = np.frombuffer(map_a, np.uint8), np.frombuffer(map_b, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    shared = min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))
    return bool(similar(shared, size_a + size_b, percent))


def possible_pairs(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The (a, b) that are tied or whose bitmaps leave room for a link. ``maps`` has node, n, map."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)
            keep = pa.array([tied or may_link(n, m, k, o, percent) for tied, n, m, k, o in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    left = maps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("map").alias("map_a"))
    right = maps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("map").alias("map_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "tied", "n_a", "map_a", "n_b", "map_b")
    return joined.mapInArrow(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the smallest node of its component), for every node of an edge.

    Large-star and small-star steps alternate until nothing changes. Each step is a grouped minimum, which is
    combined before the shuffle, and a join with it; the edges are cut off by a checkpoint after every round.
    """
    checkpoint_root(edges.sparkSession)
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pair, before = pair.checkpoint(), None
    while True:
        both = pair.unionAll(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pair = rest.unionAll(small.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        sums = pair.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if before == tuple(sums):
            break
        before = tuple(sums)
    roots = pair.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return pair.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, each member hashed to one; four bits per member of the largest set."""
    width = max(512, 1 << int(4 * max(len(s) for s in sets) - 1).bit_length())
    out = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for i, s in enumerate(sets):
        flags = np.zeros(width, dtype=np.uint8)
        flags[(s >> np.uint64(40)) & np.uint64(width - 1)] = 1
        out[i] = np.packbits(flags).view(np.uint64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def similar(shared: np.ndarray | int, total: np.ndarray | int, percent: int):
    """Whether 100 * intersection >= percent * union, with ``total`` the sum of both sizes."""
    return (100 + percent) * shared >= percent * total


def tile_groups(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Group numbers after all links between the sets; ``labels`` are groups known before."""
    count = len(sets)
    label = np.arange(count) if labels is None else np.unique(labels, return_inverse=True)[1]
    if count == 2:
        if label[0] != label[1] and len(sets[0]) and similar(overlap(*sets), len(sets[0]) + len(sets[1]), percent):
            label = np.zeros(2, dtype=np.int64)
        return label
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    maps = bitmaps(sets) if count > 1 else None
    for place in range(count - 1):
        i = order[place]
        if not sizes[i]:
            continue
        stop = np.searchsorted(ranked, 100 * sizes[i] // percent, side="right")
        others = order[place + 1 : stop]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        missing = np.bitwise_count(maps[i] & ~maps[others]).sum(axis=1, dtype=np.int64)
        beyond = np.bitwise_count(maps[others] & ~maps[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(sizes[i] - missing, sizes[others] - beyond)
        for j in others[similar(bound, sizes[i] + sizes[others], percent)]:
            if label[j] != label[i] and similar(overlap(sets[i], sets[j]), sizes[i] + sizes[j], percent):
                label[label == label[j]] = label[i]
    return label


def whole_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal values in the first ``keys`` columns of sorted batches, and the runs' offsets."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for i in range(keys):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        here = [c[0].as_py() for c in batch.columns[:keys]]
        if held and here == [c[-1].as_py() for c in held[-1].columns[:keys]] and [c[0].as_py() for c in held[0].columns[:keys]] == here:
            # All that is held is one run, which goes on here.
            last = cut(pa.Table.from_batches([batch]))
            if len(last) == 1:
                held.append(batch)
                continue
        table = pa.Table.from_batches([*held, batch])
        starts = cut(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cut(table), table.num_rows)


def _merged_in_tiles(rows: DataFrame, keys: list[str], kind: str, width: int, percent: int) -> DataFrame:
    """``(node, label)`` after comparing the rows of each tile; rows are keys, node, label, text.

    The label of a group is its smallest label. A row whose text does not have the set that its
    node names is passed over.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, len(keys)):
            node, label = table["node"].to_numpy(), table["label"].to_numpy()
            texts = table["text"].combine_chunks()
            texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
            sets = sets_of(texts, kind, width)
            true = (node_names(sets) if kind == "words" else text_names(texts)) == node
            least = label.copy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = a + np.flatnonzero(true[a:b])
                if len(at) < 2:
                    continue
                group = tile_groups([sets[i] for i in at], percent, label[at])
                best = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(best, group, label[at])
                least[at] = best[group]
            rows = [c[true] for c in (node, label, least)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["node", "old", "label"])

    parts = shuffle_partitions(rows.sparkSession)
    placed = rows.select(*keys, "node", "label", "text").repartition(parts, *keys).sortWithinPartitions(*keys, "node")
    return placed.mapInArrow(work, "node long, old long, label long")


def groups(members: DataFrame, kind: str, width: int, percent: int,
           tile_nodes: int = TILE_NODES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(node, label)`` for members (comp, node, text) of candidate components.

    Two nodes have one label exactly if a chain of links joins them. Repeated members count once.
    """
    members = members.groupBy("comp", "node").agg(F.first("text").alias("text"))
    members = members.withColumn("bytes", F.octet_length("text"))
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    slots = F.greatest(F.ceil(F.col("n") / tile_nodes), F.ceil(F.col("b") / tile_bytes)).cast("int")
    sizes = sizes.select("comp", slots.alias("slots"))
    dealt = land(
        members.join(sizes, "comp").select(
            "comp", "slots", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int").alias("slot"), "node", "text"
        ),
        "tiles",
    )
    first = _merged_in_tiles(dealt.withColumn("label", F.col("node")), ["comp", "slot"], kind, width, percent)
    first = land(first.select("node", "label"), "groups")
    large = dealt.filter("slots > 1")
    if large.isEmpty():
        return first
    return _merged_across(large, first, kind, width, percent, tile_nodes)


def _relabelled(found: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels after merging (a, b) pairs of labels."""
    roots = components(merges.select("a", "b")).select(F.col("node").alias("label"), F.col("comp").alias("root"))
    joined = found.join(roots, "label", "left")
    return joined.select("node", F.coalesce("root", "label").alias("label"))


def _merged_across(large: DataFrame, first: DataFrame, kind: str, width: int, percent: int, tile_nodes: int) -> DataFrame:
    spark = large.sparkSession
    own = large.join(first, "node")  # comp, slots, slot, node, text, label
    # One member of each group: tiles of them, until each component's fit one tile or no longer merge.
    found, before = first, None
    while True:
        heads = own.select("comp", "node", "text").join(found, "node").filter("node = label")
        counts = heads.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        state = counts.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
        if not state[0] or before == tuple(state):
            break
        before = tuple(state)
        slots = F.ceil(F.col("n") / tile_nodes)
        rows = heads.join(counts, "comp").withColumn("slot", F.pmod(F.xxhash64("node", F.lit(7)), slots).cast("int"))
        merged = _merged_in_tiles(rows, ["comp", "slot"], kind, width, percent)
        merges = land(merged.filter("old <> label").select(F.col("old").alias("a"), F.col("label").alias("b")), "merges")
        found = land(_relabelled(found, merges), "groups")
        if state[2] <= tile_nodes:
            break
    # What is apart from its component's largest group is compared with everything in the component.
    now = own.select("comp", "slots", "slot", "node", "text").join(found, "node")
    per_group = now.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = per_group.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("groups"))
    apart = largest.filter("groups > 1").select("comp", "main")
    open_rows = now.join(apart, "comp").filter("label <> main")
    blocks = open_rows.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    blocks = blocks.select("comp", F.ceil(F.col("m") / tile_nodes).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(13)), F.col("blocks")).cast("int")
    left = open_rows.join(blocks, "comp").withColumn("block", block)
    left = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    right = now.join(blocks, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["comp", "block", "slot"]
    both = left.select(*keys, "node", "label", "text").unionByName(right.select(*keys, "node", "label", "text"))
    merged = _merged_in_tiles(both, keys, kind, width, percent)
    merges = land(merged.filter("old <> label").select(F.col("old").alias("a"), F.col("label").alias("b")), "merges")
    return land(_relabelled(found, merges), "groups")
