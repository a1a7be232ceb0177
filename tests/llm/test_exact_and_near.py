"""Exact dedup, n-gram join, line dedup and the linking they share, against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitsignal.llm import exact_dedup, line_dedup, linking, ngram_join
from pitsignal.llm.common import prepare, word_shingle_sets
from pitsignal.llm.exact_dedup import GraceTable

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns that clash with the operators' own."""
    prepare(spark)
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "Same text here now", "a", 1), (2, "sAME TEXT here NOW", "b", 2), (3, None, None, None), (4, "", "c", 4),
            (5, long, "d", 5), (6, long + " more", "e", 6), (7, "x", "f", 7), (7, "x", "f", 7), (None, "x", "g", 8),
            (8, " \n\t", "h", 9), (9, "ÀB c", "i", 10), (10, "àb c", "j", 11)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id int")


def test_exact_groups(odd):
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.copy_groups(odd).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[1] == (2, 2, False) and by_id[2] == (2, 2, True)
    assert by_id[3] == (4, 2, False) and by_id[4] == (4, 2, True)
    assert by_id[7] == (7, 3, True) and by_id[None] == (7, 3, False)
    assert by_id[9] == (9, 1, True) and by_id[10] == (10, 1, True)


def test_exact_survivors_keep_columns(odd):
    kept = exact_dedup.distinct_documents(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert next(r for r in rows if r.doc_id == 2).text == "sAME TEXT here NOW"


def test_exact_of_nothing(odd):
    none = odd.filter("doc_id < 0")
    assert exact_dedup.copy_groups(none).count() == 0
    assert exact_dedup.distinct_documents(none).count() == 0


@pytest.mark.parametrize("limit", [1 << 10, 1 << 14, 1 << 30])
def test_grace_table_spills_and_agrees(limit):
    draw = random.Random(3)
    texts = [f"text {draw.randrange(400)} " * draw.randrange(1, 20) for _ in range(3000)] + ["long " * 2000] * 3
    table = GraceTable("body", limit)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        bucket = exact_dedup.content_hashes(exact_dedup.contents_of(pa.array(part)), 0).view(np.int64)
        table.add(pa.table({"__id": pa.array(range(at, at + len(part)), pa.int64()), "__count": pa.array([1] * len(part), pa.int64()),
                            "body": pa.array(part, pa.string()), "__bucket": pa.array(bucket)}))
    found = pa.concat_tables(list(table.results())).to_pylist()
    want = {}
    for i, t in enumerate(texts):
        want[t] = (i, want.get(t, (0, 0))[1] + 1)
    assert {r["body"]: (r["__id"], r["__count"]) for r in found} == want
    assert len(found) == len(want)


def test_open_addressing_compares_content():
    contents = pa.array([b"a", b"b", b"a", b"c", b"b"], pa.binary())
    same_hash = np.zeros(5, dtype=np.uint64)  # every hash collides
    owner = exact_dedup.open_addressing(contents, same_hash)
    assert owner[0] == owner[2] and owner[1] == owner[4] and len(set(owner.tolist())) == 3


# -- n-gram join --------------------------------------------------------------------------------------


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}


def variants(draw, size, count, share):
    """Chains of texts, each some edits away from one before it."""
    out = [[f"w{draw.randrange(10**6)}" for _ in range(size)]]
    while len(out) < count:
        words = list(draw.choice(out))
        for _ in range(max(1, int(size * share))):
            at = draw.randrange(len(words) + 1)
            kind = draw.randrange(3)
            if kind == 0:
                words.insert(at, f"w{draw.randrange(10**6)}")
            elif at < len(words) and len(words) > 4:
                words[at : at + 1] = [] if kind == 1 else [f"w{draw.randrange(10**6)}"]
        out.append(words)
    return [" ".join(w) for w in out]


@pytest.fixture(scope="module")
def near(spark):
    draw = random.Random(5)
    texts = []
    for size in (5, 6, 7, 8, 9, 10, 12, 13, 15, 18, 22, 30, 45, 80, 150, 400):
        for share in (0.0, 0.005, 0.01, 0.02, 0.03):
            texts += variants(draw, size, 5, share)
    common = "and here is the passage that many of the documents share with no more than a few words of their own"
    texts += [f"{common} {' '.join(f'v{draw.randrange(10**6)}' for _ in range(n))}" for n in (1, 1, 2, 2, 3, 4, 6, 8) * 4]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_finds_every_link(spark, near, width, percent):
    prepare(spark)
    docs = spark.createDataFrame(near, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs, width, percent).collect()}
    want = brute(near, width, percent)
    assert got == want
    assert sum(d != c for d, (_, c) in want.items()) > 50


def test_join_edge_cases(odd):
    got = {}
    for r in ngram_join.link_documents(odd, 4, 85).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got[1] == {(1, 1)} and got[2] == {(1, 1)}
    assert got[3] == {(0, 3)} and got[4] == {(0, 4)} and got[8] == {(0, 8)}
    assert got[6] == {(29_998, 5)} and got[7] == {(1, 7)} and got[None] == {(1, None)}
    assert ngram_join.link_documents(odd.filter("doc_id < 0"), 4, 85).count() == 0


def test_near_copies_dropped_with_all_columns(odd):
    kept = ngram_join.drop_near_copies(odd, 4, 85)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 7, 7, 8, 9, 10]


def test_near_copies_are_decided_by_id_and_text(spark):
    """One id on rows of different texts, near copies under one id, and near copies without an id."""
    prepare(spark)
    draw = random.Random(11)
    a, b, c, d, e = ([f"w{draw.randrange(10**6)}" for _ in range(60)] for _ in range(5))

    def text(words, more=""):
        return " ".join(words) + more

    rows = [(1, text(a), "a"), (9, text(a, " x"), "a copy"), (9, text(b), "b"), (9, text(b, " y"), "b"), (9, text(b).upper(), "b"),
            (None, text(a, " z"), "a copy"), (None, text(c), "c"), (None, text(c, " x"), "c"), (None, text(d), "d"), (None, text(d), "d"),
            (None, text(e), "e"), (4, "", "empty"), (4, None, "empty"), (None, "", "empty"), (None, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    kept = ngram_join.drop_near_copies(docs, 5, 80)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.kind for r in got) == ["a", "b", "c", "d", "e", *["empty"] * 4]
    assert {r.kind: r.doc_id for r in got if r.kind != "empty"} == {"a": 1, "b": 9, "c": None, "d": None, "e": None}
    assert {tuple(r) for r in got} <= set(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_miss_no_linkable_pair(percent):
    """Sets at the very limit of the similarity share a signature, at every size, also next to many empty parts."""
    draw = np.random.default_rng(2)
    bands = ngram_join.Bands(percent)
    for size in [*range(1, 60), 75, 99, 140, 333, 1000]:
        for added in {0, 1, size * (100 - percent) // (100 + percent), int(size * 100 / percent) - size}:
            for taken in {0, 1, added}:
                a = draw.integers(0, 1 << 63, size).astype(np.uint64)
                b = np.concatenate([a[taken:], draw.integers(0, 1 << 63, added).astype(np.uint64)])
                shared = size - taken
                if shared <= 0 or not linking.similar(shared, size + len(b), percent) or (not taken and not added):
                    continue
                common = np.sort(a[: size // 4])
                for known in (np.zeros(0, np.uint64), common, np.sort(a[: size * 4 // 5])):
                    (x, of_x), (y, of_y) = ngram_join.signatures([np.sort(a), np.sort(b)], bands, known)
                    assert len(np.intersect1d(x, y)), (size, added, taken)
                    # In some family they share as many as the rules of both say.
                    _, i, j = np.intersect1d(x, y, return_indices=True)
                    rules = collections.Counter((of_x[i] // linking.FAMILY).tolist())
                    need = {r // linking.FAMILY: max(r % linking.FAMILY, q % linking.FAMILY) for r, q in zip(of_x[i].tolist(), of_y[j].tolist(), strict=True)}
                    assert any(rules[f] >= need[f] for f in need), (size, added, taken)


def test_shared_passages_and_large_clusters(spark):
    """Passages that many texts share tie nothing; clusters of more copies than a small run are found whole."""
    prepare(spark)
    draw = random.Random(31)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(4)]
    texts = [f"{draw.choice(passages)} " + " ".join(f"u{draw.randrange(10**9)}" for _ in range(draw.randrange(5, 90))) for _ in range(120)]
    for _ in range(4):
        base = [f"c{draw.randrange(10**9)}" for _ in range(150)]
        for _ in range(20):
            words = list(base)
            for _ in range(draw.randrange(4)):
                words[draw.randrange(150)] = f"x{draw.randrange(10**9)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_thousands_of_equal_rows_with_a_near_copy(spark):
    prepare(spark)
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words))] * 5000 + [(2, " ".join([*words[:-1], "changed"])), (3, "something else altogether stands here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = ngram_join.link_documents(docs, 4, 85).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5000), (2, 1, 1), (3, 3, 1)]


def test_large_components_are_split_and_whole(spark):
    prepare(spark)
    draw = random.Random(9)
    texts = variants(draw, 60, 60, 0.04)
    rows = list(enumerate(texts))
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    names = linking.node_names(word_shingle_sets(np.frombuffer(b"".join(data), np.uint8), at, 4))
    members = spark.createDataFrame([(1, int(n), t) for n, t in zip(names, texts, strict=True)], "comp long, node long, text string")
    found = {r.node: r.label for r in linking.groups(members.dropDuplicates(["node"]), "words", 4, 85, tile_nodes=7).collect()}
    want = brute(rows, 4, 85)
    pairs = {(found[int(names[i])], want[i][1]) for i in range(len(rows))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_candidate_pairs_over_batches(spark, batch):
    prepare(spark)
    draw = random.Random(batch)
    rows = list({(sig, draw.randrange(60)) for sig in range(12) for _ in range(draw.choice([1, 2, 5, 8, 9, 30]))})
    table = spark.createDataFrame(rows, "sig long, node long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {(r.a, r.b): r.tied for r in linking.candidate_pairs(table, most=8).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = {}
    for sig in range(12):
        nodes = sorted(n for s, n in rows if s == sig)
        large = len(nodes) > 8
        for a, b in itertools.combinations(nodes, 2):
            if not large or a == nodes[0]:
                want[a, b] = want.get((a, b), False) or large
    assert got == want


def test_bitmaps_bound_the_overlap():
    draw = np.random.default_rng(8)
    for size in (1, 5, 40, 300, 3000):
        for kept in (0.7, 0.8, 0.9, 1.0):
            a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * kept)], draw.integers(0, 1 << 63, int(size * (1 - kept) * 2)).astype(np.uint64)]))
            linked = linking.similar(linking.overlap(a, b), len(a) + len(b), 80)
            if linked:
                assert linking.may_link(len(a), linking.bitmap(a), len(b), linking.bitmap(b), 80)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in linking.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert linking.components(edges.filter("a < 0")).count() == 0


# -- lines --------------------------------------------------------------------------------------------


def test_lines(spark):
    prepare(spark)
    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{line}\nalone\n\nother words stand here"), (2, f"Top\n{line} .\n{line}"), (3, None), (4, ""), (5, "   \n\n"),
            (6, line.upper()), (6, line.upper())]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, line int")
    got = [(r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.kept) for r in line_dedup.line_classes(docs).collect()]
    assert sorted(got) == sorted([(1, 0, 1, 0, True), (1, 1, 1, 1, True), (1, 3, 1, 3, True), (2, 0, 2, 0, True), (2, 1, 1, 0, False),
                                  (2, 2, 1, 0, False), (6, 0, 1, 0, False), (6, 0, 1, 0, False)])
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert cleaned[1] == rows[0][1] and cleaned[2] == "Top" and cleaned[3] is None and cleaned[6] == "" and cleaned[5] == "   \n\n"
    assert line_dedup.line_classes(docs.filter("doc_id < 0")).count() == 0


def test_lines_of_one_id_on_two_texts(spark):
    """A line is named by id, text and number, so what a copy loses is not lost elsewhere."""
    prepare(spark)
    copied = "this very line stands in more than one of these documents"
    rows = [(1, copied), (2, f"first words of the one text\n{copied}"), (2, "first words of another text here\nthis unique line must not be lost at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = sorted(r.text for r in line_dedup.drop_lines(docs).collect())
    assert cleaned == sorted([copied, "first words of the one text", rows[2][1]])


def test_members_of_documents_without_id_are_linear(spark):
    prepare(spark)
    lines = [f"a shared line with the number {i} in the midst of it and more" for i in range(5)]
    rows = [(None, "\n".join([f"own line number {k} of a text without any id {k * 7919}", *lines])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_classes(docs)
    assert got.count() == 1800 and got.filter("kept").count() < 310


def test_line_classes_against_brute_force(spark, data):
    prepare(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").filter(F.col("doc_id") < 120)
    lines = {}
    for d, text in docs.select("doc_id", "text").collect():
        for i, line in enumerate(text.split("\n")):
            if line.strip(" \t\n\v\f\r"):
                low = line.translate(LOWER).encode()
                lines[d, i] = frozenset(low[k : k + 7] for k in range(max(1, len(low) - 6)))
    distinct = list(set(lines.values()))
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(distinct)), 2):
        small, large = sorted((len(distinct[a]), len(distinct[b])))
        if 100 * small >= 80 * large:
            both = len(distinct[a] & distinct[b])
            if 100 * both >= 80 * (small + large - both):
                root[find(a)] = find(b)
    number = {s: i for i, s in enumerate(distinct)}
    first = {}
    for place in sorted(lines):
        first.setdefault(find(number[lines[place]]), place)
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_dedup.line_classes(docs).collect()}
    assert got == {p: first[find(number[s])] for p, s in lines.items()}


def test_lines_are_those_of_a_split():
    import re

    import numpy as np

    from pitsignal.llm.line_dedup import line_spans

    texts = ["", "a", "\n", "a\n", "\n\nb c\n \t\n\x0b\nd", "", "\né\n日本\n", "x\r\ny", " \n ", "\n"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = [(int(r), int(n), bytes(data[a:b]).decode()) for a, b, r, n in zip(*line_spans(data, offsets), strict=True)]
    assert got == [(r, n, line) for r, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)]


def test_star_edges_over_several_batches(spark):
    import re

    from pitsignal.llm.linking import components, star_edges

    # One signature with more nodes than a batch has rows, in no order; one of a pair; one of a single, repeated node.
    wide = [(5, n * 7919 % 25_000) for n in range(25_000)]
    rows = spark.createDataFrame([*wide, (6, 30_001), (6, 30_000), (7, 40_000), (7, 40_000)], "sig long, node long")
    edges = star_edges(rows)
    assert edges.count() == edges.distinct().count() and edges.filter("a >= b").isEmpty()
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {n: 0 for n in range(25_000)} | {30_000: 30_000, 30_001: 30_000}
    # One key, so that the sort is by radix.
    assert re.search(r"Sort \[sig#\d+L ASC NULLS FIRST\], false", edges._jdf.queryExecution().executedPlan().toString())


def test_signatures_travel_in_shares_and_far_pairs_are_not_tied(spark):
    from pitsignal.llm import linking
    from pitsignal.llm.line_dedup import _signature_rows

    texts = ["\n".join(f"line {i} of text {k} tells {i * k % 97} things" for i in range(200)) for k in range(8)]
    packed = _signature_rows(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1))
    # 1,600 lines have 25,600 signatures, in at most a row for each share and kind.
    assert packed.count() <= 3 * linking.shares(spark)

    def ties(rows):
        arrays = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int64, np.uint64)))
        held = pa.Table.from_batches(linking.dealt_signatures([arrays], linking.shares(spark)))
        return {(r.a, r.b) for r in linking.star_edges(spark.createDataFrame(held.to_pandas(), linking.DEALT)).collect()}

    far = (1 << 64) - 1
    half = (1 << 16) - 1
    assert ties([(9, 1, 0), (9, 2, far)]) == set()
    # 1 and 2 are far apart, 3 is close to both.
    assert ties([(9, 1, 0), (9, 2, half << 8 | 0xFF), (9, 3, half), (9, 1, 0)]) == {(1, 3), (2, 3)}
    # Of many nodes all are tied to the smallest, whatever their sketches.
    many = [(7, n, far * (n % 2)) for n in range(20)]
    assert ties(many) == {(0, n) for n in range(1, 20)}


def test_window_hashes_equal_those_of_single_spans():
    from pitsignal.llm.common import SpanHasher, byte_windows

    data = np.random.default_rng(3).integers(0, 256, 30_000).astype(np.uint8)
    cuts = np.sort(np.random.default_rng(4).choice(30_000, 900, replace=False))
    start, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [30_000]])
    hasher = SpanHasher(data)
    for some in (slice(None), slice(5, 40), slice(899, None), slice(0, 0)):
        values, at = byte_windows(hasher, start[some], stop[some], 7)
        spans = [(i, min(i + 7, b)) for a, b in zip(start[some], stop[some]) for i in range(a, max(a + 1, b - 6))]
        assert len(values) == len(spans) == at[-1]
        assert values.tolist() == [int(hasher(np.array([a]), np.array([b]))[0]) for a, b in spans]
