"""Alignment of two tokenizers, byte-level BPE, and periodic runs, each against a plain version."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.llm import alignment, byte_pairs, periodic
from pitsignal.llm.common import prepare
from pitsignal.llm.queries import QUERIES, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def pattern():
    from public_tokenizers import PATTERN

    return PATTERN


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    prepare(spark)
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh") for _ in range(3000)) + " " * 3000 + "the cat sat " * 3000
    rows = [
        (1, None, "a"), (2, "", "b"), (3, long, "c"), (4, "once <|endoftext|> <s> <0x41> twice", None), (4, "once <|endoftext|> <s> <0x41> twice", None),
        (None, "no id here, no id here", "d"), (5, "a▁b", "e"), (6, " \t\n\x0b\x0c\r ", "f"), (7, "日本語 é 🙂́ \x00 \x1c x", "g"),
        (8, "▁", "h"), (9, "don't we'll 123 4567 !!!\n\n\n  end  ", "i"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("groups", F.lit(1)).withColumn("runs", F.lit("x"))


def both(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(odd.select((F.col("doc_id") - 1000).alias("doc_id"), "text"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- alignment ----------------------------------------------------------------------------------------


def plain_tokens(text, side):
    out, at = [], 0
    for i in side.encode([text])[0]:
        out.append((i, at, at + len(side.strings[i])))
        at = out[-1][2]
    return out


def plain_alignment(rows):
    a, b = alignment.sides(A, B)
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        left, right = (plain_tokens(text, s) if text else [] for s in (a, b))
        if any(b"".join(s.strings[i] for i, _, _ in t) != whole for s, t in ((a, left), (b, right))):
            left = right = []
        links = [(i, j) for i, _, end in left for j, _, stop in right if end == stop] if len(left) < 400 else [
            (i, j) for (i, _, end) in left for j in [k for k, _, stop in right if stop == end]
        ]
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, s, e in t if low <= s and e <= high) for t in (left, right)))
        counts.update(links)
        found.append((doc_id, left, right, groups, links))
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted(
        ((d, len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), sha(";".join(g)) if x else "") for d, x, y, g, k in found),
        key=repr,
    )


def test_alignment_against_plain_loops(spark, data, odd):
    docs = both(spark, data, odd).filter("text is null or length(text) < 1500")
    assert rows_of(alignment.scored(docs, A, B)) == plain_alignment([tuple(r) for r in docs.collect()])


def test_alignment_of_odd_and_long_rows(spark, odd):
    got = {r.doc_id: r for r in alignment.scored(odd, A, B).collect()}
    assert got[1].n_a == got[2].n_links == got[5].n_b == got[8].n_groups == 0 and got[5].groups_sha256 == ""
    assert got[3].n_groups > 9000 and got[3].n_links == got[3].n_groups
    assert len(got) == 10
    groups = {r.doc_id: (r.groups, len(r.links)) for r in alignment.align(odd, A, B).collect()}
    assert all(sha(g) == got[i].groups_sha256 and n == got[i].n_links for i, (g, n) in groups.items() if n)
    assert alignment.scored(odd.limit(0), A, B).count() == 0


def test_overlaps_are_all_overlaps():
    a, b = alignment.sides(A, B)
    left, right, pairs, _ = alignment.aligned(["unbelievably tokenised words, 12345 日本", "x", ""], a, b, alignment.shown_ids(a, b))
    want = {
        (i, j) for i, x in left.iterrows() for j, y in right.iterrows()
        if x["row"] == y["row"] and x["start"] < y["end"] and y["start"] < x["end"]
    }
    assert set(zip(pairs["a"], pairs["b"], strict=True)) == want and len(pairs) == len(want)


def test_side_a_gives_the_ids_of_the_tokenizer(spark, data, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    texts = [r.text for r in both(spark, data, odd).collect() if r.text]
    texts += [" " * 60_000 + "<|endoftext|>", "".join(f"a{chr(p)}b {chr(p)}{chr(p)} 1{chr(p)}" for p in range(0x20, 0x3000))]
    assert alignment.sides(A, B)[0].encode(texts) == [plain.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_every_link_is_listed_as_possible():
    a, b = alignment.sides(A, B)
    possible = set(alignment.possible_links(a, b).tolist())
    assert len(possible) <= a.sizes.sum() + 2 * b.sizes.sum()
    rnd = random.Random(2)
    for _ in range(3000):
        i, j = rnd.randrange(len(a.strings)), rnd.randrange(len(b.strings))
        x, y = a.strings[i], b.strings[j]
        assert ((j << 32 | i) in possible) == (bool(x and y) and (x.endswith(y) or y.endswith(x)))


# -- byte-level BPE -----------------------------------------------------------------------------------


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


def test_byte_pairs_against_tiktoken(spark, data, odd):
    docs = both(spark, data, odd)
    want, plain = [], encoding()
    for doc_id, text in docs.collect():
        ids = plain.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    got = byte_pairs.digests(byte_pairs.decode(byte_pairs.encode(docs, RANKS, pattern()), RANKS, pattern()))
    assert rows_of(got) == sorted(want, key=repr)
    assert byte_pairs.decode(byte_pairs.encode(odd.limit(0), RANKS, pattern()), RANKS, pattern()).count() == 0


def test_pattern_splits_every_code_point_alike():
    coder, plain = byte_pairs.BytePairs(RANKS, pattern()), encoding()
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    # The private and unassigned planes behave alike; one point in 97 of these stands for them.
    points = points[:0x20000] + points[0x20000::97]
    texts = ["".join(f"a{c}b 1{c}{c} {c} " for c in points[k : k + 4000]) for k in range(0, len(points), 4000)]
    assert coder.encode(texts) == [plain.encode_ordinary(t) for t in texts]


def test_long_matches_are_put_together_exactly():
    coder, plain, rnd = byte_pairs.BytePairs(RANKS, pattern()), encoding(), random.Random(8)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", ["the", "ing", "a"], ["é", "日", "n"], "a", ["abc"], ["=", "-"], [" "], "\n"):
        for size in (63, 64, 65, 66, 97, 333, 2500):
            text = "".join(rnd.choice(alphabet) for _ in range(size))
            assert coder.encode([text])[0] == plain.encode_ordinary(text), (alphabet, size)


def test_million_blanks_and_letters():
    coder = byte_pairs.BytePairs(RANKS, pattern())
    blanks, letters = coder.encode([" " * 1_000_000, "ab" * 100_000])
    assert coder.decode(np.array(blanks + letters), np.array([0, len(blanks), len(blanks) + len(letters)])) == [b" " * 1_000_000, b"ab" * 100_000]


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError, match="vocabulary"):
        byte_pairs.BytePairs(RANKS, pattern()).decode(np.array([1, 10**6]), np.array([0, 2]))


# -- periodic runs ------------------------------------------------------------------------------------


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            block = words[i : i + length]
            if length >= max(24, 3 * q) and not any(block[e:] == block[:-e] for e in range(1, q)):
                out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_repeats(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept)


def test_periodic_runs_against_plain_loops(spark, data, odd):
    docs = both(spark, data, odd).filter("text is null or length(text) < 6000")
    want = sorted((plain_repeats(*r) for r in docs.collect()), key=repr)
    got = rows_of(periodic.digests(periodic.repeats(docs, plant=True)))
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_runs_of_any_shape():
    rnd = random.Random(4)
    double = [x for c in "00011011" for x in (range(100, 120) if c == "0" else range(200, 220))]
    for trial in range(300):
        docs = [[1] * 500, [1, 2] * 300, double * 3, double * 4 + double[:50]] if not trial else []
        for _ in range(3):
            words = []
            while len(words) < rnd.choice([30, 100, 300]):
                unit = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.choice([1, 2, 3, 7, 8, 15, 16, 17, 31, 32, 33]))]
                if rnd.random() < 0.3:
                    unit = unit * 2 + [rnd.randrange(3)]
                words += (unit * rnd.choice([1, 2, 3, 4, 9]))[: rnd.randrange(1, 300)]
            docs.append(words)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periodic.find_runs(np.array([w for d in docs for w in d], dtype=np.int64), bounds)
        for i, d in enumerate(docs):
            assert [r[1:] for r in got if r[0] == i] == plain_runs(list(d))


def test_runs_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in periodic.repeats(odd).collect()}
    assert got[1].n_words == got[2].n_words == got[6].n_words == 0 and got[1].collapsed == ""
    assert [tuple(r) for r in got[3].runs] == [(1, 9000, 3)] and got[3].collapsed.endswith(" the cat sat")
    assert periodic.digests(periodic.repeats(odd.limit(0))).count() == 0


def test_queries_give_a_row_per_document(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op11_alignment", "op12_byte_pairs", "op13_periodic_runs"):
        assert QUERIES[name](spark, data).count() == n


def test_tokenizers_are_shared_and_rows_laid_end_to_end():
    assert all(x is y for x, y in zip(alignment.opened(A, B), alignment.opened(A, B), strict=True))
    a, b, shown = alignment.opened(A, B)
    texts = ["one two", "", "▁no", "日本 3.14", "x", "▁", "unbelievably long"]
    whole = [(" " + t).encode() for t in texts]
    lists = b.encode(texts)
    counts = np.array([len(one) for one in lists])
    assert alignment.given_back(np.array(sum(lists, [])), counts, b, whole).tolist() == [True, False, False, True, True, False, True]
    together = alignment.aligned(texts, a, b, shown)
    alone = [alignment.aligned([t], a, b, shown) for t in texts]
    assert together[3] == [one[3][0] for one in alone] and together[3][1] == together[3][2] == together[3][5] == ""
    assert len(together[2]) == sum(len(one[2]) for one in alone)
    assert together[0]["row"].unique().tolist() == [0, 3, 4, 6]


def test_contracted_pieces_keep_their_order():
    coder = byte_pairs.BytePairs(RANKS, pattern())
    pieces = [p for p in (b"zzqxzz", b"qqz", b"unbelievablyq", b"zqz", b"\xff\xfe\xfd") if p not in coder.ranks]
    ids, at = coder._contract(pieces)
    assert [b"".join(coder.decode(ids[a:b], np.array([0, b - a]))) for a, b in zip(at[:-1], at[1:], strict=True)] == pieces
    assert [x.tolist() for x in coder._contract([])] == [[], [0]]
    encoding = [coder.encode([p.decode("latin-1")]) for p in (b"zqz", b"qqz")]
    assert encoding == [coder.encode([t]) for t in ("zqz", "qqz")]
