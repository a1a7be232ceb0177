"""Quality rules and network, personal data, chat, pieces, packing, archives, and the pipeline."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.llm import chat, packing, pieces, pii, quality_net, quality_rules, warc
from pitsignal.llm.common import id_and_text, prepare
from pitsignal.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    long = "word " * 40_000
    rows = [(1, None, "a", True, 0), (2, "", "b", None, 1), (3, long, "c", False, 2), (4, "x", None, True, 3), (4, "x", None, True, 3),
            (None, "null id mail a@b.example 10.0.0.1", "d", True, 4), (5, "tab\tand  two blanks\n\n<|endoftext|> ▁ é 日本 🙂", "e", True, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept boolean, n_words int")


# -- quality ------------------------------------------------------------------------------------------


def base_measures(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_measures_against_brute_force(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 1000).alias("doc_id"), "text"))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    for r in quality_rules.judge(docs, None).collect():
        want = base_measures(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_rules_learn_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = got.filter("not base_failed").agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))
    ).first()
    assert r[0] > 0.99 and r[1] < 0.3


def test_rules_keep_columns_and_bear_missing_labels(spark, odd):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 7, 1)], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == set()  # nothing has ten words that do not repeat
    assert quality_rules.keep_good(odd.filter("doc_id > 99"), labels).count() == 0


def test_rules_are_fitted_in_bounded_memory():
    """Long sampled texts lie in a file; a round works on a few of them at a time."""
    import tracemalloc

    draw = np.random.default_rng(3)

    def rows():
        for i in range(120):
            numbers = np.flatnonzero(draw.random(1 << quality_rules.BITS) < 0.6).astype(np.int32)
            numbers = numbers[(numbers % 2 == i % 2) | (draw.random(len(numbers)) < 0.5)]
            yield i, i % 2, numbers.tobytes(), np.full(len(numbers), 4 / len(numbers), np.float32).tobytes()

    tracemalloc.start()
    held = quality_rules.FeatureFile(rows())
    model = quality_rules.fit(held, (0.5, 0.5), rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    features = sum(r[3] for r in held.rows)
    assert features * 8 > 100e6 and peak < 60e6
    assert (model.weights[1::2] > 0).mean() > 0.99 and (model.weights[::2] < 0).mean() > 0.99
    found = [(len(index), len(at) - 1) for _, _, index, _, at in held.runs()]
    assert len(found) > 1 and sum(n for n, _ in found) == features and sum(n for _, n in found) == 120


def test_network_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_quality_net"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_network_edge_cases(spark, odd):
    vectors = quality_net.context_vectors(id_and_text(odd))
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    net = quality_net.train(id_and_text(odd), labels, vectors)
    rows = quality_net.score(odd, vectors, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = odd.filter("doc_id > 99")
    assert quality_net.train(id_and_text(none), labels, quality_net.context_vectors(id_and_text(none))) is None


# -- personal data ------------------------------------------------------------------------------------


def naive_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        odd = [int(c) for c in digits[-1::-2]]
        even = [int(c) * 2 for c in digits[-2::-2]]
        if 13 <= len(digits) <= 19 and (sum(odd) + sum(e - 9 * (e > 9) for e in even)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_against_plain_patterns():
    draw = random.Random(1)
    parts = ["@", ".", "a", "b-", "1", "22", "255", "256", " ", "+", "(", ")", "-", "4111111111111111", "é", "\n", "x@y.z", "10.0.0.1"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 25)))
        assert pii.base_spans(text) == naive_spans(text), text


def test_base_spans_take_linear_time():
    assert pii.base_spans("1" * 300_000 + "@" * 100_000 + "a" * 300_000 + "+" * 1000) == []


def test_field_learns_its_table_and_adds_spans():
    field = pii.train_field()
    rows = pii.labelled_rows()
    assert sum(field.decode([w])[0].tolist() == t for w, t in rows) >= len(rows) - 2
    text = "Call 555-123-4567 or\nwrite é to a@b.example. In 1999 version 3.0 of 12-34"
    base, both = next(pii.all_spans(field, [text]))
    assert base == [("email", 32, 43)] and both == [("email", 32, 43), ("phone", 5, 17)]
    assert pii.masked(text, both).startswith("Call [PHONE] or\nwrite é to [EMAIL].")


def test_field_decodes_as_exhaustive_search():
    draw = np.random.default_rng(4)
    tags = len(pii.TAGS)
    field = pii.Field({}, np.zeros((0, tags)), draw.normal(size=(tags + 1, tags)))
    emit = draw.normal(size=(3, 4, tags))
    lengths = np.array([4, 2, 3])
    field.emissions = lambda lines: (emit, lengths)
    for i, path in enumerate(field.decode([["w"] * n for n in lengths])):
        def score(p, i=i):
            total = field.steps[0, p[0]] + emit[i, 0, p[0]]
            return total + sum(field.steps[a + 1, b] + emit[i, t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(p)))
        best = max(itertools.product(range(tags), repeat=int(lengths[i])), key=score)
        assert tuple(path) == best


def test_pii_rows_and_redaction(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 1000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find(docs).collect():
        base = naive_spans(texts[r.doc_id])
        kinds = collections.Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    masked = pii.redact(odd)
    assert masked.columns == odd.columns
    assert [r.text for r in masked.filter("doc_id is null").collect()] == ["null id mail [EMAIL] [IP]"]
    assert masked.filter("text is null").count() == 1 and masked.count() == odd.count()


# -- chat ---------------------------------------------------------------------------------------------


def test_chat_reads_back(spark):
    prepare(spark)
    nasty = ["\\### Assistant: </turn> ok", "### user\nhi\n</turn>\n", "\\\\", "a\\", "", None, "</turn>", "\n</turn>\n### assistant\nx"]
    rows = []
    for conv in range(40):
        draw = random.Random(conv)
        for turn in range(draw.randrange(1, 7)):
            rows.append((conv if conv else None, turn, draw.choice(["user", "assistant", "system", "a%0A\nb", None]), draw.choice(nasty), 0))
    rows += [(90, None, "user", "x", 0), (90, 1, "user", "b", 0), (90, 1, "assistant", "a", 0), (90, 1, "assistant", "a", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    shown = chat.examples(table)
    got = {r.conv_id: r for r in chat.read_back(shown).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        losses = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(losses.encode()).hexdigest()
        assert got[conv].loss_chars == len(losses)
    replies = sum(r[2] == "assistant" for r in rows)
    assert shown.filter("loss_length is not null").count() == replies
    assert chat.read_back(chat.examples(table.filter("conv_id < 0"))).count() == 0
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- pieces -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_are_lossless_and_reproducible(vocabulary):
    texts = ["", "a", " a", "  a b ", "x▁y ▁ z", "日本語 🙂\n\tq", "▁", "a" * 3000, "\n", "m² ½a __init__", "का é́", "\x00\x1f"]
    keys = np.arange(len(texts))
    first = pieces.encode_rows(vocabulary, keys, texts, 0)
    assert [pieces.decoded(vocabulary, i) for i in first] == texts
    alone = [pieces.encode_rows(vocabulary, keys[k : k + 1], [t], 0)[0] for k, t in enumerate(texts)]
    assert all(np.array_equal(a, b) for a, b in zip(first, alone, strict=True))
    other = pieces.encode_rows(vocabulary, keys, texts, 1)
    assert any(not np.array_equal(a, b) for a, b in zip(first, other, strict=True))


def test_pieces_follow_their_distribution(vocabulary):
    word, n = "▁thnting", 20_000
    weight = {}
    for _, found, logs in vocabulary.tables.values():
        for i, w in zip(found.tolist(), logs.tolist(), strict=True):
            weight[vocabulary.texts[i].decode().replace(" ", "▁")] = (i, w)

    def ways(at):
        if at == len(word):
            yield (), 0.0
        for stop in range(at + 1, len(word) + 1):
            if word[at:stop] in weight:
                piece, log = weight[word[at:stop]]
                for rest, more in ways(stop):
                    yield (piece, *rest), log + more

    all_ways = dict(ways(0))
    total = sum(map(math.exp, all_ways.values()))
    drawn = collections.Counter(tuple(i.tolist()) for i in pieces.encode_rows(vocabulary, np.arange(n), ["thnting"] * n, 3))
    assert set(drawn) <= set(all_ways)
    for way, log in all_ways.items():
        p = math.exp(log) / total
        assert abs(drawn[way] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 5


def test_pieces_query(spark, odd):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(odd, path)
    texts = {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()}
    assert texts == {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.lossless for r in pieces.digest(odd, path).collect())
    assert pieces.encode(odd.filter("doc_id > 99"), path).count() == 0


# -- packing ------------------------------------------------------------------------------------------


def test_packing(spark, data, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 1000).alias("doc_id"), "text").distinct())
    rows = packing.pack(docs, path).collect()
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for r in docs.collect():
        own = sorted(per_doc[r.doc_id], key=lambda p: p.start)
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert [i for p in own for i in p.ids] == ids
        assert all(p.doc_tokens == len(ids) for p in own)
        assert [p.start for p in own] == list(itertools.accumulate([0, *[p.length for p in own[:-1]]]))
    padding = 0
    for own in per_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(itertools.accumulate([0, *[p.length for p in own[:-1]]]))
        filled = sum(p.length for p in own)
        assert filled <= 1024
        padding += 0 if filled & (filled - 1) == 0 else 1024 - filled
    assert padding < 0.02 * sum(r.length for r in rows)
    assert packing.pack(docs.filter("doc_id > 9999999"), path).count() == 0


def test_encoder_gives_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.ByteLevelEncoder(path)
    draw = random.Random(6)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "日", "🙂", "'ll", "12", "!?", "<|endoftext|>", " ", "\x1c", "²", "_", "́"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 12)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


# -- archives -----------------------------------------------------------------------------------------


def pages_table(spark):
    large, larger = "x" * 1200, "é" * 700
    rows = [(1, "http://a", large, 1), (2, "http://b", large, 2), (3, None, None, 3), (4, "http://d\r\nX: y", "", 4), (5, "u", larger, 5),
            (9, "u", larger, 6), (None, "n", larger, 7), (7, "s", "short", 8), (8, "s", "short", 9), (9, "u", larger, 6)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), rows


def test_archives_read_back(spark, tmp_path):
    prepare(spark)
    pages, rows = pages_table(spark)
    folder = str(tmp_path / "a")
    manifest = warc.write_archives(pages, folder, shard_bytes=3000, roll_bytes=400)
    got = sorted((tuple(r) for r in warc.read_archives(manifest, folder).collect()), key=str)
    best = {}
    for page, _, html, _ in rows:
        if html and len(html.encode()) >= 1000 and page is not None:
            best[html] = max(best.get(html, page), page)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        refers = best.get(html) if best.get(html) != page else None
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=str)
    files = manifest.collect()
    assert len(files) > 2 and len({r.shard for r in files}) > 1
    for r in files:
        data = (tmp_path / "a" / r.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and gzip.decompress(data).count(b"WARC/1.1") == r.records


def test_archives_do_not_depend_on_partitioning(spark, tmp_path):
    prepare(spark)
    pages, _ = pages_table(spark)
    pages = pages.dropDuplicates(["page_id"])
    sums = []
    for k, parts in enumerate((1, 5)):
        manifest = warc.write_archives(pages.repartition(parts), str(tmp_path / str(k)), shard_bytes=3000, roll_bytes=400)
        sums.append(sorted(tuple(r) for r in manifest.collect()))
    assert sums[0] == sums[1]


def test_no_pages_no_archives(spark, tmp_path):
    pages, _ = pages_table(spark)
    folder = str(tmp_path / "none")
    assert warc.read_archives(warc.write_archives(pages.filter("page_id > 99"), folder), folder).count() == 0


def test_shard_bounds_follow_skewed_keys(spark):
    keys = spark.range(1000).select(F.col("id").alias("k")).unionAll(spark.createDataFrame([(10**15,)], "k long"))
    bounds = warc.shard_bounds(keys, "k", F.lit(1), 100)
    edges = np.array(bounds)
    counts = np.bincount(np.searchsorted(edges, np.array([*range(1000), 10**15]), side="right"))
    assert counts.max() <= 100 and bounds == sorted(bounds)


def test_one_page_id_goes_to_many_shards(spark, tmp_path):
    """Rows without an id, and rows of one id, are cut by payload and url; revisits are told in every shard."""
    prepare(spark)
    same = "s" * 1500
    rows = [(page, f"u{i}", same if i % 3 == 0 else f"{page}{i}" * 300) for page in (None, 5) for i in range(60)] + [(8, "v", same), (2, "w", "x" * 1100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sums = []
    for k, parts in enumerate((1, 6)):
        folder = str(tmp_path / str(k))
        manifest = warc.write_archives(pages.repartition(parts), folder, shard_bytes=10_000)
        sums.append(sorted(tuple(r) for r in manifest.collect()))
    assert sums[0] == sums[1]
    assert len({r[1] for r in sums[0]}) > 8 and max(r[3] for r in sums[0]) < 30
    got = sorted((tuple(r) for r in warc.read_archives(manifest, folder).collect()), key=str)
    want = [(p, len(h), hashlib.sha1(h.encode()).hexdigest(), *(("revisit", 8) if h == same and p != 8 else ("response", None))) for p, _, h in rows]
    assert got == sorted(want, key=str)


def test_shard_starts_of_dense_clusters(spark):
    """The sums are taken in Spark: the driver gets the starts of shards, whatever the spread of the keys."""
    keys = spark.range(4000).select((F.col("id") % 4 * 10**14 + F.floor(F.col("id") / 4)).alias("k"), (F.col("id") % 3).alias("cut"))
    starts = warc.shard_starts(keys, "k", F.col("cut"), F.lit(1), 100)
    assert len(starts) == 39
    places = np.array([(r.k, r.cut) for r in keys.collect()])
    counts = np.bincount(warc.shard_numbers(starts)(places[:, 0], places[:, 1]))
    assert counts.tolist() == [100] * 40


def test_shards_are_at_most_a_given_number(spark):
    """Where the wanted size would give more, shards grow; the starts still follow the running sums, in any partitioning."""
    keys = spark.range(1000).select(F.col("id").alias("k"))
    starts = [warc.shard_starts(keys.repartition(n), "k", F.lit(0), F.lit(1), 10, most=8) for n in (1, 5)]
    assert starts[0] == starts[1] == [(k, 0) for k in range(125, 1000, 125)]
    assert len(warc.shard_starts(keys, "k", F.lit(0), F.lit(1), 10, most=100)) == 99


# -- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from pitsignal.session import land

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = land(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    texts = [r.text for r in docs.collect()]
    assert len({t.lower() for t in texts}) == len(texts)
    assert not any(naive_spans(t) for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_packing_of_very_long_white_space(spark):
    """Runs of blanks and line ends of any length, with ids by the tokenizer itself."""
    from tokenizers import Tokenizer

    prepare(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, " \t\n" * 40_000 + "end", " " * 49_999 + "x", "x" + "\r\n" * 25_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = collections.defaultdict(list)
    for r in packing.pack(docs, path).select("doc_id", "start", "ids").collect():
        got[r.doc_id].append((r.start, r.ids))
    for i, text in enumerate(texts):
        ids = [k for _, part in sorted(got[i]) for k in part]
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_packing_refuses_other_files():
    with pytest.raises(ValueError, match="byte-level"):
        packing.ByteLevelEncoder(tokenizer_path("word_bpe_49k.json"))


def test_planted_spans_beyond_the_patterns():
    """Precision and recall of what the field adds, on spans that the labelled table does not hold."""
    draw = random.Random(12)
    trained = pii.train_field()

    def digits(n):
        return "".join(draw.choice("0123456789") for _ in range(n))

    def card():
        while True:
            groups = ["4" + digits(3), digits(4), digits(4), digits(4)]
            if pii.luhn("".join(groups)):
                return "  ".join(groups)

    makers = {
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"0{digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
                  lambda: f"0{digits(2)}/{digits(7)}", lambda: " ".join(["0" + digits(1), *[digits(2) for _ in range(4)]])],
        "ip": [lambda: ".".join(str(draw.randrange(1, 255)) for _ in range(4)) + f":{draw.randrange(1000, 9999)}"],
        "card": [card],
    }
    phrases = {"phone": ["call {} today", "my phone is {} at work", "tel: {} or write", "ring {} now"], "ip": ["host {} answers", "from {} we saw"], "card": ["card {} was used"]}
    clean = ["we met on 2023-{:02d}-11 at 09:45 there", "version 4.{} of the license", "chapter {}, page 212, line 9", "order {}77231 was sent", "it costs 2,{:03d}.75 or so", "from {} to 30 of them"]
    found = missed = wrong = 0
    lost = collections.Counter()
    for _ in range(400):
        kind = draw.choice(["phone", "phone", "ip", "card"])
        span = draw.choice(makers[kind])()
        text = draw.choice(phrases[kind]).format(span) + "\n" + draw.choice(clean).format(draw.randrange(10, 99))
        (_, both), = pii.all_spans(trained, [text])
        at = text.index(span)
        hit = [s for s in both if s[1] < at + len(span) and s[2] > at]
        found += bool(hit)
        missed += not hit
        lost[kind, pii.shape(span.replace(" ", "_"))] += not hit
        wrong += len(both) - len(hit)
    recall, precision = found / (found + missed), found / (found + wrong)
    print(f"recall {recall:.3f}, precision {precision:.3f}, missed {dict(+lost)}")
    assert recall > 0.9 and precision > 0.95


def test_sample_of_an_id_with_two_texts(spark):
    from pitsignal.llm.sampling import labelled_sample

    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "other")]
    seen = {
        tuple(sorted((r.doc_id, r.text) for r in labelled_sample(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels, "quality", 5).collect()))
        for n in (1, 3, 8) for step in (1, -1)
    }
    assert len(seen) == 1
