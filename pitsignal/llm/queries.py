"""The operators as registered queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.llm import alignment, byte_pairs, chat, exact_dedup, line_dedup, ngram_join, packing, periodic, pieces, pii, quality_net, quality_rules, warc
from pitsignal.llm.common import id_and_text, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = id_and_text(docs)
    vectors = quality_net.context_vectors(texts)
    net = quality_net.train(texts, table(spark, sf_dir, "labels"), vectors)
    return quality_net.score(docs, vectors, net)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"),
    )
    return chat.read_back(chat.examples(turns.unionByName(extra)))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, 14 + length(role) + 2 * (length(role) - length(replace(role, '%', ''))) + 2 * (length(role) - length(replace(role, chr(10), '')))
    + length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')) AS n,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = last) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.drop("ids")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(id_and_text(docs), table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(spark)
    return warc.read_archives(warc.write_archives(pages, folder), folder)


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (SELECT html, max(page_id) AS chosen FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN chosen IS NULL OR p.page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> chosen THEN chosen END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND n >= 1000
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.scored(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = byte_pairs.encode(table(spark, sf_dir, "documents"), path, PATTERN)
    return byte_pairs.digests(byte_pairs.decode(coded, path, PATTERN))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.repeats(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_net": op2_quality_net,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_examples": op6_chat_examples,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_alignment": op11_alignment,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op6_chat_examples": OP6_SQL, "op10_warc": OP10_SQL}
