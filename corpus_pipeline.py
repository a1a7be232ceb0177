"""From raw documents to packed sequences: quality rules, exact copies, near copies, personal data, packing.

Each stage takes the session, the documents that the stage before it kept, and the folder of the tables; all but the last return the
columns of ``documents``. A stage's result is written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.llm import exact_dedup, ngram_join, packing, pii, quality_rules
from pitsignal.llm.common import prepare, table
from pitsignal.llm.queries import tokenizer_path
from pitsignal.session import land


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the classifier learns from the labels of these documents."""
    prepare(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    prepare(spark)
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the document with the smallest id."""
    prepare(spark)
    return ngram_join.drop_near_copies(docs, width=5, percent=80)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked; ``n_chars``, where there is such a column, follows the text."""
    prepare(spark)
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its token ids and its place in a sequence."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("PII", private_stage),
    ("packing", packing_stage),
]

# The classifier, the labelling field and the tokenizer cannot be written in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
