"""JSON object files merged over files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.sources.files import empty_table


def read_objects(spark: SparkSession, pattern: str) -> DataFrame:
    """Top-level entries of one-object files: ``path, key, value``.

    Values are JSON text, strings without their quotes. A file that holds no object
    has no entries.
    """
    try:
        whole = spark.read.text(pattern, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty_table(spark, "path string, key string, value string")
    return whole.select(
        F.col("_metadata.file_path").alias("path"),
        F.explode(F.from_json("value", "map<string,string>")),
    )


def merge_objects(entries: DataFrame) -> DataFrame:
    """One value per key: that of the last file by path."""
    return entries.groupBy("key").agg(F.max_by("value", "path").alias("value"))
