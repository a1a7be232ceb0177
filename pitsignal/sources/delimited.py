"""Delimited text: separator detection, positional scans, plain scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.layouts import text_schema
from pitsignal.sources.files import collect_paths, empty_table, first_line, list_files, spread, union_all

# Separators in the order in which they are looked for.
SEPARATORS = [";", "\t", ","]


def separator_of(line: Column) -> Column:
    """First known separator that a header line holds, comma when none does."""
    return F.coalesce(
        *[F.when(F.contains(line, F.lit(s)), F.lit(s)) for s in SEPARATORS], F.lit(",")
    )


def detect_separators(files: DataFrame) -> DataFrame:
    """``path, separator``; only the first line of each file is read."""

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "line": [first_line(p) for p in frame["path"]]})

    lines = spread(files.select("path"), "path").mapInPandas(heads, "path string, line string")
    return lines.select("path", separator_of(F.col("line")).alias("separator"))


def _fields_beyond(line: Column, separator: str, width: int) -> Column:
    """Whether a line has more than ``width`` fields, separators in quotes not counted.

    The quote-aware count runs only on lines with enough separators of any kind.
    """
    plain = F.length(line) - F.length(F.replace(line, F.lit(separator), F.lit("")))
    outside = '[%s](?=(?:[^"]*"[^"]*")*[^"]*$)' % separator
    return (plain >= width) & (F.regexp_count(line, F.lit(outside)) >= width)


def _origin(with_path: bool) -> list[Column]:
    return [F.col("_metadata.file_path").alias("source_file")] if with_path else []


def read_positional(
    spark: SparkSession,
    paths: Sequence[str] | str,
    columns: Sequence[str],
    separator: str = ",",
    skip_header: bool = True,
    drop_long_rows: bool = False,
    with_path: bool = False,
) -> DataFrame:
    """Text columns named by position. Short rows are padded with nulls.

    Long rows lose their surplus fields, or are dropped with ``drop_long_rows``. The
    built-in scan notices a long row only while all columns are read, so dropping reads
    whole lines and parses those that fit.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = text_schema(list(columns))
    reader = spark.read.option("header", skip_header).option("enforceSchema", True)
    reader = reader.option("mode", "PERMISSIVE")
    if not drop_long_rows:
        rows = reader.option("sep", separator).schema(schema).csv(paths)
        return rows.select(*columns, *_origin(with_path))
    lines = reader.option("sep", "\x01").option("quote", "").schema("line string").csv(paths)
    fitting = lines.filter(~_fields_beyond(F.col("line"), separator, len(columns)))
    fields = F.from_csv("line", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"sep": separator})
    return fitting.select(fields.alias("f"), *_origin(with_path)).select(
        "f.*", *(["source_file"] if with_path else [])
    )


def read_delimited(
    spark: SparkSession,
    patterns: str | Sequence[str],
    columns: Sequence[str],
    skip_header: bool = True,
    drop_long_rows: bool = False,
    with_path: bool = False,
) -> DataFrame:
    """Files of any known separator as one table.

    When all files share a separator the patterns go to one scan as they are; otherwise
    each separator gets a scan of its own files.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    files = list_files(spark, *patterns).filter(F.col("length") > 0)
    marked = detect_separators(files).persist()
    found = [r["separator"] for r in marked.select("separator").distinct().collect()]
    options = dict(
        skip_header=skip_header, drop_long_rows=drop_long_rows, with_path=with_path
    )
    if not found:
        extra = [T.StructField("source_file", T.StringType())] if with_path else []
        return empty_table(spark, T.StructType([*text_schema(list(columns)).fields, *extra]))
    if len(found) == 1:
        marked.unpersist()
        present = [p for p in patterns if not list_files(spark, p).isEmpty()]
        return read_positional(spark, present, columns, found[0], **options)
    parts = [
        read_positional(
            spark, collect_paths(marked.filter(F.col("separator") == s)), columns, s, **options
        )
        for s in sorted(found)
    ]
    marked.unpersist()
    return union_all(parts)


def read_headed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A comma-separated file whose header names the columns."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path)
