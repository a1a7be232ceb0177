"""Comma-separated files whose quoted fields hold line ends, read in splits.

A reader that looks for the end of a record from the start of a file makes one task of each file. Here the splits of Spark's text
reader stay: a physical line begins a record when an even number of quotes stands before it in the file, a doubled quote
inside a field being two. Each task counts quotes from the start of its split and numbers the
records for both cases, an even and an odd number before the split. Sums of one row per split say which case holds.
Lines that are whole records go on as they are; only parts of records of several lines are
shuffled and put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.operators.keyed import join_keys
from pitsignal.session import land

QUOTE = '"'
# Stands for an empty field without quotes, so that an empty one in quotes is not taken for it.
NO_FIELD = "\x00\uffff\x00"
PLACED = "file string, block long, seq long, odd boolean, inside boolean, even_starts long, odd_starts long, line string"


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number lines and count record starts within each split; a split's lines follow one another."""
    split, seq, odd, starts = None, 0, 0, [0, 0]
    for batch in batches:
        files, blocks, lines = batch.columns
        if not len(lines):
            continue
        names = files.dictionary_encode()
        marks = np.stack([names.indices.to_numpy(), blocks.to_numpy()])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(lines)]
        quotes = pc.count_substring(lines, QUOTE).to_numpy() % 2
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = (files[a].as_py(), blocks[a].as_py())
            if here != split:
                split, seq, odd, starts = here, 0, 0, [0, 0]
            after = (odd + np.cumsum(quotes[a:b])) % 2
            inside = np.r_[odd, after[:-1]]
            counts = [starts[0] + np.cumsum(inside == 0), starts[1] + np.cumsum(inside == 1)]
            yield pa.RecordBatch.from_arrays([
                files.slice(a, b - a), blocks.slice(a, b - a), pa.array(np.arange(seq, seq + b - a)),
                pa.array(quotes[a:b] == 1), pa.array(inside == 1), *[pa.array(c.astype(np.int64)) for c in counts],
                lines.slice(a, b - a),
            ], names=["file", "block", "seq", "odd", "inside", "even_starts", "odd_starts", "line"])
            seq, odd, starts = seq + b - a, int(after[-1]), [int(c[-1]) for c in counts]


def _split_table(placed: DataFrame) -> DataFrame:
    """Per split: whether it begins inside a quoted field, and the record that is open where it begins."""
    splits = placed.groupBy("file", "block").agg(
        F.sum(F.col("odd").cast("long")).alias("odd"),
        F.max("even_starts").alias("even_starts"), F.max("odd_starts").alias("odd_starts"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    starts = F.when(F.col("begins_inside"), F.col("odd_starts")).otherwise(F.col("even_starts"))
    last = F.last(F.when(F.col("starts") > 0, F.struct("block", "starts")), ignorenulls=True)
    return (
        splits.withColumn("begins_inside", begins)
        .withColumn("starts", starts)
        .withColumn("open", last.over(before))
        .select("file", "block", "odd", "begins_inside", "open")
    )


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, number, record``: whole records with the split and number in it at which each begins.

    Line ends inside quoted fields are kept as they are. A file with an odd number of quotes has no true
    ends of records and is an error that names it. Quotes must stand as the format has them: around a field, and doubled
    inside it; no other escape is known. The lines are landed once, since a second scan of the files might cut
    other splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    placed = land(lines.mapInArrow(_place, PLACED), "quoted-lines")
    splits = land(_split_table(placed), "quoted-splits")
    broken = splits.groupBy("file").agg(F.sum("odd").alias("n")).filter("n % 2 = 1").select("file").limit(5).collect()
    if broken:
        raise ValueError(f"unpaired quotes in {[r['file'] for r in broken]}")
    begins = F.col("begins_inside") == F.col("inside")
    number = F.when(F.col("begins_inside"), F.col("odd_starts")).otherwise(F.col("even_starts"))
    known = join_keys(placed, splits.drop("odd"), ["file", "block"]).withColumns({"begins": begins, "number": number})
    whole = known.filter(F.col("begins") & ~F.col("odd")).select("file", "block", "number", F.col("line").alias("record"))
    at = F.when(F.col("number") > 0, F.struct("block", F.col("number").alias("starts"))).otherwise(F.col("open"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "seq", "line")))
    joined = (
        known.filter(~F.col("begins") | F.col("odd"))
        .withColumn("at", at)
        .groupBy("file", "at")
        .agg(F.array_join(F.transform(pieces, lambda p: p["line"]), "\n").alias("record"))
        .select("file", F.col("at.block").alias("block"), F.col("at.starts").alias("number"), "record")
    )
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """A table from files of quoted fields, by position; with ``header`` the first record of each file is left out.

    Blank records are skipped. A field that is not of its type is null, and so is an empty one without quotes; an
    empty one in quotes is an empty text.
    """
    records = quoted_records(spark, path).filter(F.col("record") != "")
    if header:
        records = records.filter((F.col("block") > 0) | (F.col("number") > 1))
    if isinstance(schema, T.StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true", "nullValue": NO_FIELD}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
