"""Choosing, naming, ordering and adding columns; stacking and appending tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.operators.keyed import join_keys


def rename_select(df: DataFrame, names: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names)).select(*columns)


def keep_allowed(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns that exist, in the order of the list; all when none does."""
    kept = [c for c in allowed if c in df.columns]
    return df.select(*kept) if kept else df


def insert_columns(df: DataFrame, position: int, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns so that the first of them stands at ``position``."""
    order = [c for c in df.columns if c not in columns]
    order[position:position] = list(columns)
    return df.withColumns(dict(columns)).select(*order)


def tag(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``number`` or ``text`` columns."""
    wanted = {"number": T.NumericType, "text": T.StringType}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted)]


def every_third_dropped(columns: Sequence[str]) -> list[str]:
    """Column names without the 2nd, 5th, 8th, ..."""
    return [c for i, c in enumerate(columns) if i % 3 != 1]


def stack_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns 1-2, 3-4, ... below each other as ``pair``, ``first``, ``second``.

    A last column without partner is left out, and so is a row in which both are null.
    """
    pairs = [columns[i:i + 2] for i in range(0, len(columns) - 1, 2)]
    entries = [
        F.struct(
            F.lit(i).alias("pair"),
            F.col(a).cast("string").alias("first"),
            F.col(b).cast("string").alias("second"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    stacked = df.select(*keys, F.inline(F.array(*entries)))
    return stacked.filter(F.col("first").isNotNull() | F.col("second").isNotNull())


def concat_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def append_row(df: DataFrame, row: Mapping[str, object]) -> DataFrame:
    """One more row; columns it does not name are null, ones the table lacks are added."""
    known = {f.name: f.dataType for f in df.schema.fields}
    values = [
        (F.lit(v).cast(known[k]) if k in known else F.lit(v)).alias(k) for k, v in row.items()
    ]
    one = df.sparkSession.range(1).select(*values)
    return concat_tables([df, one])


def number_rows(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """A 0-based position in the order of the given columns.

    Rows are range-partitioned and sorted, written once so that the partitions stay the
    same when a task is retried, and shifted by the row count of the partitions before.
    The table of shifts has one row per partition.
    """
    from pitsignal.session import checkpoint_root

    checkpoint_root(df.sparkSession)
    # A hash of the whole row ends the order, so rows of one hot value are spread over partitions, too.
    tail = "__tail"
    tailed = df.withColumn(tail, F.xxhash64(*df.columns))
    placed = tailed.repartitionByRange(*order, tail).sortWithinPartitions(*order, tail).drop(tail).checkpoint()
    placed = placed.withColumns({
        "__part": F.spark_partition_id(),
        "__seq": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()
    shifts, total = {}, 0
    for part, n in sorted(sizes):
        shifts[part], total = total, total + n
    if not shifts:
        return placed.drop("__part", "__seq").withColumn(name, F.lit(0).cast("bigint"))
    by_part = F.array(*[F.lit(shifts.get(p, 0)) for p in range(max(shifts) + 1)])
    position = F.element_at(by_part, F.col("__part") + 1) + F.col("__seq")
    return placed.withColumn(name, position.cast("bigint")).drop("__part", "__seq")


def index_slice(df: DataFrame, index: str, start: int, stop: int, columns: Sequence[str] = ()) -> DataFrame:
    """Rows with ``start <= index < stop``; a label slice is passed ``stop + 1``."""
    kept = df.filter((F.col(index) >= start) & (F.col(index) < stop))
    return kept.select(*columns) if columns else kept


def align_series(df: DataFrame, series: Sequence[object], name: str, index: str = "idx") -> DataFrame:
    """A short list as a column, its i-th value at row i and null beyond its end."""
    values = F.array(*[F.lit(v) for v in series])
    return df.withColumn(name, F.try_element_at(values, (F.col(index) + 1).cast("int")))


def align_table(df: DataFrame, series: DataFrame, index: str = "idx") -> DataFrame:
    """The same for a series held in a table keyed by the row index."""
    return join_keys(df, series, [index], "left")


def number_range_allow_list(ranges: Sequence[tuple[int, int]], width: int = 3) -> list[str]:
    """Zero-filled numbers of the union of closed integer ranges."""
    return sorted({str(n).zfill(width) for lo, hi in ranges for n in range(lo, hi + 1)})


def allowed_numbers(spark, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """The same allow-list as a one-column table ``number``."""
    union = F.array()
    for lo, hi in ranges:
        union = F.array_union(union.cast("array<int>"), F.sequence(F.lit(lo), F.lit(hi)))
    return spark.range(1).select(F.explode(union).alias("number"))
