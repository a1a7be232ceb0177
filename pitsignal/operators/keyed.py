"""Helpers shared by the grouped operators: joins on keys, row melting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys in which null matches null; keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread_on: list[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join a one-row-per-key table to rows whose keys may be hot.

    Each key's rows are spread over ``salts`` partitions by a hash of other columns,
    and the small side is repeated once per salt; adaptive execution splits what is still
    too big. When the small side turns out to be tiny Spark broadcasts it by its measured
    size instead.
    """
    salted = rows.withColumn(
        "__salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")
    )
    repeated = per_key.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return join_keys(salted, repeated, [*keys, "__salt"], how).drop("__salt")


def melt_row(df: DataFrame, columns: dict[str, Column | str], name: str, value: str) -> DataFrame:
    """One row of statistics to one row per statistic."""
    entries = [
        F.struct(F.lit(k).alias(name), (F.col(c) if isinstance(c, str) else c).alias(value))
        for k, c in columns.items()
    ]
    return df.select(F.inline(F.array(*entries)))


def not_missing(df: DataFrame, column: str) -> Column:
    """Present means not null, and for floating point also not NaN."""
    c = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()
