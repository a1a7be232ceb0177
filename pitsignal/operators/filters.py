"""Row filters, null handling and schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.functions.times import add_days, col
from pitsignal.operators.quantiles import exact_quantiles


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str], error: type[Exception] = ValueError) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise error(f"required columns are missing: {missing}")
    return df


def drop_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop a row in which every listed column that exists is null."""
    present = [c for c in columns if c in df.columns]
    return df.na.drop(how="all", subset=present) if present else df


def either_present(a: str | Column, b: str | Column) -> Column:
    return col(a).isNotNull() | col(b).isNotNull()


def both_positive(a: str | Column, b: str | Column) -> Column:
    return (col(a) > 0) & (col(b) > 0)


def on_day(c: str | Column, day: str | date | datetime) -> Column:
    """Half-open test: from the midnight of ``day`` up to the next one."""
    text = day if isinstance(day, str) else day.strftime("%Y-%m-%d")
    start = F.lit(text[:10]).cast("timestamp_ntz")
    return (col(c) >= start) & (col(c) < add_days(start))


def valid_position(lat: str | Column, lon: str | Column) -> Column:
    return col(lat).between(-90, 90) & col(lon).between(-180, 180)


def in_table(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Membership in a table of allowed values, for lists too long for ``isin``."""
    values = allowed.select(F.col(allowed.columns[0]).alias("__allowed"))
    return df.join(values, df[column] == values["__allowed"], "left_semi")


def fill_missing(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Nulls only: numbers become 0, ``TimeStamp`` text 00:00:00, other text N/A.

    Dates stay null. ``exclude`` names columns to leave alone, such as coordinates,
    for which 0 is a real place.
    """
    fills: dict[str, float | str] = {}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            fills[f.name] = 0
        elif isinstance(f.dataType, T.StringType):
            fills[f.name] = "00:00:00" if f.name == "TimeStamp" else "N/A"
    return df.na.fill(fills) if fills else df


def split_valid(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a value in ``column``."""
    return df.filter(F.col(column).isNotNull()), df.filter(F.col(column).isNull())


def iqr_outliers(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows strictly outside the quartiles of the whole column by ``factor`` ranges.

    The fences are scalar subqueries, so the filter is a plain comparison at the scan.
    """
    q = exact_quantiles(df, [], value, [0.25, 0.75])
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    low = q.select(q1 - factor * (q3 - q1)).scalar()
    high = q.select(q3 + factor * (q3 - q1)).scalar()
    return df.filter((F.col(value) < low) | (F.col(value) > high))
