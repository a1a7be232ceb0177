"""Writing results: tables with header, quarantined rows, report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from pitsignal.operators.filters import split_valid


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Comma-separated files with header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode(mode).option("header", True).csv(path)
    return True


def write_quarantine(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> bool:
    """The rows without a value in ``column``."""
    return write_csv(split_valid(df, column)[1], path, mode)


def copy_csv(spark: SparkSession, source: str, target: str) -> bool:
    """The same table in a new place, header kept."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the source is never overwritten")
    return write_csv(spark.read.option("header", True).csv(source), target)


def write_restructured(df: DataFrame, source: str, target: str, mode: str = "errorifexists") -> None:
    """A restructured workbook as parquet, in a place of its own."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the source is never overwritten")
    df.write.mode(mode).parquet(target)


def write_report(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> list[str]:
    """One parquet table per report section; returns the paths."""
    paths = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(path)
        paths.append(path)
    return paths
