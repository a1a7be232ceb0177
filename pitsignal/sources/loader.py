"""Loading the datasets of a truck, and dispatch by source type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.layouts import LAYOUTS, TRAINING_LAYOUTS, text_schema
from pitsignal.plans.wide import parse_dates
from pitsignal.sources import columnar, delimited, files, objects, workbook

UNREADABLE = "path string, reason string"


@dataclass(frozen=True)
class Loaded:
    datasets: dict[str, DataFrame]
    unreadable: DataFrame


def _as_layout(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of a self-describing file as text: by name when all fit, else by position."""
    source = list(columns) if set(columns) <= set(df.columns) else df.columns
    taken = {c: F.col(f"`{s}`").cast("string") for c, s in zip(columns, source, strict=False)}
    return df.select(*[taken.get(c, F.lit(None).cast("string")).alias(c) for c in columns])


def combine(tables: Sequence[DataFrame], columns: Sequence[str], spark: SparkSession, ordered: bool) -> DataFrame:
    """All tables of one kind, by time with nulls last where there is a time."""
    out = files.union_all(tables)
    if out is None:
        return files.empty_table(spark, text_schema(list(columns)))
    return out.orderBy(F.asc_nulls_last("TimeStamp")) if ordered and "TimeStamp" in columns else out


def load_kind(
    spark: SparkSession,
    pattern: str,
    columns: Sequence[str],
    skip_header: bool = True,
    drop_long_rows: bool = False,
    ordered: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Every tabular file of a pattern that ends in ``.*``, and the ones not readable."""
    listed = files.list_files(spark, pattern)
    good, bad = files.split_supported(listed)
    problems = bad.select("path", F.lit("unsupported extension").alias("reason")).unionByName(
        files.empty_files(spark, pattern).select("path", F.lit("empty file").alias("reason"))
    ).unionByName(
        good.filter(files.extension_of("path") == ".xls")
        .select("path", F.lit("legacy workbook").alias("reason"))
    )
    present = {
        r["e"] for r in good.filter("length > 0").select(files.extension_of("path").alias("e"))
        .distinct().collect()
    }
    if not present:
        return files.empty_table(spark, text_schema(list(columns))), problems
    stem = pattern.removesuffix(".*")
    tables: list[DataFrame] = []
    text = [f"{stem}{e}" for e in (".csv", ".tsv") if e in present]
    if text:
        tables.append(delimited.read_delimited(spark, text, columns, skip_header, drop_long_rows))
    if ".parquet" in present:
        tables.append(_as_layout(columnar.read_parquet(spark, f"{stem}.parquet"), columns))
    if ".feather" in present:
        tables.append(_as_layout(columnar.read_arrow(spark, f"{stem}.feather"), columns))
    if ".xlsx" in present:
        rows = workbook.landed_rows(spark, f"{stem}.xlsx", first_sheet=True)
        tables.append(workbook.positional_table(rows, columns, int(skip_header)))
        problems = problems.unionByName(workbook.workbook_errors(rows))
    return combine(tables, columns, spark, ordered), problems


def load_datasets(
    spark: SparkSession,
    base: str,
    dataset: str,
    truck: str,
    layouts: Mapping[str, Sequence[str]] = LAYOUTS,
    skip_header: bool = True,
    drop_long_rows: bool = False,
    ordered: bool = True,
) -> Loaded:
    """Text tables of every data kind of a truck; a kind without files is empty."""
    files.require_truck(spark, base, dataset, truck)
    datasets, problems = {}, []
    for kind, columns in layouts.items():
        pattern = files.file_pattern(base, dataset, kind, truck)
        datasets[kind], bad = load_kind(spark, pattern, columns, skip_header, drop_long_rows, ordered)
        problems.append(bad)
    unreadable = files.union_all(problems)
    return Loaded(datasets, files.empty_table(spark, UNREADABLE) if unreadable is None else unreadable)


def load_training(
    spark: SparkSession, base: str, truck: str, layouts: Mapping[str, Sequence[str]] = TRAINING_LAYOUTS
) -> dict[str, DataFrame]:
    """The older layouts: comma files without header, long rows dropped, times parsed."""
    if files.list_files(spark, files.training_pattern(base, "*", truck)).isEmpty():
        raise ValueError(f"no files for truck {truck}")
    out = {}
    for kind, columns in layouts.items():
        table = delimited.read_delimited(
            spark, files.training_pattern(base, kind, truck), columns,
            skip_header=False, drop_long_rows=True,
        )
        dated = parse_dates(table)
        out[kind] = dated.orderBy(F.asc_nulls_last("TimeStamp")) if "TimeStamp" in columns else dated
    return out


def load_objects(
    spark: SparkSession, base: str, dataset: str, truck: str, kinds: Sequence[str] = tuple(LAYOUTS)
) -> dict[str, DataFrame]:
    """Merged JSON entries per data kind; a kind without files is empty."""
    return {
        kind: objects.merge_objects(
            objects.read_objects(spark, files.file_pattern(base, dataset, kind, truck, "json"))
        )
        for kind in kinds
    }


def read_source(spark: SparkSession, source_type: str, **options) -> DataFrame:
    """One table by source type: ``csv``, ``json``, ``parquet`` or ``database``."""
    if source_type == "csv":
        return delimited.read_delimited(spark, options.pop("path"), options.pop("columns"), **options)
    if source_type == "json":
        return objects.merge_objects(objects.read_objects(spark, options["path"]))
    if source_type == "parquet":
        return columnar.read_parquet(spark, options["path"])
    if source_type == "database":
        return spark.read.jdbc(**options)
    raise ValueError(f"unsupported source type {source_type!r}")
