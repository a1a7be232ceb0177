"""Cleaning of the wide datasets (sensor, time_model, cycle)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.functions.maths import to_number
from pitsignal.functions.times import parse_iso, replace_clock, time_of_day
from pitsignal.layouts import KEPT_COLUMNS, REQUIRED_COLUMNS, WORKING_STATUSES, is_time_column, typed_schema
from pitsignal.operators import filters
from pitsignal.operators.quality import schema_issues
from pitsignal.operators.shaping import insert_columns, keep_allowed, tag

READINGS = ["Speed", "RPM", "FuelLevel"]


def typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of a layout to their types; text that does not parse becomes null."""
    schema = {f.name: f.dataType for f in typed_schema(list(columns)).fields}

    def convert(name: str):
        wanted = schema.get(name)
        if isinstance(wanted, T.TimestampNTZType):
            return parse_iso(name)
        if isinstance(wanted, T.DoubleType):
            return to_number(name)
        return F.col(name)

    is_text = {n for n, t in df.dtypes if t == "string"}
    return df.select(*[
        (convert(c) if c in is_text else F.col(c)).alias(c) for c in df.columns
    ])


def parse_dates(df: DataFrame) -> DataFrame:
    """Only the time columns of a text table to timestamps."""
    text = {n for n, t in df.dtypes if t == "string"}
    return df.withColumns({c: parse_iso(c) for c in df.columns if c in text and is_time_column(c)})


def _drop_unusable(df: DataFrame, kind: str) -> DataFrame:
    if kind == "sensor":
        return filters.drop_all_null(df, READINGS)
    if kind == "time_model":
        return filters.drop_any_null(df, ["Status"])
    return df


def _dated(df: DataFrame) -> DataFrame:
    """Year, month and day of the shift date right behind it."""
    day = F.col("ShiftDate")
    return insert_columns(df, 1, {
        "ShiftYear": F.year(day), "ShiftMonth": F.month(day), "ShiftDay": F.dayofmonth(day),
    })


def clean_full(df: DataFrame, kind: str, exclude_fill: Sequence[str] = ()) -> DataFrame:
    """Rows with both times, typed and dated, nulls filled, tagged with their dataset."""
    filters.require_columns(df, ["ShiftDate", "TimeStamp"])
    kept = _drop_unusable(filters.drop_any_null(df, ["ShiftDate", "TimeStamp"]), kind)
    timed = kept.withColumn("FullDateTime", replace_clock("ShiftDate", "TimeStamp"))
    dated = _dated(timed).withColumn("TimeStamp", time_of_day("TimeStamp"))
    return tag(filters.fill_missing(dated, exclude_fill), "data_type", kind)


def clean_plain(df: DataFrame, kind: str) -> DataFrame:
    """The same without a combined time and without filling."""
    filters.require_columns(df, ["ShiftDate", "TimeStamp"])
    kept = _drop_unusable(filters.drop_any_null(df, ["ShiftDate", "TimeStamp"]), kind)
    return tag(_dated(kept).withColumn("TimeStamp", time_of_day("TimeStamp")), "data_type", kind)


def clean_either_date(df: DataFrame, kind: str) -> DataFrame:
    """Rows with at least one time, numbers coerced, columns cut to the allow-list."""
    if {"ShiftDate", "TimeStamp"} <= set(df.columns):
        df = df.filter(filters.either_present("ShiftDate", "TimeStamp"))
    df = _drop_unusable(df, kind)
    if kind == "sensor":
        df = df.withColumns({c: to_number(c) for c in ("Speed", "RPM") if c in df.columns})
    parts = {}
    if "ShiftDate" in df.columns:
        day = F.col("ShiftDate")
        parts.update(ShiftYear=F.year(day), ShiftMonth=F.month(day), ShiftDay=F.dayofmonth(day))
    if "TimeStamp" in df.columns:
        parts["Hour"] = F.hour("TimeStamp")
    return keep_allowed(df.withColumns(parts) if parts else df, KEPT_COLUMNS.get(kind, []))


def strict_filter(df: DataFrame, kind: str, statuses: Sequence[str] = tuple(WORKING_STATUSES)) -> DataFrame:
    """Rows with a time and, by dataset, positive readings or a working status."""
    if "TimeStamp" in df.columns:
        df = filters.drop_any_null(df, ["TimeStamp"])
    if kind == "sensor":
        return df.filter(filters.both_positive("Speed", "RPM"))
    if kind == "time_model":
        return df.filter(F.col("Status").isin(list(statuses)))
    return df


_VARIANTS = {"full": clean_full, "plain": clean_plain, "either_date": clean_either_date}


def run_wide(tables: Mapping[str, DataFrame], variant: str = "full") -> dict[str, DataFrame]:
    """One cleaning variant over a bundle of datasets."""
    if not isinstance(tables, Mapping):
        raise TypeError("expected a mapping of dataset name to DataFrame")
    return {kind: _VARIANTS[variant](df, kind) for kind, df in tables.items()}


def column_issues(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    return schema_issues(tables, REQUIRED_COLUMNS)
