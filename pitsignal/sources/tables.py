"""Tables that are not read from raw files: literals, ranges, random columns, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators.filters import require_columns


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def literal_series(spark: SparkSession, values, index: Sequence | None = None) -> DataFrame:
    """An indexed one-column table; the index is 0, 1, ... unless given."""
    if isinstance(values, dict):
        index, values = list(values), list(values.values())
    index = list(range(len(values))) if index is None else list(index)
    return spark.createDataFrame(list(zip(index, values, strict=True)), ["idx", "value"])


def date_range(ends: DataFrame, start: str, stop: str, name: str = "date") -> DataFrame:
    """All dates from ``start`` to ``stop`` of a one-row table."""
    return ends.select(F.explode(F.sequence(start, stop, F.make_dt_interval(F.lit(1)))).alias(name))


def dates_from(spark: SparkSession, start: str, periods: int, name: str = "date") -> DataFrame:
    return spark.range(periods).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias(name)
    )


def random_normal(rows: DataFrame, columns: Sequence[str], seed: int) -> DataFrame:
    """Standard normal columns beside each row."""
    return rows.withColumns({c: F.randn(seed + i) for i, c in enumerate(columns)})


def fleet_telemetry(
    df: DataFrame,
    truck: str | None = None,
    metrics: Sequence[str] = (),
    years: Sequence[int] = (),
    ts: str = "created_at_local",
) -> DataFrame:
    """Long telemetry of a truck, some metrics and some years.

    Years become ranges on the time itself, which a scan can use to skip row groups.
    """
    require_columns(df, [ts, "metric", "value"], KeyError)
    if truck is not None:
        df = df.filter(F.col("truck") == truck.upper())
    if metrics:
        df = df.filter(F.col("metric").isin(list(metrics)))
    if years:
        in_year = F.lit(False)
        for y in sorted({int(y) for y in years}):
            low, high = (F.lit(f"{n}-01-01").cast("timestamp_ntz") for n in (y, y + 1))
            in_year = in_year | ((F.col(ts) >= low) & (F.col(ts) < high))
        df = df.filter(in_year)
    return df
