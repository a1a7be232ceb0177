"""Exploratory reports: the tables behind each chart and printed section."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.times import parse_iso, year_month
from pitsignal.operators import activity, distribution, filters, profile, quality
from pitsignal.operators.shaping import columns_of_kind

LOW_COMPLETENESS = 98.0
PERFORMANCE = ["Speed", "RPM", "FuelLevel"]


def truck_report(
    tables: Mapping[str, DataFrame],
    truck: str | None = None,
    key: str | None = None,
    scatter_rows: int | None = None,
    map_rows: int | None = None,
) -> dict[str, DataFrame]:
    """Summary, quality, activity, distributions, positions and correlations of a truck.

    The scatter and map tables have all rows, or a sample of the given number. A sample goes by the
    digest of ``key``, a column that identifies sensor rows, or else of all columns.
    """
    if truck is not None:
        tables = {
            n: t.filter(F.col("Equipment") == truck) if "Equipment" in t.columns else t
            for n, t in tables.items()
        }
    out: dict[str, DataFrame] = {}
    for name, t in tables.items():
        out[f"{name}.summary"] = quality.summary(t, "ShiftDate")
        out[f"{name}.duplicates"] = quality.duplicate_rows(t)
        out[f"{name}.completeness"] = quality.completeness(t)
        out[f"{name}.incomplete"] = quality.completeness(t, LOW_COMPLETENESS)
        out[f"{name}.null_patterns"] = quality.null_patterns(t)
    sensor = tables.get("sensor")
    if sensor is None:
        return out
    if "ShiftDate" in sensor.columns:
        out["daily_activity"] = activity.daily_counts(sensor, "ShiftDate")
    if "TimeStamp" in sensor.columns:
        timed = dict(sensor.dtypes)["TimeStamp"].startswith("timestamp")
        hour = F.hour("TimeStamp") if timed else F.substring("TimeStamp", 1, 2).try_cast("int")
        hour = F.coalesce(hour, F.lit(0))
        out["hourly_activity"] = sensor.groupBy(hour.alias("hour")).agg(
            F.count(F.lit(1)).alias("n")
        )
    measured = [c for c in PERFORMANCE if c in sensor.columns]
    if measured:
        out["performance.describe"] = profile.describe_numeric(sensor, measured)
    for c in measured:
        out[f"performance.{c}.histogram"] = distribution.auto_histogram(sensor, c)
        out[f"performance.{c}.density"] = distribution.kernel_density(sensor, c)
    if {"RPM", "Speed"} <= set(sensor.columns):
        shown = [*([key] if key else []), *[c for c in measured if c != key]]
        out["scatter"] = _sampled(sensor, key, shown, scatter_rows)
    if {"Latitude", "Longitude"} <= set(sensor.columns):
        placed = sensor.filter(filters.valid_position("Latitude", "Longitude"))
        out["positions"] = placed.agg(F.count(F.lit(1)).alias("rows"))
        shown = list(dict.fromkeys(c for c in (key, "Latitude", "Longitude", "Speed") if c in sensor.columns))
        out["map"] = _sampled(placed, key, shown, map_rows)
    numeric = columns_of_kind(sensor, "number")
    if len([c for c in numeric if not c.startswith("Shift")]) >= 2:
        out["correlation"] = profile.correlation_matrix(sensor, numeric, triangle=True)
    return out


def _sampled(df: DataFrame, key: str | None, columns: list[str], rows: int | None) -> DataFrame:
    if rows is None:
        return df.select(*columns)
    return activity.sample_rows(df, key or df.columns, rows).select(*columns)


def telemetry_report(
    df: DataFrame, ts: str = "created_at_local", value: str = "value"
) -> dict[str, DataFrame]:
    """Descriptions, time density, distributions, correlations and outliers."""
    if not dict(df.dtypes)[ts].startswith("timestamp"):
        raise TypeError(f"{ts} is not a timestamp column")
    numeric, text = columns_of_kind(df, "number"), columns_of_kind(df, "text")
    outliers = filters.iqr_outliers(df, value)
    out = {
        "numeric": profile.describe_numeric(df, numeric),
        "temporal": profile.describe_temporal(df, ts),
        "categorical": profile.describe_categorical(df, text),
        "density": distribution.time_density(df, ts, ["metric"]),
        "trend": profile.median_series(df, [ts, "metric"], value),
        "histogram": distribution.histogram(df, value, 30, ["metric"]),
        "kernel_density": distribution.kernel_density(df, value, ["metric"]),
        "boxes": profile.box_stats(df, ["metric", "fleet"], value),
        "outliers": outliers,
        "outliers_by_metric": profile.value_counts(outliers, "metric"),
        "outlier_share": outlier_share(df, outliers),
    }
    if len(numeric) >= 2:
        out["correlation"] = profile.correlation_matrix(df, numeric, exclude=())
    return out


def outlier_share(df: DataFrame, outliers: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return outliers.agg(F.count(F.lit(1)).alias("outliers")).withColumn(
        "percent", F.try_divide(F.col("outliers") * F.lit(100.0), total)
    )


def dated(df: DataFrame, ts: str = "created_at_local") -> DataFrame:
    """Rows with a valid time, with ``year_month`` and ``day``."""
    time = F.col(ts) if dict(df.dtypes)[ts].startswith("timestamp") else parse_iso(ts)
    valid = df.withColumn(ts, time).filter(F.col(ts).isNotNull())
    return valid.withColumns({"year_month": year_month(ts), "day": F.dayofmonth(ts)})


def month_view(
    df: DataFrame, month: str, metric: str, ts: str = "created_at_local"
) -> dict[str, DataFrame]:
    """One metric in one month: records per day 1..31, mean, busiest day, and the choices."""
    prepared = dated(df, ts)
    chosen = prepared.filter((F.col("year_month") == month) & (F.col("metric") == metric))
    axis = activity.month_axis(chosen, "day")
    return {
        "months": profile.distinct_values(prepared, "year_month"),
        "metrics": profile.distinct_values(prepared, "metric"),
        "axis": axis,
        "busiest": activity.busiest_day(axis),
    }


def comparison(
    raw: Mapping[str, DataFrame], clean: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Raw against cleaned measures and the truck they belong to."""
    return {
        "measures": quality.compare_stages(raw, clean),
        "equipment": quality.first_equipment({
            **{f"clean.{k}": v for k, v in clean.items()},
            **{f"raw.{k}": v for k, v in raw.items()},
        }),
    }

