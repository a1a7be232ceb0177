"""Cleaning and time report of long telemetry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.times import parse_fixed, to_site_time
from pitsignal.layouts import SITE_ZONE
from pitsignal.operators.activity import daily_density
from pitsignal.operators.filters import require_columns, split_valid
from pitsignal.operators.keyed import join_keys
from pitsignal.operators.profile import describe_numeric, value_counts
from pitsignal.operators.quality import valid_ratio
from pitsignal.operators.quantiles import exact_quantiles
from pitsignal.operators.sequence import gap_counts
from pitsignal.session import land


def parse_times(raw: DataFrame, ts: str = "created_at_local", zone: str = SITE_ZONE) -> DataFrame:
    """Text times to UTC plus the local clock; times that do not parse are null."""
    parsed = parse_fixed(ts) if dict(raw.dtypes)[ts] == "string" else F.col(ts)
    return raw.withColumn(ts, parsed).withColumn("local_time", to_site_time(ts, zone))


def metric_gaps(df: DataFrame, ts: str, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """First and last time, rows, and median gap in seconds per metric; 0 for one row.

    The medians are taken over the counts of distinct gaps, however many a metric has.
    """
    keys = list(keys)
    spans = df.filter(F.col(ts).isNotNull()).groupBy(*keys).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")
    )
    # Read by each pass of the selection, so the gaps are worked out once.
    gaps = land(gap_counts(df, keys, ts), "gaps")
    medians = exact_quantiles(gaps, keys, "gap", [0.5], "n").select(
        *keys, F.col("quantiles")[0].alias("__gap")
    )
    return join_keys(spans, medians, keys, "left").withColumn(
        "median_gap", F.coalesce("__gap", F.lit(0.0))
    ).drop("__gap")


class TemporalReport:
    """Telemetry split by valid time, and descriptions of the valid part.

    Each part is made when it is asked for. Density is counted per local date.
    """

    def __init__(self, raw: DataFrame, metrics: Sequence[str], ts: str, zone: str) -> None:
        self._raw, self._metrics, self._ts = raw, list(metrics), ts
        self._parsed = parse_times(raw, ts, zone)
        self.clean, bad = split_valid(self._parsed, ts)
        self.quarantine = bad.drop("local_time")

    @cached_property
    def quarantine_counts(self) -> DataFrame:
        return value_counts(self.quarantine, "metric")

    @cached_property
    def ratio(self) -> DataFrame:
        return valid_ratio(self._parsed, self._ts)

    @cached_property
    def metric_stats(self) -> DataFrame:
        return metric_gaps(self.clean, self._ts)

    @cached_property
    def density(self) -> DataFrame:
        return daily_density(self.clean, "local_time", "metric", self._metrics)

    @cached_property
    def density_stats(self) -> DataFrame:
        return describe_numeric(self.density, self._metrics)


def clean_temporal(
    raw: DataFrame, metrics: Sequence[str], ts: str = "created_at_local", zone: str = SITE_ZONE
) -> TemporalReport:
    require_columns(raw, [ts, "metric", "value"], KeyError)
    return TemporalReport(raw, metrics, ts, zone)
