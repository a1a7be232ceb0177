"""The feature dataset: buckets, bands, trend and anomaly flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.layouts import SITE_ZONE
from pitsignal.operators import features as f
from pitsignal.operators.activity import hour_metric_crosstab
from pitsignal.operators.profile import value_shares

COLUMNS = [
    "truck", "metric", "timestamp", "value", "value_max", "value_p95", "speed_mean",
    "speed_std", "speed_max", "fleet", "speed_category", "value_rolling", "speed_anomaly",
]


@dataclass(frozen=True)
class FeatureReport:
    features: DataFrame
    reduction: DataFrame
    hour_profile: DataFrame
    band_shares: DataFrame


def feature_table(
    df: DataFrame,
    ts: str = "created_at_local",
    step_seconds: int | None = None,
    bands: bool = True,
    zone: str | None = None,
) -> DataFrame:
    """Feature rows per truck, metric and bucket, of UTC or of the wall clock of ``zone``.

    The bucket table feeds the edges, the global statistics and the result; it is far
    smaller than its input and is persisted so that the input is read once.
    """
    if step_seconds is None:
        step_seconds = f.optimal_frequency(df, ts).first()["step_seconds"] or 1
    buckets = f.bucket_features(df, ts, step_seconds, zone).persist(StorageLevel.MEMORY_AND_DISK)
    out = f.speed_bands(buckets) if bands else buckets
    out = f.rolling_value(out, step_seconds=step_seconds)
    out = f.flag_outside_sigmas(out, "speed_mean", "speed_anomaly")
    return out.select(*[c for c in COLUMNS if c in out.columns])


def feature_report(
    df: DataFrame,
    metrics: Sequence[str],
    ts: str = "created_at_local",
    step_seconds: int | None = None,
    zone: str = SITE_ZONE,
) -> FeatureReport:
    table = feature_table(df, ts, step_seconds, zone=zone)
    return FeatureReport(
        features=table,
        reduction=f.reduction_factor(df.filter(F.col(ts).isNotNull()), table),
        hour_profile=hour_metric_crosstab(table, "timestamp", "metric", "value", metrics),
        band_shares=value_shares(table, "speed_category"),
    )
