"""Time-bucketed features of long telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.times import bucket_start, to_site_time
from pitsignal.layouts import SPEED_BANDS
from pitsignal.operators.quantiles import exact_quantiles
from pitsignal.operators.sequence import gap_counts, trailing_mean

DAY_SECONDS = 86_400
SERIES = ("truck", "metric")


def optimal_frequency(df: DataFrame, ts: str) -> DataFrame:
    """Bucket length of a table: ``step_seconds``, its label and how it was found.

    When all times are evenly spaced that spacing is taken, else the most frequent gap
    between consecutive times (least on a tie, zero left out). Below a minute the step is in
    whole seconds, at least one, above in whole minutes.
    """
    known = F.when(F.col("gap") > 0, F.col("gap"))
    found = gap_counts(df, [], ts).agg(
        F.count_distinct("gap").alias("kinds"), F.sum("n").alias("gaps"), F.min("gap").alias("least"),
        F.min_by(known, F.when(F.col("gap") > 0, F.struct((-F.col("n")).alias("n"), "gap"))).alias("mode"),
    )
    regular = (F.col("kinds") == 1) & (F.col("gaps") >= 2) & (F.col("least") > 0)
    picked = found.select(
        F.when(regular, F.col("least")).otherwise(F.col("mode")).alias("gap"),
        F.when(F.coalesce(regular, F.lit(False)), "regular").otherwise("modal").alias("source"),
    )
    whole = F.when(F.col("gap") < 60, F.greatest(F.floor("gap"), F.lit(1))).otherwise(
        F.floor(F.col("gap") / 60) * 60
    )
    # Labels of second and minute steps.
    label = F.when(whole < 60, F.concat(whole.cast("string"), F.lit("S"))).otherwise(
        F.concat((whole / 60).cast("bigint").cast("string"), F.lit("T"))
    )
    return picked.select(
        whole.cast("bigint").alias("step_seconds"), label.alias("frequency"), "source"
    )


def bucket_features(df: DataFrame, ts: str, step_seconds: int, zone: str | None = None) -> DataFrame:
    """Value and speed statistics per truck, metric and time bucket.

    Buckets are of UTC, or of the wall clock of ``zone``; the hour that a clock change repeats is then one.
    """
    time = F.col(ts) if zone is None else to_site_time(ts, zone)
    origin = None
    if DAY_SECONDS % step_seconds:
        origin = df.agg(F.date_trunc("day", F.min(time)).cast("timestamp_ntz")).scalar()
    rows = df.filter(F.col(ts).isNotNull()).select(
        *SERIES, bucket_start(time, step_seconds, origin).alias("timestamp"),
        "value", "speed", "fleet", F.col(ts).alias("__at"),
    )
    # A group is one series in one bucket, so its values fit in a task.
    return rows.groupBy(*SERIES, "timestamp").agg(
        F.avg("value").alias("value"), F.max("value").alias("value_max"),
        F.avg("speed").alias("speed_mean"), F.stddev_samp("speed").alias("speed_std"),
        F.max("speed").alias("speed_max"),
        F.min_by("fleet", F.struct("__at", "fleet")).alias("fleet"),
        F.percentile("value", F.lit(0.95)).alias("value_p95"),
    )


def flag_outside_sigmas(df: DataFrame, column: str, out: str, sigmas: float = 3.0) -> DataFrame:
    """1 where a value lies strictly outside mean ± sigmas deviations, else 0."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    high = stats.select(F.col("m") + sigmas * F.col("s")).scalar()
    low = stats.select(F.col("m") - sigmas * F.col("s")).scalar()
    outside = (F.col(column) > high) | (F.col(column) < low)
    return df.withColumn(out, F.coalesce(outside, F.lit(False)).cast("int"))


def band_edges(df: DataFrame, column: str, bands: int = 5) -> DataFrame:
    """One row ``edges``: the inner quantile edges, nearly equal neighbours collapsed."""
    probs = [i / bands for i in range(bands + 1)]
    q = exact_quantiles(df, [], column, probs)
    edges = F.col("quantiles")
    positions = F.sequence(F.lit(0), F.lit(bands))
    apart = F.filter(
        positions,
        lambda i: (i == 0) | (F.get(edges, i) - F.get(edges, i - 1) > F.lit(1e-8)),
    )
    kept = F.transform(apart, lambda i: F.get(edges, i))
    inner = F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 2, F.lit(0)))
    return q.select(inner.alias("edges"))


def speed_bands(
    df: DataFrame,
    column: str = "speed_mean",
    out: str = "speed_category",
    labels: Sequence[str] = SPEED_BANDS,
) -> DataFrame:
    """Label of the quantile band of a column, left-closed; null stays null."""
    edges = band_edges(df, column, len(labels)).scalar()
    passed = [
        F.coalesce((F.get(edges, F.lit(i)) <= F.col(column)).cast("int"), F.lit(0))
        for i in range(len(labels) - 1)
    ]
    band = sum(passed, F.lit(0))
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(
        out, F.when(F.col(column).isNotNull(), F.element_at(names, band + 1))
    )


def rolling_value(df: DataFrame, rows: int = 5, step_seconds: int = DAY_SECONDS) -> DataFrame:
    """Trailing mean of ``value`` per truck and metric over the bucket table.

    A series has one row per bucket at most; it is cut into years, months or days, of some thousand
    buckets at most for steps of a minute and more.
    """
    unit = "day" if step_seconds < 600 else "month" if step_seconds < DAY_SECONDS else "year"
    return trailing_mean(df, list(SERIES), "timestamp", "value", "value_rolling", rows, unit)


def reduction_factor(raw: DataFrame, reduced: DataFrame) -> DataFrame:
    """Rows before and after an aggregation and their ratio."""
    after = reduced.agg(F.count(F.lit(1)).alias("rows_out")).scalar()
    return raw.agg(F.count(F.lit(1)).alias("rows_in")).withColumn("rows_out", after).withColumn(
        "factor", F.try_divide(F.col("rows_in"), F.col("rows_out"))
    )
