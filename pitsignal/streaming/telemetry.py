"""The batch cleaning and bucketing on a stream of telemetry.

Parsing and splitting are the batch functions. Buckets differ in one point: an exact
percentile needs all rows of a bucket, so a stream keeps the statistics that can be
updated row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitsignal.layouts import SITE_ZONE
from pitsignal.operators.filters import split_valid
from pitsignal.plans.temporal import parse_times


def split_stream(
    raw: DataFrame, ts: str = "created_at_local", zone: str = SITE_ZONE
) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid time, and the others."""
    valid, bad = split_valid(parse_times(raw, ts, zone), ts)
    return valid, bad.drop("local_time")


def bucket_stream(
    df: DataFrame, ts: str = "created_at_local", step: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Value and speed statistics per truck, metric and bucket, once a bucket is closed."""
    event_time = F.col(ts).cast("timestamp")
    timed = df.withColumn("__time", event_time).withWatermark("__time", lateness)
    grouped = timed.groupBy("truck", "metric", F.window("__time", step).alias("w"))
    return grouped.agg(
        F.avg("value").alias("value"), F.max("value").alias("value_max"),
        F.avg("speed").alias("speed_mean"), F.stddev_samp("speed").alias("speed_std"),
        F.max("speed").alias("speed_max"), F.count(F.lit(1)).alias("n"),
    ).select(
        "truck", "metric", F.col("w.start").cast("timestamp_ntz").alias("timestamp"),
        "value", "value_max", "speed_mean", "speed_std", "speed_max", "n",
    )


def write_split(
    raw: DataFrame, valid_path: str, quarantine_path: str, state_path: str,
    ts: str = "created_at_local", once: bool = True,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Valid rows to parquet and the others to a quarantine table, each exactly once."""
    valid, bad = split_stream(raw, ts)

    def start(df: DataFrame, path: str, name: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
        writer = writer.option("checkpointLocation", f"{state_path.rstrip('/')}/{name}")
        return (writer.trigger(availableNow=True) if once else writer).start()

    return start(valid, valid_path, "valid"), start(bad, quarantine_path, "quarantine")
