from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitsignal.streaming import telemetry

RAW = "created_at_local string, metric string, value double, truck string, fleet string, speed double"


@pytest.fixture()
def raw(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00.000000", "rpm", float(m), "T-1", "F", 1.0) for h in range(4) for m in (0, 30)]
    rows += [("bad", "rpm", 1.0, "T-1", "F", 1.0), (None, "rpm", 1.0, "T-1", "F", 1.0)]
    spark.createDataFrame(rows, RAW).repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_split_is_exact_and_restartable(spark, raw, tmp_path):
    for _ in range(2):
        for q in telemetry.write_split(raw, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/state"):
            q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 8
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_closed_buckets_match_batch(spark, raw, tmp_path):
    valid, _ = telemetry.split_stream(raw)
    # A generous lateness, as the files arrive in no time order.
    buckets = telemetry.bucket_stream(valid, lateness="6 hours")
    q = buckets.writeStream.outputMode("update").format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("buckets").groupBy("timestamp").agg(F.max("n").alias("n"), F.max_by("value", "n").alias("value"))
    got = {r["timestamp"]: (r["n"], r["value"]) for r in last.collect()}
    assert got == {datetime(2024, 1, 1, h): (2, 15.0) for h in range(4)}
