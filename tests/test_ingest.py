"""Streams that tell late and repeated rows, find drift, and hold bad batches back."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitsignal.streaming import ingest

SCHEMA = "truck string, id long, ts timestamp_ntz, value double"
ZERO = datetime(2024, 1, 1)


def feed(spark, folder, batches):
    """A file per batch, named in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run_to(df, path, state):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)


@pytest.mark.parametrize("salts", [1, 4])
def test_late_and_repeated_rows_are_kept_aside(spark, tmp_path, salts):
    def row(truck, i, minutes):
        return truck, i, ZERO + timedelta(minutes=minutes), 1.0

    first = [row("a", 1, 0), row("a", 2, 5), row("a", 2, 5), row("b", 1, 0)]
    second = [row("a", 1, 0), row("a", 3, 30), ("a", 4, None, 1.0), row("a", None, 31)]
    third = [row("a", 5, 1), row("a", 6, 25), row("b", 9, 1), row("a", 3, 30)]
    source = f"{tmp_path}/in"
    for batches in ([first], [second], [third]):  # one run each: the state is read back from the store
        feed(spark, source, batches) if batches == [first] else spark.createDataFrame(batches[0], SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/more")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
        run_to(ingest.sorted_rows(stream, ["truck"], "ts", "id", 600, salts), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 12
    counts = {(r.truck, r.id, r.status): r["count"] for r in got.groupBy("truck", "id", "status").count().collect()}
    assert counts["a", 2, "on time"] == counts["a", 2, "repeated"] == 1 and counts["a", 3, "repeated"] == 1
    assert counts["a", 4, "late"] == counts["a", None, "late"] == 1 and counts["b", 9, "on time"] == 1
    if salts == 1:
        # Batch two repeats id 1 within the span; batch three has minute 1, long before minute 30.
        assert counts["a", 1, "repeated"] == 1 and counts["a", 5, "late"] == 1 and counts["a", 6, "on time"] == 1


def plain_drift(values, delta=0.002):
    window, out = ingest.AdaptiveWindow(delta), []
    for i, v in enumerate(values):
        if window.add(v) is not None:
            out.append(i)
    return out


def test_drift_of_a_replayed_stream_equals_one_pass(spark, tmp_path):
    draw = random.Random(4)
    series = {"a": [draw.gauss(0 if i < 300 else 3, 1) for i in range(600)], "b": [draw.gauss(5, 1) for _ in range(600)]}
    rows = [(k, i, ZERO + timedelta(seconds=i), v) for k, values in series.items() for i, v in enumerate(values)]
    source = f"{tmp_path}/in"
    for part in range(3):
        some = [r for r in rows if r[1] // 200 == part]
        spark.createDataFrame(draw.sample(some, len(some)), SCHEMA).coalesce(1).write.parquet(f"{source}/{part}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
        run_to(ingest.drift_points(stream, ["truck"], "ts", "id", "value"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").select("truck", "id").collect()
    want = [(k, i) for k, values in series.items() for i in plain_drift(values)]
    assert sorted((r.truck, r.id) for r in got) == sorted(want)
    first = min(i for k, i in want if k == "a")
    assert 300 <= first < 340 and not [w for w in want if w[0] == "b"]


def test_adaptive_window_keeps_few_buckets_and_exact_sums():
    draw = random.Random(9)
    window, values = ingest.AdaptiveWindow(), [draw.gauss(0, 1) for _ in range(5000)]
    for v in values:
        window.add(v)
    held = values[-int(sum(window.n)):]
    mean = sum(held) / len(held)
    assert len(window.n) < 70 and sum(window.total) == pytest.approx(sum(held))
    between = sum(n * (t / n - mean) ** 2 for n, t in zip(window.n, window.total, strict=True))
    assert sum(window.spread) + between == pytest.approx(sum((v - mean) ** 2 for v in held))


RAW = "created_at_local string, metric string, value double"


def test_gate_holds_back_and_commits_once(spark, tmp_path):
    good = [("2024-01-01 00:00:00.000000", "m", 1.0)] * 18
    bad = [("bad", "m", 1.0)]
    run = ingest.gate(f"{tmp_path}/out", most_invalid=0.2)
    fine = spark.createDataFrame(good + bad * 2, RAW)
    worse = spark.createDataFrame(good + bad * 10, RAW)
    for number, batch in ((0, fine), (1, worse), (0, fine), (1, worse), (2, fine.limit(0))):
        run(batch, number)
    count = {k: spark.read.parquet(f"{tmp_path}/out/{k}").count() for k in ("valid", "invalid", "held")}
    assert count == {"valid": 18, "invalid": 2, "held": 28}
    reports = spark.read.parquet(f"{tmp_path}/out/reports").orderBy("batch").collect()
    assert [(r.batch, r.rows, r.invalid, r.held) for r in reports] == [(0, 20, 2, False), (1, 28, 10, True), (2, 0, 0, False)]


def test_batch_that_failed_half_way_is_written_anew(spark, tmp_path):
    batch = spark.createDataFrame([("2024-01-01 00:00:00.000000", "m", 1.0)] * 5, RAW)
    batch.write.parquet(f"{tmp_path}/out/valid/batch=0")  # as left by a run that ended before its report
    ingest.gate(f"{tmp_path}/out")(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/out/valid").count() == 5


def test_stream_through_the_gate_is_restartable(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:00:00.000000", "m", float(h)) for h in range(10)] + [("bad", "m", 0.0)]
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        raw = spark.readStream.schema(RAW).parquet(f"{tmp_path}/in")
        ingest.write_gated(raw, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    total = spark.read.parquet(f"{tmp_path}/out/valid").count() + spark.read.parquet(f"{tmp_path}/out/invalid").count()
    assert total == 11 and spark.read.parquet(f"{tmp_path}/out/reports").select(F.sum("rows")).first()[0] == 11
