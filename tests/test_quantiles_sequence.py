import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.operators.quantiles import bounded_quantiles, exact_quantiles
from pitsignal.operators.sequence import (
    by_range, by_unit, distinct_times, gap_counts, order_violations, row_gaps, stitched_lag,
    trailing_mean,
)

PROBS = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot key with many equal values, one spread, one single row, one null key."""
    rnd = random.Random(3)
    rows = [("hot", 7.0 if i % 3 else rnd.gauss(0, 50)) for i in range(900)]
    rows += [("wide", rnd.expovariate(1e-6)) for _ in range(120)]
    rows += [("one", 4.5), (None, 1.0), (None, 2.0), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5), rows


def wanted(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return {k: np.quantile(vs, PROBS) for k, vs in groups.items()}


@pytest.mark.parametrize("few", [False, True])
def test_quantiles_per_key(spark, skewed, few):
    df, rows = skewed
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "v", PROBS, few=few).collect()}
    want = wanted(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(list(want[k]))


def test_quantiles_of_all_rows_and_weighted(spark, skewed):
    df, rows = skewed
    want = np.quantile([v for _, v in rows if v is not None], PROBS)
    assert exact_quantiles(df, [], "v", PROBS).first()["quantiles"] == pytest.approx(list(want))
    counted = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    weighted = exact_quantiles(counted, [], "v", PROBS, weight="n")
    assert weighted.first()["quantiles"] == pytest.approx(list(want))


def test_built_in_route_agrees(spark, skewed):
    df, rows = skewed
    got = {r["k"]: r["quantiles"] for r in bounded_quantiles(df, ["k"], "v", PROBS).collect()}
    assert got == {k: pytest.approx(list(v)) for k, v in wanted(rows).items()}


def test_quantiles_of_hot_values_and_wide_ranges(spark):
    for values in ([5.0] * 3000, [1e300, -1e300, 0.0, 1e-300, -1e-300] * 40, [2.0**k for k in range(-500, 500)], [0.1] * 999 + [0.2]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
        got = exact_quantiles(df, [], "v", PROBS).first()["quantiles"]
        ranked = sorted(values)
        for p, q in zip(PROBS, got, strict=True):
            low = int(np.floor(p * (len(values) - 1)))
            assert ranked[low] <= q <= ranked[min(low + 1, len(values) - 1)]


def test_no_job_runs_before_the_result_is_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    exact_quantiles(df, ["k"], "v", PROBS)
    exact_quantiles(df, [], "v", PROBS)
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_table(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(none, ["k"], "v", [0.5]).collect() == []


START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def moments(spark):
    rnd = random.Random(5)
    rows, t = [], {"a": START, "b": START}
    for i in range(400):
        k = "a" if rnd.random() < 0.8 else "b"
        t[k] += timedelta(seconds=rnd.choice([0, 1, 30, 4000, 200_000]))
        rows.append((k, i, t[k], float(rnd.randrange(100))))
    rows.append((None, 400, START, 1.0))
    return spark.createDataFrame(rows, "k string, i bigint, t timestamp_ntz, v double").repartition(4), rows


@pytest.mark.parametrize("units", [["day"], ["hour", "day"], ["second", "minute", "hour", "day"]])
def test_stitched_lag(spark, moments, units):
    df, rows = moments
    times = distinct_times(df, ["k"], "t")
    got = {(r["k"], r["time"]): r["previous"] for r in
           stitched_lag(times, ["k"], "time", "time", [by_unit(u) for u in units]).collect()}
    for k in ("a", "b", None):
        stamps = sorted({r[2] for r in rows if r[0] == k})
        for before, now in zip([None, *stamps], stamps):
            assert got[(k, now)] == before


def test_gap_counts(spark, moments):
    df, rows = moments
    got = {(r["k"], r["gap"]): r["n"] for r in gap_counts(df, ["k"], "t").collect()}
    want = {}
    for k in ("a", "b"):
        stamps = sorted(r[2] for r in rows if r[0] == k)
        for x, y in zip(stamps, stamps[1:]):
            gap = (y - x).total_seconds()
            want[(k, gap)] = want.get((k, gap), 0) + 1
    assert got == want


def test_order_violations_and_row_gaps(spark):
    rows = [("a", 1, 10), ("a", 2, 5), ("a", 3, 5), ("b", 4, 1), ("a", 9, 4), ("b", 12, 2)]
    df = spark.createDataFrame([(k, i, START + timedelta(seconds=s)) for k, i, s in rows],
                               "k string, i bigint, t timestamp_ntz")
    for width in (2, 1000):
        got = {r["k"]: (r["rows"], r["violations"]) for r in order_violations(df, ["k"], "i", "t", width).collect()}
        assert got == {"a": (4, 2), "b": (2, 0)}
        gaps = {r["i"]: r["gap_seconds"] for r in row_gaps(df, ["k"], "i", "t", width).collect()}
        assert gaps == {1: None, 2: -5.0, 3: 0.0, 4: None, 9: -1.0, 12: 1.0}
    assert by_range(10)(F.lit(25)) is not None


@pytest.mark.parametrize("unit", [None, "hour", "day", "month"])
def test_trailing_mean(spark, unit):
    rnd = random.Random(1)
    stamps = sorted(rnd.sample(range(0, 400_000), 150))
    rows = [("a" if i % 4 else "b", START + timedelta(seconds=s), float(i)) for i, s in enumerate(stamps)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    got = {(r["k"], r["t"]): r["m"] for r in trailing_mean(df, ["k"], "t", "v", "m", 5, unit).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b"):
        series = [(t, v) for kk, t, v in rows if kk == k]
        for i, (t, _) in enumerate(series):
            assert got[(k, t)] == pytest.approx(np.mean([v for _, v in series[max(0, i - 4):i + 1]]))


@pytest.mark.parametrize("unit", [None, "day"])
def test_trailing_mean_of_one_hot_day_with_repeated_times(spark, unit):
    rnd = random.Random(5)
    # One day holds all rows of one key; a time stands on some 40 rows, and some rows are equal.
    rows = [("a", START + timedelta(minutes=rnd.randrange(10)), i, float(rnd.randrange(100))) for i in range(400)]
    rows += [("b", None, 1000, 3.0), ("b", START, 1001, None), ("b", START, 1002, 5.0), *rows[:3]]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i long, v double")
    want = []
    for key in ("a", "b"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or START, r[2]))
        for n, (_, _, i, _) in enumerate(own):
            seen = [v for *_, v in own[max(0, n - 4):n + 1] if v is not None]
            want.append((key, i, round(sum(seen) / len(seen), 9) if seen else None))
    for parts in (1, 7):
        dealt = df.repartition(parts, "i")
        got = trailing_mean(dealt, ["k"], "t", "v", "m", 5, unit, ties=["i"], block_rows=16)
        assert got.columns == ["k", "t", "i", "v", "m"]
        found = [(r["k"], r["i"], None if r["m"] is None else round(r["m"], 9)) for r in got.collect()]
        assert sorted(found, key=str) == sorted(want, key=str)


def test_trailing_mean_without_ties_is_fixed_by_the_rows(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("t"), (F.col("id") * 7 % 50).cast("double").alias("v"))
    runs = [
        sorted(map(tuple, trailing_mean(df.repartition(n), [], "t", "v", "m", 4, block_rows=10).collect()))
        for n in (1, 5)
    ]
    assert len(runs[0]) == 300 and runs[0] == runs[1]
    assert trailing_mean(df.limit(0), [], "t", "v", "m").count() == 0
