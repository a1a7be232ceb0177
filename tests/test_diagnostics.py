"""Regression diagnostics, drift, interval joins, and quantiles of awkward columns, against plain versions."""

import math
import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.functions.maths import from_ordered_bits, ordered_bits
from pitsignal.operators import drift, intervals, regression
from pitsignal.operators.quantiles import exact_quantiles


def frame(spark, columns):
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values(), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)


# -- regression ---------------------------------------------------------------------------------------


def test_variance_inflation(spark):
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=400) + 1e6, draw.normal(size=400)
    c = a * 0.5 + b * 0.2 + draw.normal(size=400) * 0.1
    df = frame(spark, {"a": a, "b": b, "c": c, "d": a + b, "k": np.full(400, 3.0)})
    got = {r.column: r for r in regression.variance_inflation(df, ["a", "b", "c", "d", "k"]).collect()}
    assert [got[n].status for n in "abcdk"].count("collinear") == 1 and got["k"].status == "constant"
    kept = [n for n in "abcd" if got[n].status == "ok"]
    values = {"a": a, "b": b, "c": c, "d": a + b}
    inverse = np.linalg.inv(np.corrcoef([values[n] for n in kept]))
    for i, n in enumerate(kept):
        assert got[n].vif == pytest.approx(inverse[i, i], rel=1e-6) and got[n].n == 400


def test_variance_inflation_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, float("nan"))], "a double, b double")
    assert [(r.n, r.status) for r in regression.variance_inflation(df, ["a", "b"]).collect()] == [(0, "constant")] * 2
    one = regression.variance_inflation(df, ["a"]).collect()
    assert [(r.column, r.n, round(r.vif, 9), r.status) for r in one] == [("a", 2, 1.0, "ok")]
    none = regression.variance_inflation(df, ["b"]).collect()
    assert [(r.column, r.n, r.status) for r in none] == [("b", 0, "constant")]


def test_fit_errors(spark):
    draw = np.random.default_rng(2)
    x, z = draw.normal(size=(2, 500))
    near = x + 1e-7 * draw.normal(size=500)
    y = 3 + 2 * x - z + near + draw.normal(size=500) * 0.1
    df = frame(spark, {"x": x, "z": z, "near": near, "twice": 2 * x + 1, "y": y})
    design = np.column_stack([np.ones(500), x, z, near])
    want, *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ want
    got = regression.fit_errors(df, "y", ["x", "z", "near"]).first()
    # Two columns agree to seven digits: the sum of their slopes is certain, each of them only to about 1e-3.
    assert got.coefficients[0] == pytest.approx(want[0], rel=1e-9) and got.coefficients[2] == pytest.approx(want[2], rel=1e-9)
    assert got.coefficients[1] == pytest.approx(want[1], rel=1e-4) and got.coefficients[1] + got.coefficients[3] == pytest.approx(want[1] + want[3], rel=1e-9)
    assert got.mae == pytest.approx(np.abs(rest).mean(), rel=1e-9) and got.rmse == pytest.approx(math.sqrt((rest**2).mean()), rel=1e-9)
    assert got.r2 == pytest.approx(1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    aliased = regression.least_squares(df, "y", ["x", "twice", "z"]).first()
    assert list(aliased.used) == [True, True, False, True] and aliased.coefficients[2] == 0
    assert regression.least_squares(df.filter("x is null"), "y", ["x"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_durbin_watson_in_any_partitioning(spark, parts):
    draw = random.Random(3)
    rows = [(k, i // 3, i, draw.gauss(0, 1)) for k, n in (("hot", 500), ("b", 2), (None, 40), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "key string, ts int, id int, e double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r.key: (r.n, r.durbin_watson) for r in regression.durbin_watson(df, ["key"], ["ts", "id"], "e").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    for key, (n, value) in got.items():
        e = np.array([r[3] for r in rows if r[0] == key])
        assert n == len(e) and value == pytest.approx(float((np.diff(e) ** 2).sum() / (e**2).sum()), rel=1e-9)
    assert len(got) == 4


def test_trend_residuals_sum_to_nothing(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + (i % 3)) for i in range(30)] + [("b", 1.0, 5.0)], "key string, x double, y double")
    got = regression.trend_residuals(df, ["key"], "x", "y").groupBy("key").agg(F.sum("residual").alias("s"), F.count("residual").alias("n"))
    assert {r.key: (r.n, r.s and round(abs(r.s), 9)) for r in got.collect()} == {"a": (30, 0.0), "b": (0, None)}


# -- intervals ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [60, 3600])
def test_overlaps_against_all_pairs(spark, cell):
    draw, zero = random.Random(cell), datetime(2024, 1, 1)

    def some(n):
        out = []
        for i in range(n):
            start = draw.choice([0, 60, 3600]) * draw.randrange(6) + draw.choice([0, 0, draw.randrange(4000)])
            out.append((draw.choice(["x", "x", "y", None]), i, zero + timedelta(seconds=start), zero + timedelta(seconds=start + draw.choice([-5, 0, 1, 60, 3600, 9000]))))
        return out

    left, right = some(80), [*some(70), ("x", 70, zero, None)]
    schema = "truck string, id int, start timestamp_ntz, end timestamp_ntz"
    pairs = intervals.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["truck"], cell_seconds=cell)
    got = sorted((r.a, r.b) for r in pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect())
    want = [(a[1], b[1]) for a in left for b in right if a[0] and a[0] == b[0] and b[3] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]]
    assert got == sorted(want) and len(got) > 50


# -- drift --------------------------------------------------------------------------------------------


def test_kl_drift(spark):
    draw = np.random.default_rng(5)
    rows = [("m", p, float(v)) for p in (0, 1, 2, 4) for v in draw.normal(p, 1, 200)] + [("k", 0, 1.0), ("k", 1, 1.0), ("k", 1, None), ("k", 2, 2.0)]
    df = spark.createDataFrame(rows, "metric string, week int, v double")
    got = {(r.metric, r.week): r for r in drift.kl_drift(df, ["metric"], "week", "v", cells=10).collect()}
    assert sorted(got) == [("k", 1), ("k", 2), ("m", 1), ("m", 2)]
    old, new = ([r[2] for r in rows if r[:2] == ("m", p)] for p in (1, 2))
    edges = np.linspace(min(old), max(old), 11)

    def shares(values):
        counts = [sum(v < edges[0] for v in values), *np.histogram(values, edges)[0], sum(v > edges[-1] for v in values)]
        return (np.array(counts) + 0.5) / (len(values) + 6)

    p, q = shares(new), shares(old)
    assert got["m", 2].kl == pytest.approx(float((p * np.log(p / q)).sum())) and got["m", 2].rows == 200
    assert got["k", 1].kl == pytest.approx(0) and got["k", 2].kl > 0


# -- quantiles ----------------------------------------------------------------------------------------


def test_ordered_bits(spark):
    draw = random.Random(6)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 2.0, 0.1, -0.1, 1e18, 1.7976931348623157e308, float("inf"), float("-inf")]
    values += [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    values += [v for v in (struct.unpack("d", draw.randbytes(8))[0] for _ in range(3000)) if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", ordered_bits("v")).withColumn("back", from_ordered_bits("k"))
    rows = df.collect()
    assert all(r.v == r.back for r in rows)
    by_value = sorted(rows, key=lambda r: r.v)
    assert all(a.k < b.k or a.v == b.v for a, b in zip(by_value, by_value[1:], strict=False))
    assert spark.createDataFrame([(float("nan"),)], "v double").select(from_ordered_bits(ordered_bits("v")).alias("b")).first().b != 0


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_of_far_outliers_and_a_hot_group(spark, few):
    draw = random.Random(7)
    rows = [("hot", draw.uniform(0, 100)) for _ in range(4000)] + [("hot", 1e18), ("hot", float("inf")), ("hot", -1e300), ("hot", None)]
    rows += [("cold", float(draw.randrange(5))) for _ in range(30)] + [("one", 3.5)] + [(None, float(i)) for i in range(-10, 11)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(6)
    got = {r.key: r.quantiles for r in exact_quantiles(df, ["key"], "v", [0.0, 0.25, 0.5, 0.9], few=few).collect()}
    for key in ("hot", "cold", "one", None):
        own = np.array([v for k, v in rows if k == key and v is not None])
        assert got[key] == pytest.approx(np.quantile(own, [0.0, 0.25, 0.5, 0.9]).tolist())
    assert exact_quantiles(df.filter("v is null"), [], "v", [0.5]).count() == 0
