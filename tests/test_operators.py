from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.operators import activity, distribution, features, filters, profile, quality, shaping

LINES = "id bigint, a double, b string, t timestamp_ntz"
T0 = datetime(2024, 1, 31, 23, 59)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "x", T0), (2, None, "x", None), (3, 3.0, None, T0), (4, None, None, None)]
    return spark.createDataFrame(rows, LINES)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_null_rules(small):
    assert ids(filters.drop_any_null(small, ["a", "b"])) == [1]
    assert ids(filters.drop_all_null(small, ["a", "b", "absent"])) == [1, 2, 3]
    assert ids(filters.drop_all_null(small, ["absent"])) == [1, 2, 3, 4]
    assert ids(small.filter(filters.either_present("a", "b"))) == [1, 2, 3]
    valid, bad = filters.split_valid(small, "t")
    assert (ids(valid), ids(bad)) == ([1, 3], [2, 4])


def test_required_columns(small):
    assert filters.require_columns(small, ["a"]) is small
    with pytest.raises(ValueError, match="zz"):
        filters.require_columns(small, ["a", "zz"])
    with pytest.raises(KeyError):
        filters.require_columns(small, ["zz"], KeyError)


def test_fill_touches_only_nulls_and_no_dates(spark, small):
    got = {r["id"]: r for r in filters.fill_missing(small.withColumn("TimeStamp", F.lit(None).cast("string"))).collect()}
    assert (got[4]["a"], got[4]["b"], got[4]["t"], got[4]["TimeStamp"]) == (0.0, "N/A", None, "00:00:00")
    assert got[1]["a"] == 1.0
    assert filters.fill_missing(small, exclude=["a"]).filter("a is null").count() == 2


def test_day_window_is_half_open(spark):
    rows = [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 1, 23, 59, 59)), (3, datetime(2024, 1, 2)), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, t timestamp_ntz")
    assert ids(df.filter(filters.on_day("t", "2024-01-01"))) == [1, 2]
    assert ids(df.filter(filters.on_day("t", datetime(2024, 1, 2, 5)))) == [3]


def test_positions_and_readings(spark):
    df = spark.createDataFrame([(1, 90.0, -180.0), (2, 90.1, 0.0), (3, None, 0.0), (4, 0.0, 0.0)], "id bigint, a double, b double")
    assert ids(df.filter(filters.valid_position("a", "b"))) == [1, 4]
    assert ids(df.filter(filters.both_positive("a", F.col("b") + 1))) == [2]


def test_outliers_are_strictly_outside(spark):
    values = [float(v) for v in [1, 2, 3, 4, 5, 8, 8.1, -2.1, -2]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    want = [i for i, v in enumerate(values) if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    assert ids(filters.iqr_outliers(df, "v")) == want
    assert filters.iqr_outliers(df.limit(0), "v").count() == 0


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, 1.0)], "a bigint, b double")
    assert quality.duplicate_rows(df).first() == (4, 2, 50.0)
    assert quality.duplicate_rows(df.limit(0)).first() == (0, 0, None)


def test_completeness_and_patterns(spark, small):
    got = {r["column"]: r["percent"] for r in quality.completeness(small).collect()}
    assert got == {"id": 100.0, "a": 50.0, "b": 50.0, "t": 50.0}
    assert quality.completeness(small, 98).count() == 3
    assert {r["column"]: r["nulls"] for r in quality.null_counts(small).collect()}["b"] == 2
    assert quality.null_patterns(small).count() == 4
    assert quality.completeness(spark.createDataFrame([(float("nan"),), (1.0,)], "a double")).first()["percent"] == 50.0


def test_constraints(spark):
    df = spark.createDataFrame([(1, "x"), (50, None)], "n bigint, s string")
    spec = {
        "n": {"type": "int64", "min": 2, "max": 50}, "s": {"type": "float64", "nullable": False}, "gone": {"min": 0},
    }
    got = {(r["column"], r["rule"]): (r["expected"], r["found"]) for r in quality.constraint_violations(df, spec).collect()}
    assert got == {
        ("n", "min"): ("2", "1"), ("s", "type"): ("double", "string"), ("s", "nullable"): ("0", "1"),
        ("gone", "missing"): ("present", "absent"),
    }
    assert quality.constraint_violations(df, {"n": {"min": 1}}).count() == 0


def test_first_equipment(spark):
    a = spark.createDataFrame([("T-2",), ("T-1",)], "Equipment string")
    assert quality.first_equipment({"x": a.limit(0), "y": a}).first()[0] == "T-1"
    assert quality.first_equipment({"x": a.select(F.lit(1).alias("z"))}).first()[0] == "N/A"


def test_summary(spark, small):
    row = quality.summary(small, "t").first()
    assert (row["rows"], row["columns"], row["days"]) == (4, 4, 1)
    assert row["types"] == "bigint:1,double:1,string:1,timestamp_ntz:1"
    assert quality.type_histogram(small)["double"] == 1


def test_describe(spark):
    values = [1.0, 2.0, 2.5, 9.0]
    df = spark.createDataFrame([(v, None) for v in values], "v double, empty double")
    got = {r["column"]: r for r in profile.describe_numeric(df, ["v", "empty"]).collect()}
    r = got["v"]
    assert (r["count"], r["min"], r["max"]) == (4, 1.0, 9.0)
    assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))
    assert r["std"] == pytest.approx(np.std(values, ddof=1))
    assert (got["empty"]["count"], got["empty"]["q50"]) == (0, None)


def test_categorical_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    got = {r["column"]: (r["count"], r["unique"], r["top"], r["freq"]) for r in profile.describe_categorical(df, ["x", "y"]).collect()}
    assert got == {"x": (4, 2, "a", 2), "y": (0, 0, None, None)}
    assert [tuple(r) for r in profile.value_counts(df, "x").collect()] == [("a", 2), ("b", 2), (None, 1)]
    assert [r["share"] for r in profile.value_shares(df, "x").collect()] == [0.5, 0.5]


def test_correlation(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) + (2024,) for r in m], "a double, b double, c double, ShiftYear int")
    got = {(r["x"], r["y"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b", "c", "ShiftYear"]).collect()}
    want = np.corrcoef(m.T)
    assert len(got) == 9
    assert got[("a", "c")] == pytest.approx(want[0, 2]) == got[("c", "a")]
    assert profile.correlation_matrix(df, ["a", "b", "c"], triangle=True).count() == 3


def test_trend_and_least(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x + 1) for x in range(5)], "x double, y double")
    row = profile.ols_trend(df, "x", "y").first()
    assert (row["slope"], row["intercept"], row["r2"]) == pytest.approx((3, 1, 1))
    routes = spark.createDataFrame([("N", 450), ("S", 280), ("E", 280)], "r string, c int")
    assert sorted(r["r"] for r in profile.smallest_rows(routes, "c").collect()) == ["E", "S"]


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 30.0, 3.0]
    df = spark.createDataFrame([("m", v) for v in values] + [("n", 1.0)], "k string, v double")
    got = {r["k"]: r for r in profile.box_stats(df, ["k"], "v").collect()}
    assert (got["m"]["whisker_low"], got["m"]["whisker_high"], got["m"]["outliers"]) == (1.0, 5.0, 1)
    assert got["m"]["median"] == np.median(values)
    assert (got["n"]["q1"], got["n"]["outliers"]) == (1.0, 0)


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.exponential(5, 300), 2)
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("c", 2.0)], "k string, v double")
    want, _ = np.histogram(values, bins=30)
    got = {r["bin"]: r["n"] for r in distribution.histogram(df, "v", 30, ["k"]).filter("k = 'k'").collect()}
    assert [got.get(i, 0) for i in range(30)] == list(want)
    assert distribution.histogram(df.filter("k = 'c'"), "v").first()["n"] == 1
    edges = np.histogram_bin_edges(values, bins="auto")
    assert distribution.auto_bin_count(df.filter("k = 'k'"), "v").first()["bins"] == len(edges) - 1


def test_density_against_formula(spark):
    values = np.array([1.0, 2.0, 2.0, 5.0])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["point"]: (r["x"], r["density"]) for r in distribution.kernel_density(df, "v").collect()}
    h = values.std(ddof=1) * len(values) ** -0.2
    for i in (0, 57, 199):
        x = 1 + i * 4 / 199
        want = np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert got[i] == pytest.approx((x, want))
    assert distribution.kernel_density(df.limit(1), "v").count() == 0
    # A far value leaves grid points that no kernel reaches; they are there with zero.
    far = spark.createDataFrame([("k", float(v % 7)) for v in range(4000)] + [("k", 1e6)], "k string, v double")
    curve = distribution.kernel_density(far, "v", ["k"])
    assert curve.count() == 200 and curve.filter("density = 0").count() > 0


def test_density_by_cells_holds_for_many_values_outliers_and_hot_values(spark):
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.normal(50, 10, 3000), "hot": np.r_[np.full(3000, 7.25), rng.gamma(2, 3, 500)],
        "far": np.r_[rng.normal(0, 1, 500), 400.0], "two": np.array([-1.0, 3.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None)], "k string, v double")
    got = {}
    for r in distribution.kernel_density(df, "v", ["k"]).collect():
        got.setdefault(r["k"], {})[r["point"]] = (r["x"], r["density"])
    for k, vs in groups.items():
        h = vs.std(ddof=1) * len(vs) ** -0.2
        x = np.linspace(vs.min(), vs.max(), 200)
        want = np.exp(-0.5 * ((x[:, None] - vs) / h) ** 2).sum(axis=1) / (len(vs) * h * np.sqrt(2 * np.pi))
        shown = np.array([got[k][i] for i in range(200)])
        np.testing.assert_allclose(shown[:, 0], x, rtol=1e-9, atol=1e-9)
        assert np.abs(shown[:, 1] - want).max() < 1e-12 and shown[:, 1].min() >= 0


def test_activity(spark):
    rows = [(datetime(2024, 1, d, h), m) for d, h, m in [(1, 0, "a"), (1, 5, "a"), (3, 5, "a"), (3, 5, "b")]]
    df = spark.createDataFrame([*rows, (None, "a")], "t timestamp_ntz, m string")
    days = activity.daily_counts(df, "t").collect()
    assert [(r["day"], r["n"], r["month_name"]) for r in days] == [(1, 2, "Enero"), (3, 2, "Enero")]
    axis = activity.month_axis(df.withColumn("day", F.dayofmonth("t")), "day")
    assert axis.count() == 31
    busiest = activity.busiest_day(axis).first()
    assert (busiest["day"], busiest["n"]) == (1, 2)
    assert busiest["mean_n"] == pytest.approx(4 / 31)
    density = {r["date"].day: (r["a"], r["b"]) for r in activity.daily_density(df, "t", "m", ["a", "b"]).collect()}
    assert density == {1: (2, 0), 3: (1, 1)}


def test_extremes_follow_label_on_ties(spark):
    df = spark.createDataFrame([(h, 1) for h in range(6)], "hour int, n int")
    got = [(r["hour"], r["kind"]) for r in activity.extremes(df, "n", "hour", 2).collect()]
    assert sorted(got) == [(0, "lowest"), (1, "lowest"), (4, "highest"), (5, "highest")]


def test_sample_is_repeatable_and_bounded(spark):
    df = spark.range(100).repartition(7)
    first = {r["id"] for r in activity.sample_rows(df, "id", 10).collect()}
    assert first == {r["id"] for r in activity.sample_rows(df.repartition(3), "id", 10).collect()}
    assert len(first) == 10 and activity.sample_rows(df, "id", 1000).count() == 100


def test_frequency(spark):
    def freq(seconds):
        df = spark.createDataFrame([(datetime.fromtimestamp(1.7e9 + s),) for s in seconds], "t timestamp_ntz")
        r = features.optimal_frequency(df, "t").first()
        return r["step_seconds"], r["frequency"], r["source"]

    assert freq([0, 30, 60, 90]) == (30, "30S", "regular")
    assert freq([0, 150, 300, 301]) == (120, "2T", "modal")
    assert freq([0, 0, 5, 10, 14]) == (5, "5S", "modal")
    assert freq([0, 0.2, 0.4, 9])[:2] == (1, "1S")


def test_bands(spark):
    def bands(values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, speed_mean double")
        return [r["speed_category"] for r in features.speed_bands(df).orderBy("id").collect()]

    assert bands([0.0, 1.0, 2.0, 3.0, 4.0, 5.0]) == ["Muy Baja", "Baja", "Media", "Alta", "Muy Alta", "Muy Alta"]
    # Four of five edges coincide, so only one inner edge is left.
    assert bands([1.0, 1.0, 1.0, 1.0, 1.0, 9.0]) == ["Muy Baja"] * 6
    assert bands([None, 1.0, 2.0])[0] is None


def test_flags_and_reduction(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 30 + [100]] + [(None,)], "v double")
    assert features.flag_outside_sigmas(df, "v", "f").agg(F.sum("f")).first()[0] == 1
    single = spark.createDataFrame([(5.0,)], "v double")
    assert features.flag_outside_sigmas(single, "v", "f").first()["f"] == 0
    assert features.reduction_factor(df, single).first()["factor"] == 32.0
    assert features.reduction_factor(df, single.limit(0)).first()["factor"] is None


def test_shaping(spark, small):
    assert shaping.insert_columns(small, 1, {"y": F.lit(1), "z": F.lit(2)}).columns == ["id", "y", "z", "a", "b", "t"]
    assert shaping.keep_allowed(small, ["b", "nope", "id"]).columns == ["b", "id"]
    assert shaping.keep_allowed(small, ["nope"]).columns == small.columns
    assert shaping.columns_of_kind(small, "number") == ["id", "a"]
    assert shaping.every_third_dropped(list("abcdefgh")) == ["a", "c", "d", "f", "g"]
    assert shaping.rename_select(small, {"a": "A"}, ["A", "id"]).columns == ["A", "id"]


def test_pairs(spark):
    df = spark.createDataFrame([(1, 1, None, None, None, 5)], "k int, a int, b int, c int, d int, e int")
    got = [tuple(r) for r in shaping.stack_pairs(df, ["k"], list("abcde")).collect()]
    assert got == [(1, 0, "1", None)]


def test_append_and_union(spark):
    df = spark.createDataFrame([(1, "x")], "a bigint, b string")
    got = shaping.append_row(df, {"a": 2, "c": "new"})
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", None), (2, None, "new")]


@pytest.mark.parametrize("parts", [1, 6])
def test_row_numbers(spark, parts):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 3).alias("g")).repartition(parts)
    got = [r["idx"] for r in shaping.number_rows(df, ["g", "v"]).orderBy("g", "v").collect()]
    assert got == list(range(500))
    assert shaping.number_rows(df.limit(0), ["v"]).count() == 0


def test_index_semantics(spark):
    df = shaping.number_rows(spark.range(6), ["id"])
    shown = shaping.align_series(df, ["tarde", "noche"], "turno").orderBy("id").collect()
    assert [r["turno"] for r in shown] == ["tarde", "noche", None, None, None, None]
    assert shaping.index_slice(df, "idx", 0, 3).count() == 3
    assert shaping.index_slice(df, "idx", 0, 4 + 1, ["id"]).count() == 5


def test_allow_list(spark):
    assert shaping.number_range_allow_list([(7, 9), (8, 11)]) == ["007", "008", "009", "010", "011"]
    assert sorted(r[0] for r in shaping.allowed_numbers(spark, [(1, 3), (2, 4)]).collect()) == [1, 2, 3, 4]


def test_nothing_divides_by_zero(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    for df in (flat, flat.limit(0), flat.limit(1)):
        assert {r["r"] for r in profile.correlation_matrix(df, ["a", "b"], triangle=True).collect()} == {None}
        profile.ols_trend(df, "a", "b").collect()
        profile.describe_numeric(df, ["a"]).collect()
        profile.describe_temporal(df.withColumn("t", F.lit(None).cast("timestamp_ntz")), "t").collect()
        quality.completeness(df).collect()
        quality.valid_ratio(df, "a").collect()
        profile.value_shares(df, "a").collect()
        distribution.auto_histogram(df, "a").collect()
        distribution.kernel_density(df, "a").collect()
        profile.box_stats(df, ["a"], "b").collect()
        activity.busiest_day(activity.month_axis(df.withColumn("d", F.lit(1)), "d")).collect()
    stamps = flat.limit(0).withColumn("t", F.lit(None).cast("timestamp_ntz"))
    assert features.optimal_frequency(stamps, "t").first()["step_seconds"] is None
