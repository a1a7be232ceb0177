from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pitsignal.layouts import CYCLE_COLUMNS, CYCLE_OLD_COLUMNS, SENSOR_COLUMNS, text_schema
from pitsignal.plans import features, fuel, reports, temporal, wide

SENSOR = "ShiftDate timestamp_ntz, TimeStamp timestamp_ntz, Equipment string, Speed double, RPM double, FuelLevel double"
D = datetime(2024, 5, 6)


@pytest.fixture(scope="module")
def sensor(spark):
    rows = [
        (D, datetime(2024, 5, 7, 1, 2, 3, 9), "T-1", 5.0, None, None),
        (D, None, "T-1", 5.0, 1.0, 1.0),
        (None, datetime(2024, 5, 7), "T-1", 5.0, 1.0, 1.0),
        (D, datetime(2024, 5, 7), None, None, None, None),
        (D, datetime(2024, 5, 7), None, 0.0, 2.0, None),
        (None, None, "T-2", 1.0, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, SENSOR)


def test_full_clean(sensor):
    out = wide.clean_full(sensor, "sensor")
    assert out.columns[:5] == ["ShiftDate", "ShiftYear", "ShiftMonth", "ShiftDay", "TimeStamp"]
    assert out.columns[-2:] == ["FullDateTime", "data_type"]
    first, second = out.orderBy(F.desc("Speed")).collect()
    assert first["TimeStamp"] == "01:02:03" and first["FullDateTime"] == datetime(2024, 5, 6, 1, 2, 3)
    assert (first["RPM"], first["FuelLevel"], second["Equipment"]) == (0.0, 0.0, "N/A")
    assert wide.clean_full(sensor, "sensor", ["RPM"]).filter("RPM is null").count() == 1


def test_plain_and_either_date(sensor):
    plain = wide.clean_plain(sensor, "sensor")
    assert plain.count() == 2 and "FullDateTime" not in plain.columns
    either = wide.clean_either_date(sensor, "sensor")
    assert either.columns == ["ShiftYear", "ShiftMonth", "ShiftDay", "Hour", "Speed", "RPM", "FuelLevel"]
    assert either.count() == 4
    assert wide.strict_filter(sensor, "sensor").count() == 1


def test_cycle_layout_without_time_is_refused(spark):
    cycle = spark.createDataFrame([], text_schema(CYCLE_COLUMNS))
    with pytest.raises(ValueError, match="TimeStamp"):
        wide.clean_full(cycle, "cycle")
    assert wide.clean_either_date(cycle, "cycle").columns[:44] == CYCLE_COLUMNS
    assert (len(SENSOR_COLUMNS), len(CYCLE_COLUMNS), len(CYCLE_OLD_COLUMNS)) == (15, 44, 36)
    with pytest.raises(TypeError):
        wide.run_wide([cycle])


def test_time_model(spark):
    rows = [(D, D, "active"), (D, D, None), (D, D, "down")]
    df = spark.createDataFrame(rows, "ShiftDate timestamp_ntz, TimeStamp timestamp_ntz, Status string")
    assert wide.clean_full(df, "time_model").count() == 2
    assert [r["Status"] for r in wide.strict_filter(df, "time_model").collect()] == ["active"]
    assert wide.column_issues({"time_model": df.drop("Status")}) == {"time_model": ["Status"]}


def test_typed_turns_bad_text_to_null(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z", "7.5", "T-1"), ("??", "x", "T-2")], "TimeStamp string, Speed string, Equipment string")
    good, bad = wide.typed(df, SENSOR_COLUMNS).orderBy("Equipment").collect()
    assert (good["TimeStamp"], good["Speed"]) == (datetime(2024, 1, 2, 3, 4, 5), 7.5)
    assert (bad["TimeStamp"], bad["Speed"]) == (None, None)


RAW = "created_at_local string, metric string, value double, truck string, fleet string, speed double"


def test_temporal_report(spark):
    stamps = ["2024-01-01 00:00:00.000000", "2024-01-01 00:00:10.000000", "2024-01-01 00:00:40.0", "2024-01-01 12:00:00", "bad", None]
    df = spark.createDataFrame([(s, "rpm", 1.0, "T-1", "F", 2.0) for s in stamps] + [(stamps[0], "fuel", 2.0, "T-1", "F", 1.0)], RAW)
    out = temporal.clean_temporal(df, ["fuel", "rpm"])
    assert out.clean.count() == 4 and out.quarantine.count() == 3
    assert [tuple(r) for r in out.quarantine_counts.collect()] == [("rpm", 3)]
    assert out.ratio.first()["valid"] == 4
    stats = {r["metric"]: (r["n"], r["median_gap"]) for r in out.metric_stats.collect()}
    assert stats == {"rpm": (3, 20.0), "fuel": (1, 0.0)}
    # Midnight UTC is the evening before at the site.
    assert [(r["date"], r["fuel"], r["rpm"]) for r in out.density.collect()] == [(date(2023, 12, 31), 1, 3)]
    assert {r["column"] for r in out.density_stats.collect()} == {"fuel", "rpm"}
    with pytest.raises(KeyError):
        temporal.clean_temporal(df.drop("value"), ["rpm"])


def test_feature_report(spark):
    rows = [
        (datetime(2024, 1, 1, h, m), "rpm", float(h * 60 + m), "T-1", "F", float(m))
        for h in range(3) for m in range(0, 60, 15)
    ]
    df = spark.createDataFrame(rows, RAW.replace("created_at_local string", "created_at_local timestamp_ntz"))
    out = features.feature_report(df, ["rpm"], step_seconds=3600)
    got = out.features.orderBy("timestamp").collect()
    assert out.features.columns == features.COLUMNS
    assert [r["value"] for r in got] == [22.5, 82.5, 142.5]
    assert [r["value_rolling"] for r in got] == [22.5, 52.5, 82.5]
    assert got[0]["value_p95"] == pytest.approx(42.75)
    assert out.reduction.first()["factor"] == 4.0
    assert sorted(r["hour"] for r in out.hour_profile.collect()) == [21, 22, 23]
    assert sum(r["share"] for r in out.band_shares.collect()) == 1.0
    # Evenly spaced input picks its own spacing.
    assert features.feature_table(df).count() == 12


def test_truck_report(spark, sensor):
    typed = sensor.withColumns({"Latitude": F.lit(10.0), "Longitude": F.lit(200.0)})
    out = reports.truck_report({"sensor": wide.clean_full(typed, "sensor")})
    assert out["sensor.summary"].first()["rows"] == 2
    assert out["positions"].first()["rows"] == 0
    assert {r["hour"]: r["n"] for r in out["hourly_activity"].collect()} == {0: 1, 1: 1}
    assert {r["x"] for r in out["correlation"].collect()} & {"ShiftYear"} == set()
    assert out["scatter"].count() == 2
    for df in out.values():
        df.collect()
    assert "daily_activity" not in reports.truck_report({"time_model": sensor})


def test_report_hours_and_samples(spark):
    df = spark.range(5000).select(
        F.lit("T-1").alias("Equipment"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("TimeStamp"),
        (F.col("id") % 5).cast("double").alias("RPM"), F.col("id").cast("double").alias("Speed"),
        F.lit(1.0).alias("Latitude"), F.lit(2.0).alias("Longitude"),
    )
    out = reports.truck_report({"sensor": df}, scatter_rows=500, map_rows=100)
    assert {r["hour"] for r in out["hourly_activity"].collect()} == set(range(24))
    got = out["scatter"].collect()
    assert len(got) == 500 and {r["RPM"] for r in got} == {0.0, 1.0, 2.0, 3.0, 4.0}
    assert out["map"].count() == 100
    assert reports.truck_report({"sensor": df})["scatter"].count() == 5000


def test_shared_folder_is_demanded_on_a_cluster(spark):
    from pitsignal import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_hot_value_spans_partitions(spark):
    from pitsignal.operators.shaping import number_rows

    df = spark.range(4000).select(F.lit(1).alias("k"), "id").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = number_rows(df, ["k"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r["idx"] for r in placed.collect()) == list(range(4000))


def test_telemetry_report_needs_a_time(spark):
    df = spark.createDataFrame([("x", "rpm", 1.0, "T-1", "F", 2.0)], RAW)
    with pytest.raises(TypeError):
        reports.telemetry_report(df)


def test_comparison(sensor):
    out = reports.comparison({"sensor": sensor}, {"sensor": wide.clean_plain(sensor, "sensor")})
    got = {r["stage"]: r for r in out["measures"].collect()}
    assert (got["raw"]["rows"], got["clean"]["rows"]) == (6, 2)
    assert got["clean"]["date_range"] == "2024-05-06 - 2024-05-06"
    assert out["equipment"].first()[0] == "T-1"


def test_month_view_parses_text(spark):
    df = spark.createDataFrame([("2024-01-03 10:00:00", "rpm"), ("2024-02-01", "rpm"), ("x", "rpm")], "created_at_local string, metric string")
    out = reports.month_view(df, "2024-01", "rpm")
    assert [r[0] for r in out["months"].collect()] == ["2024-01", "2024-02"]
    assert out["busiest"].first()["day"] == 3


def test_dispatch(spark):
    rows = [
        ("CAM 210", " cat - 789c ", "3/2/2024 10:00:00", 5.5), ("CAM 226", "CAT - 789C", "3/2/2024", 1.0),
        ("CAM 21", "CAT - 789C", "3/2/2024", 1.0), ("243x", "CAT - 793D", "13/13/2024", 1.0),
        ("243", "CAT - 793D", "31/12/2024", None), ("230", "OTHER", "3/2/2024", 1.0), (None, "CAT - 793D", "3/2/2024", 1.0),
    ]
    df = spark.createDataFrame(rows, "Veh string, Descripcion string, fin_desp string, volumCorregido double")
    out = fuel.dispatch_readings(df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == [(date(2024, 12, 31), "00:00:00", "T-243", None), (date(2024, 2, 3), "10:00:00", "T-210", 5.5)] or got == [
        (date(2024, 2, 3), "10:00:00", "T-210", 5.5), (date(2024, 12, 31), "00:00:00", "T-243", None)]
    checks = fuel.fuel_checks(out)
    assert [r[0] for r in checks["equipment"].collect()] == ["T-210", "T-243"]
    assert checks["fuel"].first()["count"] == 1
    assert fuel.dispatch_readings(df.limit(0)).count() == 0


def sheet(spark, table, name="s"):
    rows = [("f", 0, name, i, [None if v == "" else v for v in values]) for i, values in enumerate(table, 1)]
    return spark.createDataFrame(rows, "file string, sheet_no int, sheet string, row int, values array<string>")


def test_sheet_readings(spark):
    table = [
        ["", "title"],
        ["", "", "EQUIPO CAEX 5/2/2024"],
        ["", "", "N", "x CODIGO EQ. y", "RECEPCION", "LITROS"],
        ["", "", "1", " 210 ", "r", "100.5"],
        ["", "", "2", "99", "r", "1"],
        ["", "", "3", "211", "r", "1.2.3"],
        ["", "", "4", "212", "r"],
        ["", "", "5", "2x3", "r", "5"],
        ["", "", "6", "243", "r", "7."],
    ]
    got = sorted(map(tuple, fuel.sheet_readings(sheet(spark, table)).collect()), key=str)
    assert got == [(date(2024, 2, 5), "00:00:00", "T-210", 100.5), (date(2024, 2, 5), "00:00:00", "T-243", 7.0)]


@pytest.mark.parametrize("table", [
    [["EQUIPO CAEX 5/2/2024"], ["", "", "", "", "", "", "CODIGO EQ."], ["", "", "", "", "", "", "210", "", "1"]],
    [["EQUIPO CAEX 35/2/2024"], ["CODIGO EQ."], ["210", "", "1"]],
    [["x"], ["x"], ["x"], ["EQUIPO CAEX 5/2/2024"], ["CODIGO EQ."], ["210", "", "1"]],
])
def test_sheet_without_usable_head(spark, table):
    assert fuel.sheet_readings(sheet(spark, table)).count() == 0


def test_restructure(spark):
    df = sheet(spark, [[f"r1c{c}" for c in range(1, 8)], ["r2c1", "", "", "", "gone"], [], ["", "gone"]])
    dropped = fuel.drop_third_columns(df)
    assert [r["values"] for r in dropped.orderBy("row").collect()] == [
        ["r1c1", "r1c3", "r1c4", "r1c6", "r1c7"], ["r2c1", None, None], [], [None]]
    got = sorted((r["pair"], r["row"], r["first"], r["second"]) for r in fuel.stack_value_pairs(dropped).collect())
    assert got == [(0, 1, "r1c1", "r1c3"), (0, 2, "r2c1", None), (1, 1, "r1c4", "r1c6")]
    # The pair exists for a short row when another row of the sheet reaches its second column.
    short = fuel.stack_value_pairs(sheet(spark, [["a", "b", "c"], ["a", "b", "c", "d"]]))
    assert short.filter("pair = 1").count() == 2


def test_overlay(spark, sensor):
    cleaned = wide.clean_full(sensor, "sensor").withColumn("FuelLevelLiters", F.lit(3))
    readings = spark.createDataFrame([
        (date(2024, 5, 6), "10:00:00", "T-1", 8.0), (date(2024, 5, 6), "bad", "T-1", 1.0), (date(2024, 5, 7), "00:00:00", "T-1", 1.0),
    ], "ShiftDate date, TimeStamp string, Equipment string, FuelLevelLiters double")
    got = {r["source"]: (r["time"], r["liters"]) for r in fuel.fuel_overlay(cleaned, readings, "T-1", "2024-05-06").collect()}
    assert got == {"sensor": (datetime(2024, 5, 6, 1, 2, 3), 3.0), "validation": (datetime(2024, 5, 6, 10), 8.0)}
