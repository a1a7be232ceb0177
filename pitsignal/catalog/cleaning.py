"""Cleaning, time-report and quality queries."""

from pyspark.sql import functions as F

from pitsignal.catalog.registry import big, dec, query, stamp
from pitsignal.catalog.views import (
    METRICS, duplicated, having, sensor, table, telemetry, telemetry_raw, time_model,
)
from pitsignal.operators import filters, profile, quality
from pitsignal.plans import reports, temporal, wide

_SENSOR_KEPT = """SELECT * FROM sensor WHERE ShiftDate IS NOT NULL AND TimeStamp IS NOT NULL
    AND NOT (Speed IS NULL AND RPM IS NULL AND FuelLevel IS NULL)"""
_MODEL_KEPT = """SELECT * FROM time_model WHERE ShiftDate IS NOT NULL AND TimeStamp IS NOT NULL
    AND Status IS NOT NULL"""
_DATE_PARTS = "year(ShiftDate) AS ShiftYear, month(ShiftDate) AS ShiftMonth, day(ShiftDate) AS ShiftDay"
_FULL = stamp("date_trunc('second', ShiftDate + (TimeStamp - date_trunc('day', TimeStamp)))", "FullDateTime")
_READINGS = ("FuelLevelLiters", "Speed", "RPM", "FuelLevel", "Latitude", "Longitude")


@query("clean_sensor", having("sensor", k=_SENSOR_KEPT)
       + f"""SELECT {stamp('ShiftDate', 'ShiftDate')}, {_DATE_PARTS}, strftime(TimeStamp, '%H:%M:%S') AS TimeStamp,
           coalesce(Equipment, 'N/A') AS Equipment,
           {', '.join(dec(f'coalesce({c}, 0)', c) for c in _READINGS)}, {_FULL},
           'sensor' AS data_type FROM k""")
def clean_sensor(spark, sf_dir):
    return wide.clean_full(sensor(spark, sf_dir), "sensor")


@query("clean_time_model", having("time_model", k=_MODEL_KEPT)
       + f"""SELECT {stamp('ShiftDate', 'ShiftDate')}, {_DATE_PARTS}, strftime(TimeStamp, '%H:%M:%S') AS TimeStamp,
           coalesce(Equipment, 'N/A') AS Equipment, Status, coalesce(Event, 'N/A') AS Event, {_FULL},
           'time_model' AS data_type FROM k""")
def clean_time_model(spark, sf_dir):
    return wide.clean_full(time_model(spark, sf_dir), "time_model")


@query("clean_sensor_plain", having("sensor", k=_SENSOR_KEPT)
       + f"""SELECT {stamp('ShiftDate', 'ShiftDate')}, {_DATE_PARTS}, strftime(TimeStamp, '%H:%M:%S') AS TimeStamp,
           Equipment, {', '.join(dec(c, c) for c in _READINGS)}, 'sensor' AS data_type FROM k""")
def clean_sensor_plain(spark, sf_dir):
    return wide.clean_plain(sensor(spark, sf_dir), "sensor")


_EITHER_SENSOR = f"""SELECT {_DATE_PARTS}, hour(TimeStamp) AS Hour, Speed, RPM, FuelLevel, FuelLevelLiters
    FROM sensor WHERE (ShiftDate IS NOT NULL OR TimeStamp IS NOT NULL)
    AND NOT (Speed IS NULL AND RPM IS NULL AND FuelLevel IS NULL)"""


@query("clean_either_date", having("sensor", k=_EITHER_SENSOR)
       + "SELECT ShiftYear, ShiftMonth, ShiftDay, Hour, "
       + ", ".join(dec(c, c) for c in ("Speed", "RPM", "FuelLevel", "FuelLevelLiters")) + " FROM k")
def clean_either_date(spark, sf_dir):
    return wide.clean_either_date(sensor(spark, sf_dir), "sensor")


@query("clean_either_date_model", having("time_model")
       + f"""SELECT {_DATE_PARTS}, hour(TimeStamp) AS Hour, Status, Event FROM time_model
           WHERE Status IS NOT NULL""")
def clean_either_date_model(spark, sf_dir):
    return wide.clean_either_date(time_model(spark, sf_dir), "time_model")


@query("strict_filter", having("sensor")
       + f"""SELECT {stamp('ShiftDate', 'ShiftDate')}, {stamp('TimeStamp', 'TimeStamp')}, Equipment,
           {', '.join(dec(c, c) for c in _READINGS)} FROM sensor
           WHERE TimeStamp IS NOT NULL AND Speed > 0 AND RPM > 0""")
def strict_filter(spark, sf_dir):
    return wide.strict_filter(sensor(spark, sf_dir), "sensor")


@query("strict_filter_model", having("time_model")
       + f"""SELECT {stamp('ShiftDate', 'ShiftDate')}, {stamp('TimeStamp', 'TimeStamp')}, Equipment, Status, Event
           FROM time_model WHERE TimeStamp IS NOT NULL AND Status IN ('active', 'idle')""")
def strict_filter_model(spark, sf_dir):
    return wide.strict_filter(time_model(spark, sf_dir), "time_model")


_PARSED = """SELECT * REPLACE (try_strptime(created_at_local, '%Y-%m-%d %H:%M:%S.%f') AS created_at_local)
    FROM telemetry_raw"""
_LOCAL = "timezone('America/Santiago', timezone('UTC', created_at_local))"


@query("temporal_clean", having("telemetry_raw", p=_PARSED)
       + f"""SELECT event_id, truck, metric, {stamp('created_at_local', 'created_at_local')},
           {dec('value', 'value')}, {dec('speed', 'speed')}, fleet, {stamp(_LOCAL, 'local_time')}
           FROM p WHERE created_at_local IS NOT NULL""")
def temporal_clean(spark, sf_dir):
    parsed = temporal.parse_times(telemetry_raw(spark, sf_dir))
    return filters.split_valid(parsed, "created_at_local")[0]


@query("quarantine", having("telemetry_raw", p=_PARSED)
       + f"""SELECT event_id, truck, metric, {dec('value', 'value')}, {dec('speed', 'speed')}, fleet
           FROM p WHERE created_at_local IS NULL""")
def quarantine(spark, sf_dir):
    parsed = temporal.parse_times(telemetry_raw(spark, sf_dir))
    bad = filters.split_valid(parsed, "created_at_local")[1]
    return bad.drop("created_at_local", "local_time")


@query("quarantine_counts", having("telemetry_raw", p=_PARSED)
       + "SELECT metric, count(*) AS n FROM p WHERE created_at_local IS NULL GROUP BY metric")
def quarantine_counts(spark, sf_dir):
    parsed = temporal.parse_times(telemetry_raw(spark, sf_dir))
    return profile.value_counts(filters.split_valid(parsed, "created_at_local")[1], "metric")


@query("valid_ratio", having("telemetry_raw", p=_PARSED)
       + f"""SELECT count(*) AS rows, count(created_at_local) AS valid,
           {dec('count(created_at_local) * 100.0 / count(*)', 'percent')} FROM p""")
def valid_ratio(spark, sf_dir):
    return quality.valid_ratio(temporal.parse_times(telemetry_raw(spark, sf_dir)), "created_at_local")


@query("metric_gaps", having("telemetry_raw", p=_PARSED,
       g="""SELECT metric, created_at_local AS t, (epoch_us(created_at_local) - epoch_us(lag(created_at_local)
            OVER (PARTITION BY metric ORDER BY created_at_local))) / 1e6 AS gap
            FROM p WHERE created_at_local IS NOT NULL""")
       + f"""SELECT metric, {stamp('min(t)', 'first')}, {stamp('max(t)', 'last')}, count(*) AS n,
           {dec('coalesce(median(gap), 0)', 'median_gap')} FROM g GROUP BY metric""")
def metric_gaps(spark, sf_dir):
    clean, _ = filters.split_valid(temporal.parse_times(telemetry_raw(spark, sf_dir)), "created_at_local")
    return temporal.metric_gaps(clean, "created_at_local")


_DENSITY = f"""SELECT CAST({_LOCAL} AS DATE) AS d, """ + ", ".join(
    f"count(*) FILTER (WHERE metric = '{m}') AS \"{m}\"" for m in METRICS
) + " FROM p WHERE created_at_local IS NOT NULL GROUP BY 1"


@query("daily_density", having("telemetry_raw", p=_PARSED, d=_DENSITY)
       + "SELECT strftime(d, '%Y-%m-%d') AS date, " + ", ".join(f'"{m}"' for m in METRICS) + " FROM d")
def daily_density(spark, sf_dir):
    return temporal.clean_temporal(telemetry_raw(spark, sf_dir), METRICS).density


def _describe_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS count, {dec(f'avg("{c}")', 'mean')},
        {dec(f'stddev_samp("{c}")', 'std')}, {dec(f'min("{c}")::DOUBLE', 'min')},
        {dec(f'quantile_cont("{c}", 0.25)', 'q25')}, {dec(f'quantile_cont("{c}", 0.5)', 'q50')},
        {dec(f'quantile_cont("{c}", 0.75)', 'q75')}, {dec(f'max("{c}")::DOUBLE', 'max')} FROM {source}"""
        for c in columns
    )


@query("daily_density_stats", having("telemetry_raw", p=_PARSED, d=_DENSITY) + _describe_sql("d", METRICS))
def daily_density_stats(spark, sf_dir):
    return temporal.clean_temporal(telemetry_raw(spark, sf_dir), METRICS).density_stats


@query("dup_rows", having("duplicated", g="SELECT count(*) AS n FROM duplicated GROUP BY ALL")
       .replace("GROUP BY ALL", "GROUP BY event_id, ts, user_id, event_type, value, props")
       + f"""SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
           {dec('sum(n - 1) * 100.0 / sum(n)', 'percent')} FROM g""")
def dup_rows(spark, sf_dir):
    return quality.duplicate_rows(duplicated(spark, sf_dir))


_SENSOR_COLUMNS = [
    "ShiftDate", "TimeStamp", "Equipment", "FuelLevelLiters", "Speed", "RPM", "FuelLevel",
    "Latitude", "Longitude",
]


@query("completeness", having("sensor") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {dec(f'round(count({c}) * 100.0 / count(*), 2)', 'percent')} FROM sensor"""
    for c in _SENSOR_COLUMNS))
def completeness(spark, sf_dir):
    return quality.completeness(sensor(spark, sf_dir))


@query("low_completeness", having("sensor", c=" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(count({c}) * 100.0 / count(*), 2) AS p FROM sensor"""
    for c in _SENSOR_COLUMNS)) + f"""SELECT "column", {dec('p', 'percent')} FROM c WHERE p < 98""")
def low_completeness(spark, sf_dir):
    return quality.completeness(sensor(spark, sf_dir), reports.LOW_COMPLETENESS)


@query("null_counts", having("sensor") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM sensor""" for c in _SENSOR_COLUMNS))
def null_counts(spark, sf_dir):
    return quality.null_counts(sensor(spark, sf_dir))


@query("null_patterns", having("sensor") + "SELECT "
       + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _SENSOR_COLUMNS)
       + " AS pattern, count(*) AS rows FROM sensor GROUP BY 1")
def null_patterns(spark, sf_dir):
    return quality.null_patterns(sensor(spark, sf_dir))


def _measure_sql(source: str, stage: str, columns: list[str]) -> str:
    nulls = " + ".join(f"(count(*) - count({c}))" for c in columns)
    keys = ", ".join(columns)
    return f"""SELECT 'sensor' AS dataset, '{stage}' AS stage, count(*) AS rows,
        CAST({len(columns)} AS BIGINT) AS columns, CAST({nulls} AS BIGINT) AS nulls,
        (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})) AS duplicates,
        strftime(min(ShiftDate), '%Y-%m-%d') || ' - ' || strftime(max(ShiftDate), '%Y-%m-%d') AS date_range
        FROM {source}"""


@query("raw_vs_clean", having("sensor", k=_SENSOR_KEPT, c=f"SELECT *, {_DATE_PARTS}, 'sensor' AS data_type FROM k",
       t="SELECT * REPLACE (strftime(TimeStamp, '%H:%M:%S') AS TimeStamp) FROM c")
       + _measure_sql("sensor", "raw", _SENSOR_COLUMNS) + " UNION ALL "
       + _measure_sql("t", "clean", [*_SENSOR_COLUMNS, "ShiftYear", "ShiftMonth", "ShiftDay", "data_type"]))
def raw_vs_clean(spark, sf_dir):
    raw = {"sensor": sensor(spark, sf_dir)}
    return quality.compare_stages(raw, wide.run_wide(raw, "plain"))


@query("dataset_summary", having("sensor")
       + f"""SELECT count(*) AS rows, {stamp('min(ShiftDate)', 'first')}, {stamp('max(ShiftDate)', 'last')},
           date_diff('day', min(ShiftDate), max(ShiftDate)) + 1 AS days, CAST(9 AS BIGINT) AS columns,
           'double:6,string:1,timestamp_ntz:2' AS types FROM sensor""")
def dataset_summary(spark, sf_dir):
    return quality.summary(sensor(spark, sf_dir), "ShiftDate")


@query("first_equipment", having("sensor") + "SELECT coalesce(min(Equipment), 'N/A') AS equipment FROM sensor")
def first_equipment(spark, sf_dir):
    return quality.first_equipment({
        "sensor": sensor(spark, sf_dir), "time_model": time_model(spark, sf_dir),
    })


# Column constraints that the line items meet in part.
LINE_SPEC = {
    "l_quantity": {"type": "float64", "nullable": False, "min": 5, "max": 40},
    "l_discount": {"type": "float64", "min": 0.0, "max": 0.05},
    "l_linenumber": {"type": "int64", "min": 1},
    "l_comment": {"type": "object"},
}


@query("constraint_violations",
       """SELECT 'l_quantity' AS "column", 'min' AS rule, '5' AS expected,
           printf('%.1f', min(l_quantity)) AS found FROM lineitem HAVING min(l_quantity) < 5
       UNION ALL SELECT 'l_quantity', 'max', '40', printf('%.1f', max(l_quantity)) FROM lineitem HAVING max(l_quantity) > 40
       UNION ALL SELECT 'l_quantity', 'nullable', '0', CAST(count(*) - count(l_quantity) AS VARCHAR)
           FROM lineitem HAVING count(*) > count(l_quantity)
       UNION ALL SELECT 'l_discount', 'min', '0.0', CAST(min(l_discount) AS VARCHAR) FROM lineitem HAVING min(l_discount) < 0
       UNION ALL SELECT 'l_discount', 'max', '0.05', CAST(max(l_discount) AS VARCHAR) FROM lineitem HAVING max(l_discount) > 0.05
       UNION ALL SELECT 'l_linenumber', 'type', 'bigint', 'int'
       UNION ALL SELECT 'l_linenumber', 'min', '1', CAST(min(l_linenumber) AS VARCHAR) FROM lineitem HAVING min(l_linenumber) < 1
       UNION ALL SELECT 'l_comment', 'missing', 'present', 'absent'""")
def constraint_violations(spark, sf_dir):
    return quality.constraint_violations(table(spark, sf_dir, "lineitem"), LINE_SPEC)


@query("either_date_rows", having("sensor")
       + "SELECT count(*) AS rows FROM sensor WHERE ShiftDate IS NOT NULL OR TimeStamp IS NOT NULL")
def either_date_rows(spark, sf_dir):
    rows = sensor(spark, sf_dir).filter(filters.either_present("ShiftDate", "TimeStamp"))
    return rows.agg(F.count(F.lit(1)).alias("rows"))


@query("fill_missing", having("sensor")
       + f"""SELECT {stamp('TimeStamp', 'TimeStamp')}, {dec('coalesce(Speed, 0)', 'Speed')},
           {dec('RPM', 'RPM')}, coalesce(Equipment, 'N/A') AS Equipment FROM sensor""")
def fill_missing(spark, sf_dir):
    rows = sensor(spark, sf_dir).select("TimeStamp", "Speed", "RPM", "Equipment")
    return filters.fill_missing(rows, exclude=["RPM"])


@query("text_time_forms", having("telemetry_raw", p=_PARSED)
       + f"""SELECT event_id, {stamp('created_at_local', 'fixed')}, {stamp('created_at_local', 'iso')},
           {big('created_at_local IS NULL', 'missing')} FROM p""")
def text_time_forms(spark, sf_dir):
    from pitsignal.functions.times import parse_fixed, parse_iso

    c = "created_at_local"
    return telemetry_raw(spark, sf_dir).select(
        "event_id", parse_fixed(c).alias("fixed"), parse_iso(c).alias("iso"),
        parse_fixed(c).isNull().cast("int").alias("missing"),
    )


@query("coerced_numbers", having("telemetry")
       + f"""SELECT event_id, {dec("try_cast(CASE WHEN speed < 50 THEN CAST(value AS VARCHAR) ELSE metric END AS DOUBLE)", 'number')}
           FROM telemetry""")
def coerced_numbers(spark, sf_dir):
    from pitsignal.functions.maths import to_number

    mixed = F.when(F.col("speed") < 50, F.col("value").cast("string")).otherwise(F.col("metric"))
    return telemetry(spark, sf_dir).select("event_id", to_number(mixed).alias("number"))
