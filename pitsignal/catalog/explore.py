"""Activity, description, distribution and trend queries."""

from pyspark.sql import functions as F

from pitsignal.catalog.registry import big, dec, query, stamp
from pitsignal.catalog.views import (
    having, keyed_sensor, sensor, table, telemetry,
)
from pitsignal.functions.times import to_site_time
from pitsignal.layouts import MONTHS_ES
from pitsignal.operators import activity, distribution, filters, profile
from pitsignal.plans import reports

TS = "created_at_local"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTHS_ES) + "]"


def _days_sql(source: str, time: str, where: str = "true") -> str:
    return f"""SELECT year({time}) AS year, month({time}) AS month, day({time}) AS day,
        count(*) AS n FROM {source} WHERE {where} GROUP BY ALL"""


@query("daily_counts", having("sensor", d=_days_sql("sensor", "ShiftDate"))
       + f"SELECT year, month, day, n, {_MONTHS}[month] AS month_name FROM d")
def daily_counts(spark, sf_dir):
    return activity.daily_counts(sensor(spark, sf_dir), "ShiftDate")


_LOCAL = "timezone('America/Santiago', timezone('UTC', created_at_local))"


@query("daily_counts_local", having("telemetry", d=_days_sql("telemetry", _LOCAL, "metric = 'view'"))
       + f"SELECT year, month, day, n, {_MONTHS}[month] AS month_name FROM d")
def daily_counts_local(spark, sf_dir):
    rows = telemetry(spark, sf_dir).filter(F.col("metric") == "view")
    return activity.daily_counts(rows, to_site_time(TS))


@query("mean_daily_count", having("telemetry", d="""SELECT metric, count(*) AS n FROM telemetry
       GROUP BY metric, CAST(created_at_local AS DATE)""")
       + f"SELECT metric, {dec('avg(n)', 'mean_n')}, count(*) AS days FROM d GROUP BY metric")
def mean_daily_count(spark, sf_dir):
    days = activity.daily_counts(telemetry(spark, sf_dir), TS, ["metric"])
    return activity.mean_daily_count(days, ["metric"])


@query("hourly_counts", "SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_counts(spark, sf_dir):
    return activity.hourly_counts(table(spark, sf_dir, "events"), "ts")


@query("hour_totals", f"SELECT hour(ts) AS hour, {dec('sum(value)', 'total')} FROM events GROUP BY 1")
def hour_totals(spark, sf_dir):
    return activity.clock_totals(table(spark, sf_dir, "events"), "ts", "value")


@query("minute_totals",
       f"SELECT hour(ts) * 60 + minute(ts) AS minute, {dec('sum(value)', 'total')} FROM events GROUP BY 1")
def minute_totals(spark, sf_dir):
    return activity.clock_totals(table(spark, sf_dir, "events"), "ts", "value", "minute")


@query("top_bottom_hours", f"""WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1)
       (SELECT hour, n, 'lowest' AS kind FROM h ORDER BY n, hour LIMIT 4) UNION ALL
       (SELECT hour, n, 'highest' AS kind FROM h ORDER BY n DESC, hour DESC LIMIT 4)""")
def top_bottom_hours(spark, sf_dir):
    return activity.extremes(activity.hourly_counts(table(spark, sf_dir, "events"), "ts"), "n", "hour")


@query("top_bottom_minutes", f"""WITH h AS (SELECT hour(ts) * 60 + minute(ts) AS minute, count(*) AS n FROM events GROUP BY 1)
       (SELECT minute, n, 'lowest' AS kind FROM h ORDER BY n, minute LIMIT 4) UNION ALL
       (SELECT minute, n, 'highest' AS kind FROM h ORDER BY n DESC, minute DESC LIMIT 4)""")
def top_bottom_minutes(spark, sf_dir):
    minutes = table(spark, sf_dir, "events").groupBy(
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"))
    return activity.extremes(minutes, "n", "minute")


_AXIS = """SELECT d AS day, count(created_at_local) AS n FROM generate_series(1, 31) g(d)
    LEFT JOIN telemetry ON day(created_at_local) = d AND metric = 'view'
    AND strftime(created_at_local, '%Y-%m') = '2024-01' GROUP BY d"""


@query("month_axis_counts", having("telemetry", a=_AXIS) + "SELECT day, n FROM a")
def month_axis_counts(spark, sf_dir):
    return reports.month_view(telemetry(spark, sf_dir), "2024-01", "view")["axis"]


@query("busiest_day", having("telemetry", a=_AXIS)
       + f"""SELECT (SELECT day FROM a ORDER BY n DESC, day LIMIT 1) AS day, max(n) AS n,
           {dec('avg(n)', 'mean_n')} FROM a""")
def busiest_day(spark, sf_dir):
    return reports.month_view(telemetry(spark, sf_dir), "2024-01", "view")["busiest"]


@query("distinct_values", having("telemetry")
       + "SELECT DISTINCT strftime(created_at_local, '%Y-%m') AS year_month FROM telemetry")
def distinct_values(spark, sf_dir):
    return reports.month_view(telemetry(spark, sf_dir), "2024-01", "view")["months"]


@query("series_summary", having("telemetry")
       + f"""SELECT metric, year(created_at_local) AS year,
           upper(metric) || ' ' || year(created_at_local) AS series, count(*) AS n,
           {stamp('min(created_at_local)', 'first')}, {stamp('max(created_at_local)', 'last')},
           {dec('min(value)', 'min')}, {dec('max(value)', 'max')} FROM telemetry GROUP BY 1, 2, 3""")
def series_summary(spark, sf_dir):
    return activity.series_summary(telemetry(spark, sf_dir), TS, "value")


def _describe(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {dec(f'avg({c})', 'mean')},
        {dec(f'stddev_samp({c})', 'std')}, {dec(f'min({c})', 'min')},
        {dec(f'quantile_cont({c}, 0.25)', 'q25')}, {dec(f'quantile_cont({c}, 0.5)', 'q50')},
        {dec(f'quantile_cont({c}, 0.75)', 'q75')}, {dec(f'max({c})', 'max')} FROM {source}"""


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", " UNION ALL ".join(_describe("lineitem", c) for c in _LINE_NUMBERS))
def describe_numeric(spark, sf_dir):
    return profile.describe_numeric(table(spark, sf_dir, "lineitem"), _LINE_NUMBERS)


@query("describe_performance", having("sensor")
       + " UNION ALL ".join(_describe("sensor", c) for c in reports.PERFORMANCE))
def describe_performance(spark, sf_dir):
    return profile.describe_numeric(sensor(spark, sf_dir), reports.PERFORMANCE)


@query("describe_grouped", f"""SELECT event_type, count(value) AS count, {dec('avg(value)', 'mean')},
       {dec('stddev_samp(value)', 'std')}, {dec('min(value)', 'min')}, {dec('max(value)', 'max')},
       {dec('quantile_cont(value, 0.25)', 'q25')}, {dec('quantile_cont(value, 0.5)', 'q50')},
       {dec('quantile_cont(value, 0.75)', 'q75')} FROM events GROUP BY event_type""")
def describe_grouped(spark, sf_dir):
    return profile.describe_grouped(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("quantiles_split", f"""SELECT event_type, {dec('quantile_cont(value, 0.05)', 'p05')},
       {dec('quantile_cont(value, 0.5)', 'p50')}, {dec('quantile_cont(value, 0.95)', 'p95')}
       FROM events GROUP BY event_type""")
def quantiles_split(spark, sf_dir):
    """The route for groups too big for one task, forced by a small limit."""
    from pitsignal.operators.quantiles import exact_quantiles

    q = exact_quantiles(
        table(spark, sf_dir, "events"), ["event_type"], "value", [0.05, 0.5, 0.95]
    )
    return q.select("event_type", *[
        F.col("quantiles")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))
    ])


@query("describe_temporal", f"""SELECT {stamp('min(ts)', 'min')}, {stamp('max(ts)', 'max')},
       {dec('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6', 'range_seconds')},
       count(ts) AS count, count(DISTINCT ts) AS nunique FROM events""")
def describe_temporal(spark, sf_dir):
    return profile.describe_temporal(table(spark, sf_dir, "events"), "ts")


@query("describe_categorical", having("telemetry") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "unique",
    (SELECT {c} FROM telemetry WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
    (SELECT count(*) FROM telemetry WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq
    FROM telemetry""" for c in ("truck", "metric", "fleet")))
def describe_categorical(spark, sf_dir):
    return profile.describe_categorical(telemetry(spark, sf_dir), ["truck", "metric", "fleet"])


@query("value_counts", having("time_model") + "SELECT Status, count(*) AS n FROM time_model GROUP BY Status")
def value_counts(spark, sf_dir):
    from pitsignal.catalog.views import time_model

    return profile.value_counts(time_model(spark, sf_dir), "Status")


@query("value_shares", having("time_model")
       + f"""SELECT Status, count(*) AS n, {dec('count(*) / (SELECT count(Status) FROM time_model)', 'share')}
           FROM time_model WHERE Status IS NOT NULL GROUP BY Status""")
def value_shares(spark, sf_dir):
    from pitsignal.catalog.views import time_model

    return profile.value_shares(time_model(spark, sf_dir), "Status")


_CORR = ["FuelLevelLiters", "Speed", "RPM", "FuelLevel", "Latitude"]


@query("corr_matrix", having("sensor") + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {dec(f'corr({a}, {b})', 'r')} FROM sensor"
    for a in _CORR for b in _CORR))
def corr_matrix(spark, sf_dir):
    return profile.correlation_matrix(sensor(spark, sf_dir), _CORR)


@query("corr_triangle", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {dec(f'corr({a}, {b})', 'r')} FROM lineitem"
    for i, a in enumerate(_LINE_NUMBERS) for b in _LINE_NUMBERS[:i]))
def corr_triangle(spark, sf_dir):
    return profile.correlation_matrix(table(spark, sf_dir, "lineitem"), _LINE_NUMBERS, triangle=True)


@query("median_series", having("telemetry")
       + f"""SELECT metric, {stamp("date_trunc('hour', created_at_local)", 'bucket')},
           {dec('median(value)', 'median')} FROM telemetry GROUP BY metric, date_trunc('hour', created_at_local)""")
def median_series(spark, sf_dir):
    from pitsignal.functions.times import bucket_start

    rows = telemetry(spark, sf_dir).select("metric", bucket_start(TS, 3600).alias("bucket"), "value")
    return profile.median_series(rows, ["metric", "bucket"], "value")


@query("time_density", having("telemetry")
       + f"""SELECT metric, {stamp("date_trunc('hour', created_at_local)", 'bucket')}, count(*) AS n
           FROM telemetry GROUP BY metric, date_trunc('hour', created_at_local)""")
def time_density(spark, sf_dir):
    return distribution.time_density(telemetry(spark, sf_dir), TS, ["metric"])


@query("histogram30", having("telemetry",
       e="SELECT metric, min(value) AS lo, max(value) AS hi FROM telemetry GROUP BY metric",
       b="""SELECT metric, lo, hi, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin
            FROM telemetry JOIN e USING (metric) WHERE value IS NOT NULL""")
       + f"""SELECT metric, bin, {dec('lo + bin * ((hi - lo) / 30)', 'bin_start')}, count(*) AS n
           FROM b GROUP BY metric, lo, hi, bin""")
def histogram30(spark, sf_dir):
    return distribution.histogram(telemetry(spark, sf_dir), "value", 30, ["metric"])


@query("auto_histogram", having(
       s="""SELECT min(value) AS lo, max(value) AS hi, count(value) AS n,
            quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events""",
       k="""SELECT lo, hi, ceil((hi - lo) / CASE WHEN iqr > 0 THEN
            least(2 * iqr / pow(n, 1 / 3), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END) AS bins FROM s""",
       b="""SELECT lo, hi, bins, CAST(least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin
            FROM events CROSS JOIN k WHERE value IS NOT NULL""")
       + f"SELECT bin, {dec('lo + bin * ((hi - lo) / bins)', 'bin_start')}, count(*) AS n FROM b GROUP BY lo, hi, bins, bin")
def auto_histogram(spark, sf_dir):
    return distribution.auto_histogram(table(spark, sf_dir, "events"), "value")


def _kde_sql(keys: str, view: str = "telemetry", value: str = "value") -> str:
    on = "true" if not keys else f"f.{keys} = s.{keys}"
    cols = f"f.{keys}, " if keys else ""
    key = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return having(view,
        s=f"""SELECT {key}count({value}) AS n, min({value}) AS lo, max({value}) AS hi,
            stddev_samp({value}) * pow(count({value}), -0.2) AS h FROM {view} {tail}""",
        f=f"SELECT {key}{value} AS v, count(*) AS c FROM {view} GROUP BY {key}{value}",
        g=f"""SELECT {cols}i AS point, lo + i * ((hi - lo) / 199) AS x, v, c, n, h
            FROM f JOIN s ON {on} CROSS JOIN generate_series(0, 199) g(i)""") + f"""
        SELECT {key}point, {dec('x', 'x')},
        {dec('sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi()))', 'density')}
        FROM g GROUP BY {key}point, x, n, h"""


@query("kde_curve", _kde_sql(""))
def kde_curve(spark, sf_dir):
    return distribution.kernel_density(telemetry(spark, sf_dir), "value")


@query("kde_by_metric", _kde_sql("metric"))
def kde_by_metric(spark, sf_dir):
    return distribution.kernel_density(telemetry(spark, sf_dir), "value", ["metric"])


@query("box_stats", having("telemetry",
       q="""SELECT metric, fleet, quantile_cont(value, 0.25) AS q1, median(value) AS q2,
            quantile_cont(value, 0.75) AS q3 FROM telemetry GROUP BY metric, fleet""",
       m="""SELECT t.metric, t.fleet, value, q1, q2, q3,
            value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS near
            FROM telemetry t JOIN q ON t.metric = q.metric AND t.fleet = q.fleet""")
       + f"""SELECT metric, fleet, {dec('q1', 'q1')}, {dec('q2', 'median')}, {dec('q3', 'q3')},
           {dec('min(value) FILTER (WHERE near)', 'whisker_low')},
           {dec('max(value) FILTER (WHERE near)', 'whisker_high')},
           count(*) FILTER (WHERE NOT near) AS outliers, count(*) AS n FROM m GROUP BY metric, fleet, q1, q2, q3""")
def box_stats(spark, sf_dir):
    return profile.box_stats(telemetry(spark, sf_dir), ["metric", "fleet"], "value")


_OUT = """SELECT t.* FROM telemetry t CROSS JOIN (SELECT quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.75) AS q3 FROM telemetry) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


@query("iqr_outliers", having("telemetry", o=_OUT)
       + f"""SELECT event_id, truck, metric, {stamp('created_at_local', 'created_at_local')},
           {dec('value', 'value')}, {dec('speed', 'speed')}, fleet FROM o""")
def iqr_outliers(spark, sf_dir):
    return filters.iqr_outliers(telemetry(spark, sf_dir), "value")


@query("outlier_breakdown", having("telemetry", o=_OUT) + "SELECT metric, count(*) AS n FROM o GROUP BY metric")
def outlier_breakdown(spark, sf_dir):
    return profile.value_counts(filters.iqr_outliers(telemetry(spark, sf_dir), "value"), "metric")


@query("outlier_share", having("telemetry", o=_OUT)
       + f"SELECT count(*) AS outliers, {dec('count(*) * 100.0 / (SELECT count(*) FROM telemetry)', 'percent')} FROM o")
def outlier_share(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return reports.outlier_share(rows, filters.iqr_outliers(rows, "value"))


@query("ols_trend", f"""SELECT {dec('regr_slope(l_extendedprice, l_quantity)', 'slope')},
       {dec('regr_intercept(l_extendedprice, l_quantity)', 'intercept')},
       {dec('regr_r2(l_extendedprice, l_quantity)', 'r2')},
       {big('regr_count(l_extendedprice, l_quantity)', 'n')} FROM lineitem""")
def ols_trend(spark, sf_dir):
    return profile.ols_trend(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query("linear_score", f"SELECT l_orderkey, l_linenumber, l_partkey, {dec('100 + 0.3 * l_quantity', 'score')} FROM lineitem")
def linear_score(spark, sf_dir):
    from pitsignal.functions.maths import linear_score as score

    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", score("l_quantity", 100, 0.3).alias("score")
    )


@query("argmin_row", f"""SELECT s_suppkey, s_name, {dec('s_acctbal', 's_acctbal')} FROM supplier
       WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier)""")
def argmin_row(spark, sf_dir):
    return profile.smallest_rows(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_acctbal"
    )


@query("mean_use", f"SELECT {dec('avg(o_totalprice)', 'mean')}, count(*) AS n FROM orders")
def mean_use(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n")
    )


@query("hash_sample", having("keyed_sensor")
       + f"""SELECT event_id, {dec('Speed', 'Speed')}, {dec('RPM', 'RPM')} FROM keyed_sensor
           ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 2000""")
def hash_sample(spark, sf_dir):
    rows = keyed_sensor(spark, sf_dir).select("event_id", "Speed", "RPM")
    return activity.sample_rows(rows, "event_id", 2000)


@query("map_sample", having("keyed_sensor")
       + f"""SELECT event_id, {dec('Latitude', 'Latitude')}, {dec('Longitude', 'Longitude')}, {dec('Speed', 'Speed')}
           FROM keyed_sensor WHERE Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180
           ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 1000""")
def map_sample(spark, sf_dir):
    rows = keyed_sensor(spark, sf_dir)
    placed = rows.filter(filters.valid_position("Latitude", "Longitude"))
    return activity.sample_rows(
        placed.select("event_id", "Latitude", "Longitude", "Speed"), "event_id", 1000
    )


@query("coord_valid", having("keyed_sensor")
       + f"""SELECT event_id, {dec('Latitude', 'Latitude')}, {dec('Longitude', 'Longitude')} FROM keyed_sensor
           WHERE Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180""")
def coord_valid(spark, sf_dir):
    return keyed_sensor(spark, sf_dir).filter(
        filters.valid_position("Latitude", "Longitude")
    ).select("event_id", "Latitude", "Longitude")


@query("head_tail", f"""(SELECT event_id, event_type, {dec('value', 'value')}, 'head' AS part FROM events ORDER BY event_id LIMIT 10)
       UNION ALL (SELECT event_id, event_type, {dec('value', 'value')}, 'tail' FROM events ORDER BY event_id DESC LIMIT 10)""")
def head_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    head = activity.head_rows(rows, "event_id", 10).withColumn("part", F.lit("head"))
    tail = activity.tail_rows(rows, "event_id", 10).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


# The sections of both reports in long form, as one result each.
@query("truck_report", having("sensor",
       s="SELECT * FROM sensor WHERE Equipment = 'T-212'",
       d="SELECT count(*) AS n FROM s GROUP BY ShiftDate, TimeStamp, Equipment, FuelLevelLiters, Speed, RPM, FuelLevel, Latitude, Longitude")
       + f"""SELECT 'rows' AS item, {dec('count(*)', 'amount')} FROM s
       UNION ALL SELECT 'days', {dec("date_diff('day', min(ShiftDate), max(ShiftDate)) + 1", 'amount')} FROM s
       UNION ALL SELECT 'duplicates', {dec('sum(n - 1)', 'amount')} FROM d
       UNION ALL SELECT 'positions', {dec('count(*)', 'amount')} FROM s WHERE Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180
       UNION ALL SELECT 'active_days', {dec('count(DISTINCT ShiftDate)', 'amount')} FROM s
       UNION ALL SELECT 'speed_rpm_correlation', {dec('corr(Speed, RPM)', 'amount')} FROM s""")
def truck_report(spark, sf_dir):
    out = reports.truck_report({"sensor": sensor(spark, sf_dir)}, "T-212")
    corr = out["correlation"].filter((F.col("x") == "RPM") & (F.col("y") == "Speed"))

    def item(name, df, column):
        return df.select(F.lit(name).alias("item"), column.cast("double").alias("amount"))

    parts = [
        item("rows", out["sensor.summary"], F.col("rows")),
        item("days", out["sensor.summary"], F.col("days")),
        item("duplicates", out["sensor.duplicates"], F.col("duplicates")),
        item("positions", out["positions"], F.col("rows")),
        item("active_days", out["daily_activity"].agg(F.count(F.lit(1)).alias("n")), F.col("n")),
        item("speed_rpm_correlation", corr, F.col("r")),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


@query("hourly_activity", having("sensor")
       + "SELECT coalesce(hour(TimeStamp), 0) AS hour, count(*) AS n FROM sensor WHERE Equipment = 'T-212' GROUP BY 1")
def hourly_activity(spark, sf_dir):
    return reports.truck_report({"sensor": sensor(spark, sf_dir)}, "T-212")["hourly_activity"]


@query("hourly_activity_by_truck", having("sensor")
       + """SELECT Equipment AS truck, coalesce(hour(TimeStamp), 0) AS hour, count(*) AS n FROM sensor GROUP BY 1, 2""")
def hourly_activity_by_truck(spark, sf_dir):
    """The report's hours of every truck of the table; trucks are as many as the fleet has."""
    rows = sensor(spark, sf_dir)
    hour = F.coalesce(F.hour("TimeStamp"), F.lit(0))
    return rows.groupBy(F.col("Equipment").alias("truck"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("daily_counts_by_metric", having("telemetry", d=f"""SELECT metric, year({_LOCAL}) AS year, month({_LOCAL}) AS month, day({_LOCAL}) AS day,
       count(*) AS n FROM telemetry GROUP BY ALL""")
       + f"SELECT metric, year, month, day, n, {_MONTHS}[month] AS month_name FROM d")
def daily_counts_by_metric(spark, sf_dir):
    return activity.daily_counts(telemetry(spark, sf_dir), to_site_time(TS), ["metric"])


@query("telemetry_report", having("telemetry", o=_OUT)
       + f"""SELECT 'mean_value' AS item, {dec('avg(value)', 'amount')} FROM telemetry
       UNION ALL SELECT 'distinct_times', {dec('count(DISTINCT created_at_local)', 'amount')} FROM telemetry
       UNION ALL SELECT 'top_metric_rows', {dec('max(n)', 'amount')} FROM (SELECT count(*) AS n FROM telemetry GROUP BY metric)
       UNION ALL SELECT 'outliers', {dec('count(*)', 'amount')} FROM o
       UNION ALL SELECT 'value_speed_correlation', {dec('corr(value, speed)', 'amount')} FROM telemetry""")
def telemetry_report(spark, sf_dir):
    out = reports.telemetry_report(telemetry(spark, sf_dir))
    corr = out["correlation"].filter((F.col("x") == "value") & (F.col("y") == "speed"))

    def item(name, df, column):
        return df.select(F.lit(name).alias("item"), column.cast("double").alias("amount"))

    parts = [
        item("mean_value", out["numeric"].filter(F.col("column") == "value"), F.col("mean")),
        item("distinct_times", out["temporal"], F.col("nunique")),
        item("top_metric_rows", out["categorical"].filter(F.col("column") == "metric"), F.col("freq")),
        item("outliers", out["outlier_share"], F.col("outliers")),
        item("value_speed_correlation", corr, F.col("r")),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total

