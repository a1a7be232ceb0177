"""Feature, gap and order queries."""

from pyspark.sql import functions as F

from pitsignal.catalog.registry import big, dec, query, stamp
from pitsignal.catalog.views import METRICS, having, table, telemetry
from pitsignal.functions.times import to_site_time
from pitsignal.layouts import SITE_ZONE
from pitsignal.operators import features as f
from pitsignal.operators import sequence
from pitsignal.operators.activity import hour_metric_crosstab
from pitsignal.operators.profile import value_shares
from pitsignal.plans.features import feature_table

TS = "created_at_local"


def _buckets_sql(unit: str) -> str:
    return f"""SELECT truck, metric, date_trunc('{unit}', created_at_local) AS bucket,
        avg(value) AS value, max(value) AS value_max, quantile_cont(value, 0.95) AS value_p95,
        avg(speed) AS speed_mean, stddev_samp(speed) AS speed_std, max(speed) AS speed_max,
        arg_min(fleet, created_at_local) AS fleet
        FROM telemetry GROUP BY truck, metric, date_trunc('{unit}', created_at_local)"""


_EDGES_SQL = """SELECT list_filter(kept[2:len(kept) - 1], lambda e: e IS NOT NULL) AS inner_edges FROM (
    SELECT list_transform(list_filter(generate_series(1, 6),
        lambda i: i = 1 OR q[i] - q[i - 1] > 1e-8), lambda i: q[i]) AS kept
    FROM (SELECT quantile_cont(speed_mean, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM b))"""
_LABEL_SQL = """CASE WHEN speed_mean IS NULL THEN NULL ELSE
    ['Muy Baja', 'Baja', 'Media', 'Alta', 'Muy Alta'][
        len(list_filter(inner_edges, lambda e: e <= speed_mean)) + 1] END"""
_FEATURE_COLUMNS = ", ".join([
    "truck", "metric", stamp("bucket", "timestamp"),
    *[dec(c, c) for c in ("value", "value_max", "value_p95", "speed_mean", "speed_std", "speed_max")],
    "fleet",
    dec("avg(value) OVER (PARTITION BY truck, metric ORDER BY bucket "
        "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "value_rolling"),
    big("CASE WHEN speed_mean > m + 3 * sd OR speed_mean < m - 3 * sd THEN 1 ELSE 0 END",
        "speed_anomaly"),
])
_GLOBAL = "SELECT avg(speed_mean) AS m, stddev_samp(speed_mean) AS sd FROM b"


@query("feature_buckets", having("telemetry", b=_buckets_sql("day"), g=_GLOBAL)
       + f"SELECT {_FEATURE_COLUMNS} FROM b CROSS JOIN g")
def feature_buckets(spark, sf_dir):
    return feature_table(telemetry(spark, sf_dir), TS, f.DAY_SECONDS, bands=False)


@query("feature_dataset", having("telemetry", b=_buckets_sql("hour"), g=_GLOBAL, e=_EDGES_SQL)
       + f"SELECT {_FEATURE_COLUMNS}, {_LABEL_SQL} AS speed_category FROM b CROSS JOIN g CROSS JOIN e")
def feature_dataset(spark, sf_dir):
    return feature_table(telemetry(spark, sf_dir), TS, 3600)


_LOCAL_BUCKETS = """SELECT truck, metric, bucket, avg(value) AS value, max(value) AS value_max, quantile_cont(value, 0.95) AS value_p95,
        avg(speed) AS speed_mean, stddev_samp(speed) AS speed_std, max(speed) AS speed_max, arg_min(fleet, t) AS fleet
        FROM s GROUP BY truck, metric, bucket"""


@query("feature_buckets_local", having("telemetry",
       s="""SELECT *, created_at_local + INTERVAL 75 DAY AS t,
            date_trunc('hour', timezone('America/Santiago', timezone('UTC', created_at_local + INTERVAL 75 DAY))) AS bucket FROM telemetry""",
       b=_LOCAL_BUCKETS, g=_GLOBAL)
       + f"SELECT {_FEATURE_COLUMNS} FROM b CROSS JOIN g")
def feature_buckets_local(spark, sf_dir):
    """Hours of the site's clock, over times that are shifted so that they span its change in April."""
    moved = telemetry(spark, sf_dir).withColumn(TS, F.col(TS) + F.expr("INTERVAL 75 DAYS"))
    return feature_table(moved, TS, 3600, bands=False, zone=SITE_ZONE)


_ADAPTIVE = having("telemetry",
    d="SELECT DISTINCT created_at_local AS t FROM telemetry",
    q="SELECT (epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t))) / 1e6 AS gap FROM d",
    m="SELECT gap FROM q WHERE gap > 0 GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1",
    st="SELECT CAST(CASE WHEN gap < 60 THEN greatest(floor(gap), 1) ELSE floor(gap / 60) * 60 END AS BIGINT) * 1000000 AS s FROM m",
    o="SELECT date_trunc('day', min(created_at_local)) AS origin FROM telemetry",
    b="""SELECT truck, metric, origin + to_microseconds(((epoch_us(created_at_local) - epoch_us(origin)) // s) * s) AS bucket,
         avg(value) AS value, max(value) AS value_max, quantile_cont(value, 0.95) AS value_p95,
         avg(speed) AS speed_mean, stddev_samp(speed) AS speed_std, max(speed) AS speed_max,
         arg_min(fleet, created_at_local) AS fleet FROM telemetry CROSS JOIN o CROSS JOIN st GROUP BY truck, metric, bucket""",
    g=_GLOBAL)


@query("feature_adaptive", _ADAPTIVE + f"SELECT {_FEATURE_COLUMNS} FROM b CROSS JOIN g")
def feature_adaptive(spark, sf_dir):
    """The step follows from the times."""
    return feature_table(telemetry(spark, sf_dir), TS, bands=False)


@query("feature_odd_step", having("telemetry", o="""SELECT date_trunc('day', min(created_at_local)) AS origin FROM telemetry""",
       b="""SELECT truck, metric, origin + to_microseconds(
            ((epoch_us(created_at_local) - epoch_us(origin)) // 2580000000) * 2580000000) AS bucket,
            value, speed FROM telemetry CROSS JOIN o""")
       + f"""SELECT truck, metric, {stamp('bucket', 'timestamp')}, {dec('avg(value)', 'value')},
           {dec('quantile_cont(value, 0.95)', 'value_p95')}, {dec('max(speed)', 'speed_max')}
           FROM b GROUP BY truck, metric, bucket""")
def feature_odd_step(spark, sf_dir):
    """A 43-minute step, which does not divide a day: buckets count from the first midnight."""
    return f.bucket_features(telemetry(spark, sf_dir), TS, 43 * 60).select(
        "truck", "metric", "timestamp", "value", "value_p95", "speed_max"
    )


@query("speed_bands", having("telemetry", b=_buckets_sql("day"), e=_EDGES_SQL)
       + f"""SELECT truck, metric, {stamp('bucket', 'timestamp')}, {dec('speed_mean', 'speed_mean')},
           {_LABEL_SQL} AS speed_category FROM b CROSS JOIN e""")
def speed_bands(spark, sf_dir):
    buckets = f.bucket_features(telemetry(spark, sf_dir), TS, f.DAY_SECONDS)
    means = buckets.select("truck", "metric", "timestamp", "speed_mean")
    return f.speed_bands(means.persist())


@query("band_share", having("telemetry", b=_buckets_sql("day"), e=_EDGES_SQL,
       l=f"SELECT {_LABEL_SQL} AS speed_category FROM b CROSS JOIN e")
       + f"""SELECT speed_category, count(*) AS n,
           {dec('count(*) / (SELECT count(speed_category) FROM l)', 'share')}
           FROM l WHERE speed_category IS NOT NULL GROUP BY speed_category""")
def band_share(spark, sf_dir):
    buckets = f.bucket_features(telemetry(spark, sf_dir), TS, f.DAY_SECONDS)
    return value_shares(f.speed_bands(buckets.select("speed_mean").persist()), "speed_category")


@query("optimal_freq", having("telemetry",
       t="SELECT created_at_local AS t, count(*) AS n FROM telemetry GROUP BY 1",
       g="SELECT (epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t))) / 1e6 AS gap, n, row_number() OVER (ORDER BY t) AS i FROM t",
       h="SELECT count(DISTINCT gap) = 1 AND count(gap) >= 2 AND max(n) = 1 AS regular, min(gap) AS gap FROM g",
       m="SELECT gap FROM g WHERE gap > 0 GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1",
       p="SELECT CASE WHEN regular THEN h.gap ELSE m.gap END AS gap, regular FROM h CROSS JOIN m",
       w="SELECT CAST(CASE WHEN gap < 60 THEN greatest(floor(gap), 1) ELSE floor(gap / 60) * 60 END AS BIGINT) AS s, regular FROM p")
       + """SELECT s AS step_seconds,
           CASE WHEN s < 60 THEN s || 'S' ELSE (s // 60) || 'T' END AS frequency,
           CASE WHEN regular THEN 'regular' ELSE 'modal' END AS source FROM w""")
def optimal_freq(spark, sf_dir):
    return f.optimal_frequency(telemetry(spark, sf_dir), TS)


@query("optimal_freq_changed", """WITH e AS (SELECT event_id, CASE WHEN event_id < 1200 THEN event_id ELSE event_id * 60 END AS s FROM events),
       g AS (SELECT s - lag(s) OVER (ORDER BY s) AS gap FROM e),
       m AS (SELECT gap FROM g WHERE gap > 0 GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)
       SELECT CAST(CASE WHEN gap < 60 THEN gap ELSE gap // 60 * 60 END AS BIGINT) AS step_seconds,
         CASE WHEN gap < 60 THEN CAST(gap AS BIGINT) || 'S' ELSE CAST(gap // 60 AS BIGINT) || 'T' END AS frequency,
         CASE WHEN (SELECT count(DISTINCT gap) FROM g) = 1 THEN 'regular' ELSE 'modal' END AS source FROM m""")
def optimal_freq_changed(spark, sf_dir):
    """A table that is even for its first 1200 times and goes on at another rate."""
    seconds = F.when(F.col("event_id") < 1200, F.col("event_id")).otherwise(F.col("event_id") * 60)
    times = table(spark, sf_dir, "events").select(F.timestamp_seconds(seconds + 1_704_067_200).cast("timestamp_ntz").alias("t"))
    return f.optimal_frequency(times, "t")


@query("hour_metric_crosstab", having("telemetry", b=_buckets_sql("hour"),
       l="SELECT hour(timezone('America/Santiago', timezone('UTC', bucket))) AS h, metric, value FROM b")
       + "SELECT CAST(h AS BIGINT) AS hour, "
       + ", ".join(dec(f"avg(CASE WHEN metric = '{m}' THEN value END)", f'"{m}"') for m in METRICS)
       + " FROM l GROUP BY h")
def crosstab(spark, sf_dir):
    buckets = f.bucket_features(telemetry(spark, sf_dir), TS, 3600).select("timestamp", "metric", "value")
    return hour_metric_crosstab(
        buckets, to_site_time("timestamp"), "metric", "value", METRICS
    )


@query("reduction_factor", having("telemetry", b=_buckets_sql("day"))
       + f"""SELECT rows_in, rows_out, {dec('rows_in / rows_out', 'factor')} FROM
           (SELECT (SELECT count(*) FROM telemetry) AS rows_in, (SELECT count(*) FROM b) AS rows_out)""")
def reduction_factor(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    return f.reduction_factor(rows, f.bucket_features(rows, TS, f.DAY_SECONDS))


@query("monotonic_violations", having("telemetry",
       l="""SELECT truck, metric, created_at_local < lag(created_at_local)
            OVER (PARTITION BY truck, metric ORDER BY event_id) AS bad FROM telemetry""")
       + """SELECT truck, metric, count(*) AS rows, count(*) FILTER (WHERE bad) AS violations
           FROM l GROUP BY truck, metric""")
def monotonic_violations(spark, sf_dir):
    return sequence.order_violations(telemetry(spark, sf_dir), ["truck", "metric"], "event_id", TS)


@query("value_order_violations", having("telemetry",
       l="SELECT metric, value < lag(value) OVER (PARTITION BY metric ORDER BY event_id) AS bad FROM telemetry")
       + "SELECT metric, count(*) AS rows, count(*) FILTER (WHERE bad) AS violations FROM l GROUP BY metric")
def value_order_violations(spark, sf_dir):
    return sequence.order_violations(telemetry(spark, sf_dir), ["metric"], "event_id", "value")


@query("row_gaps", having("telemetry")
       + f"""SELECT event_id, truck, metric, {dec('''(epoch_us(created_at_local) - epoch_us(lag(created_at_local)
           OVER (PARTITION BY truck, metric ORDER BY event_id))) / 1e6''', 'gap_seconds')} FROM telemetry""")
def row_gaps(spark, sf_dir):
    gaps = sequence.row_gaps(telemetry(spark, sf_dir), ["truck", "metric"], "event_id", TS)
    return gaps.select("event_id", "truck", "metric", "gap_seconds")


_TRAILING_SQL = having("telemetry") + f"""SELECT event_id, {dec('''avg(value) OVER (PARTITION BY truck, metric
    ORDER BY created_at_local, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)''', 'value_rolling')} FROM telemetry"""


@query("rolling_mean_chunked", _TRAILING_SQL)
def rolling_mean_chunked(spark, sf_dir):
    """Trailing mean over raw rows, cut by day; a day is given the last rows before it."""
    rows = telemetry(spark, sf_dir).select("event_id", "truck", "metric", TS, "value")
    out = sequence.trailing_mean(
        rows, ["truck", "metric"], TS, "value", "value_rolling", 5, "day", ties=["event_id"]
    )
    return out.select("event_id", "value_rolling")


@query("rolling_mean", _TRAILING_SQL)
def rolling_mean(spark, sf_dir):
    """The same over raw rows, cut into blocks of one size by their number."""
    rows = telemetry(spark, sf_dir).select("event_id", "truck", "metric", TS, "value")
    out = sequence.trailing_mean(rows, ["truck", "metric"], TS, "value", "value_rolling", 5, ties=["event_id"])
    return out.select("event_id", "value_rolling")


@query("rolling_mean_one_day", having("telemetry") + f"""SELECT event_id, {dec('''avg(value) OVER (
    ORDER BY date_trunc('day', created_at_local), event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)''', 'value_rolling')}
    FROM telemetry""")
def rolling_mean_one_day(spark, sf_dir):
    """Trailing mean of the whole table as one series whose times are days, so that nearly all rows repeat one."""
    rows = telemetry(spark, sf_dir).select("event_id", F.date_trunc("day", TS).alias("day"), "value")
    out = sequence.trailing_mean(rows, [], "day", "value", "value_rolling", 5, ties=["event_id"])
    return out.select("event_id", "value_rolling")


@query("speed_flags", having("telemetry", g="SELECT avg(value) AS m, stddev_samp(value) AS sd FROM telemetry")
       + f"""SELECT event_id, {big('CASE WHEN value > m + 3 * sd OR value < m - 3 * sd THEN 1 ELSE 0 END', 'anomaly')}
           FROM telemetry CROSS JOIN g""")
def speed_flags(spark, sf_dir):
    return f.flag_outside_sigmas(
        telemetry(spark, sf_dir).select("event_id", "value"), "value", "anomaly"
    ).select("event_id", "anomaly")


@query("local_time_parts", having("telemetry", l="""SELECT event_id, created_at_local AS u,
       timezone('America/Santiago', timezone('UTC', created_at_local)) AS t FROM telemetry""")
       + f"""SELECT event_id, {stamp('t', 'local_time')},
           ['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre',
            'Octubre', 'Noviembre', 'Diciembre'][month(t)] AS month_name,
           strftime(t, '%Y-%m') AS year_month, year(t) AS year, month(t) AS month, day(t) AS day,
           hour(t) AS hour, strftime(t, '%H:%M:%S') AS clock,
           strftime(u + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM l""")
def local_time_parts(spark, sf_dir):
    from pitsignal.functions import times

    t = F.col("local_time")
    rows = telemetry(spark, sf_dir).withColumn("local_time", to_site_time(TS))
    return rows.select(
        "event_id", "local_time", times.month_name_es(t).alias("month_name"),
        times.year_month(t).alias("year_month"), F.year(t).alias("year"),
        F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"),
        times.time_of_day(t).alias("clock"),
        F.date_format(times.add_days(TS), "yyyy-MM-dd").alias("next_day"),
    )
