"""Queries on model diagnostics, efficiency and drift."""

from pyspark.sql import functions as F

from pitsignal.catalog.registry import dec, query, stamp
from pitsignal.catalog.views import having, table, telemetry
from pitsignal.operators import drift, intervals, regression

_R = "corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc"


@query("variance_inflation", f"""WITH r AS (SELECT {_R}, count(*) AS n FROM lineitem
         WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
       d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
       SELECT 'quantity' AS "column", n, {dec('(1 - bc * bc) / det', 'vif')}, 'ok' AS status FROM d UNION ALL
       SELECT 'price', n, {dec('(1 - ac * ac) / det', 'vif')}, 'ok' FROM d UNION ALL
       SELECT 'discount', n, {dec('(1 - ab * ab) / det', 'vif')}, 'ok' FROM d UNION ALL
       SELECT 'dozens', n, NULL, 'collinear' FROM d UNION ALL
       SELECT 'unit', n, NULL, 'constant' FROM d""")
def variance_inflation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        (F.col("l_quantity") / 12 + 1).alias("dozens"),
        F.when(F.col("l_quantity").isNotNull(), 7.0).alias("unit"),
    )
    return regression.variance_inflation(rows, ["quantity", "price", "discount", "dozens", "unit"])


_FIT = """WITH x AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem
         WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
       s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
         covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM x),
       c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
       e AS (SELECT y - (my - ca * ma - cb * mb) - ca * a - cb * b AS e FROM x, c),
       g AS (SELECT avg(abs(e)) AS mae, avg(e * e) AS mse FROM e)"""


@query("fit_errors", _FIT + f"""SELECT n, {dec('my - ca * ma - cb * mb', 'intercept')}, {dec('ca', 'slope_quantity')},
         {dec('cb', 'slope_discount')}, {dec('mae', 'mae')}, {dec('sqrt(mse)', 'rmse')}, {dec('1 - mse / yy', 'r2')} FROM c, g""")
def fit_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    fit = regression.fit_errors(rows, "l_extendedprice", ["l_quantity", "l_discount"])
    names = ("intercept", "slope_quantity", "slope_discount")
    return fit.select("n", *[F.col("coefficients")[i].alias(c) for i, c in enumerate(names)], "mae", "rmse", "r2")


_HOURS = "epoch_us(created_at_local - TIMESTAMP '2024-01-01') / 3.6e9"


@query("durbin_watson", having("telemetry", t=f"SELECT truck, metric, event_id, created_at_local AS ts, {_HOURS} AS hours, value FROM telemetry",
       l="SELECT truck, metric, regr_slope(value, hours) AS s, regr_intercept(value, hours) AS i FROM t GROUP BY ALL",
       e="SELECT truck, metric, ts, event_id, value - i - s * hours AS e FROM t JOIN l USING (truck, metric)",
       d="SELECT *, e - lag(e) OVER (PARTITION BY truck, metric ORDER BY ts, event_id) AS d FROM e")
       + f"SELECT truck, metric, count(*) AS n, {dec('sum(d * d) / sum(e * e)', 'durbin_watson')} FROM d GROUP BY ALL")
def durbin_watson(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    since = F.unix_micros(F.col("created_at_local").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    timed = rows.withColumn("hours", since / 3.6e9)
    rest = regression.trend_residuals(timed, ["truck", "metric"], "hours", "value")
    return regression.durbin_watson(rest, ["truck", "metric"], ["created_at_local", "event_id"], "residual")


def loads_and_fuel(spark, sf_dir):
    """Loads from purchases, which take a minute a unit of ``speed``, and fuel spells from views, half a minute a unit of ``value``."""
    rows = telemetry(spark, sf_dir)
    start = F.col("created_at_local").alias("start")

    def until(seconds):
        micros = F.unix_micros(F.col("created_at_local").cast("timestamp")) + F.round(seconds * 1e6).cast("bigint")
        return F.timestamp_micros(micros).cast("timestamp_ntz").alias("end")

    loads = rows.filter("metric = 'purchase'").select(
        "truck", "event_id", start, until(F.col("speed") * 60), F.col("value").alias("tonnes")
    )
    fuel = rows.filter("metric = 'view'").select("truck", start, until(F.col("value") * 30), (F.col("value") * 2).alias("litres"))
    return loads, fuel


_EFFICIENCY = dict(
    l="""SELECT truck, event_id, created_at_local AS s, created_at_local + to_microseconds(CAST(round(speed * 6e7) AS BIGINT)) AS e, value AS tonnes
         FROM telemetry WHERE metric = 'purchase'""",
    f="""SELECT truck, created_at_local AS s, created_at_local + to_microseconds(CAST(round(value * 3e7) AS BIGINT)) AS e, value * 2 AS litres
         FROM telemetry WHERE metric = 'view'""",
    o="""SELECT event_id, sum(litres * epoch_us(least(l.e, f.e) - greatest(l.s, f.s)) / epoch_us(f.e - f.s)) AS litres
         FROM l JOIN f ON l.truck = f.truck AND l.s < f.e AND f.s < l.e WHERE f.s < f.e AND l.s < l.e GROUP BY event_id""",
    p="SELECT truck, event_id, s, tonnes, coalesce(litres, 0) AS litres FROM l LEFT JOIN o USING (event_id)",
)


@query("load_efficiency", having("telemetry", **_EFFICIENCY) + f"""SELECT truck, event_id, {stamp('s', 'start')}, {dec('tonnes', 'tonnes')},
         {dec('litres', 'litres')}, {dec('CASE WHEN litres > 0 THEN tonnes / litres END', 'tonnes_per_litre')} FROM p""")
def load_efficiency(spark, sf_dir):
    return intervals.load_efficiency(*loads_and_fuel(spark, sf_dir), ["truck"], "event_id")


@query("truck_efficiency", having("telemetry", **_EFFICIENCY) + f"""SELECT truck, count(*) AS loads, {dec('sum(tonnes)', 'tonnes')},
         {dec('sum(litres)', 'litres')}, {dec('CASE WHEN sum(litres) > 0 THEN sum(tonnes) / sum(litres) END', 'tonnes_per_litre')}
         FROM p GROUP BY truck""")
def truck_efficiency(spark, sf_dir):
    per_load = intervals.load_efficiency(*loads_and_fuel(spark, sf_dir), ["truck"], "event_id")
    return intervals.efficiency_by(per_load, ["truck"])


@query("kl_drift", having("telemetry",
       v="SELECT metric, date_diff('day', DATE '2024-01-01', CAST(created_at_local AS DATE)) // 7 AS week, value AS v FROM telemetry WHERE value IS NOT NULL",
       w="SELECT metric, week, min(v) AS lo, max(v) AS hi FROM v GROUP BY ALL",
       r="SELECT metric, week AS base, v, 1 AS q, 0 AS p FROM v UNION ALL SELECT metric, week - 1, v, 0, 1 FROM v",
       c="""SELECT r.metric, base, q, p, CAST(CASE WHEN v < lo THEN 0 WHEN v > hi THEN 21 WHEN hi = lo THEN 1
              ELSE least(floor((v - lo) / ((hi - lo) / 20)), 19) + 1 END AS INT) AS cell
            FROM r JOIN w ON r.metric = w.metric AND r.base = w.week""",
       t="SELECT metric, base, sum(q) AS nq, sum(p) AS np FROM c GROUP BY ALL HAVING sum(q) > 0 AND sum(p) > 0",
       g="SELECT metric, base, nq, np, cell FROM t, generate_series(0, 21) AS s(cell)",
       n="SELECT metric, base, cell, sum(q) AS q, sum(p) AS p FROM c GROUP BY ALL",
       h="""SELECT g.metric, g.base, nq, np, (coalesce(p, 0) + 0.5) / (np + 11) AS p, (coalesce(q, 0) + 0.5) / (nq + 11) AS q
            FROM g LEFT JOIN n ON g.metric = n.metric AND g.base = n.base AND g.cell = n.cell""")
       + f"""SELECT metric, CAST(base + 1 AS BIGINT) AS week, CAST(nq AS BIGINT) AS rows_before, CAST(np AS BIGINT) AS rows,
         {dec('sum(p * ln(p / q))', 'kl')}, {dec('sum((p - q) * ln(p / q))', 'psi')} FROM h GROUP BY metric, base, nq, np""")
def kl_drift(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    week = F.floor(F.datediff("created_at_local", F.lit("2024-01-01").cast("date")) / 7)
    return drift.kl_drift(rows.withColumn("week", week), ["metric"], "week", "value")
