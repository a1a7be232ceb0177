"""Column, row, index and union queries."""

from pyspark.sql import functions as F

from pitsignal.catalog.registry import big, day, dec, query, stamp
from pitsignal.catalog.views import having, table, telemetry
from pitsignal.functions import maths
from pitsignal.operators import filters, shaping
from pitsignal.plans.fuel import FLEET_NUMBERS
from pitsignal.sources.tables import date_range, fleet_telemetry, random_normal


@query("day_window", having("telemetry")
       + f"""SELECT event_id, {stamp('created_at_local', 'created_at_local')} FROM telemetry
           WHERE created_at_local >= TIMESTAMP '2024-01-10' AND created_at_local < TIMESTAMP '2024-01-11'""")
def day_window(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("event_id", "created_at_local")
    return rows.filter(filters.on_day("created_at_local", "2024-01-10"))


@query("membership", having("telemetry")
       + """SELECT event_id, truck FROM telemetry
           WHERE CAST(substr(truck, 3) AS INTEGER) BETWEEN 210 AND 225
              OR CAST(substr(truck, 3) AS INTEGER) BETWEEN 230 AND 243""")
def membership(spark, sf_dir):
    allowed = [f"T-{n}" for n in FLEET_NUMBERS]
    return telemetry(spark, sf_dir).select("event_id", "truck").filter(F.col("truck").isin(allowed))


@query("membership_table", """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def membership_table(spark, sf_dir):
    allowed = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return filters.in_table(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey",
        allowed.select("c_custkey"),
    )


@query("allow_list_union", """SELECT truck, count(*) AS n FROM (SELECT 'T-' || CAST(210 + user_id % 14 AS VARCHAR) AS truck FROM events)
       WHERE truck IN (SELECT 'T-' || CAST(g AS VARCHAR) FROM (SELECT unnest(generate_series(210, 215)) AS g
       UNION SELECT unnest(generate_series(213, 218)))) GROUP BY truck""")
def allow_list_union(spark, sf_dir):
    numbers = shaping.allowed_numbers(spark, [(210, 215), (213, 218)]).select(
        F.concat(F.lit("T-"), F.col("number").cast("string")).alias("truck")
    )
    kept = filters.in_table(telemetry(spark, sf_dir), "truck", numbers)
    return kept.groupBy("truck").agg(F.count(F.lit(1)).alias("n"))


@query("equality_filters", having("telemetry")
       + f"""SELECT event_id, {dec('value', 'value')} FROM telemetry WHERE truck = 'T-211' AND metric = 'view'
           AND strftime(created_at_local, '%Y-%m') = '2024-01'""")
def equality_filters(spark, sf_dir):
    rows = fleet_telemetry(telemetry(spark, sf_dir), truck="T-211", metrics=["view"], years=[2024])
    return rows.filter(F.date_format("created_at_local", "yyyy-MM") == "2024-01").select(
        "event_id", "value"
    )


@query("numeric_mask", f"SELECT event_id, value > 23 AS above_23, {dec('value', 'value')} FROM events")
def numeric_mask(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") > 23).alias("above_23"), "value"
    )


@query("numeric_filter", f"SELECT event_id, {dec('value', 'value')} FROM events WHERE value > 53")
def numeric_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").filter(F.col("value") > 53)


@query("row_numbers", """SELECT o_orderkey, o_orderpriority,
       row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS idx FROM orders""")
def row_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return shaping.number_rows(rows, ["o_orderpriority", "o_orderkey"])


@query("index_align", """WITH i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)
       SELECT c_custkey, idx, ['tarde', 'noche', 'tarde', 'maniana'][idx + 1] AS turno FROM i""")
def index_align(spark, sf_dir):
    rows = shaping.number_rows(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    return shaping.align_series(rows, ["tarde", "noche", "tarde", "maniana"], "turno")


@query("index_align_table", """WITH i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer),
       s AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier)
       SELECT c_custkey, i.idx, s_name FROM i LEFT JOIN s ON i.idx = s.idx""")
def index_align_table(spark, sf_dir):
    rows = shaping.number_rows(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    series = shaping.number_rows(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"]
    ).drop("s_suppkey")
    return shaping.align_table(rows, series)


@query("index_slice", """WITH i AS (SELECT p_partkey, p_name, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part)
       SELECT p_name, p_size FROM i WHERE idx <= 4""")
def index_slice(spark, sf_dir):
    rows = shaping.number_rows(
        table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"]
    )
    return shaping.index_slice(rows, "idx", 0, 5, ["p_name", "p_size"])


@query("append_row", f"""SELECT s_suppkey, s_name, s_nationkey, {dec('s_acctbal', 's_acctbal')}, CAST(NULL AS VARCHAR) AS turno FROM supplier
       UNION ALL SELECT -1, 'otra', NULL, NULL, 'noche'""")
def append_row(spark, sf_dir):
    return shaping.append_row(
        table(spark, sf_dir, "supplier"), {"s_suppkey": -1, "s_name": "otra", "turno": "noche"}
    )


@query("concat_tables", """SELECT o_orderkey AS key, o_totalprice > 100000 AS large, CAST(NULL AS VARCHAR) AS name FROM orders
       UNION ALL SELECT c_custkey, NULL, c_name FROM customer""")
def concat_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), (F.col("o_totalprice") > 100000).alias("large")
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    return shaping.concat_tables([orders, people])


@query("trig_pow", f"""SELECT l_orderkey, l_linenumber, l_partkey, {dec('pow(10, l_tax * 10)', 'ten')},
       {dec('pow(2, l_discount * 100)', 'two')}, {dec('sin(radians(l_quantity))', 'sine')},
       {dec('cos(radians(l_quantity))', 'cosine')} FROM lineitem""")
def trig_pow(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        maths.power_of_ten(F.col("l_tax") * 10).alias("ten"),
        maths.power_of_two(F.col("l_discount") * 100).alias("two"),
        maths.sin_degrees("l_quantity").alias("sine"),
        maths.cos_degrees("l_quantity").alias("cosine"),
    )


@query("rename_select", """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders""")
def rename_select(spark, sf_dir):
    return shaping.rename_select(
        table(spark, sf_dir, "orders"), {"o_orderkey": "id", "o_orderstatus": "status"}, ["id", "status"]
    )


@query("column_shaping", f"""SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month,
       o_custkey, {dec('o_totalprice', 'o_totalprice')}, 'orders' AS data_type FROM orders""")
def column_shaping(spark, sf_dir):
    """Insert at a position, drop, keep an allow-list, tag."""
    rows = table(spark, sf_dir, "orders")
    dated = shaping.insert_columns(rows, 1, {"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    kept = shaping.keep_allowed(
        dated.drop("o_orderpriority"),
        ["o_orderkey", "year", "month", "o_custkey", "o_totalprice", "absent"],
    )
    return shaping.tag(kept, "data_type", "orders")


@query("numeric_columns", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(dec(c, c) for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} FROM lineitem")
def numeric_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*shaping.columns_of_kind(rows, "number"))


@query("time_sort", "SELECT event_id, row_number() OVER (ORDER BY ts DESC) - 1 AS place FROM events")
def time_sort(spark, sf_dir):
    """Descending time order, made visible as a position."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    flipped = rows.withColumn("back", -F.unix_micros(F.col("ts").cast("timestamp")))
    return shaping.number_rows(flipped, ["back"], "place").select("event_id", "place")


@query("date_axis", f"""WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1),
       a AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM d)
       SELECT {day('a.d', 'date')}, {big('coalesce(n, 0)', 'n')} FROM a LEFT JOIN d ON CAST(a.d AS DATE) = d.d""")
def date_axis(spark, sf_dir):
    """Every date between the first and the last event with its rows."""
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ends = counts.agg(F.min("date").alias("start"), F.max("date").alias("stop"))
    return date_range(ends, "start", "stop", "date").join(counts, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).alias("n")
    )


@query("random_normal", """SELECT c AS "column", (SELECT count(*) FROM events) AS rows, 0 AS nulls, true AS mean_near_0, true AS deviation_near_1
       FROM (VALUES ('a'), ('b'), ('c'), ('d')) t(c)""")
def random_columns(spark, sf_dir):
    """Whether four normal columns beside the events have the rows, the mean and the deviation they should have."""
    drawn = random_normal(table(spark, sf_dir, "events").select("event_id"), ["a", "b", "c", "d"], 7)
    long = drawn.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in "abcd"])).alias("x")).select("x.*")
    n = F.count(F.lit(1))
    return long.groupBy("column").agg(
        n.alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"),
        (F.abs(F.avg("v")) < 6 / F.sqrt(n)).alias("mean_near_0"), (F.abs(F.stddev("v") - 1) < 6 / F.sqrt(n)).alias("deviation_near_1"),
    )
