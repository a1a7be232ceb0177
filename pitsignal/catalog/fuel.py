"""Fuel and sheet-reshaping queries."""

from pyspark.sql import functions as F

from pitsignal.catalog.registry import day, dec, query, stamp
from pitsignal.catalog.views import fuel_dispatch, fuel_readings, grid, having, sensor
from pitsignal.functions.maths import to_number
from pitsignal.functions.text import first_three_digits, tidy_upper, truck_code, zero_fill
from pitsignal.operators.shaping import every_third_dropped, stack_pairs
from pitsignal.plans import fuel, wide

_DISPATCH = """SELECT CAST(fin_desp AS DATE) AS d, strftime(fin_desp, '%H:%M:%S') AS TimeStamp,
    'T-' || regexp_extract(Veh, '[0-9]{3}') AS Equipment, volumCorregido AS liters
    FROM fuel_dispatch WHERE Veh IS NOT NULL AND fin_desp IS NOT NULL
    AND upper(trim(Descripcion)) IN ('CAT - 789C', 'CAT - 793D')
    AND (CAST(regexp_extract(Veh, '[0-9]{3}') AS INTEGER) BETWEEN 210 AND 225
         OR CAST(regexp_extract(Veh, '[0-9]{3}') AS INTEGER) BETWEEN 230 AND 243)"""
_RESULT = f"{day('d', 'ShiftDate')}, TimeStamp, Equipment, {dec('liters', 'FuelLevelLiters')}"


@query("fuel_dispatch", having("fuel_dispatch", r=_DISPATCH) + f"SELECT {_RESULT} FROM r")
def dispatch(spark, sf_dir):
    return fuel.dispatch_readings(fuel_dispatch(spark, sf_dir))


@query("fuel_dispatch_text", having("fuel_dispatch", r=_DISPATCH) + f"SELECT {_RESULT} FROM r")
def dispatch_text(spark, sf_dir):
    """The same with day-first text times."""
    return fuel.dispatch_readings(fuel_dispatch(spark, sf_dir, as_text=True))


@query("fuel_checks", having("fuel_dispatch", r=_DISPATCH)
       + f"""SELECT count(*) AS count, {dec('avg(liters)', 'mean')}, {dec('quantile_cont(liters, 0.5)', 'q50')},
           {day('min(d)', 'first')}, {day('max(d)', 'last')}, count(DISTINCT Equipment) AS trucks FROM r""")
def fuel_checks(spark, sf_dir):
    checks = fuel.fuel_checks(fuel.dispatch_readings(fuel_dispatch(spark, sf_dir)))
    trucks = checks["equipment"].agg(F.count(F.lit(1)).alias("n")).scalar()
    dates = checks["dates"]
    return checks["fuel"].select("count", "mean", "q50").withColumns({
        "first": dates.select("first").scalar(), "last": dates.select("last").scalar(),
        "trucks": trucks,
    })


@query("fuel_overlay", having("sensor", "fuel_readings",
       k="""SELECT * FROM sensor WHERE TimeStamp IS NOT NULL
            AND NOT (Speed IS NULL AND RPM IS NULL AND FuelLevel IS NULL)""")
       + f"""SELECT 'sensor' AS source, {stamp("date_trunc('second', TimeStamp)", 'time')},
           {dec('FuelLevelLiters', 'liters')} FROM k
           WHERE Equipment = 'T-210' AND CAST(TimeStamp AS DATE) = DATE '2024-01-05'
       UNION ALL SELECT 'validation', {stamp("CAST(ShiftDate || ' ' || TimeStamp AS TIMESTAMP)", 'time')},
           {dec('FuelLevelLiters', 'liters')} FROM fuel_readings
           WHERE Equipment = 'T-210' AND ShiftDate = DATE '2024-01-05'""")
def overlay(spark, sf_dir):
    cleaned = wide.clean_full(sensor(spark, sf_dir), "sensor")
    return fuel.fuel_overlay(cleaned, fuel_readings(spark, sf_dir), "T-210", "2024-01-05")


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = ["l_linestatus", "l_orderkey", "l_linenumber"]


@query("pair_stack", having("grid", p="""SELECT l_linestatus, l_orderkey, l_linenumber, 0 AS pair,
       l_quantity AS first, l_extendedprice AS second FROM grid
       UNION ALL SELECT l_linestatus, l_orderkey, l_linenumber, 1, l_discount, l_tax FROM grid""")
       + f"""SELECT l_linestatus, l_orderkey, l_linenumber, pair, {dec('first', 'first')}, {dec('second', 'second')}
           FROM p WHERE first IS NOT NULL OR second IS NOT NULL""")
def pair_stack(spark, sf_dir):
    stacked = stack_pairs(grid(spark, sf_dir), _KEYS, _COLUMNS)
    return stacked.withColumns({c: to_number(c) for c in ("first", "second")})


@query("drop_third_cols", having("grid")
       + f"""SELECT l_linestatus, l_orderkey, l_linenumber, {dec('l_quantity', 'l_quantity')},
           {dec('l_discount', 'l_discount')}, {dec('l_tax', 'l_tax')} FROM grid""")
def drop_third_cols(spark, sf_dir):
    return grid(spark, sf_dir).select(*_KEYS, *every_third_dropped(_COLUMNS))


@query("cell_restructure", """SELECT CAST(l_orderkey AS VARCHAR) AS sheet, CAST(0 AS BIGINT) AS pair,
       CAST(l_linenumber AS BIGINT) AS row, round(l_quantity, 6) + 0.0 AS first, round(l_discount, 6) + 0.0 AS second
       FROM lineitem""")
def cell_restructure(spark, sf_dir):
    """A sheet per order. Columns 2 and 5 of five are dropped; of three left the last has no partner."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.lit("lines").alias("file"), F.col("l_orderkey").alias("sheet_no"),
        F.col("l_orderkey").cast("string").alias("sheet"), F.col("l_linenumber").alias("row"),
        F.array(*[F.col(c).cast("string") for c in names]).alias("values"),
    )
    out = fuel.restructure(rows).drop("file", "sheet_no")
    return out.withColumns({c: to_number(c) for c in ("first", "second")})


@query("text_functions", """SELECT o_orderkey, upper(trim(' ' || o_orderpriority || ' ')) AS tidy,
       nullif(regexp_extract(CAST(o_custkey AS VARCHAR), '[0-9]{3}'), '') AS digits,
       CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 3 THEN lpad(CAST(o_custkey AS VARCHAR), 3, '0')
            ELSE CAST(o_custkey AS VARCHAR) END AS filled,
       'T-' || CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 3 THEN lpad(CAST(o_custkey AS VARCHAR), 3, '0')
            ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders""")
def text_functions(spark, sf_dir):
    from pitsignal.catalog.views import table

    cust = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        tidy_upper(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("tidy"),
        first_three_digits(cust).alias("digits"), zero_fill(cust).alias("filled"),
        truck_code(cust).alias("code"),
    )


@query("sheet_text", """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS banner,
       o_custkey % 2 = 0 AS header, true AS digits,
       o_orderstatus <> 'F' AS plain_number, format('{:,}', CAST(o_custkey AS BIGINT)) AS shown FROM orders""")
def sheet_text(spark, sf_dir):
    from pitsignal.catalog.views import table
    from pitsignal.functions import text

    o = table(spark, sf_dir, "orders")
    banner = F.concat(F.lit("Equipo CAEX "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    header = F.when(F.col("o_custkey") % 2 == 0, "x CODIGO EQ. y").otherwise("RECEPCION")
    amount = F.when(F.col("o_orderstatus") == "F", "1.2.3").otherwise(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))
    )
    return o.select(
        "o_orderkey", text.banner_date(banner).alias("banner"),
        text.is_code_header(header).alias("header"),
        text.is_digits(F.col("o_custkey").cast("string")).alias("digits"),
        text.is_plain_number(amount).alias("plain_number"),
        text.grouped_number("o_custkey").alias("shown"),
    )
