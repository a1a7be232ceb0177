"""Scans and sinks: the given tables written as raw files and read back."""

import pyarrow as pa
from pyspark.sql import functions as F

from pitsignal.catalog.cleaning import _PARSED
from pitsignal.catalog.explore import _OUT
from pitsignal.catalog.fuel import _DISPATCH, _RESULT
from pitsignal.catalog.registry import dec, query, stamp
from pitsignal.catalog.views import _truck, fuel_dispatch, having, table, telemetry, telemetry_raw
from pitsignal.functions.maths import to_number
from pitsignal.functions.text import time_text
from pitsignal.layouts import SENSOR_COLUMNS
from pitsignal.operators import distribution, filters, sequence
from pitsignal.plans import fuel, temporal, wide
from pitsignal.session import land, scratch_dir
from pitsignal.sinks import files as sinks
from pitsignal.sinks.workbook import sheet_texts, write_arrow, write_lines, write_sheets, write_workbooks
from pitsignal.sources import columnar, delimited, files, loader, quoted, workbook
from pitsignal.sources.files import open_output


def _sensor_text(spark, sf_dir):
    """All fifteen sensor columns as text, with the event id as the record duration."""
    k = F.get_json_object("props", "$.k")
    shown = {
        "ShiftDate": F.date_format("ts", "yyyy-MM-dd"), "Shift": F.lit("day"),
        "TimeStamp": time_text("ts"), "RecordDuration": F.col("event_id").cast("string"),
        "Equipment": _truck(), "TruckFleet": F.col("event_type"), "FuelLevel": F.col("value").cast("string"),
        "FuelLevelLiters": F.when(F.col("event_id") % 9 != 0, F.col("value").cast("string")),
        "FuelGauge": F.lit("x"), "Speed": k, "RPM": (F.col("value") * 10).cast("string"),
        "Ralenti": F.lit(None).cast("string"), "Latitude": k, "Longitude": k, "Elevation": F.lit("0"),
    }
    events = table(spark, sf_dir, "events")
    return events.select(*[shown[c].alias(c) for c in SENSOR_COLUMNS])


def _write_sensor_lines(spark, sf_dir, base: str) -> None:
    """Comma, semicolon and tab files by truck; every 37th line has a surplus field."""
    kind = F.substring("Equipment", 3, 3).cast("int") % 3
    separator = F.when(kind == 0, ",").when(kind == 1, ";").otherwise("\t")
    fields = [F.coalesce(c, F.lit("")) for c in SENSOR_COLUMNS]
    surplus = F.when(F.col("RecordDuration").cast("bigint") % 37 == 0, F.concat(separator, F.lit("more")))
    lines = _sensor_text(spark, sf_dir).select(
        F.col("Equipment").alias("stem"), F.when(kind == 2, "tsv").otherwise("csv").alias("extension"),
        F.array_join(F.array(*[F.lit(c) for c in SENSOR_COLUMNS]), "\x01").alias("header"),
        F.array_join(F.array(*fields), "\x01").alias("line"), separator.alias("sep"),
        F.coalesce(surplus, F.lit("")).alias("tail"),
    ).select(
        "stem", "extension", F.replace("header", F.lit("\x01"), F.col("sep")).alias("header"),
        F.concat(F.replace("line", F.lit("\x01"), F.col("sep")), F.col("tail")).alias("line"),
    )
    write_lines(lines, f"{base}/val_data_sensor/raw")


_SENSOR_SQL = f"""SELECT event_id AS "RecordDuration", 'T-' || CAST(210 + user_id % 14 AS VARCHAR) AS "Equipment",
    {stamp('ts', '"TimeStamp"')}, {dec("CASE WHEN event_id % 9 <> 0 THEN value END", '"FuelLevelLiters"')},
    {dec("CAST(props->>'$.k' AS DOUBLE)", '"Speed"')} FROM events"""


def _shown(df):
    typed = wide.typed(df, SENSOR_COLUMNS)
    return typed.select(
        F.col("RecordDuration").cast("bigint").alias("RecordDuration"), "Equipment", "TimeStamp",
        "FuelLevelLiters", "Speed",
    )


@query("scan_delimited", _SENSOR_SQL)
def scan_delimited(spark, sf_dir):
    base = scratch_dir(spark, "delimited")
    _write_sensor_lines(spark, sf_dir, base)
    return _shown(loader.load_datasets(spark, base, "val_data", "*", ordered=False).datasets["sensor"])


@query("scan_strict", _SENSOR_SQL + " WHERE event_id % 37 <> 0")
def scan_strict(spark, sf_dir):
    base = scratch_dir(spark, "strict")
    _write_sensor_lines(spark, sf_dir, base)
    loaded = loader.load_datasets(spark, base, "val_data", "*", drop_long_rows=True, ordered=False)
    return _shown(loaded.datasets["sensor"])


@query("scan_sorted", """SELECT 'T-' || CAST(210 + user_id % 14 AS VARCHAR) AS "Equipment", count(*) AS n FROM events
       WHERE 210 + user_id % 14 = 213 GROUP BY 1""")
def scan_sorted(spark, sf_dir):
    """One truck's files in time order."""
    base = scratch_dir(spark, "sorted")
    _write_sensor_lines(spark, sf_dir, base)
    sensor = loader.load_datasets(spark, base, "val_data", "t-213").datasets["sensor"]
    return sensor.groupBy("Equipment").agg(F.count(F.lit(1)).alias("n"))


@query("load_order", f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violations, {stamp('min(ts)', 'first')}, {stamp('max(ts)', 'last')}
       FROM events""")
def load_order(spark, sf_dir):
    """All trucks' files in time order: every row against the one before it, across the borders of partitions, too."""
    base = scratch_dir(spark, "order")
    _write_sensor_lines(spark, sf_dir, base)
    loaded = loader.load_datasets(spark, base, "val_data", "*").datasets["sensor"]
    # The place is fixed by landing the loaded order once.
    placed = land(loaded.select("TimeStamp", F.monotonically_increasing_id().alias("place")), "order")
    ends = placed.agg(F.min_by("TimeStamp", "place").alias("first"), F.max_by("TimeStamp", "place").alias("last"))
    shown = [F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("first", "last")]
    ends = ends.select(*shown)
    return sequence.order_violations(placed, [], "place", "TimeStamp").withColumns({
        c: ends.select(c).scalar() for c in ends.columns
    })


@query("separators", """SELECT CASE (210 + user_id % 14) % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS separator,
       count(DISTINCT user_id % 14) AS trucks FROM events GROUP BY 1""")
def separators(spark, sf_dir):
    base = scratch_dir(spark, "separators")
    _write_sensor_lines(spark, sf_dir, base)
    listed = files.list_files(spark, files.file_pattern(base, "val_data", "sensor"))
    marked = delimited.detect_separators(listed).withColumn("truck", files.truck_of("path"))
    return marked.groupBy("separator").agg(F.count_distinct("truck").alias("trucks"))


@query("unreadable_files", "SELECT 'unsupported extension' AS reason, count(DISTINCT user_id % 14) AS trucks FROM events")
def unreadable_files(spark, sf_dir):
    base = scratch_dir(spark, "unreadable")
    lines = table(spark, sf_dir, "events").groupBy(_truck().alias("stem")).agg(
        F.lit("log").alias("extension"), F.lit("note").alias("header"),
        F.count(F.lit(1)).cast("string").alias("line"),
    )
    write_lines(lines, f"{base}/val_data_sensor/raw")
    bad = loader.load_datasets(spark, base, "val_data", "*").unreadable
    truck = files.truck_of("path")
    return bad.groupBy("reason").agg(F.count_distinct(truck).alias("trucks"))


@query("scan_parquet", _SENSOR_SQL)
def scan_parquet(spark, sf_dir):
    folder = scratch_dir(spark, "parquet")
    _sensor_text(spark, sf_dir).write.parquet(folder)
    return _shown(columnar.read_parquet(spark, folder))


@query("scan_arrow", _SENSOR_SQL)
def scan_arrow(spark, sf_dir):
    folder = scratch_dir(spark, "arrow")
    write_arrow(_sensor_text(spark, sf_dir), folder, "sensor")
    return _shown(columnar.read_arrow(spark, f"{folder}/*.feather"))


# Rows per sheet of the workbooks written here, well under the limit of the format.
SHEET_ROWS = 100_000


@query("scan_workbook", _SENSOR_SQL)
def scan_workbook(spark, sf_dir):
    """Positional workbook scan; the first row of each sheet is skipped."""
    base = scratch_dir(spark, "workbook")
    event = F.col("RecordDuration").cast("bigint")
    rows = _sensor_text(spark, sf_dir).select(
        F.floor(event / SHEET_ROWS).cast("string").alias("sheet"),
        (event % SHEET_ROWS + 2).cast("int").alias("row"), F.array(*SENSOR_COLUMNS).alias("values"),
    )
    _one_book_per_sheet(_with_head(rows, SENSOR_COLUMNS), f"{base}/val_data_sensor/raw", "T-210")
    return _shown(loader.load_datasets(spark, base, "val_data", "T-210", ordered=False).datasets["sensor"])


@query("fuel_dispatch_workbook", having("fuel_dispatch", r=_DISPATCH) + f"SELECT {_RESULT} FROM r")
def fuel_dispatch_workbook(spark, sf_dir):
    """Dispatch workbooks with a header row and a column that is not wanted."""
    folder = scratch_dir(spark, "dispatch")
    names = ["Turno", "Veh", "Descripcion", "fin_desp", "volumCorregido"]
    text = fuel_dispatch(spark, sf_dir, as_text=True, keys=["o_orderkey"]).withColumn("Turno", F.lit("A"))
    rows = text.select(
        F.floor(F.col("o_orderkey") / SHEET_ROWS).cast("string").alias("sheet"),
        (F.col("o_orderkey") % SHEET_ROWS + 2).cast("int").alias("row"),
        F.array(*[F.col(c).cast("string") for c in names]).alias("values"),
    )
    _one_book_per_sheet(_with_head(rows, names), folder, "despacho")
    raw, _ = workbook.read_named(spark, names[1:], f"{folder}/despacho*.xlsx")
    return fuel.dispatch_readings(raw.withColumn("volumCorregido", to_number("volumCorregido")))


def _with_head(rows, names):
    head = F.array(*[F.lit(c) for c in names])
    return rows.unionByName(rows.select("sheet").distinct().select(
        "sheet", F.lit(1).alias("row"), head.alias("values")
    ))


def _one_book_per_sheet(rows, folder: str, stem: str) -> None:
    def write(batches):
        for name, texts in sheet_texts(batches):
            with open_output(f"{folder}/{stem}_{name}.xlsx") as target:
                yield pa.RecordBatch.from_pydict({"n": pa.array([write_sheets(target, [(name, texts)])], pa.int32())})

    placed = rows.select("sheet", "row", "values").repartition("sheet").sortWithinPartitions("sheet", "row")
    placed.mapInArrow(write, "n int").agg(F.sum("n")).collect()


_SHEET_DISPATCH = """SELECT CAST(o_orderdate AS DATE) AS d, '00:00:00' AS TimeStamp,
    'T-' || CAST(200 + o_custkey % 50 AS VARCHAR) AS Equipment, round(o_totalprice) AS liters FROM orders
    WHERE 200 + o_custkey % 50 BETWEEN 210 AND 225 OR 200 + o_custkey % 50 BETWEEN 230 AND 243"""


@query("equipment_sheets", f"WITH r AS ({_SHEET_DISPATCH}) SELECT {_RESULT} FROM r")
def equipment_sheets(spark, sf_dir):
    """Sheets by order date: banner, code header, then code, reception and fuel."""
    folder = scratch_dir(spark, "sheets")
    block = F.floor(F.col("o_orderkey") / SHEET_ROWS).cast("string")
    orders = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "o_orderkey",
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd "), block).alias("sheet"),
        F.array(
            F.lit(None), (F.lit(200) + F.col("o_custkey") % 50).cast("string"), F.lit("r"),
            F.round("o_totalprice").cast("bigint").cast("string"),
        ).alias("values"),
    )
    body = fuel.number_in_order(orders, ["sheet"], ["o_orderkey"], "n").select(
        "sheet", (F.col("n") + 2).alias("row"), "values"
    )
    tops = orders.select("sheet", "date").distinct()
    banner = tops.select("sheet", F.lit(1).alias("row"), F.array(
        F.concat(F.lit("Equipo CAEX "), F.date_format(F.to_date("date"), "d/M/yyyy"))
    ).alias("values"))
    header = tops.select("sheet", F.lit(2).alias("row"), F.array(
        F.lit("N"), F.lit("CODIGO EQ."), F.lit("RECEPCION"), F.lit("LITROS")
    ).alias("values"))
    write_workbooks(body.unionByName(banner).unionByName(header), folder, "equipo")
    rows = workbook.landed_rows(spark, f"{folder}/equipo*.xlsx")
    return fuel.sheet_readings(rows.filter(F.col("error").isNull())).select(*fuel.RESULT)


@query("workbook_grid", """SELECT (s_suppkey // 100000) AS sheet, 2 + s_suppkey % 100000 AS row,
       CAST(c AS BIGINT) AS col, CASE c WHEN 1 THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS value
       FROM supplier CROSS JOIN (VALUES (1), (3)) v(c)""")
def workbook_grid(spark, sf_dir):
    """Every non-empty cell of all sheets; the second column is empty."""
    folder = scratch_dir(spark, "grid")
    rows = table(spark, sf_dir, "supplier").select(
        F.floor(F.col("s_suppkey") / SHEET_ROWS).cast("string").alias("sheet"),
        (F.col("s_suppkey") % SHEET_ROWS + 2).cast("int").alias("row"),
        F.array("s_name", F.lit(None), F.col("s_nationkey").cast("string")).alias("values"),
    )
    write_workbooks(rows, folder, "grid")
    cells = workbook.workbook_cells(workbook.workbook_rows(spark, f"{folder}/grid*.xlsx"))
    return cells.select(F.col("sheet").cast("bigint").alias("sheet"), "row", "col", "value")


@query("workbook_restructure", """SELECT l_suppkey || '-' || (l_orderkey // 100000) AS sheet,
       round(l_quantity, 6) + 0.0 AS first, round(l_discount, 6) + 0.0 AS second FROM lineitem""")
def workbook_restructure(spark, sf_dir):
    """Sheets by supplier, five columns: two are dropped, the last has no partner."""
    folder = scratch_dir(spark, "restructure")
    block = F.floor(F.col("l_orderkey") / SHEET_ROWS).cast("string")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), block).alias("sheet"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array(*[F.col(c).cast("string") for c in (
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")]).alias("values"),
    )
    rows = fuel.number_in_order(lines, ["sheet"], ["l_orderkey", "l_linenumber", "l_partkey"], "row")
    write_workbooks(rows, folder, "EQUIPO")
    read = workbook.landed_rows(spark, f"{folder}/EQUIPO*.xlsx")
    target = f"{folder}-restructured"
    sinks.write_restructured(fuel.restructure(read.filter(F.col("error").isNull())), folder, target)
    stacked = columnar.read_parquet(spark, target)
    return stacked.select("sheet", to_number("first").alias("first"), to_number("second").alias("second"))


@query("json_merge", """SELECT CAST(user_id AS VARCHAR) AS key, max(event_type) AS value
       FROM events GROUP BY user_id""")
def json_merge(spark, sf_dir):
    """Object files by event type and block of users; for each user the last file wins."""
    base = scratch_dir(spark, "json")
    users = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    block = F.floor(F.col("user_id") / 1000).cast("string")
    entry = F.struct(F.col("user_id").cast("string").alias("u"), "event_type")
    objects = users.groupBy("event_type", block.alias("block")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("line")
    )
    write_lines(objects.select(
        F.concat_ws("-", F.lit("T"), "event_type", "block").alias("stem"), F.lit("json").alias("extension"),
        F.lit("").alias("header"), "line",
    ), f"{base}/val_data_sensor/raw")
    return loader.load_objects(spark, base, "val_data", "*", ["sensor"])["sensor"]


@query("csv_copy", f"""SELECT c_custkey, c_name, c_nationkey, {dec('c_acctbal', 'c_acctbal')}, c_mktsegment FROM customer""")
def csv_copy(spark, sf_dir):
    folder = scratch_dir(spark, "copy")
    rows = table(spark, sf_dir, "customer")
    sinks.write_csv(rows, f"{folder}/a")
    sinks.copy_csv(spark, f"{folder}/a", f"{folder}/b")
    return delimited.read_headed(spark, f"{folder}/b", rows.schema)


@query("quarantine_saved", having("telemetry_raw", p=_PARSED)
       + f"SELECT event_id, metric, {dec('value', 'value')} FROM p WHERE created_at_local IS NULL")
def quarantine_saved(spark, sf_dir):
    path = scratch_dir(spark, "quarantine")
    parsed = temporal.parse_times(telemetry_raw(spark, sf_dir)).select(
        "event_id", "metric", "value", "created_at_local"
    )
    sinks.write_quarantine(parsed, "created_at_local", path)
    return delimited.read_headed(
        spark, path, "event_id bigint, metric string, value double, created_at_local string"
    ).drop("created_at_local")


@query("outliers_saved", having("telemetry", o=_OUT) + f"SELECT event_id, {dec('value', 'value')} FROM o")
def outliers_saved(spark, sf_dir):
    path = scratch_dir(spark, "outliers")
    rows = telemetry(spark, sf_dir).select("event_id", "value")
    sinks.write_csv(filters.iqr_outliers(rows, "value"), path)
    return delimited.read_headed(spark, path, "event_id bigint, value double")


@query("fuel_saved", having("fuel_dispatch", r=_DISPATCH) + f"SELECT {_RESULT} FROM r")
def fuel_saved(spark, sf_dir):
    path = scratch_dir(spark, "fuel")
    sinks.write_csv(fuel.dispatch_readings(fuel_dispatch(spark, sf_dir)), path)
    return delimited.read_headed(
        spark, path, "ShiftDate date, TimeStamp string, Equipment string, FuelLevelLiters double"
    )


@query("report_saved", having("telemetry")
       + f"""SELECT metric, {stamp("date_trunc('hour', created_at_local)", 'bucket')}, count(*) AS n
           FROM telemetry GROUP BY metric, date_trunc('hour', created_at_local)""")
def report_saved(spark, sf_dir):
    folder = scratch_dir(spark, "report")
    density = distribution.time_density(telemetry(spark, sf_dir), "created_at_local", ["metric"])
    path = sinks.write_report({"density": density}, folder)[0]
    return columnar.read_parquet(spark, path)


@query("scan_quoted", """SELECT doc_id, lang, length(text) AS n_chars, md5(text) AS digest,
       length(text) - length(replace(text, chr(10), '')) AS n_line_ends FROM documents""")
def scan_quoted(spark, sf_dir):
    """All documents written with quoted fields that hold line ends, and read back in splits."""
    folder = scratch_dir(spark, "quoted")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows.write.option("header", True).option("quoteAll", True).option("escape", quoted.QUOTE).csv(folder)
    text = F.col("text")
    return quoted.read_quoted(spark, folder, rows.schema).select(
        "doc_id", "lang", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("digest"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("n_line_ends"),
    )
