"""Telemetry views over the given tables, in Spark and as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.functions.text import time_text

METRICS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").try_cast("double")


def _truck():
    return F.concat(F.lit("T-"), (F.lit(210) + F.col("user_id") % 14).cast("string"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", _truck().alias("truck"), F.col("event_type").alias("metric"),
        F.col("ts").cast("timestamp_ntz").alias("created_at_local"), "value",
        _k().alias("speed"),
        F.concat(F.lit("F"), (F.col("user_id") % 3).cast("string")).alias("fleet"),
    )


def telemetry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("event_id") % 23 == 0, F.lit(None))
        .when(F.col("event_id") % 29 == 0, "bad")
        .otherwise(time_text("created_at_local"))
    )
    return telemetry(spark, sf_dir).withColumn("created_at_local", text)


def _unless(divisor: int, value):
    return F.when(F.col("event_id") % divisor != 0, value)


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ShiftDate"),
        _unless(31, F.col("ts").cast("timestamp_ntz")).alias("TimeStamp"),
        _truck().alias("Equipment"),
        F.col("value").alias("FuelLevelLiters"),
        _unless(7, _k()).alias("Speed"),
        _unless(5, F.col("value") * 10).alias("RPM"),
        _unless(11, F.col("value")).alias("FuelLevel"),
        (_k() * 2 - 99).alias("Latitude"),
        (_k() * 4 - 200).alias("Longitude"),
    )


def keyed_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor view with the id of its event, for repeatable samples."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", _k().alias("Speed"), (F.col("value") * 10).alias("RPM"),
        (_k() * 2 - 99).alias("Latitude"), (_k() * 4 - 200).alias("Longitude"),
    )


def time_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "active").when(F.col("event_id") % 3 == 1, "idle")
    return table(spark, sf_dir, "events").select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ShiftDate"),
        _unless(31, F.col("ts").cast("timestamp_ntz")).alias("TimeStamp"),
        _truck().alias("Equipment"), status.alias("Status"),
        F.col("event_type").alias("Event"),
    )


def fuel_dispatch(
    spark: SparkSession, sf_dir: str, as_text: bool = False, keys: Sequence[str] = ()
) -> DataFrame:
    model = F.col("o_orderkey") % 3
    finished = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        *keys, F.concat(F.lit("CAM-"), (F.lit(200) + F.col("o_custkey") % 50).cast("string")).alias("Veh"),
        F.when(model == 0, " cat - 789c ").when(model == 1, "CAT - 793D").otherwise("other")
        .alias("Descripcion"),
        (F.date_format(finished, "d/M/yyyy H:m:s") if as_text else finished).alias("fin_desp"),
        (F.col("o_totalprice") / 1000).alias("volumCorregido"),
    )


def fuel_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated levels: the purchase events as readings."""
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.to_date("ts").alias("ShiftDate"), F.date_format("ts", "HH:mm:ss").alias("TimeStamp"),
        _truck().alias("Equipment"), F.col("value").alias("FuelLevelLiters"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def gap(rest: int, name: str):
        return F.when(F.col("l_orderkey") % 13 != rest, F.col(name)).alias(name)

    both = (F.col("l_orderkey") % 13).isin(2, 3)
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_orderkey", "l_linenumber",
        gap(0, "l_quantity"), gap(1, "l_extendedprice"),
        F.when(~both, F.col("l_discount")).alias("l_discount"),
        F.when(~(F.col("l_orderkey") % 13).isin(2, 4), F.col("l_tax")).alias("l_tax"),
    )


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.unionByName(events.filter(F.col("event_id") % 10 == 0))


# The same views as SQL, written apart from the Spark ones.
_K = "CAST(props->>'$.k' AS DOUBLE)"
_TRUCK = "'T-' || CAST(210 + user_id % 14 AS VARCHAR)"
SQL_VIEWS = {
    "telemetry": f"""SELECT event_id, {_TRUCK} AS truck, event_type AS metric,
        ts AS created_at_local, value, {_K} AS speed,
        'F' || CAST(user_id % 3 AS VARCHAR) AS fleet FROM events""",
    "telemetry_raw": f"""SELECT event_id, {_TRUCK} AS truck, event_type AS metric,
        CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'bad'
             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS created_at_local,
        value, {_K} AS speed, 'F' || CAST(user_id % 3 AS VARCHAR) AS fleet FROM events""",
    "sensor": f"""SELECT date_trunc('day', ts) AS ShiftDate,
        CASE WHEN event_id % 31 <> 0 THEN ts END AS TimeStamp,
        {_TRUCK} AS Equipment, value AS FuelLevelLiters,
        CASE WHEN event_id % 7 <> 0 THEN {_K} END AS Speed,
        CASE WHEN event_id % 5 <> 0 THEN value * 10 END AS RPM,
        CASE WHEN event_id % 11 <> 0 THEN value END AS FuelLevel,
        {_K} * 2 - 99 AS Latitude, {_K} * 4 - 200 AS Longitude FROM events""",
    "keyed_sensor": f"""SELECT event_id, {_K} AS Speed, value * 10 AS RPM,
        {_K} * 2 - 99 AS Latitude, {_K} * 4 - 200 AS Longitude FROM events""",
    "time_model": f"""SELECT date_trunc('day', ts) AS ShiftDate,
        CASE WHEN event_id % 31 <> 0 THEN ts END AS TimeStamp, {_TRUCK} AS Equipment,
        CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'idle' END AS Status,
        event_type AS Event FROM events""",
    "fuel_dispatch": """SELECT 'CAM-' || CAST(200 + o_custkey % 50 AS VARCHAR) AS Veh,
        CASE o_orderkey % 3 WHEN 0 THEN ' cat - 789c ' WHEN 1 THEN 'CAT - 793D'
             ELSE 'other' END AS Descripcion,
        CAST(o_orderdate AS TIMESTAMP) AS fin_desp,
        o_totalprice / 1000 AS volumCorregido FROM orders""",
    "fuel_readings": f"""SELECT CAST(ts AS DATE) AS ShiftDate,
        strftime(ts, '%H:%M:%S') AS TimeStamp, {_TRUCK} AS Equipment,
        value AS FuelLevelLiters FROM events WHERE event_type = 'purchase'""",
    "grid": """SELECT l_linestatus, l_orderkey, l_linenumber,
        CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END AS l_quantity,
        CASE WHEN l_orderkey % 13 <> 1 THEN l_extendedprice END AS l_extendedprice,
        CASE WHEN l_orderkey % 13 NOT IN (2, 3) THEN l_discount END AS l_discount,
        CASE WHEN l_orderkey % 13 NOT IN (2, 4) THEN l_tax END AS l_tax FROM lineitem""",
    "duplicated": """SELECT * FROM events UNION ALL
        SELECT * FROM events WHERE event_id % 10 = 0""",
}


def having(*names: str, **steps: str) -> str:
    """A WITH clause of the named views and of further named steps, in order."""
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    parts += [f"{n} AS ({s})" for n, s in steps.items()]
    return "WITH " + ",\n".join(parts) + "\n"
