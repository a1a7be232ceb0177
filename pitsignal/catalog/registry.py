"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.session import configure

# Moves means that end in an exact half off the rounding edge, on which two engines that
# add in different order would part.
TIE_SHIFT = 3e-8

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Run
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; its result is brought to plain comparable columns."""

    def register(run: Run) -> Run:
        @wraps(run)
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(run(configure(spark), sf_dir))

        QUERIES[name] = Registered(shown, sql)
        return run

    return register


def presentable(df: DataFrame) -> DataFrame:
    """Six decimals, long integers, and dates and times as text."""

    def show(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c + F.lit(TIE_SHIFT), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        return c.alias(f.name)

    return df.select(*[show(f) for f in df.schema.fields])


def dec(expression: str, alias: str) -> str:
    return f"round({expression} + {TIE_SHIFT}, 6) + 0.0 AS {alias}"


def stamp(expression: str, alias: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {alias}"


def day(expression: str, alias: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {alias}"


def big(expression: str, alias: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {alias}"
