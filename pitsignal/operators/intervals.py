"""Joins of time intervals that overlap, and tonnes moved per litre burnt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_SECONDS = 3600


def _cell(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", cell_seconds: int = CELL_SECONDS
) -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals share some time: structs ``l`` and ``r``.

    Of two overlapping intervals one begins inside the other. An interval is laid out over the time cells that it touches
    and meets there the intervals that begin in the cell, once with either side laid out; equal beginnings belong to the first
    join. So each pair is found once, in one cell, and a key with many rows is spread over its cells. An
    interval that does not end after its start, or lacks an end, overlaps nothing; null keys match nothing.
    """
    keys = list(keys)

    def whole(df: DataFrame, name: str) -> DataFrame:
        row = df.filter(F.col(start) < F.col(end)).select(F.struct(*df.columns).alias(name))
        return row

    def laid(df: DataFrame, name: str) -> DataFrame:
        # The end is open: an interval up to the border of a cell does not touch the next.
        last = F.floor((F.unix_micros(F.col(f"{name}.{end}").cast("timestamp")) - 1) / (cell_seconds * 1_000_000)).cast("bigint")
        cells = F.sequence(_cell(F.col(f"{name}.{start}"), cell_seconds), last)
        return df.select(name, F.explode(cells).alias("__cell"), *[F.col(f"{name}.{k}").alias(f"__k_{k}") for k in keys])

    def begun(df: DataFrame, name: str) -> DataFrame:
        cell = _cell(F.col(f"{name}.{start}"), cell_seconds).alias("__cell")
        return df.select(name, cell, *[F.col(f"{name}.{k}").alias(f"__k_{k}") for k in keys])

    a, b = whole(left, "l"), whole(right, "r")
    on = ["__cell", *[f"__k_{k}" for k in keys]]
    inside_left = laid(a, "l").join(begun(b, "r"), on).filter(
        (F.col(f"r.{start}") >= F.col(f"l.{start}")) & (F.col(f"r.{start}") < F.col(f"l.{end}"))
    )
    inside_right = laid(b, "r").join(begun(a, "l"), on).filter(
        (F.col(f"l.{start}") > F.col(f"r.{start}")) & (F.col(f"l.{start}") < F.col(f"r.{end}"))
    )
    return inside_left.select("l", "r").unionByName(inside_right.select("l", "r"))


def overlap_seconds(start: str = "start", end: str = "end") -> Column:
    """Seconds that the two rows of a pair share."""
    low = F.greatest(F.col(f"l.{start}"), F.col(f"r.{start}"))
    high = F.least(F.col(f"l.{end}"), F.col(f"r.{end}"))
    return (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / 1e6


def load_efficiency(
    loads: DataFrame, fuel: DataFrame, keys: Sequence[str], load_id: str, tonnes: str = "tonnes", litres: str = "litres",
    start: str = "start", end: str = "end", cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """Per load its tonnes, the litres burnt during it, and ``tonnes_per_litre``.

    Fuel burns evenly over its interval, so a load gets the litres of each interval by the share of it that falls into
    the load. Loads without fuel have 0 litres and no efficiency. ``load_id`` tells the loads apart.
    """
    pairs = overlapping(loads, fuel, keys, start, end, cell_seconds)
    spell = (F.unix_micros(F.col(f"r.{end}").cast("timestamp")) - F.unix_micros(F.col(f"r.{start}").cast("timestamp"))) / 1e6
    burnt = pairs.select(F.col(f"l.{load_id}").alias("__id"), (F.col(f"r.{litres}") * overlap_seconds(start, end) / spell).alias("__litres"))
    summed = burnt.groupBy("__id").agg(F.sum("__litres").alias("__litres"))
    joined = loads.join(summed, F.col(load_id) == F.col("__id"), "left")
    used = F.coalesce("__litres", F.lit(0.0))
    return joined.select(
        *keys, load_id, start, F.col(tonnes).cast("double").alias("tonnes"), used.alias("litres"),
        F.when(used > 0, F.col(tonnes) / used).alias("tonnes_per_litre"),
    )


def efficiency_by(per_load: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loads, tonnes, litres and tonnes per litre of groups of loads."""
    out = per_load.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loads"), F.sum("tonnes").alias("tonnes"), F.sum("litres").alias("litres"),
    )
    return out.withColumn("tonnes_per_litre", F.when(F.col("litres") > 0, F.col("tonnes") / F.col("litres")))
