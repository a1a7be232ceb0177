"""Row-to-row operators over time: gaps, order checks, trailing means.

A window over a whole truck, or a whole table, would put it in one task. Rows are cut
into chunks instead, each chunk is handled by itself, and the value a chunk needs from
its predecessor comes from a table of one row per chunk. That table is stitched the same
way on the next coarser chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.times import seconds_between
from pitsignal.operators.keyed import join_keys
from pitsignal.operators.shaping import number_rows

Chunker = Callable[[Column], Column]


def by_unit(unit: str) -> Chunker:
    return lambda order: F.date_trunc(unit, order)


def by_range(width: int) -> Chunker:
    return lambda order: F.floor(order / F.lit(width)).cast("bigint")


# Width of the ranges into which an integer order is cut.
RANGE_ROWS = 1_000_000

# Rows of a block of the trailing mean.
BLOCK_ROWS = 100_000


def time_chunks() -> list[Chunker]:
    """Chunks for stitching, finest first: hours of a key, then its days."""
    return [by_unit("hour"), by_unit("day")]


def stitched_lag(
    df: DataFrame,
    keys: list[str],
    order: str,
    carry: str,
    chunkers: list[Chunker],
    out: str = "previous",
) -> DataFrame:
    """Add ``out``, the value of ``carry`` in the row before, per key in ``order``."""
    if not chunkers:
        partition = keys or [F.lit(0)]
        w = Window.partitionBy(*partition).orderBy(order)
        return df.withColumn(out, F.lag(carry).over(w))
    level = len(chunkers)
    mark, last, kept, before = (f"__{n}{level}" for n in ("chunk", "last", "kept", "before"))
    chunk = [*keys, mark]
    cut = df.withColumn(mark, chunkers[0](F.col(order)))
    tails = cut.groupBy(*chunk).agg(
        F.max(order).alias(last), F.max_by(carry, order).alias(kept)
    )
    linked = stitched_lag(tails, keys, last, kept, chunkers[1:], before)
    in_chunk = Window.partitionBy(*chunk).orderBy(order)
    inner = cut.withColumn("__inner", F.lag(F.struct(F.col(carry).alias("c"))).over(in_chunk))
    joined = join_keys(inner, linked.select(*chunk, before), chunk, "left")
    value = F.when(F.col("__inner").isNotNull(), F.col("__inner.c")).otherwise(F.col(before))
    return joined.withColumn(out, value).drop("__inner", before, mark)


def distinct_times(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Distinct times per key with how often each occurs."""
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.col(ts).alias("time"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def linked_times(times: DataFrame, keys: list[str], chunkers: list[Chunker]) -> DataFrame:
    """``distinct_times`` with ``gap``, the seconds since the time before it."""
    linked = stitched_lag(times, keys, "time", "time", chunkers)
    return linked.withColumn("gap", seconds_between("time", "previous")).drop("previous")


def gap_counts(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """How often each gap in seconds occurs per key; repeated times are gaps of zero."""
    gaps = linked_times(distinct_times(df, keys, ts), keys, time_chunks())
    entries = F.array(
        F.struct(F.col("gap").alias("gap"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("n")),
    )
    return (
        gaps.select(*keys, F.inline(entries))
        .filter(F.col("gap").isNotNull() & (F.col("n") > 0))
        .groupBy(*keys, "gap")
        .agg(F.sum("n").alias("n"))
    )


def row_gaps(df: DataFrame, keys: list[str], order: str, ts: str, width: int = RANGE_ROWS) -> DataFrame:
    """Every row with ``gap_seconds`` to the row before it, by a unique integer ``order``."""
    linked = stitched_lag(df, keys, order, ts, [by_range(width)])
    return linked.withColumn("gap_seconds", seconds_between(ts, "previous")).drop("previous")


def order_violations(
    df: DataFrame, keys: list[str], order: str, ts: str, width: int = RANGE_ROWS
) -> DataFrame:
    """Rows per key whose time is before that of the row ahead of them."""
    linked = stitched_lag(df, keys, order, ts, [by_range(width)])
    return linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts) < F.col("previous")).alias("violations")
    )


def trailing_mean(
    df: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    out: str,
    rows: int = 5,
    unit: str | None = None,
    ties: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the current and up to ``rows - 1`` earlier rows, at least one row.

    Rows of one time follow the columns ``ties``, then a hash of the row, so the result does not hang on
    how the rows are dealt; rows without a time come first.

    Rows are numbered over the whole table and cut into blocks of ``block_rows``; the last ``rows - 1``
    rows of a block are sent to the next one, too. A block is of one size whatever a key or a day holds.
    With ``unit`` (``hour``, ``day``, ...) the rows of a key are cut by the clock instead and
    each chunk is given the last rows of the chunks before it, which saves the numbering where
    a chunk is small by nature, as one row per bucket is.
    """
    frame = (-(rows - 1), 0)
    if unit is None:
        width = max(block_rows, rows)
        numbered = number_rows(df, [*keys, ts, *ties], "__n")
        own = F.floor(F.col("__n") / width).cast("bigint")
        blocks = F.when(F.pmod("__n", F.lit(width)) > width - rows, F.array(own, own + 1)).otherwise(F.array(own))
        w = Window.partitionBy(*keys, "__block").orderBy("__n").rowsBetween(*frame)
        return (
            numbered.withColumns({"__own": own, "__block": F.explode(blocks)})
            .withColumn(out, F.avg(value).over(w))
            .filter(F.col("__block") == F.col("__own"))
            .drop("__n", "__own", "__block")
        )

    chunk = [*keys, "__chunk"]
    place = ["__time", "__tie"]
    cut = df.withColumns({
        "__chunk": F.date_trunc(unit, F.col(ts)), "__time": F.col(ts),
        "__tie": F.struct(*ties, F.xxhash64(*df.columns).alias("__hash")), "__value": F.col(value),
        "__row": F.struct(*df.columns),
    }).select(*chunk, *place, "__value", "__row")
    newest_first = Window.partitionBy(*chunk).orderBy(*[F.desc(c) for c in place])
    tails = (
        cut.withColumn("__nth", F.row_number().over(newest_first))
        .filter(F.col("__nth") < rows)
        .groupBy(*chunk)
        .agg(F.collect_list(F.struct(*place, "__value")).alias("__tail"))
    )
    chunks_in_order = Window.partitionBy(*keys).orderBy("__chunk")
    empty = F.array().cast(tails.schema["__tail"].dataType)
    before = F.concat(*[
        F.coalesce(F.lag("__tail", i).over(chunks_in_order), empty) for i in range(1, rows)
    ])
    halo = (
        tails.withColumn("__before", before)
        .withColumn("__before", F.slice(F.sort_array("__before", asc=False), 1, rows - 1))
        .select(*chunk, F.inline("__before"))
        .withColumn("__row", F.lit(None).cast(cut.schema["__row"].dataType))
    )
    w = Window.partitionBy(*chunk).orderBy(*place).rowsBetween(*frame)
    return (
        cut.unionByName(halo)
        .withColumn("__mean", F.avg("__value").over(w))
        .filter(F.col("__row").isNotNull())
        .select("__row.*", F.col("__mean").alias(out))
    )
