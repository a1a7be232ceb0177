"""Exact quantiles (linear interpolation) of groups of any size, by radix selection.

A value is turned into a whole number of 64 bits that is ordered as the values are (``functions.maths.ordered_bits``). Four
passes fix 16 bits each: rows are counted per group and prefix, and only prefixes that hold a wanted rank are
looked at in the next pass. A pass sends counts, at most 65,536 per looked-at prefix and task, so neither far outliers, nor
infinities, nor a group with most of the rows put many values into one task. A pass hands on a row per group and wanted
rank at most; rows meet it by group and prefix, spread over tasks. No job runs before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.maths import from_ordered_bits, ordered_bits
from pitsignal.operators.keyed import join_keys, spread_join

#: Bits that are left open after each pass.
OPEN_BITS = (48, 32, 16, 0)


def _wanted(cells: DataFrame, group: list[str], part: list[str]) -> DataFrame:
    """Of counted prefixes those that hold wanted ranks.

    ``__base`` becomes the number of smaller values of the group, ``__ranks`` the ranks in the prefix. ``part`` are the columns of
    which each group of values holds the prefixes of one looked-at prefix.
    """
    upto = F.sum("__n").over(Window.partitionBy(*group, *part).orderBy("__prefix"))
    placed = cells.withColumn("__base", F.col("__base") + upto - F.col("__n"))
    held = F.filter("__ranks", lambda r: (r >= F.col("__base")) & (r < F.col("__base") + F.col("__n")))
    return placed.withColumn("__ranks", held).filter(F.size("__ranks") > 0)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None, few: bool = False
) -> DataFrame:
    """One row per key with ``quantiles``, an array in the order of ``probs``.

    With ``weight`` each row stands for that many equal values. Nulls are left out. NaN is greater than any number. ``few`` says that
    the number of keys is fixed by the caller, as with columns, and does not grow with the data.
    """
    n = F.col(weight) if weight else F.lit(1)
    group, few = (keys, few) if keys else (["__all"], True)
    named = df if keys else df.withColumn("__all", F.lit(0))
    rows = named.filter(F.col(value).isNotNull()).select(
        *group, ordered_bits(F.col(value).cast("double")).alias("__key"), n.cast("bigint").alias("__n")
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__total") - 1)

    ranks = F.array_distinct(F.array(*[f(position(p)).cast("bigint") for p in probs for f in (F.floor, F.ceil)]))
    counts = rows.groupBy(*group, F.shiftright("__key", OPEN_BITS[0]).alias("__prefix")).agg(F.sum("__n").alias("__n"))
    counts = counts.withColumn("__total", F.sum("__n").over(Window.partitionBy(*group)))
    counts = counts.withColumns({"__ranks": ranks, "__base": F.lit(0).cast("bigint")})
    cells = _wanted(counts, group, [])
    for before, bits in zip(OPEN_BITS[:-1], OPEN_BITS[1:], strict=True):
        looked = cells.select(*group, F.col("__prefix").alias("__in"), "__base", "__ranks", "__total")
        placed = rows.withColumn("__in", F.shiftright("__key", before))
        on = [*group, "__in"]
        inside = join_keys(placed, F.broadcast(looked), on) if few else spread_join(placed, looked, on, ["__key"])
        kept = [F.first(c).alias(c) for c in ("__base", "__ranks", "__total")]
        counted = inside.groupBy(*on, F.shiftright("__key", bits).alias("__prefix")).agg(F.sum("__n").alias("__n"), *kept)
        cells = _wanted(counted, group, ["__in"])
    hits = cells.select(*group, "__total", from_ordered_bits("__prefix").alias("__v"), F.explode("__ranks").alias("__rank"))
    found = hits.groupBy(*group, "__total").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def interpolated(p: float) -> Column:
        pos, at = position(p), F.col("__at")
        low = F.element_at(at, F.floor(pos).cast("bigint"))
        high = F.element_at(at, F.ceil(pos).cast("bigint"))
        share = pos - F.floor(pos)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return found.select(*keys, F.array(*[interpolated(p) for p in probs]).alias("quantiles"))


def bounded_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """The same by the built-in aggregate, for groups that are small by their nature.

    Such are the rows of one series in one time bucket or at one time; a group's distinct values are held
    in one task.
    """
    n = F.col(weight) if weight else F.lit(1)
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs]), n)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(q.alias("quantiles"))
