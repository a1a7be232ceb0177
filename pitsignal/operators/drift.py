"""How far the distribution of a period has moved from that of the period before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.keyed import join_keys, spread_join

CELLS = 20
#: Rows added to each cell of both periods, so that no cell is empty.
SMOOTHING = 0.5


def kl_drift(
    df: DataFrame, keys: Sequence[str], period: str, value: str, cells: int = CELLS, smoothing: float = SMOOTHING
) -> DataFrame:
    """Divergence of each period from the one before it, per key.

    ``period`` is a whole number. The earlier period sets the cells: ``cells`` of equal width between its least and greatest
    value, and one on either side for what lies beyond. Rows are counted per cell before the shuffle, as members of their own period
    and of the comparison with the period before. Returns ``period`` (the later one), rows of both periods, ``kl`` =
    sum of p ln(p / q) with p from the later and q from the earlier period, and ``psi`` = sum of (p - q) ln(p / q). Pairs of which
    either period has no values are left out. Null and NaN values do not count.
    """
    keys, edge = list(keys), [*keys, "__base"]
    rows = df.select(*keys, F.col(period).cast("bigint").alias("__at"), F.col(value).cast("double").alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v") & F.col("__at").isNotNull())
    ends = rows.groupBy(*keys, F.col("__at").alias("__base")).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    roles = F.array(
        F.struct(F.col("__at").alias("__base"), F.lit(1).alias("__q"), F.lit(0).alias("__p")),
        F.struct((F.col("__at") - 1).alias("__base"), F.lit(0).alias("__q"), F.lit(1).alias("__p")),
    )
    placed = spread_join(rows.select(*keys, "__v", F.inline(roles)), ends, edge, ["__v", "__p"])
    width = (F.col("__hi") - F.col("__lo")) / cells
    inside = F.when(F.col("__hi") == F.col("__lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(cells - 1)) + 1
    )
    cell = F.when(F.col("__v") < F.col("__lo"), 0).when(F.col("__v") > F.col("__hi"), cells + 1).otherwise(inside).cast("int")
    counts = placed.groupBy(*edge, cell.alias("__cell")).agg(F.sum("__q").alias("__q"), F.sum("__p").alias("__p"))
    totals = counts.groupBy(*edge).agg(F.sum("__q").alias("rows_before"), F.sum("__p").alias("rows"))
    totals = totals.filter((F.col("rows_before") > 0) & (F.col("rows") > 0))
    every = totals.withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(cells + 1))))
    full = join_keys(every, counts, [*edge, "__cell"], "left")
    extra = smoothing * (cells + 2)
    p = (F.coalesce("__p", F.lit(0)) + smoothing) / (F.col("rows") + extra)
    q = (F.coalesce("__q", F.lit(0)) + smoothing) / (F.col("rows_before") + extra)
    return full.groupBy(*edge, "rows_before", "rows").agg(
        F.sum(p * F.log(p / q)).alias("kl"), F.sum((p - q) * F.log(p / q)).alias("psi")
    ).select(*keys, (F.col("__base") + 1).alias(period), "rows_before", "rows", "kl", "psi")
