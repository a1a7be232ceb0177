"""Descriptive statistics of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.keyed import join_keys, spread_join
from pitsignal.operators.quantiles import bounded_quantiles, exact_quantiles


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max, one row per column.

    The plain statistics of all columns are one aggregation, and the quartiles of all are one set of scans of
    the columns laid below each other.
    """
    one = df.agg(*[m for c in columns for m in _moments(c, c)])
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
            *[F.col(f"{c}__{s}").alias(s) for s in ("mean", "std", "min", "max")],
        )
        for c in columns
    ]
    plain = one.select(F.inline(F.array(*rows)))
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("__value")) for c in columns]
    long = df.select(F.inline(F.array(*entries)))
    q = exact_quantiles(long, ["column"], "__value", [0.25, 0.5, 0.75], few=True)
    named = q.select("column", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return join_keys(plain, named, ["column"], "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _moments(column: str, prefix: str) -> list:
    c = F.col(column).cast("double")
    stats = {
        "count": F.count(column), "mean": F.avg(c), "std": F.stddev_samp(c),
        "min": F.min(c), "max": F.max(c),
    }
    return [v.alias(f"{prefix}__{k}") for k, v in stats.items()]


def describe_grouped(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same statistics of one column per group."""
    keys, v = list(keys), F.col(value)
    plain = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    named = q.select(*keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return join_keys(plain, named, keys, "left")


def describe_temporal(df: DataFrame, column: str) -> DataFrame:
    """Min, max, range in seconds, count and distinct count of a time column.

    Distinct values are grouped first, so the counting spreads over all tasks.
    """
    per_value = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("__n")
    )
    seconds = F.unix_micros(F.max(column).cast("timestamp")) - F.unix_micros(
        F.min(column).cast("timestamp")
    )
    return per_value.agg(
        F.min(column).alias("min"), F.max(column).alias("max"),
        (seconds / 1e6).alias("range_seconds"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("count"),
        F.count(F.lit(1)).alias("nunique"),
    )


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its count, one row per column.

    Ties go to the smallest value. The table is read once for all columns.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("__v")) for c in columns
    ])
    counts = (
        df.select(F.inline(cells))
        .groupBy("column", "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    present = F.col("__v").isNotNull()
    best = F.max(F.when(present, F.col("__n")))
    ranked = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("__n"))), F.lit(0)).alias("count"),
        F.count("__v").alias("unique"),
        F.min_by("__v", F.when(present, F.struct((-F.col("__n")).alias("n"), "__v"))).alias("top"),
        best.alias("freq"),
    )
    return ranked


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    return (
        rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last(column))
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each non-null value among the non-null rows."""
    counts = value_counts(df, column, keep_null=False)
    total = df.agg(F.count(column).alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def correlation_matrix(
    df: DataFrame,
    columns: Sequence[str],
    exclude: Sequence[str] = ("ShiftYear", "ShiftMonth", "ShiftDay"),
    triangle: bool = False,
) -> DataFrame:
    """Pearson correlation of every column pair over the rows that have both.

    One aggregation: a pair and its mirror image share one statistic. A constant column
    has no correlation.
    """
    used = [c for c in columns if c not in exclude]
    pairs = [(i, j) for i in range(len(used)) for j in range(i + 1)]

    def stat(i: int, j: int):
        a, b = F.col(used[i]).cast("double"), F.col(used[j]).cast("double")
        if i == j:
            return F.when(F.var_pop(a) > 0, 1.0).alias(f"r_{i}_{j}")
        both = a.isNotNull() & b.isNotNull()
        spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
        return F.try_divide(F.covar_pop(a, b), spread).alias(f"r_{i}_{j}")

    one = df.agg(*[stat(i, j) for i, j in pairs])
    wanted = (
        [(i, j) for i, j in pairs if i > j] if triangle
        else [(i, j) for i in range(len(used)) for j in range(len(used))]
    )
    entries = [
        F.struct(
            F.lit(used[i]).alias("x"), F.lit(used[j]).alias("y"),
            F.col(f"r_{max(i, j)}_{min(i, j)}").alias("r"),
        )
        for i, j in wanted
    ]
    return one.select(F.inline(F.array(*entries)))


def ols_trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with its r-squared."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
    )


def smallest_rows(df: DataFrame, column: str) -> DataFrame:
    """All rows holding the least value of a column."""
    return df.filter(F.col(column) == df.agg(F.min(column)).scalar())


def box_stats(
    df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5
) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group.

    Rows are counted per distinct value first; whiskers and outliers come from those counts.
    """
    keys = list(keys)
    freq = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    fences = q.select(
        *keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    ).withColumns({
        "__low": F.col("q1") - factor * (F.col("q3") - F.col("q1")),
        "__high": F.col("q3") + factor * (F.col("q3") - F.col("q1")),
    })
    near = F.col("__v").between(F.col("__low"), F.col("__high"))
    marked = spread_join(freq, fences, keys, ["__v"])
    return marked.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(near, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(near, F.col("__v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~near, F.col("__n"))), F.lit(0)).alias("outliers"),
        F.sum("__n").alias("n"),
    )


def median_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median of a column per time and metric, or other groups that are small by nature."""
    q = bounded_quantiles(df, list(keys), value, [0.5])
    return q.select(*keys, F.col("quantiles")[0].alias("median"))

