"""Counts of records over calendar and clock units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.times import month_name_es


def calendar_columns(time: Column) -> dict[str, Column]:
    return {
        "year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time),
        "month_name": month_name_es(time),
    }


def daily_counts(df: DataFrame, ts: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per calendar day in time order, with the Spanish month name."""
    time = F.col(ts) if isinstance(ts, str) else ts
    parts = calendar_columns(time)
    return (
        df.filter(time.isNotNull())
        .groupBy(*keys, *[c.alias(n) for n, c in parts.items() if n != "month_name"])
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "month_name", month_name_es(F.make_date(F.col("year"), F.col("month"), F.lit(1)))
        )
        .orderBy(*keys, "year", "month", "day")
    )


def mean_daily_count(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return days.groupBy(*keys).agg(F.avg("n").alias("mean_n"), F.count(F.lit(1)).alias("days"))


def hourly_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def clock_totals(df: DataFrame, ts: str, amount: str | Column, unit: str = "hour") -> DataFrame:
    """Sum of an amount per hour (24 bins) or minute (1440 bins) of the day."""
    slot = F.hour(ts) if unit == "hour" else F.hour(ts) * 60 + F.minute(ts)
    return df.groupBy(slot.alias(unit)).agg(F.sum(amount).alias("total"))


def extremes(df: DataFrame, amount: str, label: str, n: int = 4) -> DataFrame:
    """The ``n`` least and ``n`` greatest rows, tagged; ties follow the label."""
    low = df.orderBy(F.asc(amount), F.asc(label)).limit(n)
    high = df.orderBy(F.desc(amount), F.desc(label)).limit(n)
    return low.withColumn("kind", F.lit("lowest")).unionByName(
        high.withColumn("kind", F.lit("highest"))
    )


def month_axis(df: DataFrame, day: str) -> DataFrame:
    """Rows per day of month on the whole axis 1..31, zero where there are none.

    The 31 counters are one aggregation, so the axis needs no join.
    """
    counters = [F.count_if(F.col(day) == d).alias(f"d{d}") for d in range(1, 32)]
    entries = [
        F.struct(F.lit(d).alias("day"), F.col(f"d{d}").alias("n")) for d in range(1, 32)
    ]
    return df.agg(*counters).select(F.inline(F.array(*entries)))


def busiest_day(axis: DataFrame) -> DataFrame:
    """Day with most records, the first on a tie, and the mean over the axis."""
    order = F.struct(F.col("n"), -F.col("day"))
    return axis.agg(
        F.max_by("day", order).alias("day"), F.max("n").alias("n"), F.avg("n").alias("mean_n")
    )


def metric_year_series(df: DataFrame, ts: str, value: str, metric: str = "metric") -> DataFrame:
    """Rows labelled with the series they belong to: metric and year."""
    name = F.concat_ws(" ", F.upper(metric), F.year(ts).cast("string"))
    return df.withColumns({"year": F.year(ts), "series": name})


def series_summary(df: DataFrame, ts: str, value: str, metric: str = "metric") -> DataFrame:
    labelled = metric_year_series(df, ts, value, metric)
    return labelled.groupBy(metric, "year", "series").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def daily_density(df: DataFrame, ts: str | Column, metric: str, metrics: Sequence[str]) -> DataFrame:
    """Rows per date, one column per metric, zero where a metric has none.

    The metric list is explicit, so no extra job looks for the distinct metrics.
    """
    time = F.col(ts) if isinstance(ts, str) else ts
    counters = [F.count_if(F.col(metric) == m).alias(m) for m in metrics]
    known = df.filter(F.col(metric).isin(list(metrics)) & time.isNotNull())
    return known.groupBy(F.to_date(time).alias("date")).agg(*counters)


def hour_metric_crosstab(
    df: DataFrame, ts: str | Column, metric: str, value: str, metrics: Sequence[str]
) -> DataFrame:
    """Mean value per hour of day, one column per metric."""
    time = F.col(ts) if isinstance(ts, str) else ts
    means = [F.avg(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics]
    return df.filter(F.col(metric).isin(list(metrics))).groupBy(F.hour(time).alias("hour")).agg(*means)


def sample_rows(df: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows, chosen by the digest of a key so that a rerun picks the same.

    Rows are counted by the first three digits of the digest. Only those up to the digits that
    hold the n-th row are ordered, so a task passes on few rows, not its own first ``n``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    texts = [F.col(k).cast("string") for k in keys]
    one = texts[0] if len(texts) == 1 else F.concat_ws("\x1f", *[F.coalesce(t, F.lit("\x00")) for t in texts])
    digest = F.coalesce(F.md5(one), F.lit(""))
    upto = F.sum("n").over(Window.orderBy("digits"))  # 4097 rows at most
    counts = df.groupBy(F.substring(digest, 1, 3).alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    last = counts.withColumn("upto", upto).agg(F.min(F.when(F.col("upto") >= n, F.col("digits"))))
    wanted = F.substring(digest, 1, 3) <= F.coalesce(last.scalar(), F.lit("fff"))
    return df.filter(wanted).orderBy(digest, *keys).limit(n)


def head_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.asc(order)).limit(n)


def tail_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows, in their own order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(F.asc(order))
