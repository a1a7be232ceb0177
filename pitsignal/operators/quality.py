"""Data-quality measures. Each is one aggregation over the table it describes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.keyed import melt_row, not_missing

# Type names of the constraint specs and their Spark names.
_TYPE_NAMES = {
    "int64": "bigint", "int32": "int", "float64": "double", "float32": "float",
    "object": "string", "bool": "boolean", "datetime64[ns]": "timestamp_ntz",
}


def type_histogram(df: DataFrame) -> dict[str, int]:
    return dict(sorted(Counter(t for _, t in df.dtypes).items()))


def date_span(column: str) -> dict[str, Column]:
    """First and last value, and the days they cover counting both ends."""
    first, last = F.min(column), F.max(column)
    return {"first": first, "last": last, "days": F.datediff(last, first) + 1}


def summary(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """Rows, columns, types, and the date span when there is a date."""
    types = ",".join(f"{t}:{n}" for t, n in type_histogram(df).items())
    span = date_span(date_column) if date_column in df.columns else {}
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in span.items()]
    ).withColumns({"columns": F.lit(len(df.columns)).cast("bigint"), "types": F.lit(types)})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one in all columns, nulls being equal.

    Copies are counted before the shuffle, so a row copied very often moves once per task.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    rows, extra = F.sum("__n"), F.sum(F.col("__n") - 1)
    return copies.agg(
        F.coalesce(rows, F.lit(0)).alias("rows"),
        F.coalesce(extra, F.lit(0)).alias("duplicates"),
        F.try_divide(extra * F.lit(100.0), rows).alias("percent"),
    )


def completeness(df: DataFrame, below: float | None = None) -> DataFrame:
    """Percent of non-null values per column, optionally only columns under a threshold."""
    share = {
        c: F.round(F.try_divide(
            F.count(F.when(not_missing(df, c), 1)) * F.lit(100.0), F.count(F.lit(1))
        ), 2)
        for c in df.columns
    }
    one = df.agg(*[v.alias(k) for k, v in share.items()])
    out = melt_row(one, {c: c for c in df.columns}, "column", "percent")
    return out if below is None else out.filter(F.col("percent") < below)


def null_count_columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.count_if(~not_missing(df, c)) for c in df.columns}


def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*[v.alias(k) for k, v in null_count_columns(df).items()])
    return melt_row(one, {c: c for c in df.columns}, "column", "nulls")


def null_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of nulls occurs; ``1`` marks a null."""
    flags = [F.when(not_missing(df, c), "0").otherwise("1") for c in df.columns]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def measured(df: DataFrame, dataset: str, stage: str, date_column: str = "ShiftDate") -> DataFrame:
    """Rows, columns, nulls, duplicates and date range of one stage of one dataset."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    cells = sum(
        (F.when(not_missing(df, c), F.lit(0)).otherwise(F.lit(1)) for c in df.columns), F.lit(0)
    )
    has_date = date_column in df.columns
    day = F.to_date(F.col(date_column)) if has_date else F.lit(None).cast("date")
    span = F.concat_ws(
        " - ", F.date_format(F.min(day), "yyyy-MM-dd"), F.date_format(F.max(day), "yyyy-MM-dd")
    )
    one = copies.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(cells * F.col("__n")), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.nullif(span, F.lit("")), F.lit("N/A")).alias("date_range"),
    )
    return one.select(
        F.lit(dataset).alias("dataset"), F.lit(stage).alias("stage"), "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "nulls", "duplicates", "date_range",
    )


def compare_stages(raw: Mapping[str, DataFrame], clean: Mapping[str, DataFrame]) -> DataFrame:
    """The same measures before and after cleaning, for every dataset."""
    parts = [
        measured(tables[name], name, stage)
        for stage, tables in (("raw", raw), ("clean", clean))
        for name in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_equipment(tables: Mapping[str, DataFrame], column: str = "Equipment") -> DataFrame:
    """Smallest equipment id over the datasets that have one, else ``N/A``."""
    ids = [t.agg(F.min(column).alias("id")) for t in tables.values() if column in t.columns]
    if not ids:
        spark = next(iter(tables.values())).sparkSession
        return spark.range(1).select(F.lit("N/A").alias("equipment"))
    found = [i.select("id").scalar() for i in ids]
    return ids[0].sparkSession.range(1).select(
        F.coalesce(*found, F.lit("N/A")).alias("equipment")
    )


def constraint_violations(df: DataFrame, spec: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Rules of ``spec`` that the table breaks, as ``column, rule, expected, found``.

    A spec maps a column to any of ``type``, ``nullable``, ``min`` and ``max``. All
    statistics come from one pass.
    """
    types = dict(df.dtypes)
    known = [c for c in spec if c in types]
    text = "string"
    stats = df.agg(F.lit(1).alias("__one"), *[
        a for c in known for a in (
            F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
            F.count_if(~not_missing(df, c)).alias(f"{c}__nulls"),
        )
    ])

    def finding(column: str, rule: str, expected: Column, found: Column, broken: Column) -> Column:
        return F.struct(
            F.lit(column).alias("column"), F.lit(rule).alias("rule"),
            expected.cast(text).alias("expected"), found.cast(text).alias("found"),
            F.coalesce(broken, F.lit(False)).alias("broken"),
        )

    rules = []
    for c, rule in spec.items():
        if c not in types:
            rules.append(finding(c, "missing", F.lit("present"), F.lit("absent"), F.lit(True)))
            continue
        if "type" in rule:
            wanted = _TYPE_NAMES.get(rule["type"], rule["type"])
            rules.append(finding(
                c, "type", F.lit(wanted), F.lit(types[c]), F.lit(wanted != types[c])))
        if rule.get("nullable") is False:
            nulls = F.col(f"{c}__nulls")
            rules.append(finding(c, "nullable", F.lit("0"), nulls, nulls > 0))
        for bound in ("min", "max"):
            if bound in rule:
                found, limit = F.col(f"{c}__{bound}"), F.lit(rule[bound])
                broken = found < limit if bound == "min" else found > limit
                rules.append(finding(c, bound, limit, found, broken))
    out = stats.select(F.inline(F.array(*rules)))
    return out.filter("broken").drop("broken")


def schema_issues(tables: Mapping[str, DataFrame], required: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """Required columns each dataset lacks."""
    return {
        name: [c for c in required.get(name, []) if c not in t.columns]
        for name, t in tables.items()
    }


def valid_ratio(df: DataFrame, column: str) -> DataFrame:
    """Rows, rows with a value in ``column``, and their percentage."""
    valid, total = F.count(column), F.count(F.lit(1))
    return df.agg(
        total.alias("rows"), valid.alias("valid"), F.try_divide(valid * F.lit(100.0), total).alias("percent")
    )
