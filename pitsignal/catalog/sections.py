"""Both reports whole: every section written by the report sink, read back, and shown in long form."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.catalog.cleaning import _SENSOR_COLUMNS
from pitsignal.catalog.explore import TS, _describe, _kde_sql
from pitsignal.catalog.registry import QUERIES, big, dec, query, stamp
from pitsignal.catalog.views import having, sensor, telemetry
from pitsignal.plans import reports
from pitsignal.session import scratch_dir
from pitsignal.sinks import files as sinks

_STATISTICS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high", "outliers", "n"]
_NUMERIC = ["event_id", "value", "speed"]
_MEASURES = [c for c in _SENSOR_COLUMNS if c not in ("ShiftDate", "TimeStamp", "Equipment")]

# Section: the columns that name a row, and those with its numbers.
_TELEMETRY = {
    "numeric": (["column"], _STATISTICS), "temporal": (["min", "max"], ["range_seconds", "count", "nunique"]),
    "categorical": (["column", "top"], ["count", "unique", "freq"]), "density": (["metric", "bucket"], ["n"]),
    "trend": (["metric", TS], ["median"]), "histogram": (["metric", "bin"], ["bin_start", "n"]),
    "kernel_density": (["metric", "point"], ["x", "density"]), "boxes": (["metric", "fleet"], _BOX),
    "outliers": (["event_id", "truck", "metric", "fleet", TS], ["value", "speed"]),
    "outliers_by_metric": (["metric"], ["n"]), "outlier_share": ([], ["outliers", "percent"]),
    "correlation": (["x", "y"], ["r"]),
}
_SENSOR = {
    "sensor.summary": (["first", "last", "types"], ["rows", "days", "columns"]),
    "sensor.duplicates": ([], ["rows", "duplicates", "percent"]), "sensor.completeness": (["column"], ["percent"]),
    "sensor.incomplete": (["column"], ["percent"]), "sensor.null_patterns": (["pattern"], ["rows"]),
    "daily_activity": (["year", "month", "day", "month_name"], ["n"]), "hourly_activity": (["hour"], ["n"]),
    "performance.describe": (["column"], _STATISTICS), "scatter": ([], ["Speed", "RPM", "FuelLevel"]),
    "positions": ([], ["rows"]), "map": ([], ["Latitude", "Longitude", "Speed"]), "correlation": (["x", "y"], ["r"]),
}
for _c in reports.PERFORMANCE:
    _SENSOR[f"performance.{_c}.histogram"] = (["bin"], ["bin_start", "n"])
    _SENSOR[f"performance.{_c}.density"] = (["point"], ["x", "density"])


def _long_sql(shapes: dict, given: dict[str, str]) -> str:
    parts = []
    for section, (labels, amounts) in shapes.items():
        names = "".join(f""", CAST("{c}" AS VARCHAR)""" for c in labels)
        numbers = ", ".join(f"""{{'name': '{c}', 'amount': CAST("{c}" AS DOUBLE)}}""" for c in amounts)
        parts.append(f"""SELECT '{section}' AS section, concat_ws('|', u.name{names}) AS label, u.amount AS amount
            FROM (SELECT *, unnest([{numbers}]) AS u FROM ({given[section]}))""")
    return " UNION ALL ".join(parts)


def _long(df: DataFrame, section: str, labels: list[str], amounts: list[str]) -> DataFrame:
    def shown(name: str):
        if dict(df.dtypes)[name].startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.col(name).cast("string")

    numbers = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("amount")) for c in amounts
    ])
    rows = df.select(*[shown(c).alias(f"__{c}") for c in labels], F.inline(numbers))
    label = F.concat_ws("|", "name", *[f"__{c}" for c in labels])
    return rows.select(F.lit(section).alias("section"), label.alias("label"), "amount")


def _written(spark, out: dict[str, DataFrame], shapes: dict) -> DataFrame:
    """All sections through the sink; a section without a shape, or the other way round, is an error."""
    if set(out) != set(shapes):
        raise ValueError(f"sections differ: {sorted(set(out) ^ set(shapes))}")
    paths = dict(zip(out, sinks.write_report(out, scratch_dir(spark, "sections")), strict=True))
    return reduce(DataFrame.unionByName, [
        _long(spark.read.schema(out[s].schema).parquet(paths[s]), s, *shape) for s, shape in shapes.items()
    ])


def _all_pairs(view: str, columns: list[str], below: bool) -> str:
    return having(view) + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {dec(f'corr({a}, {b})', 'r')} FROM {view}"
        for i, a in enumerate(columns) for b in (columns[:i] if below else columns)
    )


def _known(name: str) -> str:
    return QUERIES[name].sql


@query("telemetry_report_sections", _long_sql(_TELEMETRY, {
    "numeric": having("telemetry") + " UNION ALL ".join(_describe("telemetry", c) for c in _NUMERIC),
    "temporal": _known("describe_temporal"), "categorical": _known("describe_categorical"),
    "density": _known("time_density"), "histogram": _known("histogram30"),
    "trend": having("telemetry") + f"""SELECT metric, {stamp(TS, TS)}, {dec('median(value)', 'median')}
        FROM telemetry GROUP BY metric, {TS}""",
    "kernel_density": _known("kde_by_metric"), "boxes": _known("box_stats"), "outliers": _known("iqr_outliers"),
    "outliers_by_metric": _known("outlier_breakdown"), "outlier_share": _known("outlier_share"),
    "correlation": _all_pairs("telemetry", _NUMERIC, False),
}))
def telemetry_report_sections(spark, sf_dir):
    return _written(spark, reports.telemetry_report(telemetry(spark, sf_dir)), _TELEMETRY)


def _histogram_sql(column: str) -> str:
    return having("sensor",
        s=f"""SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS n,
            quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25) AS iqr FROM sensor""",
        k="""SELECT lo, hi, CASE WHEN hi > lo THEN ceil((hi - lo) / CASE WHEN iqr > 0 THEN
            least(2 * iqr / pow(n, 1 / 3), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END) ELSE 1 END AS bins FROM s""",
        b=f"""SELECT lo, hi, bins, CAST(least(floor(({column} - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin
            FROM sensor CROSS JOIN k WHERE {column} IS NOT NULL""") + f"""
        SELECT bin, {dec('lo + bin * ((hi - lo) / bins)', 'bin_start')}, count(*) AS n FROM b GROUP BY lo, hi, bins, bin"""


_PLACED = "Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180"


@query("truck_report_sections", _long_sql(_SENSOR, {
    "sensor.summary": _known("dataset_summary"), "sensor.completeness": _known("completeness"),
    "sensor.incomplete": _known("low_completeness"), "sensor.null_patterns": _known("null_patterns"),
    "sensor.duplicates": having("sensor", g=f"SELECT count(*) AS n FROM sensor GROUP BY {', '.join(_SENSOR_COLUMNS)}")
        + f"""SELECT {big('sum(n)', 'rows')}, {big('sum(n - 1)', 'duplicates')}, {dec('sum(n - 1) * 100.0 / sum(n)', 'percent')} FROM g""",
    "daily_activity": _known("daily_counts"), "performance.describe": _known("describe_performance"),
    "hourly_activity": having("sensor") + "SELECT coalesce(hour(TimeStamp), 0) AS hour, count(*) AS n FROM sensor GROUP BY 1",
    "scatter": having("sensor") + f"SELECT {dec('Speed', 'Speed')}, {dec('RPM', 'RPM')}, {dec('FuelLevel', 'FuelLevel')} FROM sensor",
    "positions": having("sensor") + f"SELECT count(*) AS rows FROM sensor WHERE {_PLACED}",
    "map": having("sensor") + f"""SELECT {dec('Latitude', 'Latitude')}, {dec('Longitude', 'Longitude')}, {dec('Speed', 'Speed')}
        FROM sensor WHERE {_PLACED}""",
    "correlation": _all_pairs("sensor", _MEASURES, True),
    **{f"performance.{c}.histogram": _histogram_sql(c) for c in reports.PERFORMANCE},
    **{f"performance.{c}.density": _kde_sql("", "sensor", c) for c in reports.PERFORMANCE},
}))
def truck_report_sections(spark, sf_dir):
    """The report of the whole fleet: all rows, no truck chosen."""
    return _written(spark, reports.truck_report({"sensor": sensor(spark, sf_dir)}), _SENSOR)
