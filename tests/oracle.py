"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, registered, sf_dir: str):
    """``None`` when equal, else what differs."""
    df = registered.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if registered.sql is None:
        return None if got else "no rows"
    result = con.execute(registered.sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return None if not bad else f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    from pitsignal.catalog import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    con, failed = connect(sf_dir), 0
    for name, q in QUERIES.items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:400]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
