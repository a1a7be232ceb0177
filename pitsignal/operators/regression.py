"""Least squares with several predictors, and the diagnostics of its assumptions.

What a task knows of its rows is one small matrix: an R factor or a centred cross-product. These merge in any
order, so tasks send one row each, ``FAN`` tasks merge those and one merges what these send. Nothing but
matrices of the number of columns squared leaves a task, and no result passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.keyed import join_keys, spread_join

#: Tasks that merge what all tasks send.
FAN = 16
#: Share of a column's spread, left over by the columns before it, below which it counts as their combination.
COLLINEAR = 1e-10

Partial = tuple[int, np.ndarray]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, of rows that have a finite number in each."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]
    return numbers.filter(F.expr("true") if not finite else _all(finite))


def _all(conditions: Sequence[Column]) -> Column:
    first, *others = conditions
    for c in others:
        first = first & c
    return first


def merged(
    rows: DataFrame,
    of_batch: Callable[[np.ndarray], Partial],
    merge: Callable[[Partial, Partial], Partial],
) -> DataFrame:
    """One row ``n, cells`` with the merge of all batches' matrices, or none without rows."""
    schema = "n long, cells array<double>"

    def sent(state: Partial | None) -> Iterator[pa.RecordBatch]:
        if state is not None:
            cells = pa.array([state[1].ravel()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), cells], names=["n", "cells"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                new = of_batch(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                state = new if state is None else merge(state, new)
        yield from sent(state)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for n, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = n, np.array(cells).reshape(-1, round(len(cells) ** 0.5))
                state = new if state is None else merge(state, new)
        yield from sent(state)

    parts = rows.mapInArrow(read, schema).repartition(FAN).mapInArrow(join, schema)
    return parts.repartition(1).mapInArrow(join, schema)


# -- collinearity -------------------------------------------------------------------------------------


def _products(rows: np.ndarray) -> Partial:
    """Centred cross-products, with the means as a last column."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    return len(rows), _with_means(centred.T @ centred, mean)


def _with_means(products: np.ndarray, mean: np.ndarray) -> np.ndarray:
    out = np.zeros((len(mean) + 1, len(mean) + 1))
    out[:-1, :-1], out[:-1, -1] = products, mean
    return out


def _join_products(a: Partial, b: Partial) -> Partial:
    n = a[0] + b[0]
    apart = b[1][:-1, -1] - a[1][:-1, -1]
    products = a[1][:-1, :-1] + b[1][:-1, :-1] + np.outer(apart, apart) * (a[0] * b[0] / n)
    return n, _with_means(products, a[1][:-1, -1] + apart * (b[0] / n))


def pivoted(correlation: np.ndarray, least: float = COLLINEAR) -> list[int]:
    """Columns in the order of a pivoted Cholesky factorisation, up to where nothing is left.

    The next column is the one with most spread left, of equal ones the first.
    """
    left, order = correlation.copy(), []
    while len(order) < len(left):
        spread = np.diag(left).copy()
        spread[order] = -1
        # A tie within rounding goes to the first column.
        k = int(np.flatnonzero(spread >= spread.max() - 1e-12)[0])
        if spread[k] <= least:
            break
        order.append(k)
        left = left - np.outer(left[k], left[k]) / left[k, k]
    return order


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``n``, ``vif`` and ``status`` per column, over rows that have all columns.

    A column without spread is ``constant``; one that the columns chosen before it determine is ``collinear``. Both
    have no factor and are left out of those of the others, which are ``ok``. Without rows all are ``constant``.
    """
    names = list(columns)

    def factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cells = 0, np.zeros((len(names) + 1, len(names) + 1))
        for batch in batches:
            for count, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, cells = count, np.array(flat).reshape(cells.shape)
        products, mean = cells[:-1, :-1], cells[:-1, -1]
        spread = np.sqrt(np.diag(products))
        varies = spread > 1e-12 * np.sqrt(max(n, 1)) * np.maximum(np.abs(mean), np.finfo(float).tiny)
        status = ["collinear" if v else "constant" for v in varies]
        vif: list[float | None] = [None] * len(names)
        used = np.flatnonzero(varies)
        if len(used):
            correlation = products[np.ix_(used, used)] / np.outer(spread[used], spread[used])
            chosen = pivoted(correlation)
            inverse = np.linalg.inv(correlation[np.ix_(chosen, chosen)])
            for place, k in enumerate(chosen):
                status[used[k]], vif[used[k]] = "ok", float(inverse[place, place])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([n] * len(names), pa.int64()), pa.array(vif, pa.float64()), pa.array(status)],
            names=["column", "n", "vif", "status"],
        )

    one = merged(complete_rows(df, names), _products, _join_products)
    # One task, also where no row arrives.
    return one.repartition(1).mapInArrow(factors, "column string, n long, vif double, status string")


# -- least squares ------------------------------------------------------------------------------------


def _factor(rows: np.ndarray) -> Partial:
    """R of the rows with a column of ones before them."""
    return len(rows), _square(np.column_stack([np.ones(len(rows)), rows]))


def _square(rows: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    width = rows.shape[1]
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _join_factors(a: Partial, b: Partial) -> Partial:
    return a[0] + b[0], _square(np.vstack([a[1], b[1]]))


def solved(r: np.ndarray, least: float = COLLINEAR) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, which columns are used, and the sum of squared residuals, from R of (columns, target).

    A column that those before it determine has coefficient 0 and is not used.
    """
    x, y = r[:, :-1], r[:, -1]
    used: list[int] = []
    for k in range(x.shape[1]):
        column = x[:, k]
        rest = column - x[:, used] @ np.linalg.lstsq(x[:, used], column, rcond=None)[0] if used else column
        if np.linalg.norm(rest) > least * np.linalg.norm(column):
            used.append(k)
    out, flags = np.zeros(x.shape[1]), np.zeros(x.shape[1], dtype=bool)
    out[used] = np.linalg.lstsq(x[:, used], y, rcond=None)[0]
    flags[used] = True
    rest = y - x @ out
    return out, flags, float(rest @ rest)


def least_squares(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """One row: ``coefficients`` (intercept first), ``used``, ``n``, ``sse``, ``sst``; none without rows.

    The R factors of tall blocks merge to that of all rows, so nearly collinear predictors lose half as many digits as
    normal equations do. A predictor that those before it determine has coefficient 0.
    """

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = np.array(flat).reshape(len(predictors) + 2, -1)
                coefficients, used, sse = solved(r)
                spread = float(r[1:, -1] @ r[1:, -1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([coefficients], pa.list_(pa.float64())), pa.array([used.tolist()], pa.list_(pa.bool_())),
                     pa.array([n], pa.int64()), pa.array([sse]), pa.array([spread])],
                    names=["coefficients", "used", "n", "sse", "sst"],
                )

    rows = complete_rows(df, [*predictors, target])
    schema = "coefficients array<double>, used array<boolean>, n long, sse double, sst double"
    return merged(rows, _factor, _join_factors).mapInArrow(solve, schema)


def predicted(coefficients: Column, predictors: Sequence[str]) -> Column:
    terms = [coefficients[i + 1] * F.col(c).cast("double") for i, c in enumerate(predictors)]
    return sum(terms, coefficients[0])


def fit_errors(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """The fit's row with ``mae``, ``rmse`` and ``r2``; a constant target has no r2.

    Squared errors follow from the R factor; absolute ones take a second pass with the coefficients.
    """
    fit = least_squares(df, target, predictors)
    rows = complete_rows(df, [*predictors, target])
    guess = predicted(fit.select("coefficients").scalar(), predictors)
    mae = rows.agg(F.avg(F.abs(F.col(target) - guess)).alias("mae"))
    return fit.select(
        "*", mae.scalar().alias("mae"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"),
    )


# -- residuals in order -------------------------------------------------------------------------------


def durbin_watson(df: DataFrame, keys: Sequence[str], order: Sequence[str], residual: str) -> DataFrame:
    """``n`` and ``durbin_watson`` of each series: squared steps between neighbours over squared residuals.

    ``order`` must tell any two rows of a series apart. Rows are dealt by ranges of (keys, order), so a hot series spreads over
    tasks. A task sums up each stretch of a series by its first and last residual, its squares and its squared steps;
    the stretches of a series, at most one per task, are folded in order. Null residuals are left out.
    """
    keys, order = list(keys), list(order)
    rows = df.filter(F.col(residual).isNotNull()).select(
        F.struct(*keys).alias("key"), F.struct(*order).alias("place"), F.col(residual).cast("double").alias("e")
    )
    key, place = rows.schema["key"].dataType, rows.schema["place"].dataType
    dealt = rows.repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    schema = (
        f"key {key.simpleString()}, place {place.simpleString()}, n long, first double, last double, squares double, steps double"
    )

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_e, open_row = None, 0.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            e = batch.column(2).to_numpy()
            code = batch.column(0)
            fields = [code.field(i) for i in range(code.type.num_fields)]
            new = np.zeros(batch.num_rows, dtype=bool)
            for f in fields:
                ids = f.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                ids = np.nan_to_num(ids.astype(float), nan=-1)
                new[1:] |= ids[1:] != ids[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            for a, b in zip(starts, [*starts[1:], len(e)], strict=True):
                part, name = e[a:b], code[a].as_py()
                squares, steps = float(part @ part), float(np.sum(np.diff(part) ** 2))
                if open_row is not None and name == last_key:
                    open_row["n"] += len(part)
                    open_row["squares"] += squares
                    open_row["steps"] += steps + float((part[0] - last_e) ** 2)
                else:
                    if open_row is not None:
                        yield _stretch(open_row, batch.schema)
                    open_row = {"key": code[a], "place": batch.column(1)[a], "n": len(part), "first": float(part[0]),
                                "squares": squares, "steps": steps}
                last_key, last_e = name, float(part[-1])
                open_row["last"] = last_e
            kept_schema = batch.schema
        if open_row is not None:
            yield _stretch(open_row, kept_schema)

    parts = dealt.mapInArrow(stretches, schema)
    in_order = F.array_sort(F.collect_list(F.struct("place", "n", "first", "last", "squares", "steps")))
    grouped = parts.groupBy("key").agg(in_order.alias("parts"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("last"),
        F.lit(0.0).alias("squares"), F.lit(0.0).alias("steps"),
    )

    def fold(done: Column, part: Column) -> Column:
        joint = F.coalesce(F.pow(part["first"] - done["last"], F.lit(2)), F.lit(0.0))
        return F.struct(
            (done["n"] + part["n"]).alias("n"), part["last"].alias("last"),
            (done["squares"] + part["squares"]).alias("squares"), (done["steps"] + part["steps"] + joint).alias("steps"),
        )

    folded = grouped.select("key", F.aggregate("parts", start, fold).alias("all"))
    return folded.select(
        *[F.col("key")[k].alias(k) for k in keys], F.col("all.n").alias("n"),
        F.when(F.col("all.squares") > 0, F.col("all.steps") / F.col("all.squares")).alias("durbin_watson"),
    )


def _stretch(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array([row[c].as_py()], schema.field(c).type) for c in ("key", "place")]
    arrays.append(pa.array([row["n"]], pa.int64()))
    arrays += [pa.array([row[c]], pa.float64()) for c in ("first", "last", "squares", "steps")]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "place", "n", "first", "last", "squares", "steps"])


def trend_residuals(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "residual") -> DataFrame:
    """The rows with their distance from the least-squares line of their series; null where there is no line."""
    keys = list(keys)
    line = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("__slope"), F.regr_intercept(y, x).alias("__intercept"))
    joined = spread_join(df, line, keys, [x, y], "left") if keys else join_keys(
        df.withColumn("__one", F.lit(1)), line.withColumn("__one", F.lit(1)), ["__one"]
    ).drop("__one")
    rest = F.col(y) - F.col("__intercept") - F.col("__slope") * F.col(x)
    return joined.withColumn(out, rest).drop("__slope", "__intercept")
