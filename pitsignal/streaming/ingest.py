"""Stream ingestion: repeated and late rows told apart, batches held back where too much is invalid, drift per series.

State lives in Spark's state store, by series, so a restarted query goes on where it stopped. What a series keeps
is bounded: the ids of the lateness window, or the buckets of an adaptive window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitsignal.layouts import SITE_ZONE
from pitsignal.operators.filters import split_valid
from pitsignal.plans.temporal import parse_times

ON_TIME, LATE, REPEATED = "on time", "late", "repeated"


def sorted_rows(
    df: DataFrame, keys: Sequence[str], ts: str, row_id: str, lateness_seconds: float, salts: int = 1
) -> DataFrame:
    """The rows of a stream with ``status``: on time, late, or repeated. No row is dropped.

    Per series, a row is late if its time lies more than ``lateness_seconds`` before the latest time of the batches before; it is repeated
    if its id came before within that span, or earlier in the same batch. Ids older than that are forgotten, so a series keeps the ids of the
    span and nothing else. With ``salts``, the rows of a series are dealt to so many states by their id, for hot series; lateness is then counted per
    state. Rows without a time or an id are late.
    """
    keys, micros = list(keys), int(lateness_seconds * 1_000_000)
    columns = df.columns
    timed = df.withColumns({
        "__micros": F.unix_micros(F.col(ts).cast("timestamp")),
        "__id": F.col(row_id).cast("string"),
        "__salt": F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int"),
    })
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", status string"

    def work(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, times, ids = state.get if state.exists else (None, [], [])
        rows = pd.concat(list(parts), ignore_index=True)
        rows = rows.sort_values(["__micros", "__id"], kind="stable", ignore_index=True)
        known = dict(zip(ids, times, strict=True))
        status = []
        for at, row in zip(rows["__micros"], rows["__id"], strict=True):
            if pd.isna(at) or row is None or pd.isna(row) or (top is not None and at < top - micros):
                status.append(LATE)
            elif row in known:
                status.append(REPEATED)
                known[row] = max(known[row], int(at))
            else:
                status.append(ON_TIME)
                known[row] = int(at)
        seen = rows["__micros"].dropna()
        if len(seen):
            top = int(seen.max()) if top is None else max(top, int(seen.max()))
        kept = {i: t for i, t in known.items() if top is not None and t >= top - micros}
        state.update((top, list(kept.values()), list(kept)))
        yield rows[columns].assign(status=status)

    grouped = timed.groupBy(*[F.col(k) for k in keys], "__salt")
    return grouped.applyInPandasWithState(
        work, schema, "top long, times array<long>, ids array<string>", "append", GroupStateTimeout.NoTimeout
    )


# -- drift --------------------------------------------------------------------------------------------


class AdaptiveWindow:
    """A window over the newest values that shrinks when its older part differs from its newer one.

    The window is kept as buckets of 1, 2, 4, ... values, at most ``per_size`` of a size, oldest first; a bucket has its number of values, sum, and
    squared deviations. After a value is added, the oldest bucket is dropped as long as some cut between buckets parts two means that differ by more than chance
    allows at confidence ``delta``. Memory and time per value grow with the logarithm of the window.
    """

    def __init__(self, delta: float = 0.002, per_size: int = 5, buckets: Sequence[Sequence[float]] = ((), (), ())):
        self.delta, self.per_size = delta, per_size
        self.n, self.total, self.spread = ([float(v) for v in part] for part in buckets)

    def add(self, value: float) -> tuple[float, float, float, float] | None:
        """Take a value; where the window shrinks, the rows and means before and after the deciding cut."""
        self.n.append(1.0)
        self.total.append(float(value))
        self.spread.append(0.0)
        self._merge()
        found = None
        while (cut := self._cut()) is not None:
            found = found or cut
            for part in (self.n, self.total, self.spread):
                del part[0]
        return found

    def _merge(self) -> None:
        size, stop = 1.0, len(self.n)
        while True:
            start = stop
            while start and self.n[start - 1] == size:
                start -= 1
            if stop - start <= self.per_size:
                return
            # The two oldest of this size become one of the next.
            a, b = start, start + 1
            apart = self.total[a] / size - self.total[b] / size
            self.spread[a] += self.spread[b] + apart * apart * size / 2
            self.total[a] += self.total[b]
            self.n[a] = 2 * size
            for part in (self.n, self.total, self.spread):
                del part[b]
            size, stop = 2 * size, start + 1

    def _cut(self) -> tuple[float, float, float, float] | None:
        n, total = np.array(self.n), np.array(self.total)
        count = n.sum()
        if len(n) < 2 or count < 10:
            return None
        mean = total.sum() / count
        variance = (np.array(self.spread).sum() + (n * (total / n - mean) ** 2).sum()) / count
        before, sums = np.cumsum(n)[:-1], np.cumsum(total)[:-1]
        after = count - before
        old, new = sums / before, (total.sum() - sums) / after
        harmonic = 1 / (1 / before + 1 / after)
        chance = np.log(2 * np.log(count) / self.delta)
        allowed = np.sqrt(2 / harmonic * variance * chance) + 2 / (3 * harmonic) * chance
        far = np.flatnonzero((np.abs(old - new) > allowed) & (before >= 5) & (after >= 5))
        if not len(far):
            return None
        k = far[0]
        return float(before[k]), float(old[k]), float(after[k]), float(new[k])


DRIFT_SCHEMA = "rows_before double, mean_before double, rows_after double, mean_after double"


def drift_points(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, value: str, delta: float = 0.002) -> DataFrame:
    """A row for each value of a stream at which the adaptive window of its series shrank.

    Rows of a batch are taken in order of time and id, batches as they come, so files that arrive in order of time give the same points
    however they are dealt to batches. Null values are passed over.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ts, row_id]) + ", " + DRIFT_SCHEMA
    rows = df.filter(F.col(value).isNotNull()).select(*keys, ts, row_id, F.col(value).cast("double").alias("__value"))

    def work(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = AdaptiveWindow(delta, buckets=state.get if state.exists else ((), (), ()))
        batch = pd.concat(list(parts), ignore_index=True).sort_values([ts, row_id], kind="stable", ignore_index=True)
        out: list[tuple[Any, ...]] = []
        for at, row, v in zip(batch[ts], batch[row_id], batch["__value"], strict=True):
            found = window.add(v)
            if found is not None:
                out.append((*key, at, row, *found))
        state.update((window.n, window.total, window.spread))
        yield pd.DataFrame(out, columns=[*keys, ts, row_id, "rows_before", "mean_before", "rows_after", "mean_after"])

    return rows.groupBy(*keys).applyInPandasWithState(
        work, schema, "n array<double>, total array<double>, spread array<double>", "append", GroupStateTimeout.NoTimeout
    )


# -- gate ---------------------------------------------------------------------------------------------


def gate(
    root: str, most_invalid: float = 0.1, ts: str = "created_at_local", zone: str = SITE_ZONE
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that parts a batch into valid and invalid rows and commits it once.

    Below ``root``, rows of batch i go to ``valid/batch=i`` and ``invalid/batch=i``. Where more than ``most_invalid`` of the rows are invalid, the whole
    batch goes to ``held/batch=i`` as it came, and nothing to ``valid``. Last, ``reports/batch=i`` gets a row with the counts and ``held``, the alert; a
    batch with a report is done and is passed over. A batch that failed half way has none, and is written anew over what
    there is. The batch is kept while it is counted and written, so the source is read once.
    """
    root = root.rstrip("/")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _reported(batch, f"{root}/reports/batch={number}"):
            return
        kept = batch.persist()
        try:
            valid, invalid = split_valid(parse_times(kept, ts, zone), ts)
            total = kept.count()
            good = valid.count()
            held = total > 0 and (total - good) > most_invalid * total
            if held:
                kept.write.mode("overwrite").parquet(f"{root}/held/batch={number}")
            else:
                valid.write.mode("overwrite").parquet(f"{root}/valid/batch={number}")
                invalid.drop("local_time").write.mode("overwrite").parquet(f"{root}/invalid/batch={number}")
            report = spark.range(1).select(
                F.lit(total).cast("bigint").alias("rows"), F.lit(total - good).cast("bigint").alias("invalid"), F.lit(held).alias("held")
            )
            report.coalesce(1).write.mode("overwrite").parquet(f"{root}/reports/batch={number}")
        finally:
            kept.unpersist()

    return run


def _reported(batch: DataFrame, path: str) -> bool:
    try:
        return not batch.sparkSession.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def write_gated(raw: DataFrame, root: str, state_path: str, most_invalid: float = 0.1, ts: str = "created_at_local", once: bool = True) -> StreamingQuery:
    """Run a stream through the gate."""
    writer = raw.writeStream.foreachBatch(gate(root, most_invalid, ts)).option("checkpointLocation", state_path)
    return (writer.trigger(availableNow=True) if once else writer).start()
