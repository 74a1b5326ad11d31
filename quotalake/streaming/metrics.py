"""T2 stream_metrics: windows emitted when they close, and again when a late row changes them.

Rows are combined in the task that reads them (one row per dims, window and
distinct value of the rows it reads), so a tenant with a third of all calls
sends few rows on.  ``transformWithState`` keeps the windows of one day per
key; a timer emits a window once the arrival clock has passed its end by
``delay``, and a row that comes later still makes the window come out again
with the next ``version``.  Readers take the newest version.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator, Sequence
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quotalake.functions.timecols import bucket_start

ARRIVAL = "_clock"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1)
# Rows that a task holds while it combines what it reads.
HELD_ROWS = 500_000


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers and large state need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def windowed(stream: DataFrame, dims: Sequence[str], value: Column, sums: dict[str, Column], periods: Sequence[int],
             arrived: str | None) -> DataFrame:
    """(dims, period_s, period_start, v, valued, n, sums, clock) per row and period.

    The clock is the column ``arrived``, else the time of the micro-batch.
    """
    clock = (F.col(arrived) if arrived else F.current_timestamp()).cast("timestamp")
    window = F.explode(F.array(*[F.struct(F.lit(p).alias("period_s"), bucket_start(F.col("ts"), p).alias("period_start")) for p in periods]))
    v = value.cast("bigint")
    read = stream.select(*dims, window.alias("_w"), F.coalesce(v, F.lit(0)).alias("v"), v.isNotNull().alias("valued"), F.lit(1).cast("long").alias("n"),
                         *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(k) for k, c in sums.items()], clock.alias(ARRIVAL))
    return read.select(*dims, "_w.period_s", "_w.period_start", *[c for c in read.columns if c not in dims and c != "_w"])


def combined(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], delay: str, tops: Sequence[str] = ()) -> DataFrame:
    """``rows`` per ``keys`` among those a task reads: sums, maxima (``tops``) and the newest clock.

    Where the keys are too many to hold, what was combined so far is sent on and may come again.
    """
    keys, made = list(keys), [*[(c, "sum") for c in sums], *[(c, "max") for c in (*tops, ARRIVAL)]]
    read = rows.select(*keys, *[c for c, _ in made])

    def fold(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by(keys).aggregate(made)
        return found.select([*keys, *[f"{c}_{how}" for c, how in made]]).rename_columns([*keys, *[c for c, _ in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            part = pa.Table.from_batches([batch])
            parts.append(part.cast(pa.schema([f.with_nullable(True) for f in part.schema])))
            held += batch.num_rows
            if held >= HELD_ROWS:
                parts = [fold(parts)]
                held = parts[0].num_rows
                if held > HELD_ROWS // 2:
                    yield from parts[0].combine_chunks().to_batches(max_chunksize=10_000)
                    parts, held = [], 0
        if parts:
            yield from fold(parts).combine_chunks().to_batches(max_chunksize=10_000)

    return read.mapInArrow(run, read.schema).withWatermark(ARRIVAL, delay)


def _ms(start) -> int:
    return int((pd.Timestamp(start).to_pydatetime() - EPOCH).total_seconds() * 1000)


def exact_percentile(counts: dict[int, int], share: float) -> float | None:
    """Interpolated percentile of values with counts, rounded to 6 decimals."""
    values = np.array(sorted(counts), dtype="int64")
    upto = np.cumsum([0, *[counts[v] for v in values.tolist()]])
    return _percentiles(values, upto, [0], [len(values)], share)[0]


def _percentiles(values: np.ndarray, upto: np.ndarray, first, last, share: float) -> list[float | None]:
    """Interpolated percentile of each window; its sorted values stand at ``first`` to ``last``, ``upto`` is the running count before each."""
    totals = [int(n) for n in upto[last] - upto[first]]
    at = [max(n - 1, 0) * share for n in totals]
    places = [np.searchsorted(upto[1:], upto[first] + np.array([end(x) for x in at], dtype="int64"), "right") for end in (floor, ceil)]
    out: list[float | None] = []
    for n, x, i, j in zip(totals, at, *[p.tolist() for p in places]):
        if not n:
            out.append(None)
            continue
        low, high = int(values[i]), int(values[j])
        out.append(round(float(low) if floor(x) == ceil(x) else (ceil(x) - x) * low + (x - floor(x)) * high, 6))
    return out


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` summed per distinct column of ``keys``, in their order (both with one row per field)."""
    if not keys.shape[1]:
        return keys, values
    order = np.lexsort(keys[::-1])
    keys, values = keys[:, order], values[:, order]
    first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
    return keys[:, first], np.add.reduceat(values, first, axis=1)


class _Windows(StatefulProcessor):
    """The windows of one day and period of one key: counts, sums and the histogram of the value.

    State is two arrays of whole numbers, ``windows`` (start, version, rows,
    sums) and ``hist`` (start, value, rows), in order of their first fields.
    """

    def __init__(self, dims: Sequence[str], sums: Sequence[str]):
        self.dims, self.sums = list(dims), list(sums)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "rows binary")

    def _load(self) -> dict:
        if self.state.exists():
            return pickle.loads(self.state.get()[0])
        return {"timer": None, "windows": np.zeros((3 + len(self.sums), 0), "int64"), "hist": np.zeros((3, 0), "int64")}

    def _emit(self, key, had: dict, chosen: np.ndarray) -> Iterator[pd.DataFrame]:
        if not chosen.any():
            return
        had["windows"][1, chosen] += 1
        found = had["windows"][:, chosen]
        start, value, rows = had["hist"][:, np.isin(had["hist"][0], found[0])]
        first, last = np.searchsorted(start, found[0], "left"), np.searchsorted(start, found[0], "right")
        if np.abs(value.astype("float64")) @ rows >= 2.0 ** 62:  # sums beyond 64 bits
            value = value.astype("object")
        upto, total = np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(value * rows)]
        counted = (upto[last] - upto[first]).tolist()
        out = pd.DataFrame([[*key[:len(self.dims)], key[len(self.dims)], EPOCH + dt.timedelta(milliseconds=w[0]), *w[1:]] for w in found.T.tolist()],
                           columns=[*self.dims, "period_s", "period_start", "version", "calls", *self.sums])
        out["average"] = pd.Series([int(s) / n if n else None for s, n in zip(total[last] - total[first], counted)], dtype="float64")
        out["maximum"] = pd.Series([int(value[end - 1]) if n else None for end, n in zip(last, counted)], dtype="Int64")
        out["p99"] = pd.Series(_percentiles(value, upto, first, last, 0.99), dtype="float64")
        yield out.astype({"period_s": "int32", "version": "int32", "calls": "int64", **{c: "int64" for c in self.sums}})

    def _wait(self, had: dict, period: int) -> None:
        """One timer, at the end of the first window that was never emitted."""
        waiting = had["windows"][0, had["windows"][1] == 0]
        first = int(waiting[0]) + period * 1000 if len(waiting) else None
        if first != had["timer"]:
            if had["timer"] is not None:
                self.handle.deleteTimer(had["timer"])
            if first is not None:
                self.handle.registerTimer(first)
            had["timer"] = first

    def _add(self, had: dict, pdf: pd.DataFrame) -> np.ndarray:
        """Count the rows in; returns the starts of the windows they belong to."""
        start = pdf["period_start"].to_numpy("datetime64[ms]").astype("int64")
        new = np.stack([start, np.zeros_like(start), *[pdf[c].to_numpy("int64") for c in ("n", *self.sums)]])
        both = np.concatenate([had["windows"], new], axis=1)
        had["windows"] = np.concatenate(_added(both[:1], both[1:]))
        valued = pdf["valued"].to_numpy("bool")
        both = np.concatenate([had["hist"], np.stack([start, pdf["v"].to_numpy("int64"), new[2]])[:, valued]], axis=1)
        had["hist"] = np.concatenate(_added(both[:2], both[2:]))
        return start

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A row without a start is a tick of the clock, or a row without a time.
        parts = [p for p in (pdf[pdf["period_start"].notna()] for pdf in rows) if len(p)]
        if not parts:
            return
        had, period, now = self._load(), key[len(self.dims)], timerValues.getCurrentWatermarkInMs()
        touched = self._add(had, pd.concat(parts, ignore_index=True))
        start, version = had["windows"][:2]
        # Windows that were emitted, or closed before their first row came, come out at once.
        yield from self._emit(key, had, np.isin(start, touched) & ((version > 0) | (start + period * 1000 <= now)))
        self._wait(had, period)
        self.state.update((pickle.dumps(had),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had, period, now = self._load(), key[len(self.dims)], timerValues.getCurrentWatermarkInMs()
        had["timer"] = None
        start, version = had["windows"][:2]
        yield from self._emit(key, had, (version == 0) & (start + period * 1000 <= now))
        self._wait(had, period)
        self.state.update((pickle.dumps(had),))

    def close(self) -> None:
        pass


def stream_metrics(stream: DataFrame, dims: Sequence[str], value: Column, sums: dict[str, Column], root: str, checkpoint: str,
                   periods: Sequence[int] = (60, 300, 3600, 86400), arrived: str | None = None, delay: str = "10 minutes"):
    """Counts, sums, average, maximum and p99 of ``value`` per (dims, window) of each period in seconds; returns the writer.

    A window comes out once ``delay`` after its end on the clock of arrival
    (the column ``arrived`` in whose order the stream delivers, else the time
    of the micro-batch), and again with the next version when a row comes
    later; windows without new rows are not written again.  Rows without a
    time belong to no window; one with a later arrival than all others moves
    the clock.  State is one entry per key, period and day, for ever.
    """
    keep_state_on_disk(stream.sparkSession)
    if any(86400 % p for p in periods):
        raise ValueError("periods divide a day")
    rows = windowed(stream, dims, value, sums, periods, arrived)
    parts = combined(rows, [*dims, "period_s", "period_start", "v", "valued"], ["n", *sums], delay)
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    out = ", ".join([*[f"`{d}` {types[d]}" for d in dims], "period_s int", "period_start timestamp_ntz", "version int", "calls bigint",
                     *[f"`{c}` bigint" for c in sums], "average double", "maximum bigint", "p99 double"])
    found = (parts.withColumn("day", F.to_date("period_start")).groupBy(*dims, "period_s", "day")
             .transformWithStateInPandas(_Windows(dims, list(sums)), out, "append", "eventTime"))
    return (found.writeStream.format("parquet").partitionBy("period_s").option("path", root)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def read_versions(spark: SparkSession, root: str, period_s: int) -> DataFrame:
    """Everything that was emitted for a period."""
    return spark.read.parquet(root).where(F.col("period_s") == period_s).drop("period_s")


def read_metrics(spark: SparkSession, root: str, dims: Sequence[str], period_s: int) -> DataFrame:
    """The newest version of every window of a period."""
    rows = read_versions(spark, root, period_s)
    rest = [c for c in rows.columns if c not in (*dims, "period_start", "version")]
    return (rows.groupBy(*dims, "period_start").agg(F.max_by(F.struct(*rest), "version").alias("w"))
            .select(*dims, "period_start", "w.*"))
