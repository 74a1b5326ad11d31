"""M1-M19 from stored rollups: mergeable parts per minute, hour, day and month.

Each level holds one row per (dims, bucket) with counts, sums, minima and
maxima, made from the level below it, so the calls are read once.  A series
or a total over any span of whole minutes is put together from the coarsest
levels that fit: months and days in the middle, hours and minutes at the
ends.  Quantiles and distinct counts do not merge this way; they have
sketches (``sketches.py``).
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.functions.timecols import bucket_start, month_start

LEVELS = ("minute", "hour", "day", "month")
_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
# Folders of a level: a day's minutes and hours, a month's days and months.
_FOLDER = {"minute": "day", "hour": "day", "day": "month", "month": "month"}
_PARTS = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _bucket(ts: Column, level: str) -> Column:
    return month_start(ts) if level == "month" else bucket_start(ts, _SECONDS[level])


def _folder(level: str) -> Column:
    return _bucket(F.col("at"), _FOLDER[level]).cast("date").alias("folder")


def minute_parts(rows: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(dims, at, calls, <measure>_n, _sum, _min, _max) per minute of ``rows(ts, ...)``.

    ``_n`` counts values that are not null; rows without a time are left out.
    """
    parts = [f(m).alias(f"{m}_{name}") for m in measures for name, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    return (rows.where(F.col("ts").isNotNull()).groupBy(*dims, _bucket(F.col("ts"), "minute").alias("at"))
            .agg(F.count(F.lit(1)).alias("calls"), *parts))


def _merged(parts: DataFrame, keys: Sequence[str | Column], measures: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("calls").cast("bigint").alias("calls"), *[
        f(f"{m}_{name}").cast(parts.schema[f"{m}_{name}"].dataType).alias(f"{m}_{name}") for m in measures for name, f in _PARTS.items()])


def write_rollups(rows: DataFrame, path: str, dims: Sequence[str], measures: Sequence[str]) -> None:
    """Store all levels of whole days of ``rows`` below ``path``.

    Days written again replace their own folders: minutes and hours by day,
    days and months by month, made anew from the stored level below.  The
    driver lists the days of one write.
    """
    spark = rows.sparkSession

    def write(parts: DataFrame, level: str) -> None:
        (parts.withColumn("folder", _folder(level)).repartition("folder", F.pmod(F.hash("at"), F.lit(8)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(os.path.join(path, level)))

    def read(level: str) -> DataFrame:
        return spark.read.parquet(os.path.join(path, level))

    rows = rows.where(F.col("ts").isNotNull())
    days = [r.day for r in rows.select(F.to_date("ts").alias("day")).distinct().collect()]
    months = sorted({d.replace(day=1) for d in days})
    if not days:
        return
    write(minute_parts(rows, dims, measures), "minute")
    step = lambda finer, level: write(_merged(finer, [*dims, _bucket(F.col("at"), level).alias("at")], measures), level)
    step(read("minute").where(F.col("folder").isin(days)), "hour")
    step(read("hour").where(F.trunc("folder", "MM").isin(months)), "day")
    step(read("day").where(F.col("folder").isin(months)), "month")


def _floor(at: dt.datetime, level: str) -> dt.datetime:
    zero = {"second": 0, "microsecond": 0}
    for part, name, least in (("minute", "hour", 0), ("hour", "day", 0), ("day", "month", 1)):
        if LEVELS.index(level) >= LEVELS.index(name):
            zero[part] = least
    return at.replace(**zero)


def _next(at: dt.datetime, level: str) -> dt.datetime:
    if level == "month":
        return (at.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return at + dt.timedelta(seconds=_SECONDS[level])


def cover(start: dt.datetime, end: dt.datetime, coarsest: str = "month") -> list[tuple[str, dt.datetime, dt.datetime]]:
    """[start, end) as disjoint (level, from, to) of whole buckets, the coarsest possible; two per level at most."""
    if _floor(start, "minute") != start or _floor(end, "minute") != end:
        raise ValueError("spans begin and end at whole minutes")
    if start >= end:
        return []
    low, high = _floor(start, coarsest), _floor(end, coarsest)
    if low != start:
        low = _next(low, coarsest)
    if coarsest == "minute":
        return [("minute", low, high)]
    finer = LEVELS[LEVELS.index(coarsest) - 1]
    if low >= high:
        return cover(start, end, finer)
    return cover(start, low, finer) + [(coarsest, low, high)] + cover(high, end, finer)


def rollup_series(spark: SparkSession, path: str, dims: Sequence[str], measures: Sequence[str], start: dt.datetime,
                  end: dt.datetime, period: str | None = None) -> DataFrame:
    """(dims, [period_start], calls, <measure>_n, _sum, _min, _max, _avg) of [start, end) from the stored levels.

    ``dims`` and ``measures`` are any of the stored ones.  ``period`` is a
    level (a series of its buckets) or None (one total).  Only buckets inside
    the span are read: those of a period that the span cuts come from finer
    levels.  An empty span gives no rows; without ``dims`` and ``period``,
    one row with 0 calls.
    """
    def ntz(at: dt.datetime) -> Column:
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")

    def piece(level: str, low: dt.datetime, high: dt.datetime) -> DataFrame:
        first, last = (_floor(at, _FOLDER[level]).date() for at in (low, high - dt.timedelta(microseconds=1)))
        return (spark.read.parquet(os.path.join(path, level))
                .where(F.col("folder").between(F.lit(first), F.lit(last)) & (F.col("at") >= ntz(low)) & (F.col("at") < ntz(high))))

    pieces = cover(start, end, period or "month") or [("minute", start, start)]
    parts = piece(*pieces[0])
    for p in pieces[1:]:
        parts = parts.unionByName(piece(*p))
    over = [_bucket(F.col("at"), period).alias("period_start")] if period else []
    merged = _merged(parts, [*dims, *over], measures).withColumn("calls", F.coalesce("calls", F.lit(0)))
    return merged.select("*", *[(F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_n"), F.lit(0))).alias(f"{m}_avg") for m in measures])
