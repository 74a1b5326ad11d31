"""Storage tiers and retention by age at ``as_of``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.operators.usage import days_before, since_filter, ts_lit
from quotalake.session import cut_lineage, delete_path

# Lifecycle transitions of the log bucket (age in days).
TIERS = [(365, "EXPIRED"), (90, "GLACIER"), (30, "STANDARD_IA")]
DEFAULT_TIER = "STANDARD"


def storage_tier(inv: DataFrame, as_of) -> DataFrame:
    """Rows and first/last day per storage tier by age in whole days."""
    age = F.datediff(F.to_date(ts_lit(as_of)), F.to_date("ts"))
    tier = F.lit(DEFAULT_TIER)
    for days, name in reversed(TIERS):
        tier = F.when(age >= days, F.lit(name)).otherwise(tier)
    return (inv.groupBy(tier.alias("tier"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.min(F.to_date("ts")).cast("timestamp_ntz").alias("oldest_day"),
                 F.max(F.to_date("ts")).cast("timestamp_ntz").alias("newest_day")))


def expire_partitions(df: DataFrame, days: int, as_of) -> DataFrame:
    """R2: rows that survive a ``days`` retention rule (day bound prunes partitions)."""
    return since_filter(df, days_before(as_of, days))


def _folders(spark: SparkSession, path: str) -> Iterator[tuple[str, dict[str, str]]]:
    """The innermost partition folders of a stored table with their values, from names alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def below(at, values: dict[str, str]) -> Iterator[tuple[str, dict[str, str]]]:
        inner = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
        for p in inner:
            yield from below(p, values | dict([p.getName().split("=", 1)]))
        if not inner and values:
            yield at.toString(), values

    return below(root, {})


def _span(values: dict[str, str]) -> tuple[dt.datetime, dt.datetime] | None:
    """Times from and before which a partition of the day or the hour layout has rows; None for any other."""
    try:
        if "usage_day" in values:
            start, length = dt.datetime.fromisoformat(values["usage_day"]), dt.timedelta(days=1)
        else:
            start, length = dt.datetime(*(int(values[k]) for k in ("year", "month", "day", "hour"))), dt.timedelta(hours=1)
    except (KeyError, ValueError):
        return None
    return start, start + length


def expire_stored(spark: SparkSession, path: str, cutoff: dt.datetime) -> dict[str, int]:
    """R2 on a stored fact table, in place: rows before ``cutoff`` (UTC) go; returns how many folders were dropped and rewritten.

    Folders that end by the cutoff are deleted by name, without reading them;
    the one folder that the cutoff lies in is rewritten; no other is touched,
    so the work does not depend on the data that is kept.  Both steps can run
    again after a failure.  Folders without a time (null partitions) are
    kept.  Layouts are those of ``write_invocations_partitioned``.
    """
    done = {"dropped": 0, "rewritten": 0}
    for folder, values in list(_folders(spark, path)):
        span = _span(values)
        if span is None or span[0] >= cutoff:
            continue
        if span[1] <= cutoff:
            delete_path(spark, folder)
            done["dropped"] += 1
            continue
        left = cut_lineage(spark.read.parquet(folder).where(F.col("ts") >= F.lit(str(cutoff)).cast("timestamp_ntz")))
        left.write.mode("overwrite").parquet(folder)
        done["rewritten"] += 1
    return done


def rewrite_retained(spark, src: str, dst: str, days: int, as_of) -> None:
    """R2 on a stored fact table: write only the day partitions that survive.

    The read prunes expired ``usage_day`` folders, so the job touches only
    the kept data; the result is a new table at ``dst`` with the same layout
    (swap it in for ``src`` afterwards).
    """
    from quotalake.sources.logs import read_invocations, write_invocations_partitioned

    write_invocations_partitioned(expire_partitions(read_invocations(spark, src), days, as_of), dst)
