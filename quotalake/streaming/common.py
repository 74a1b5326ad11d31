"""Helpers shared by the streaming operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.session import checkpoint_dir, cut_lineage


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run's sink and checkpoint (shared storage)."""
    return os.path.join(checkpoint_dir(spark), "quotalake-streams", f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, path: str, template: DataFrame,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Tail the parquet files of a stored table (schema taken from ``template``)."""
    reader = spark.readStream.schema(template.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


# Rows of one file of a slice, so that one task reads it in seconds.
FILE_ROWS = 250_000


def write_slices(df: DataFrame, path: str, at: str, order: Sequence[Column] = (), slices: int = 3) -> None:
    """Store ``df`` as slices of about as many rows, one after the other in time ``at``, for ``slice_stream``.

    Each slice has the same number of files, which grows with the rows, so
    that many tasks write and read it.  Rows without a time are in no slice.
    """
    edges = df.agg(F.percentile_approx(at, [k / slices for k in range(1, slices)], 1000).alias("at")).first().at or []
    number = reduce(lambda a, b: a + b, [(F.col(at) >= F.lit(e)).cast("int") for e in edges], F.lit(0))
    placed = df.where(F.col(at).isNotNull()).withColumn("_slice", number)
    rows = {r["_slice"]: r["count"] for r in placed.groupBy("_slice").count().collect()}
    # Never so many files that one of them could stay empty: an empty part is not written.
    files = max(1, min(-(-max(rows.values(), default=0) // FILE_ROWS), min(rows.get(k, 0) for k in range(slices)) // 1000))
    for k in range(slices):
        part = placed.where(F.col("_slice") == k).drop("_slice").repartition(files)
        (part.sortWithinPartitions(*order) if order else part).write.mode("append").parquet(path)
    if len(df.sparkSession.read.parquet(path).inputFiles()) != slices * files:
        raise ValueError("the slices do not have the same number of files")


def slice_stream(spark: SparkSession, path: str, slices: int = 3) -> DataFrame:
    """Tail what ``write_slices`` stored, one slice a micro-batch."""
    stored = spark.read.parquet(path)
    return file_stream(spark, path, stored, max_files_per_trigger=len(stored.inputFiles()) // slices)


def run_until_caught_up(writer):
    """Start with ``availableNow`` (process what exists, then stop) and wait until all of it is processed.

    There is no time limit: an unfinished sink is never taken for a result.
    Nor is one that a stateful operator has dropped rows from: arrival times
    that run backwards by more than the delay raise an error.
    """
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if dropped:
        raise ValueError(f"{dropped} rows arrived more than the delay after later ones and were dropped")
    return query


def make_folder(spark: SparkSession, path: str) -> str:
    """An empty table, if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def overwrite_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


class BatchTable:
    """One table of what micro-batches have put out, partitioned by ``batch``.

    A batch that runs again replaces its own partition, so each row is there
    once; readers scan one table, however many batches there were.
    """

    def __init__(self, root: str, schema: str):
        self.root, self.schema = root, schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        make_folder(df.sparkSession, self.root)
        overwrite_partitions(df.withColumn("batch", F.lit(batch_id).cast("long")), self.root, ["batch"])

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, batch long").parquet(self.root)


class PeriodTotals:
    """Running totals per (user_id, day), partitioned by month and hash bucket of the user.

    A micro-batch rewrites the partitions it touches and no others, so
    storage is one row per user and day however many batches there were.  A
    table that is gone after the first batch is an error, never an empty state.
    ``last_updated`` is the newest time counted.  Each row keeps what it was
    before the batch that changed it last (``was``, ``was_updated``,
    ``batch``): a batch that runs again, even after some of its partitions
    were replaced, starts from there and adds nothing twice.  A large
    partition is written by several tasks.
    """

    COLUMNS = ("user_id string, day date, used long, last_updated timestamp_ntz, was long, was_updated timestamp_ntz, "
               "batch long, month date, bucket int")

    def __init__(self, root: str, buckets: int = 4):
        self.root, self.buckets = root, buckets

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows(user_id, day, ...)`` with their partition."""
        return (rows.withColumn("month", F.trunc("day", "MM"))
                .withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")))

    def _before(self, spark: SparkSession, touched: list, batch_id: int) -> DataFrame:
        """Rows of the ``touched`` partitions as they stood before the batch, null where it made them."""
        if not batch_id:
            make_folder(spark, self.root)
        rows = spark.read.schema(self.COLUMNS).parquet(self.root)
        here = F.lit(False)
        for month, buckets in _grouped(touched).items():
            here = here | ((F.col("month") == F.lit(month)) & F.col("bucket").isin(buckets))
        again = F.col("batch") >= F.lit(batch_id)
        return (rows.where(here).withColumn("used", F.when(again, F.col("was")).otherwise(F.col("used")))
                .withColumn("last_updated", F.when(again, F.col("was_updated")).otherwise(F.col("last_updated"))))

    def touched(self, rows: DataFrame) -> list:
        """(month, bucket) of the partitions of ``rows(user_id, day)``: those of one micro-batch."""
        return [(r.month, r.bucket) for r in self.placed(rows).where("month is not null").select("month", "bucket").distinct().collect()]

    def before(self, spark: SparkSession, touched: list, batch_id: int) -> DataFrame:
        """(user_id, day, month, used) counted by earlier batches in the touched partitions."""
        return self._before(spark, touched, batch_id).where("used is not null").select("user_id", "day", "month", "used")

    def add(self, parts: DataFrame, touched: list, batch_id: int) -> None:
        """Add ``parts(user_id, day, used, last_updated)``, one row per user and day."""
        spark = parts.sparkSession
        new = self.placed(parts).select("user_id", "day", "month", "bucket", F.col("used").alias("_add"), F.col("last_updated").alias("_at"))
        both = self._before(spark, touched, batch_id).join(new, ["user_id", "day", "month", "bucket"], "full_outer")
        hit = F.col("_add").isNotNull()
        merged = both.where("used is not null or _add is not null").select(
            "user_id", "day", F.when(hit, F.coalesce("used", F.lit(0)) + F.col("_add")).otherwise(F.col("used")).alias("used"),
            F.greatest("last_updated", "_at").alias("last_updated"), F.when(hit, F.col("used")).otherwise(F.col("was")).alias("was"),
            F.when(hit, F.col("last_updated")).otherwise(F.col("was_updated")).alias("was_updated"),
            F.when(hit, F.lit(batch_id)).otherwise(F.col("batch")).cast("long").alias("batch"), "month", "bucket")
        # Stored first: the partitions are read and replaced.
        overwrite_partitions(cut_lineage(merged.hint("rebalance", "month", "bucket")), self.root, ["month", "bucket"])

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.COLUMNS).parquet(self.root).select("user_id", "day", "used", "last_updated")


def _grouped(touched: list) -> dict:
    out: dict = {}
    for month, bucket in touched:
        out.setdefault(month, []).append(bucket)
    return out
