"""Invocation-log sources and sinks.

At scale the log is normalised once (S2) and stored as a day-partitioned
parquet fact table (S6); every query then scans only the columns it uses,
its time bound reaches the scan as a pushed filter on ``ts``, and the
matching ``usage_day`` predicate prunes whole partitions.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotalake.schema import INVOCATION_LOG
from quotalake.session import cut_lineage

PARTITION_COLUMN = "usage_day"


def _as_date(since) -> dt.date:
    if isinstance(since, dt.datetime):
        return since.date()
    if isinstance(since, dt.date):
        return since
    return dt.date.fromisoformat(str(since)[:10])


# ---------------------------------------------------------------- S1 / S5
def read_invocation_logs(spark: SparkSession, path: str, since=None,
                         schema: T.StructType = INVOCATION_LOG) -> DataFrame:
    """The JSON log under ``path`` (hive-style ``year/month/day/hour`` dirs).

    The explicit schema skips inference and prunes prompt / completion
    bodies.  With ``since`` the partition columns are filtered too, which
    prunes directories (the ``timestamp`` text alone cannot).
    """
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    if since is not None and "year" in df.columns:
        d = _as_date(since)
        key = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
        df = df.where(key >= F.lit(d.year * 10000 + d.month * 100 + d.day))
    return df


def stream_invocations(spark: SparkSession, path: str, schema: T.StructType = INVOCATION_LOG,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Tail the JSON log as an unbounded stream (new files as they land)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


# ---------------------------------------------------------------- S6 / S7
def write_invocations_partitioned(inv: DataFrame, path: str, layout: str = "day",
                                  files_per_day: int | None = None, mode: str = "overwrite", dealt: bool = False) -> None:
    """Persist the fact table partitioned by ``usage_day`` (or year/month/day/hour).

    Rows are range-partitioned on (day, ts) first: each task writes a
    contiguous time slice, so files are sorted by time (tight ``ts``
    min/max statistics for pushed filters), few files per partition, and a
    very busy day is split over many tasks instead of one.  Rows that are
    ``dealt`` lie in such ranges already.
    """
    out = inv
    if layout == "hour":
        out = (out.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
               .withColumn("day", F.dayofmonth("ts")).withColumn("hour", F.hour("ts")))
        parts = ["year", "month", "day", "hour"]
    elif layout == "day":
        parts = [PARTITION_COLUMN]
    else:
        raise ValueError("layout must be 'day' or 'hour'")
    # A stated number of ranges, so that AQE does not merge them into one
    # writer that opens every folder.
    ranges = files_per_day or int(inv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not dealt:
        out = out.repartitionByRange(ranges, *[F.col(c) for c in parts], F.col("ts"), F.col("request_id"))
    out = out.sortWithinPartitions(*parts, "ts")
    out.write.mode(mode).partitionBy(*parts).parquet(path)


def read_invocations(spark: SparkSession, path: str) -> DataFrame:
    """Read a fact table written by ``write_invocations_partitioned``."""
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a query result set."""
    df.write.mode(mode).format(fmt).save(path)


# ---------------------------------------------------------------- derived tables
_DERIVED: dict[tuple[str, str, str], tuple[str, str]] = {}
_DERIVED_LOCKS: dict[tuple[str, str, str], threading.RLock] = {}
_LOCK = threading.Lock()


def source_version(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and modification times of the files under ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def derived_table(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """A table derived from the files under ``source`` and stored in the shared checkpoint folder.

    ``build()`` returns the DataFrame to store; later calls in the same
    application read the stored parquet as long as the source's files are
    the same ones, and build it anew otherwise.
    """
    return spark.read.parquet(derived_path(spark, name, source, build))


def _store(df: DataFrame, path: str) -> None:
    if PARTITION_COLUMN in df.columns:
        write_invocations_partitioned(cut_lineage(df), path)  # stored first: dealing by range reads its input twice
    else:
        df.write.mode("overwrite").parquet(path)


def derived_path(spark: SparkSession, name: str, source: str, build, write=_store) -> str:
    """Path of the stored table of ``derived_table`` (building it on first use)."""
    from quotalake.session import checkpoint_dir, stage_scope

    app = spark.sparkContext.applicationId
    key, version = (app, name, source), source_version(spark, source)
    with _LOCK:
        lock = _DERIVED_LOCKS.setdefault(key, threading.RLock())
    with lock:   # queries run from several threads build each table once
        known, path = _DERIVED.get(key, ("", ""))
        if known != version:
            digest = hashlib.sha1(f"{app}|{name}|{source}|{version}".encode()).hexdigest()[:16]
            path = os.path.join(checkpoint_dir(spark), "quotalake-derived", digest, name)
            with stage_scope(spark):
                write(build(), path)
            _DERIVED[key] = version, path
    return path


# ---------------------------------------------------------------- S3
def _flatten(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    out = {}
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out[name] = f.dataType.simpleString()
        if isinstance(f.dataType, T.StructType):
            out.update(_flatten(f.dataType, name + "."))
    return out


# Numbers in the order in which they widen.
_NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType]


def widen_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that values of both can be read as: long, then double, then text.

    Structs merge field by field, arrays by their elements; any other pair
    (an object here and text there, say) becomes text, which holds the JSON.
    """
    if a == b:
        return a
    if type(a) in _NUMBERS and type(b) in _NUMBERS:
        return max(a, b, key=lambda t: _NUMBERS.index(type(t)))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge_schemas(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widen_types(a.elementType, b.elementType), True)
    return T.StringType()


def merge_schemas(previous: T.StructType, current: T.StructType) -> T.StructType:
    """Add-only merge: keep every previous field, widened to hold both types, and append new ones (recursively)."""
    cur = {f.name: f for f in current.fields}
    fields = [T.StructField(f.name, widen_types(f.dataType, cur[f.name].dataType) if f.name in cur else f.dataType, True)
              for f in previous.fields]
    names = {f.name for f in previous.fields}
    fields.extend(f for f in current.fields if f.name not in names)
    return T.StructType(fields)


def discover_schema(spark: SparkSession, path: str, previous: T.StructType | None = None,
                    sampling_ratio: float = 1.0):
    """S3: infer the log schema, merge add-only with ``previous``, report the changes.

    Returns (merged schema, DataFrame of ``field, type, change`` with change in
    added / missing / type_changed).  Missing fields are kept, only reported.
    A field whose type changes is widened, so that ``read_invocation_logs``
    with the merged schema reads every record, older and newer, whole.
    Inference is one distributed pass over the files (``samplingRatio``).
    """
    current = spark.read.option("samplingRatio", sampling_ratio).json(path).schema
    previous = previous or T.StructType([])
    merged = merge_schemas(previous, current)
    before, after = _flatten(previous), _flatten(current)
    rows = [(k, after[k], "added") for k in after if k not in before]
    rows += [(k, before[k], "missing") for k in before if k not in after]
    rows += [(k, after[k], "type_changed") for k in after if k in before and before[k] != after[k]]
    diff = spark.createDataFrame(sorted(rows), "field string, type string, change string")
    return merged, diff


# ---------------------------------------------------------------- S10 / S11
def log_file_inventory(spark: SparkSession, path: str, n: int | None = 10) -> DataFrame:
    """Files under the log prefix with size and record count, first ``n`` by path
    (``None``: every file)."""
    df = spark.read.schema(INVOCATION_LOG).json(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    out = (df.groupBy("file_path").agg(F.first("file_size").alias("size_bytes"),
                                       F.count(F.lit(1)).alias("records"))
           .orderBy("file_path"))
    return out.limit(n) if n is not None else out


def folder_inventory(files: DataFrame) -> DataFrame:
    """S10 per hour folder: its path below the prefix and its records, from ``log_file_inventory`` of every file."""
    folder = F.regexp_extract("file_path", r"(year=\d+/month=\d+/day=\d+/hour=\d+)/[^/]+$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.sum("records").cast("bigint").alias("records"))


def log_freshness(inv: DataFrame, sources: DataFrame, as_of, source_col: str = "source") -> DataFrame:
    """Newest event per source, its lag in seconds at ``as_of``; 'no events yet' if none."""
    from quotalake.functions.timecols import epoch_seconds
    from quotalake.operators.usage import ts_lit

    newest = inv.groupBy(F.col(source_col).alias("source")).agg(F.max("ts").alias("newest_event"))
    lag = epoch_seconds(ts_lit(as_of)) - epoch_seconds(F.col("newest_event"))
    return sources.select("source").join(newest, "source", "left").select(
        "source", "newest_event",
        F.when(F.col("newest_event").isNotNull(), lag).alias("lag_seconds"),
        F.when(F.col("newest_event").isNull(), F.lit("no events yet"))
        .otherwise(F.lit("ok")).alias("status"))
