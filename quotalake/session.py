"""Session settings the operators assume (UTC, ANSI, AQE) and lineage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every quotalake job wants; applied only where the session does not
# already set them, so a cluster's own configuration always wins.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "quotalake") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set DEFAULT_CONF keys that the session leaves unset."""
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


# Parquet of our tables is about an eighth of its rows in memory.  Taken at
# its stored size, a table far beyond the broadcast limit would pass through
# the driver.
FILE_SIZE = "spark.sql.sources.fileCompressionFactor"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set to shared storage; only when it is unset
    in a ``local[...]`` session (tests) do we create one of our own.
    """
    if float(spark.conf.get(FILE_SIZE)) == 1:
        spark.conf.set(FILE_SIZE, "8.0")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="quotalake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_SCOPES = threading.local()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own in whatever store it lives in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def stage_scope(spark: SparkSession):
    """Delete the stage tables that ``cut_lineage`` stores inside this block when it ends.

    For callers that have written their result by then, so that nothing
    reads the stage tables any more.  Yields the list of their paths; one
    that is taken out of it stays.
    """
    outer = getattr(_SCOPES, "paths", None)
    _SCOPES.paths = paths = []
    try:
        yield paths
    finally:
        _SCOPES.paths = outer
        for path in paths:
            delete_path(spark, path)


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once (with writer ``options``) as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint (the stored files survive
    lost executors), but in one pass and columnar: an RDD checkpoint
    computes its input twice and stores serialised rows.  Inside a
    ``stage_scope`` the table is deleted when the scope ends.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "quotalake-stage", uuid.uuid4().hex)
    df.write.mode("overwrite").options(**options).parquet(path)
    if getattr(_SCOPES, "paths", None) is not None:
        _SCOPES.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
