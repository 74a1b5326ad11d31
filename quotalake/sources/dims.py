"""Dimension tables with key-value put semantics.

A key-value store keeps one item per key and a later put replaces the
earlier one.  Loaded as DataFrames this is "latest row per key", computed
with a window over the key (one shuffle on the key, no driver work).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.functions.timecols import iso_to_ts
from quotalake.plans.asof import neighbour
from quotalake.schema import QUOTA_POLICIES, TENANT_PROFILES, USER_METADATA

USER_KEYS = ["userId"]
POLICY_KEYS = ["policy_type", "identifier"]
PROFILE_KEYS = ["profile_id"]


def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str | None = "updatedAt",
                   seq_col: str | None = None) -> DataFrame:
    """Keep the newest row per key (by ``order_col``, then ``seq_col``, e.g. a batch id).

    An aggregate (``max_by`` over the row) rather than a ranking window:
    partial aggregation runs before the shuffle, so a key with very many
    puts never lands in one task as a whole.  NULL ordering values lose.
    """
    order = [c for c in (order_col, seq_col) if c and c in df.columns]
    keys = list(keys)
    if not order:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


PUT_ORDER = "_put"


def _load(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    """The stored puts with their order: ``updatedAt``, then the file's time and name, then the place in it."""
    reader = spark.read.schema(schema)
    df = reader.json(path) if fmt == "json" else reader.format(fmt).load(path)
    return df.withColumn(PUT_ORDER, F.struct(
        "updatedAt", "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("place")))


def _latest_put(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return latest_per_key(df, keys, order_col=PUT_ORDER).drop(PUT_ORDER)


def load_user_metadata(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """User metadata, one row per userId (the latest put wins)."""
    return _latest_put(_load(spark, path, USER_METADATA, fmt), USER_KEYS)


def load_quota_policies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Quota policies, one row per (policy_type, identifier) (the latest put wins)."""
    return _latest_put(_load(spark, path, QUOTA_POLICIES, fmt), POLICY_KEYS)


def load_policy_puts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Every stored put of a quota policy, for ``policy_versions``."""
    return _load(spark, path, QUOTA_POLICIES, fmt)


POLICY_VALUES = ["monthly_limit", "daily_limit", "enforcement_mode"]
# A put without a readable time has been in force for ever.
FOR_EVER = "0001-01-01 00:00:00"


def policy_versions(puts: DataFrame) -> DataFrame:
    """(policy_type, identifier, values, valid_from, valid_to) per version of a policy, from all its puts.

    A put is in force from its ``updatedAt`` until the next put of the same
    policy; ``valid_to`` is null for the last.  Of puts with the same time the
    last one counts, and a put that changes no value makes no version.  Puts
    without an identifier are ignored.
    """
    order = F.col(PUT_ORDER) if PUT_ORDER in puts.columns else F.struct(*POLICY_VALUES)
    values = F.struct(*POLICY_VALUES)
    once = (puts.where("policy_type is not null and identifier is not null")
            .groupBy(*POLICY_KEYS, F.coalesce(iso_to_ts(F.col("updatedAt")), F.lit(FOR_EVER).cast("timestamp_ntz")).alias("valid_from"))
            .agg(F.max_by(values, order).alias("_v")).select(*POLICY_KEYS, "valid_from", "_v.*"))
    new = (neighbour(once, POLICY_KEYS, "valid_from", values, "_before")
           .where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(values)).drop("_before"))
    closed = neighbour(new, POLICY_KEYS, "valid_from", F.struct("valid_from"), "_after", later=True)
    return closed.select(*POLICY_KEYS, *POLICY_VALUES, "valid_from", F.col("_after.valid_from").alias("valid_to"))


def load_tenant_profiles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Tenant inference profiles, one row per profile_id (the latest put wins)."""
    return _latest_put(_load(spark, path, TENANT_PROFILES, fmt), PROFILE_KEYS)


def upsert_dimension(dim: DataFrame, changes: DataFrame, keys: Sequence[str],
                     partial: bool = False, seq_col: str | None = None) -> DataFrame:
    """Apply puts (``partial=False``) or attribute updates (``partial=True``).

    A put replaces the whole item; an update sets only the non-NULL
    attributes of the change and keeps the rest, so several updates of one
    item add up.  Changes are applied in ``updatedAt`` order when that column
    exists, ties by ``seq_col`` (a column of the changes that is not stored);
    for each attribute the latest value wins.
    """
    keys = list(keys)
    if not partial:
        latest = latest_per_key(changes, keys, seq_col=seq_col)
        merged = (dim.join(latest.select(*keys), keys, "left_anti")
                  .unionByName(latest.drop(*([seq_col] if seq_col else [])), allowMissingColumns=True))
        return merged.select(*dim.columns)
    order = [c for c in ("updatedAt", seq_col) if c and c in changes.columns]
    rank = F.struct(*order) if order else F.struct(F.lit(0))  # without an order, one change per attribute is expected
    attributes = [x for x in changes.columns if x in dim.columns and x not in keys]
    # max_by skips rows without a rank, so each attribute takes its own latest value.
    c = changes.groupBy(*keys).agg(*[
        F.max_by(x, F.when(F.col(x).isNotNull(), rank)).alias(f"_new_{x}") for x in attributes])
    joined = dim.join(c, keys, "full_outer")
    return joined.select(*[F.coalesce(F.col(f"_new_{x}"), F.col(x)).alias(x) if x in attributes else F.col(x)
                           for x in dim.columns])


def derive_user_policies(users: DataFrame) -> DataFrame:
    """One ``user`` policy per user from its own limits, mode ``block``."""
    return users.select(
        F.lit("user").alias("policy_type"),
        F.col("userId").alias("identifier"),
        F.col("monthlyLimit").cast("bigint").alias("monthly_limit"),
        F.col("dailyLimit").cast("bigint").alias("daily_limit"),
        F.lit("block").alias("enforcement_mode"),
        F.concat(F.lit("User-specific quota for "), F.col("userId")).alias("description"),
        F.col("createdAt"), F.col("updatedAt"),
    )
