"""M0 quantiles and Q10/V8 distinct counts over any span from stored daily sketches.

One pass over a day's calls leaves a row per (dims, day): counts, a KLL
sketch of the latencies and an HLL sketch of the users.  Spans of any length
merge these rows (Spark's own sketch functions, partial aggregation before
the shuffle) and never read the calls again.  The exact forms are M0
(``metric_statistics``) and ``count(distinct)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of a KLL sketch: the rank of a quantile is off by rank_error(KLL_K) at most, at 99 % confidence.
KLL_K = 4_096
# Log2 of an HLL sketch's registers: the relative standard error is 1.04 / 2 ** (HLL_LOG2 / 2).
HLL_LOG2 = 14


def rank_error(k: int = KLL_K) -> float:
    """Bound on the error of a rank (share of all values) of a KLL sketch, at 99 % confidence."""
    return 2.296 / k ** 0.9021


def daily_sketches(rows: DataFrame, dims: Sequence[str], value: str | Column, distinct: str | Column, k: int = KLL_K,
                   log2: int = HLL_LOG2) -> DataFrame:
    """(dims, day, calls, valued, quantiles, members) per day of ``rows(ts, ...)``: mergeable parts.

    Null values and members are not counted; a day without any has a null
    sketch.  Rows without a time form a null day.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    who = F.col(distinct) if isinstance(distinct, str) else distinct
    return rows.select(*dims, F.to_date("ts").alias("day"), v.alias("_v"), who.cast("string").alias("_w")).groupBy(*dims, "day").agg(
        F.count(F.lit(1)).alias("calls"), F.count("_v").alias("valued"),
        F.when(F.count("_v") > 0, F.kll_sketch_agg_bigint("_v", F.lit(k))).alias("quantiles"),
        F.when(F.count("_w") > 0, F.hll_sketch_agg("_w", F.lit(log2))).alias("members"))


def write_daily_sketches(parts: DataFrame, path: str) -> None:
    """Store daily parts; days that are written again replace their own partitions."""
    parts.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_daily_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def span_statistics(parts: DataFrame, dims: Sequence[str], span: Column | None = None, quantiles: Sequence[float] = (0.5, 0.99)) -> DataFrame:
    """(dims, span, calls, valued, q50, q99, ..., distinct) of daily parts merged per ``dims`` and ``span`` (an expression on ``day``).

    Quantiles are values of the data whose rank is within ``rank_error`` of
    the one asked for; null where there is no value.  ``distinct`` is an
    estimate, 0 where there is no member.  Without ``span`` all days are one.
    """
    over = [span.alias("span")] if span is not None else []
    merged = parts.groupBy(*dims, *over).agg(
        F.sum("calls").cast("bigint").alias("calls"), F.sum("valued").cast("bigint").alias("valued"),
        F.kll_merge_agg_bigint("quantiles").alias("_q"), F.hll_union_agg("members").alias("_m"))
    some = F.col("valued") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_bigint("_q", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return merged.select(*dims, *[F.col("span") for _ in over], "calls", "valued", *at,
                         F.coalesce(F.hll_sketch_estimate("_m"), F.lit(0)).alias("distinct"))
