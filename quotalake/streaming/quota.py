"""T4 stream_quota_decisions: check-then-add per micro-batch, and T3 on quota percent behind it.

Each micro-batch applies the batch replay rules (K8: the calls are sent once,
a user with very many of them is spread over many tasks) on top of the
usage accepted by earlier batches.  That usage is one row per user and day,
in partitions by month and user bucket of which a batch reads and replaces
those it touches: a late call, however old its day, meets the usage of that
day.
Equals K8 for input in time order; other calls are decided on arrival.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.functions.timecols import bucket_start
from quotalake.operators.alarms import evaluate_alarm
from quotalake.operators.quota import decide_calls, prepare_calls, rejected_calls
from quotalake.session import stage_scope
from quotalake.streaming.common import BatchTable, PeriodTotals

DECISIONS = ("request_id string, ts timestamp_ntz, user_id string, enforcement_mode string, monthly_limit bigint, "
             "daily_limit bigint, metric_monthly_limit bigint, tokens bigint, allowed boolean, charged_tokens bigint, "
             "monthly_usage bigint, daily_usage bigint, status int")
Dimensions = Callable[[], tuple[DataFrame, DataFrame]]


def stream_quota_decisions(calls_stream: DataFrame, dimensions: Dimensions, root: str, checkpoint: str, chunk_seconds: int = 60,
                           buckets: int = 4):
    """T4; returns the writer.

    ``dimensions`` returns (users, policies); it is called for every batch,
    so a changed limit takes effect with the next batch.  Calls without a
    user id and of unknown users get their 400 and 404 rows.
    """
    usage, decisions = PeriodTotals(os.path.join(root, "usage"), buckets), BatchTable(os.path.join(root, "decisions"), DECISIONS)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with stage_scope(spark):
            base = prepare_calls(batch, *dimensions())
            touched = usage.touched(batch.select("user_id", F.to_date("ts").alias("day")).where("user_id is not null"))
            earlier = usage.before(spark, touched, batch_id)
            # One row per user, so that the calls are sent once, by user.
            months = earlier.groupBy("user_id", "month").agg(
                F.sum("used").cast("bigint").alias("used"), F.map_from_entries(F.collect_list(F.struct("day", "used"))).alias("days"))
            carried = months.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct("used", "days")))).alias("_carried"))
            carry = F.col("_carried")[F.col("_month")]

            def carried_on(rows: DataFrame) -> DataFrame:
                return (rows.join(carried, "user_id", "left").withColumns({
                    "_carry_m": F.coalesce(carry["used"], F.lit(0)), "_carry_d": F.coalesce(carry["days"][F.col("_day")], F.lit(0))})
                    .drop("_carried"))

            decided = decide_calls(base.where("status is null"), chunk_seconds, batch, carried_on)
            decided = decided.unionByName(rejected_calls(base), allowMissingColumns=True)
            decisions.write(decided.select(*[c.split()[0] for c in DECISIONS.split(", ")]), batch_id)
            done = decisions.read(spark).where((F.col("batch") == batch_id) & F.col("charged_tokens").isNotNull())
            accepted = done.groupBy("user_id", F.to_date("ts").alias("day")).agg(
                F.sum("charged_tokens").cast("bigint").alias("used"), F.max("ts").alias("last_updated"))
            usage.add(accepted, touched, batch_id)

    return calls_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)


def read_decisions(spark: SparkSession, root: str) -> DataFrame:
    return BatchTable(os.path.join(root, "decisions"), DECISIONS).read(spark).drop("batch")


def read_quota_alarm(decisions: DataFrame, threshold: float = 80.0, period_s: int = 300) -> DataFrame:
    """T3 on quota percent: A1 over T4's decisions."""
    used = F.col("monthly_usage") + F.col("charged_tokens")
    pct = F.when(F.col("metric_monthly_limit") > 0, used / F.col("metric_monthly_limit") * F.lit(100)).otherwise(F.lit(0.0))
    series = (decisions.where(F.col("status") == 200)
              .groupBy(bucket_start(F.col("ts"), period_s).alias("period_start")).agg(F.max(pct).alias("value")))
    return evaluate_alarm(series, threshold, period_s)
