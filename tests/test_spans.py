import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quotalake.operators import quota as K
from tests.test_quota import policies_df, users_df

CALLS = "request_id string, ts timestamp_ntz, user_id string, input_tokens long, output_tokens long, failed boolean"
D = lambda m, d: dt.date(2024, m, d)


def _inputs(spark):
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 28)
    rows = [(f"r{k:04d}", t0 + dt.timedelta(minutes=rnd.randrange(9 * 1440)), f"u{rnd.randrange(6)}" if k % 3 else "u0",
             rnd.choice([0, 2, 5]), None, rnd.random() < 0.1) for k in range(600)]
    rows += [("ghost", t0, "nobody", 1, 1, False), ("none", t0 + dt.timedelta(days=3), None, 1, 1, False)]
    users = users_df(spark, [(f"u{u}", "g", "t", "d") for u in range(6)])
    pols = policies_df(spark, [("user", f"u{u}", 60 + 50 * u, 30 + 8 * u, "block" if u % 4 else "alert") for u in range(6)])
    return spark.createDataFrame(rows, CALLS), users, pols


def _key(df):
    return sorted(map(str, df.select("request_id", "allowed", "charged_tokens", "monthly_usage", "daily_usage", "status").collect()))


@pytest.mark.parametrize("ends", [[D(1, 29), D(1, 30), D(1, 31), D(2, 1), D(2, 2), D(2, 4), D(2, 6)], [D(1, 30), D(2, 3), D(2, 6)]])
def test_spans_equal_one_full_replay(spark, tmp_dir, ends):
    calls, users, pols = _inputs(spark)
    start = D(1, 28)
    for end in ends:
        K.replay_span(spark, tmp_dir, calls, users, pols, start, end)
        if end == ends[1]:
            K.replay_span(spark, tmp_dir, calls, users, pols, start, end)  # again
        start = end
    full = K.quota_replay(calls, users, pols)
    assert _key(K.decisions_of_spans(spark, tmp_dir)) == _key(full)
    rows = lambda df: sorted(map(str, df.select("user_email", "metric_period", "tokens_used", "last_updated", "ttl").collect()))
    assert rows(K.counters_from_spans(spark, tmp_dir)) == rows(K.counters_from_replay(full))


def test_a_span_reads_its_own_days_and_needs_its_predecessor(spark, tmp_dir):
    calls, users, pols = _inputs(spark)
    path = os.path.join(tmp_dir, "calls")
    calls.withColumn("usage_day", F.to_date("ts")).write.partitionBy("usage_day").parquet(path)
    root = os.path.join(tmp_dir, "out")
    K.replay_span(spark, root, calls, users, pols, D(1, 28), D(1, 30))
    with pytest.raises(ValueError):
        K.replay_span(spark, root, calls, users, pols, D(1, 31), D(2, 1))
    with pytest.raises(ValueError):
        K.replay_span(spark, root, calls, users, pols, D(1, 31), D(1, 31))
    only = calls.where((F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")))  # earlier calls are not there any more
    K.replay_span(spark, root, only, users, pols, D(1, 30), D(2, 1))
    want = K.quota_replay(calls.where(F.col("ts") < F.lit("2024-02-01").cast("timestamp_ntz")), users, pols)
    assert _key(K.decisions_of_spans(spark, root)) == _key(want)
