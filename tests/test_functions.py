import datetime as dt

from pyspark.sql import functions as F

from quotalake.functions.jsonpath import json_scalar, parse_json_text
from quotalake.functions.pricing import blended_cost, estimate_cost, usage_totals
from quotalake.functions.timecols import bucket_start, iso_to_ts
from quotalake.operators.usage import percent_2dp


def test_json_scalar_semantics(spark):
    rows = [
        ('{"a": {"b": 1}, "c": "x", "d": 12, "e": null, "f": [1], "g": true, "h": "{not object}"}',),
        ("not json",), (None,),
    ]
    df = spark.createDataFrame(rows, "t string")
    v = parse_json_text(F.col("t"))
    out = df.select(*[json_scalar(v, f"$.{k}").alias(k) for k in "acdefghz"]).collect()
    assert out[0].asDict() == {"a": None, "c": "x", "d": "12", "e": None, "f": None, "g": "true",
                               "h": "{not object}", "z": None}
    assert all(v is None for v in out[1].asDict().values())
    assert all(v is None for v in out[2].asDict().values())


def test_iso_to_ts_offsets_and_garbage(spark):
    rows = [("2024-02-14T23:59:59.999Z",), ("2024-02-15T01:00:00+02:00",), ("2024-02-14T18:00:00-0500",),
            ("2024-02-14 10:00:00",), ("garbage",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(iso_to_ts(F.col("s"))).collect()]
    assert got == [dt.datetime(2024, 2, 14, 23, 59, 59, 999000), dt.datetime(2024, 2, 14, 23, 0),
                   dt.datetime(2024, 2, 14, 23, 0), dt.datetime(2024, 2, 14, 10, 0), None, None]


def test_cost_is_exact_half_up(spark):
    # 50 micro-dollars is exactly half of the 4th decimal: rounds up.
    rows = [(0, 0), (1, 0), (50, 0), (16, 1), (10 ** 15, 10 ** 15), (None, 5)]
    df = spark.createDataFrame(rows, "i long, o long")
    got = [r[0] for r in df.select(estimate_cost(F.col("i"), F.col("o"), dp=4)).collect()]
    assert got[0] == 0.0 and got[1] == 0.0          # 3 micro-dollars -> 0.0000
    assert got[2] == 0.0002                           # 150 micro -> 0.00015 -> 0.0002
    assert got[3] == 0.0001                           # 48 + 15 = 63 micro -> 0.0001
    assert got[4] == 18_000_000_000.0
    assert got[5] is None
    two = df.select(estimate_cost(F.lit(1666), F.lit(0), dp=2)).first()[0]   # 4998 micro -> 0.00
    assert two == 0.0
    assert df.select(blended_cost(F.lit(1_000_000), dp=None)).first()[0] == 9.0


def test_percent_2dp_golden(spark):
    # Published figures: 150,000,350 of 500M is 30.0 %, 80,000,233 of 300M is 26.7 %.
    df = spark.createDataFrame([(150000350, 500000000), (80000233, 300000000), (5, 0), (1, 200)],
                               "u long, l long")
    got = [r[0] for r in df.select(percent_2dp(F.col("u"), F.col("l"))).collect()]
    assert got == [30.0, 26.67, None, 0.5]


def test_bucket_start_is_epoch_aligned(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 14, 23, 59, 59, 999000),)], "ts timestamp_ntz")
    r = df.select(bucket_start(F.col("ts"), 300).alias("a"), bucket_start(F.col("ts"), 3600).alias("b"),
                  bucket_start(F.col("ts"), 86400).alias("c")).first()
    assert r.a == dt.datetime(2024, 2, 14, 23, 55) and r.b == dt.datetime(2024, 2, 14, 23) \
        and r.c == dt.datetime(2024, 2, 14)


def test_usage_totals_zero_guard(spark):
    empty = spark.createDataFrame([], "input_tokens long, output_tokens long")
    r = usage_totals(empty).first()
    assert (r.total_calls, r.total_tokens, r.avg_tokens_per_call) == (0, 0, 0)
    # Published test traffic: 12 calls, 1,361 tokens, 113 per call.
    calls = spark.createDataFrame([(100, 13)] * 11 + [(100, 18)], "input_tokens long, output_tokens long")
    r = usage_totals(calls).first()
    assert (r.total_calls, r.total_tokens, r.avg_tokens_per_call) == (12, 1361, 113)


def test_approx_distinct_close_to_exact(spark):
    from quotalake.operators import usage as U

    inv = spark.range(0, 20000).select(
        F.lit("1").alias("account_id"), F.lit(True).alias("has_metadata"),
        F.lit("2024-02-10 00:00:00").cast("timestamp_ntz").alias("ts"), F.to_date(F.lit("2024-02-10")).alias("usage_day"),
        F.concat(F.lit("u"), (F.col("id") % 5000).cast("string")).alias("user_id"),
        (F.col("id") % 3).cast("string").alias("tenant"), F.lit("d").alias("department"),
        F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    exact = {r.tenant: r.unique_users for r in U.department_cost(inv, dt.datetime(2024, 2, 18), "1").collect()}
    approx = {r.tenant: r.unique_users for r in U.department_cost(inv, dt.datetime(2024, 2, 18), "1", approx=True).collect()}
    assert all(abs(approx[k] - exact[k]) <= 0.05 * exact[k] for k in exact)
