import datetime as dt
import random

from pyspark.sql import functions as F

from quotalake.operators import sketches as SK

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, n):
    """Skewed latencies of many users over twenty days, made by Spark."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)).cast("double") / 1e6
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("tenant"),
        F.timestamp_add("MINUTE", (F.col("id") % 28800).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("ts"),
        F.when(F.col("id") % 50 != 0, F.floor(F.exp(h(1) * 9) * 10)).alias("latency_ms"),
        F.concat(F.lit("u"), F.floor(h(2) * 60_000).cast("string")).alias("user_id"))


def test_rank_and_count_errors_are_within_their_bounds(spark, tmp_dir):
    rows = _rows(spark, 400_000).cache()
    SK.write_daily_sketches(SK.daily_sketches(rows, ["tenant"], "latency_ms", "user_id", k=400), tmp_dir)
    parts = SK.read_daily_sketches(spark, tmp_dir)
    asked = (0.01, 0.25, 0.5, 0.9, 0.99)
    found = {r.tenant: r for r in SK.span_statistics(parts, ["tenant"], quantiles=asked).collect()}
    exact = {r.tenant: r for r in rows.groupBy("tenant").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"),
                                                             F.count("latency_ms").alias("valued")).collect()}
    assert set(found) == set(exact)
    for tenant, r in found.items():
        own = rows.where((F.col("tenant") == tenant) & F.col("latency_ms").isNotNull())
        assert (r.calls, r.valued) == (exact[tenant].calls, exact[tenant].valued)
        assert abs(r.distinct / exact[tenant].users - 1) < 4 * 1.04 / 2 ** (SK.HLL_LOG2 / 2)
        for q in asked:
            v = r[f"q{round(q * 100)}"]
            below, upto = own.agg(F.avg((F.col("latency_ms") < v).cast("int")), F.avg((F.col("latency_ms") <= v).cast("int"))).first()
            assert below - SK.rank_error(400) <= q <= upto + SK.rank_error(400)
    assert SK.rank_error(400) < 0.012 and SK.rank_error() < 0.0013


def test_spans_of_few_values_are_exact_and_days_replace_themselves(spark, tmp_dir):
    rng = random.Random(2)
    rows = [("a" if k % 2 else None, T0 + dt.timedelta(hours=k), None if k % 7 == 0 else rng.randrange(100), f"u{k % 9}" if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "tenant string, ts timestamp_ntz, latency_ms long, user_id string")
    parts = SK.daily_sketches(df, ["tenant"], "latency_ms", "user_id")
    SK.write_daily_sketches(parts, tmp_dir)
    SK.write_daily_sketches(parts.where(F.col("day") == F.lit("2024-01-03").cast("date")), tmp_dir)
    stored = SK.read_daily_sketches(spark, tmp_dir)
    got = {r.tenant: (r.calls, r.q50, r.distinct) for r in SK.span_statistics(stored, ["tenant"]).collect()}
    for tenant in ("a", None):
        mine = [r for r in rows if r[0] == tenant]
        values = sorted(r[2] for r in mine if r[2] is not None)
        assert got[tenant] == (len(mine), values[-(-len(values) // 2) - 1], len({r[3] for r in mine if r[3]}))
    by_week = SK.span_statistics(stored, ["tenant"], F.weekofyear("day")).agg(F.sum("calls")).first()[0]
    assert by_week == 200


def test_no_values_and_no_rows(spark):
    df = spark.createDataFrame([("a", T0, None, None)], "tenant string, ts timestamp_ntz, latency_ms long, user_id string")
    r = SK.span_statistics(SK.daily_sketches(df, ["tenant"], "latency_ms", "user_id"), ["tenant"]).first()
    assert (r.calls, r.valued, r.q50, r.q99, r.distinct) == (1, 0, None, None, 0)
    assert SK.span_statistics(SK.daily_sketches(df.where("false"), ["tenant"], "latency_ms", "user_id"), ["tenant"]).count() == 0
