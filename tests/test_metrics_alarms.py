import datetime as dt
import random

from quotalake.operators import alarms as AL
from quotalake.operators import metrics as M


def test_alarm_strict_threshold_gaps_and_n_of_n(spark):
    t = dt.datetime(2024, 2, 1)
    p = lambda k: t + dt.timedelta(minutes=5 * k)
    series = spark.createDataFrame([(p(0), 80.0), (p(1), 81.0), (p(2), 90.0), (p(4), 95.0), (p(5), 99.0)],
                                   "period_start timestamp_ntz, value double")
    one = {r.period_start: (r.state, r.changed) for r in AL.evaluate_alarm(series, 80, 300).collect()}
    assert one[p(0)] == ("OK", False)            # exactly 80 is not breaching
    assert one[p(1)] == ("ALARM", True) and one[p(2)] == ("ALARM", False)
    assert one[p(4)] == ("ALARM", True)          # p(3) had no data: OK in between
    two = {r.period_start: r.state for r in AL.evaluate_alarm(series, 80, 300, eval_periods=2).collect()}
    assert [two[p(k)] for k in (0, 1, 2, 4, 5)] == ["OK", "OK", "ALARM", "OK", "ALARM"]


def test_peak_concurrency_matches_brute_force(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 2, 1, 0, 58)
    ms = lambda n: dt.timedelta(milliseconds=n)
    calls = [(f"r{i}", t0 + ms(rnd.randint(0, 240_000)), rnd.choice([0, 500, 1000, 1999, 90_000, 200_000])) for i in range(300)]
    calls += [("same-a", t0, 1000), ("same-b", t0 + ms(1000), 1000), ("to-minute", dt.datetime(2024, 2, 1, 1, 9, 59), 1000),
              ("alone", dt.datetime(2024, 2, 1, 2, 10), 200_000)]
    df = spark.createDataFrame(calls, "request_id string, ts timestamp_ntz, latency_ms long")
    want = {}
    for minute in (dt.datetime(2024, 2, 1, 0, 50) + dt.timedelta(minutes=k) for k in range(100)):
        # The count is highest at the minute's beginning or where a call begins.
        instants = [minute] + [ts for _, ts, _ in calls if minute <= ts < minute + dt.timedelta(minutes=1)]
        peak = max(sum(ts <= at < ts + ms(lat) for _, ts, lat in calls) for at in instants)
        if peak:
            want[minute] = peak
    assert want[dt.datetime(2024, 2, 1, 2, 11)] == want[dt.datetime(2024, 2, 1, 2, 13)] == 1
    assert dt.datetime(2024, 2, 1, 1, 10) not in want
    for chunk in (10, 60):
        assert {r.period_start: r.max_concurrent for r in M.peak_concurrency_1m(df, chunk).collect()} == want


def test_peak_concurrency_with_very_long_and_undefined_calls(spark):
    t = dt.datetime(2024, 2, 1, 0, 0, 30)
    year = 365 * 86_400_000
    calls = [("long", t, year), ("longer", t + dt.timedelta(days=40), 2 * year), ("none", t, None), ("timeless", None, 5), ("zero", t, 0), ("minus", t, -5)]
    df = spark.createDataFrame(calls, "request_id string, ts timestamp_ntz, latency_ms long")
    got = M.peak_concurrency_1m(df).groupBy("max_concurrent").count().collect()
    both = (365 - 40) * 1440 + 1
    assert {r.max_concurrent: r["count"] for r in got} == {2: both, 1: (40 + 2 * 365) * 1440 + 1 - both}
    assert M.peak_concurrency_1m(df.where("latency_ms is null")).count() == 0


def test_percentile_from_counts(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(dt.datetime(2024, 2, 1), rnd.choice([1, 2, 50, 700])) for _ in range(333)], "ts timestamp_ntz, v long")
    got = M.metric_statistics(df, "v", [], 300, "p90").first().value
    assert got == df.selectExpr("percentile(v, 0.9)").first()[0]
