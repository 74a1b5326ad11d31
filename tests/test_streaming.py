import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quotalake.operators import metrics as M
from quotalake.operators import quota as K
from quotalake.operators.alarms import alarm_transitions
from quotalake.streaming import alerts as T3
from quotalake.streaming import common as SC
from quotalake.streaming import counters as T1
from quotalake.streaming import metrics as T2
from quotalake.streaming import quota as T4
from tests.test_quota import policies_df, users_df

CALLS = "request_id string, ts timestamp_ntz, user_id string, input_tokens long, output_tokens long, failed boolean"


def _calls(spark, n_users=12, seed=5):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 31, 20)
    rows = []
    for u in range(n_users):
        for i in range(30):
            ts = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 30))
            rows.append((f"r{u:02d}-{i:02d}", ts, f"u{u}", rnd.choice([0, 2, 5, 9]), 0, rnd.random() < 0.1))
    return spark.createDataFrame(rows, CALLS)


def _append(df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def _stream(spark, path, schema_of, per_batch=1):
    return SC.file_stream(spark, path, schema_of, max_files_per_trigger=per_batch)


def test_quota_decisions_equal_batch_replay_in_order(spark, tmp_dir):
    calls = _calls(spark).unionByName(spark.createDataFrame(
        [("ghost", dt.datetime(2024, 2, 1), "nobody", 1, 1, False), ("none", dt.datetime(2024, 2, 1), None, 1, 1, False)], CALLS))
    users = users_df(spark, [(f"u{u}", "g", "t", "d") for u in range(12)])
    pols = policies_df(spark, [("user", f"u{u}", 20 + 7 * u, 9 + u, "block" if u % 3 else "alert") for u in range(12)])
    src, out = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "out")
    t0 = dt.datetime(2024, 1, 31, 20)
    for k in range(3):
        _append(calls.where((F.col("ts") >= F.lit(t0 + dt.timedelta(hours=12 * k))) & (F.col("ts") < F.lit(t0 + dt.timedelta(hours=12 * (k + 1))))), src)
    SC.run_until_caught_up(T4.stream_quota_decisions(_stream(spark, src, calls), lambda: (users, pols), out, out + "_ck"))
    rows = lambda df: {r.request_id: (r.allowed, r.monthly_usage, r.daily_usage, r.status) for r in df.collect()}
    got = rows(T4.read_decisions(spark, out))
    assert got == rows(K.quota_replay(calls, users, pols))
    assert got["ghost"][3] == 404 and got["none"][3] == 400


def test_late_call_changed_limit_and_lost_batch(spark, tmp_dir):
    users = users_df(spark, [("a", "g", "t", "d")])
    limits = {"now": 10}
    dims = lambda: (users, policies_df(spark, [("user", "a", 10**9, limits["now"], "block")]))
    call = lambda rid, day, tokens=10: spark.createDataFrame([(rid, dt.datetime(2024, 1, day, 12), "a", tokens, 0, False)], CALLS)
    src, out = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "out")
    run = lambda: SC.run_until_caught_up(T4.stream_quota_decisions(
        _stream(spark, src, call("x", 1)), dims, out, out + "_ck"))
    for rid, day in (("r1", 1), ("r2", 2), ("r3", 3), ("late", 1)):
        _append(call(rid, day), src)
    run()
    got = {r.request_id: (r.allowed, r.daily_usage) for r in T4.read_decisions(spark, out).collect()}
    assert got["late"] == (False, 10) and all(got[k] == (True, 0) for k in ("r1", "r2", "r3"))
    limits["now"] = 25  # in force from the next batch on
    _append(call("raised", 1), src)
    run()
    got = {r.request_id: r.allowed for r in T4.read_decisions(spark, out).collect()}
    assert got["raised"]
    from quotalake.session import delete_path
    used = {(r.user_id, r.day.day): r.used for r in SC.PeriodTotals(os.path.join(out, "usage")).read(spark).collect()}
    assert used == {("a", 1): 20, ("a", 2): 10, ("a", 3): 10}
    delete_path(spark, os.path.join(out, "usage"))
    _append(call("after", 2), src)
    with pytest.raises(Exception):
        run()


DELIVERED = "request_id string, ts timestamp_ntz, user_id string, error_type string, input_tokens long, output_tokens long, arrived_at timestamp_ntz"


def _deliveries(spark, src, seed=2):
    """Calls delivered up to three times, within the hour and long after, in order of arrival; returns the calls."""
    rnd = random.Random(seed)
    t0, rows, sent = dt.datetime(2024, 1, 25), [], []
    for i in range(200):
        ts = t0 + dt.timedelta(hours=rnd.randrange(400))
        row = (f"r{i}", ts, f"u{i % 5}", "E" if i % 9 == 0 else None, rnd.randrange(50), rnd.choice([None, 3]))
        rows.append(row)
        first = ts + dt.timedelta(minutes=rnd.randrange(5))
        sent.append((*row, first))
        for wait in rnd.sample([10, 50, 61, 600, 6000, 60000], rnd.randrange(3)):
            sent.append((*row, first + dt.timedelta(minutes=wait)))
    sent.sort(key=lambda r: r[-1])
    for k in range(4):
        part = sent[len(sent) * k // 4:len(sent) * (k + 1) // 4]
        rnd.shuffle(part)
        _append(spark.createDataFrame(part, DELIVERED), src)
    return spark.createDataFrame(rows, DELIVERED.rpartition(",")[0])


def test_counters_count_each_request_once_however_late(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "inv"), os.path.join(tmp_dir, "out")
    inv = _deliveries(spark, src)
    stream = lambda: _stream(spark, src, spark.read.parquet(src))
    SC.run_until_caught_up(T1.stream_usage_counters(stream(), out, out + "_ck", "arrived_at", buckets=2))
    key = lambda df: sorted(map(tuple, df.select("user_email", "metric_period", "tokens_used", "last_updated", "ttl").collect()))
    assert key(T1.read_counters(spark, out)) == key(K.usage_counters(inv.withColumn("usage_day", F.to_date("ts"))))
    SC.run_until_caught_up(T1.dedup_stream(stream(), out + "_d", out + "_dck", "arrived_at", buckets=2))
    got = T1.read_deduplicated(spark, out + "_d", inv.schema).select(*inv.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, inv.collect()))
    # Each id is stored once, whatever the number of batches.
    ids = spark.read.parquet(out + "_d/ids")
    assert ids.count() == ids.select("request_id").distinct().count() == 200


def test_arrival_by_the_clock_and_rows_without_id_or_time(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day), ("b", day), (None, day), (None, day), ("c", None), ("c", None)]
    df = spark.createDataFrame(rows, "request_id string, ts timestamp_ntz")
    for _ in range(3):
        _append(df, src)
    SC.run_until_caught_up(T1.dedup_stream(_stream(spark, src, df), out, out + "_ck"))
    got = [tuple(r) for r in T1.read_deduplicated(spark, out, df.schema).collect()]
    assert sorted(got, key=str) == sorted([("a", day), ("b", day)] + 6 * [(None, day)] + 6 * [("c", None)], key=str)


def test_rows_dropped_for_running_backwards_are_an_error(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    for k, day in enumerate((9, 9, 1)):
        at = dt.datetime(2024, 1, day)
        _append(spark.createDataFrame([(f"r{k}", at, at)], "request_id string, ts timestamp_ntz, arrived_at timestamp_ntz"), src)
    with pytest.raises(ValueError):
        SC.run_until_caught_up(T1.dedup_stream(_stream(spark, src, spark.read.parquet(src)), out, out + "_ck", "arrived_at"))


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_dir):
    totals = SC.PeriodTotals(os.path.join(tmp_dir, "totals"), buckets=2)
    day = lambda k: dt.date(2024, 1, k)
    at = dt.datetime(2024, 1, 1)

    def add(batch, *rows):
        parts = spark.createDataFrame([(u, d, n, at) for u, d, n in rows], "user_id string, day date, used long, last_updated timestamp_ntz")
        totals.add(parts, totals.touched(parts), batch)

    add(0, ("a", day(1), 5), ("b", day(1), 7))
    add(1, ("a", day(1), 1), ("a", day(31), 2))
    add(1, ("a", day(1), 1), ("a", day(31), 2))
    add(2, ("b", day(2), 3))
    add(2, ("b", day(2), 3))
    assert {(r.user_id, r.day.day): r.used for r in totals.read(spark).collect()} == {("a", 1): 6, ("a", 31): 2, ("b", 1): 7, ("b", 2): 3}
    before = totals.before(spark, totals.touched(spark.createDataFrame([("b", day(5))], "user_id string, day date")), 2)
    assert ("b", day(2)) not in {(r.user_id, r.day) for r in before.collect()}


METRIC_ROWS = "request_id string, ts timestamp_ntz, tenant string, latency_ms long, arrived_at timestamp_ntz"


def test_windows_come_out_closed_and_again_when_late_rows_change_them(spark, tmp_dir):
    """In time, then late rows: every period equals the batch metric, and only touched windows have a second version."""
    t0 = dt.datetime(2024, 2, 1)
    minute = lambda n: dt.timedelta(minutes=n)
    rows = [(f"r{i}", t0 + minute(i), ("a", "b", None)[i % 3], None if i % 11 == 0 else i * i % 97, t0 + minute(i + i % 4)) for i in range(240)]
    late = [("l1", t0 + minute(7), "a", 1000, t0 + minute(400)), ("l2", t0 + minute(7), "a", None, t0 + minute(400)),
            ("new", t0 - minute(90), "c", 5, t0 + minute(400))]
    tick = [(None, None, None, None, t0 + dt.timedelta(days=2))]
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    rows.sort(key=lambda r: r[-1])
    for part in (rows[:100], rows[100:], late, tick):
        _append(spark.createDataFrame(part, METRIC_ROWS), src)
    df = spark.createDataFrame(rows + late, METRIC_ROWS)
    SC.run_until_caught_up(T2.stream_metrics(_stream(spark, src, df), ["tenant"], F.col("latency_ms"), {"n_calls": F.lit(1)}, sink, sink + "_ck",
                                             arrived="arrived_at"))
    for period in (60, 300, 3600, 86400):
        got = {(r.tenant, r.period_start): (r.calls, r.n_calls, r.average, r.maximum, r.p99) for r in T2.read_metrics(spark, sink, ["tenant"], period).collect()}
        stat = lambda s, v="latency_ms": {(r.tenant, r.period_start): r.value
                                          for r in M.metric_statistics(df, v, ["tenant"], period, s).collect()}
        n, avg, top, p99 = stat("SampleCount", F.lit(1)), stat("Average"), stat("Maximum"), stat("p99")
        assert got == {k: (n[k], n[k], avg[k], top[k], p99[k]) for k in n}
    versions = {(r.tenant, r.period_start, r.version) for r in T2.read_versions(spark, sink, 300).collect()}
    assert {(t, s) for t, s, v in versions if v == 2} == {("a", t0 + minute(5))} and all(v <= 2 for _, _, v in versions)
    assert ("c", t0 - minute(90), 1) in versions


def test_percentile_is_the_batch_percentile(spark):
    rnd = random.Random(1)
    for n in (1, 2, 5, 100, 101):
        values = [rnd.randrange(50) for _ in range(n)]
        counts = {v: values.count(v) for v in values}
        df = spark.createDataFrame([(v,) for v in values], "v long")
        assert T2.exact_percentile(counts, 0.99) == df.agg(F.round(F.percentile("v", 0.99), 6)).first()[0]
    assert T2.exact_percentile({}, 0.5) is None


@pytest.mark.parametrize("missing,n", [("notBreaching", 1), ("notBreaching", 2), ("breaching", 3), ("ignore", 2), ("missing", 2)])
def test_alerts_over_batches_equal_the_batch_transitions(spark, tmp_dir, missing, n):
    rnd = random.Random(n)
    t0, rows, at = dt.datetime(2024, 1, 31, 20), [], 0
    for k in range(160):
        at += rnd.choice([1, 1, 2, 4, 25])
        ts = t0 + dt.timedelta(minutes=at)
        rows.append((f"r{k}", ts, "ab"[rnd.random() < 0.3], rnd.choice([1, 9]), ts + dt.timedelta(minutes=rnd.randrange(5))))
    rows.sort(key=lambda r: r[-1])
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    for k in range(4):
        _append(spark.createDataFrame(rows[k * 40:(k + 1) * 40], METRIC_ROWS), src)
    df = spark.createDataFrame(rows, METRIC_ROWS)
    ends = {t: max(r[1] for r in rows if r[2] == t) for t in "ab"}
    end = min(ends.values()).replace(second=0)  # later than this, one series may be silent that the batch form does not judge
    last = max(ends.values()) - t0
    tick = t0 + dt.timedelta(minutes=(last.total_seconds() // 300 + 1) * 5 + 10, seconds=1)
    _append(spark.createDataFrame([(None, None, t, None, tick) for t in "ab"], METRIC_ROWS), src)
    SC.run_until_caught_up(T3.stream_alerts(_stream(spark, src, df), F.col("latency_ms"), "sum", 8, 300, sink, sink + "_ck", n, missing,
                                            ["tenant"], "arrived_at"))
    got = sorted(map(tuple, spark.read.parquet(sink).where(F.col("period_start") < F.lit(end)).collect()), key=str)
    series = M.metric_statistics(df, "latency_ms", ["tenant"], 300, "Sum")
    want = alarm_transitions(series, 8, 300, n, ["tenant"], missing=missing).where(F.col("period_start") < F.lit(end))
    assert got == sorted(map(tuple, want.collect()), key=str) and got


def test_silence_is_reported_by_a_timer_and_only_once(spark, tmp_dir):
    """An alarm, then nothing but the clock: the return to OK comes without data, and later batches add no row."""
    t0 = dt.datetime(2024, 3, 1)
    src, sink = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "sink")
    row = lambda m, v: spark.createDataFrame([("x", t0 + dt.timedelta(minutes=m), "t", v, t0 + dt.timedelta(minutes=m))], METRIC_ROWS)
    tick = lambda m: spark.createDataFrame([(None, None, None, None, t0 + dt.timedelta(minutes=m))], METRIC_ROWS)
    for df in (row(1, 99), tick(40), tick(80), row(90, 1), tick(130), row(62, 99)):  # the last one is too late
        _append(df, src)
    SC.run_until_caught_up(T3.stream_alerts(_stream(spark, src, row(1, 1)), F.col("latency_ms"), "max", 5, 300, sink, sink + "_ck",
                                            arrived="arrived_at", delay="2 hours"))
    _append(tick(400), src)
    SC.run_until_caught_up(T3.stream_alerts(_stream(spark, src, row(1, 1)), F.col("latency_ms"), "max", 5, 300, sink, sink + "_ck",
                                            arrived="arrived_at", delay="2 hours"))
    got = [(int((r.period_start - t0).total_seconds() // 60), r.value, r.previous, r.state) for r in spark.read.parquet(sink).orderBy("period_start").collect()]
    assert got == [(0, 99.0, "OK", "ALARM"), (5, None, "ALARM", "OK"), (60, 99.0, "OK", "ALARM"), (65, None, "ALARM", "OK")]
