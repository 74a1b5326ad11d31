"""Work that grows with the rows is shared by all tasks."""

import datetime as dt
import os

from pyspark.sql import functions as F

from quotalake.operators import quota as K
from quotalake.operators.normalize import normalize_rejects
from quotalake.session import FILE_SIZE, checkpoint_dir
from quotalake.sources import fixtures as fx
from quotalake.streaming import common as SC
from quotalake.streaming import counters as T1
from quotalake.streaming import metrics as T2
from tests.test_quota import policies_df, users_df

SF = "/root/testdata/sf0.001"
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _rows(spark, n, keys):
    return spark.range(0, n, 1, 1).select((F.col("id") % keys).alias("k"), F.lit(1).cast("long").alias("n"),
                                          F.col("id").cast("timestamp").alias(T2.ARRIVAL))


def test_rows_are_combined_over_all_that_a_task_reads(spark, monkeypatch):
    found = T2.combined(_rows(spark, 35_000, 7), ["k"], ["n"], "1 minute").collect()
    assert {(r.k, r.n) for r in found} == {(k, 5000) for k in range(7)} and len(found) == 7
    # More keys than a task holds: some come again, and nothing is lost.
    monkeypatch.setattr(T2, "HELD_ROWS", 15_000)
    found = T2.combined(_rows(spark, 60_000, 9000), ["k"], ["n"], "1 minute").groupBy("k").agg(F.sum("n").alias("n"), F.max(T2.ARRIVAL).alias("at"))
    assert found.count() == 9000 and found.agg(F.sum("n"), F.max(F.unix_timestamp("at"))).first()[:] == (60_000, 59_999)


def test_averages_of_sums_beyond_64_bits(spark):
    import numpy as np

    windows = T2._Windows([], [])
    had = {"timer": None, "windows": np.array([[0], [0], [4]]), "hist": np.array([[0, 0], [2**62, 2**62 + 2**20], [2, 2]])}
    out = next(windows._emit((60,), had, np.array([True]))).iloc[0]
    assert out.average == (4 * 2**62 + 2 * 2**20) / 4 and out.maximum == 2**62 + 2**20 and out.version == 1


def test_slices_have_as_many_files_each_and_follow_in_time(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(SC, "FILE_ROWS", 1500)
    t0 = dt.datetime(2024, 1, 1)
    df = spark.range(9000).select("id", F.timestamp_add("SECOND", F.col("id"), F.lit(t0)).cast("timestamp_ntz").alias("at"))
    path = os.path.join(tmp_dir, "slices")
    SC.write_slices(df.unionByName(spark.createDataFrame([(-1, None)], "id long, at timestamp_ntz")), path, "at")
    files = (spark.read.parquet(path).groupBy("_metadata.file_path", "_metadata.file_modification_time")
             .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("n")).orderBy("file_modification_time").collect())
    assert len(files) % 3 == 0 and len(files) > 3 and sum(r.n for r in files) == 9000
    each = len(files) // 3
    spans = [(min(r.low for r in files[k * each:(k + 1) * each]), max(r.high for r in files[k * each:(k + 1) * each])) for k in range(3)]
    assert spans[0][1] < spans[1][0] and spans[1][1] < spans[2][0]


def _files(path):
    return [sum(f.endswith(".parquet") and not f.startswith(".") for f in fs) for _, _, fs in os.walk(path) if any(f.endswith(".parquet") for f in fs)]


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_dir):
    spark.conf.set(ADVISED, "20KB")
    try:
        calls = spark.range(8000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"),
                                         F.timestamp_add("SECOND", F.col("id"), F.lit(dt.datetime(2024, 1, 3))).cast("timestamp_ntz").alias("ts"),
                                         F.concat(F.lit("u"), (F.col("id") % 4000).cast("string")).alias("user_id"),
                                         F.lit(1).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(False).alias("failed"))
        T1.Deduplicator(tmp_dir).remember(calls, 0)
        assert max(_files(os.path.join(tmp_dir, "ids"))) > 1
        users, pols = users_df(spark, [("u1", "g", "t", "d")]), policies_df(spark, [("default", "default", 100, 10, "block")])
        root = os.path.join(tmp_dir, "spans")
        K.replay_span(spark, root, calls, users, pols, dt.date(2024, 1, 1), dt.date(2024, 1, 6))
        assert K.decisions_of_spans(spark, root).count() == 8000
        parts = calls.select("user_id", F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("used"), F.col("ts").alias("last_updated")).dropDuplicates(["user_id"])
        totals = SC.PeriodTotals(os.path.join(tmp_dir, "totals"), 1)
        totals.add(parts, totals.touched(parts), 0)
        assert totals.read(spark).count() == 4000
    finally:
        spark.conf.unset(ADVISED)


def test_raw_log_is_sorted_before_its_rows_are_wide(spark):
    by_hour = fx.invocation_log(spark, SF, by_hour=True)
    plain = fx.invocation_log(spark, SF)
    assert sorted(map(str, by_hour.drop(*fx.HOUR_KEYS).collect())) == sorted(map(str, plain.collect()))
    plan = by_hour._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Project") < plan.index("Sort") and "requestmetadata" not in plan[plan.index("Sort"):]


def test_events_are_dealt_before_they_are_parsed(spark):
    for made in (fx.invocation_log(spark, SF), fx.gateway_calls(spark, SF)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    bad = fx.invocation_log(spark, SF).limit(10).withColumn("usage", F.lit("{")).withColumn("timestamp", F.lit("x"))
    assert normalize_rejects(bad).first()[:] == (10, 10, 0, 0, 0, 10)


def test_stored_tables_are_not_taken_at_their_compressed_size(spark, tmp_dir):
    checkpoint_dir(spark)
    assert float(spark.conf.get(FILE_SIZE)) > 1
    spark.range(1_000_000).select(F.lit("x" * 50).alias("t")).repartition(1).write.parquet(tmp_dir + "/t")
    size = int(str(spark.read.parquet(tmp_dir + "/t")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    stored = sum(os.path.getsize(os.path.join(tmp_dir, "t", f)) for f in os.listdir(tmp_dir + "/t") if f.endswith(".parquet"))
    assert size >= 7 * stored


def test_facts_are_dealt_once_as_narrow_events(spark, tmp_dir, monkeypatch):
    from quotalake.operators.normalize import normalize_invocations
    from quotalake.plans import registry
    from quotalake.sources import fixtures, logs

    def twice(*args, **options):
        raise AssertionError("the facts are stored twice")

    rows = [(k, f"2024-01-{1 + k % 3:02d} 00:00:{k % 60:02d}", k % 40, "error" if k % 9 == 0 else "view", k / 7, '{"k": %d}' % (k % 90)) for k in range(500)]
    rows += [(1, "2024-01-01 00:00:01", 1, "view", 1.0, "{}"), (None, None, None, None, None, None)]
    (spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
     .selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(tmp_dir + "/events.parquet"))
    monkeypatch.setattr(logs, "cut_lineage", twice)
    got = registry.invocations(spark, tmp_dir)
    expected = normalize_invocations(fixtures.invocation_log(spark, tmp_dir))
    text = lambda df: sorted(map(str, df.select(*expected.columns).collect()))
    assert text(got) == text(expected)
    assert len(got.inputFiles()) > 4
