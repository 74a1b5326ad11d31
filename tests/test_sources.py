import os

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotalake.sources import dims as DM
from quotalake.sources import logs as LG
from tests.test_quota import users_df


def test_latest_put_wins_and_partial_update(spark, tmp_dir):
    users = users_df(spark, [("a", "g1", "t", "d"), ("b", "g2", "t", "d")])
    later = users.where("userId = 'a'").withColumn("group", F.lit("g9")).withColumn("updatedAt", F.lit("2024-03-01"))
    path = os.path.join(tmp_dir, "users")
    users.unionByName(later).write.json(path)
    loaded = {r.userId: r.group for r in DM.load_user_metadata(spark, path).collect()}
    assert loaded == {"a": "g9", "b": "g2"}
    change = spark.createDataFrame([("b", 7, None)], "userId string, dailyLimit long, group string")
    merged = {r.userId: (r.group, r.dailyLimit) for r in DM.upsert_dimension(users, change, ["userId"], True).collect()}
    assert merged == {"a": ("g1", None), "b": ("g2", 7)}
    put = {r.userId: r.group for r in DM.upsert_dimension(users, later, ["userId"]).collect()}
    assert put == {"a": "g9", "b": "g2"}


def test_schema_merge_is_add_only(spark):
    prev = T.StructType([T.StructField("a", T.StringType()),
                         T.StructField("s", T.StructType([T.StructField("x", T.LongType())]))])
    cur = T.StructType([T.StructField("s", T.StructType([T.StructField("y", T.LongType())])),
                        T.StructField("b", T.LongType())])
    merged = LG.merge_schemas(prev, cur)
    assert [f.name for f in merged.fields] == ["a", "s", "b"]
    assert [f.name for f in merged["s"].dataType.fields] == ["x", "y"]


def test_partitioned_write_prunes_days(spark, tmp_dir):
    from quotalake.operators.usage import since_filter, ts_lit

    df = spark.range(0, 48).select(
        F.timestamp_add("HOUR", F.col("id"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"))
    df = df.withColumn("usage_day", F.to_date("ts"))
    path = os.path.join(tmp_dir, "fact")
    LG.write_invocations_partitioned(df, path)
    q = since_filter(LG.read_invocations(spark, path), ts_lit("2024-02-02 12:00:00"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_day" in plan and "PushedFilters" in plan
    assert q.count() == 12


def test_json_log_reader_prunes_hour_folders(spark, tmp_dir):
    import datetime as dt

    from quotalake.sources import fixtures as fx

    rows = [{"timestamp": f"2024-02-{d:02d}T{h:02d}:00:00.000000Z", "accountid": "1", "requestid": f"r{d}{h}"}
            for d in (10, 11, 12) for h in (0, 23)]
    raw = spark.createDataFrame(rows, "timestamp string, accountid string, requestid string")
    path = os.path.join(tmp_dir, "log")
    fx.write_raw_log(raw, path)
    df = LG.read_invocation_logs(spark, path, since=dt.datetime(2024, 2, 11, 5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.requestid for r in df.collect()) == ["r110", "r1123", "r120", "r1223"]


def test_rewrite_retained_keeps_recent_days(spark, tmp_dir):
    import datetime as dt

    from quotalake.operators.retention import rewrite_retained, storage_tier

    df = spark.range(0, 40).select(
        F.timestamp_add("DAY", F.col("id"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).alias("ts"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"))
    df = df.withColumn("usage_day", F.to_date("ts"))
    src, dst = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "dst")
    LG.write_invocations_partitioned(df, src)
    rewrite_retained(spark, src, dst, 30, dt.datetime(2024, 2, 15))
    kept = spark.read.parquet(dst)
    assert kept.count() == 25 and kept.agg(F.min("usage_day")).first()[0] == dt.date(2024, 1, 16)
    tiers = {r.tier: r.rows for r in storage_tier(spark.read.parquet(src), dt.datetime(2024, 2, 15)).collect()}
    assert tiers == {"STANDARD_IA": 16, "STANDARD": 24}


def test_discover_schema_reports_changes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    spark.createDataFrame([("x", 1, "y")], "a string, b long, d string").write.json(path)
    previous = T.StructType([T.StructField("a", T.StringType()), T.StructField("c", T.StringType()),
                             T.StructField("d", T.LongType())])
    merged, diff = LG.discover_schema(spark, path, previous)
    changes = {(r.field, r.change) for r in diff.collect()}
    assert changes == {("b", "added"), ("c", "missing"), ("d", "type_changed")}
    assert [f.name for f in merged.fields] == ["a", "c", "d", "b"]      # add-only: c kept


def test_log_whose_fields_change_type_is_read_whole(spark, tmp_dir):
    from quotalake.operators.normalize import normalize_invocations

    eras = {
        "era=1": ['{"requestid": "a", "latency_ms": 9007199254740993, "usage": {"inputTokens": 5, "outputTokens": 7}, "tags": [1]}'],
        "era=2": ['{"requestid": "b", "latency_ms": 12.75, "usage": {"inputTokens": 1, "outputTokens": 2}, "tags": ["x"]}'],
        "era=3": ['{"requestid": "c", "latency_ms": "31", "usage": "{\\"inputTokens\\": 3, \\"outputTokens\\": 4}"}',
                  '{"requestid": "d", "latency_ms": "soon", "usage": "none", "model": {"id": 1}}'],
    }
    schema, seen = None, []
    for era, lines in eras.items():
        os.makedirs(os.path.join(tmp_dir, era))
        with open(os.path.join(tmp_dir, era, "part.json"), "w") as f:
            f.write("\n".join(lines))
        schema, _ = LG.discover_schema(spark, os.path.join(tmp_dir, era), schema)
        seen.append(schema["latency_ms"].dataType.simpleString())
    assert seen == ["bigint", "double", "string"]
    assert schema["usage"].dataType == T.StringType() and schema["tags"].dataType == T.ArrayType(T.StringType())
    raw = LG.read_invocation_logs(spark, tmp_dir, schema=schema)
    got = {r.request_id: (r.latency_ms, r.input_tokens, r.output_tokens) for r in normalize_invocations(raw).collect()}
    assert got == {"a": (9007199254740993, 5, 7), "b": (12, 1, 2), "c": (31, 3, 4), "d": (None, None, None)}


def test_log_freshness_marks_silent_sources(spark):
    import datetime as dt

    inv = spark.createDataFrame([("gw", dt.datetime(2024, 2, 14, 23, 0))], "source string, ts timestamp_ntz")
    srcs = spark.createDataFrame([("gw",), ("batch",)], "source string")
    got = {r.source: (r.lag_seconds, r.status) for r in LG.log_freshness(inv, srcs, dt.datetime(2024, 2, 14, 23, 30)).collect()}
    assert got == {"gw": (1800, "ok"), "batch": (None, "no events yet")}


def test_updates_of_one_item_add_up(spark):
    users = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "userId string, dailyLimit long, department string")
    changes = spark.createDataFrame([("a", 50, None, "2024-01-01", 1), ("a", None, "moved", "2024-01-02", 2),
                                     ("b", 7, None, "2024-01-03", 4), ("b", 6, None, "2024-01-03", 3), ("c", 9, None, "2024-01-01", 5)],
                                    "userId string, dailyLimit long, department string, updatedAt string, seq int")
    got = {r.userId: (r.dailyLimit, r.department) for r in DM.upsert_dimension(users, changes, ["userId"], True, "seq").collect()}
    assert got == {"a": (50, "moved"), "b": (7, "y"), "c": (9, None)}


def test_profiles_keep_the_latest_put(spark, tmp_dir):
    rows = [("p", "old", "t", "#1", "2024-01-01"), ("p", "new", "t", "#2", "2024-01-02"), ("q", "only", "t", "#3", None)]
    spark.createDataFrame(rows, "profile_id string, name string, tenant string, color string, updatedAt string").coalesce(1).write.json(tmp_dir + "/p")
    assert {r.profile_id: r.name for r in DM.load_tenant_profiles(spark, tmp_dir + "/p").collect()} == {"p": "new", "q": "only"}


def test_derived_table_follows_its_source(spark, tmp_dir):
    from quotalake.sources.logs import derived_table

    path = tmp_dir + "/events"
    table = lambda: derived_table(spark, "copy", path, lambda: spark.read.parquet(path)).count()
    spark.range(50).write.parquet(path)
    assert table() == 50 and table() == 50
    spark.range(1000).write.mode("append").parquet(path)
    assert table() == 1050


def test_whole_tokens_per_call_are_exact(spark):
    from quotalake.functions.pricing import usage_totals

    inv = spark.createDataFrame([(9007199254740993, 0), (9007199254740993, 0)], "input_tokens long, output_tokens long")
    assert usage_totals(inv).first().avg_tokens_per_call == 9007199254740993
    assert usage_totals(inv.limit(0)).first().avg_tokens_per_call == 0


@pytest.mark.parametrize("layout", ["day", "hour"])
def test_expiry_drops_folders_and_rewrites_only_the_border(spark, tmp_dir, layout):
    import datetime as dt
    import pathlib

    from quotalake.operators.retention import expire_stored
    from quotalake.sources.logs import read_invocations, write_invocations_partitioned

    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"r{k}", t0 + dt.timedelta(minutes=37 * k)) for k in range(300)] + [("none", None)]
    df = spark.createDataFrame(rows, "request_id string, ts timestamp_ntz").withColumn("usage_day", F.to_date("ts"))
    path = os.path.join(tmp_dir, "fact")
    write_invocations_partitioned(df, path, layout=layout)
    files = lambda: {p: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    before, cutoff = files(), t0 + dt.timedelta(days=3, hours=5, minutes=20)
    done = expire_stored(spark, path, cutoff)
    kept = {r for r, ts in rows if ts is None or ts >= cutoff}
    assert {r.request_id for r in read_invocations(spark, path).collect()} == kept
    assert done["rewritten"] == 1 and done["dropped"] >= 3
    new = [p for p, at in files().items() if before.get(p) != at]
    assert len({p.parent for p in new}) == 1  # what is kept was not written again
    assert expire_stored(spark, path, cutoff)["dropped"] == 0
    assert {r.request_id for r in read_invocations(spark, path).collect()} == kept
    assert expire_stored(spark, path, t0) == {"dropped": 0, "rewritten": 0}
