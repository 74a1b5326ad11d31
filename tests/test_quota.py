import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quotalake.operators import quota as K
from quotalake.schema import QUOTA_POLICIES, USER_METADATA


def users_df(spark, rows):
    return spark.createDataFrame(
        [(u, g, t, d, None, None, "active", "2024-01-01", "2024-01-01") for u, g, t, d in rows], USER_METADATA)


def policies_df(spark, rows):
    return spark.createDataFrame([(t, i, m, d, mode, "", "2024-01-01", "2024-01-01") for t, i, m, d, mode in rows],
                                 QUOTA_POLICIES)


def test_reference_seed_policies_resolve(spark):
    # Published seed: five users, 1 default + 4 group + 5 user policies.
    users = users_df(spark, [("john.doe@company.com", "engineering", "tenant_a", "platform"),
                             ("bob.wilson@company.com", "sales", "tenant_b", "sales-ops"),
                             ("eve@company.com", "marketing", None, None),
                             ("zed@company.com", "sales", "tenant_b", None)])
    pols = policies_df(spark, [
        ("default", "default", 100000000, 5000000, "block"),
        ("group", "engineering", 500000000, 20000000, "block"),
        ("group", "sales", 250000000, 10000000, "alert"),
        ("user", "john.doe@company.com", 500000000, 20000000, "block"),
        ("user", "bob.wilson@company.com", None, 10000000, None),
    ])
    r = {x.user_id: x for x in K.resolve_policy(users, pols).collect()}
    assert (r["john.doe@company.com"].policy_source, r["john.doe@company.com"].monthly_limit) == ("user", 500000000)
    bob = r["bob.wilson@company.com"]   # whole row: missing limit -> 0 for checks, 1 for metrics
    assert (bob.policy_source, bob.monthly_limit, bob.metric_monthly_limit, bob.enforcement_mode) == \
        ("user", 0, 1, "block")
    assert (r["eve@company.com"].policy_source, r["eve@company.com"].enforcement_mode) == ("default", "block")
    assert (r["zed@company.com"].policy_source, r["zed@company.com"].enforcement_mode) == ("group", "alert")
    none = K.resolve_policy(users, pols.where("policy_type = 'user'")).where("user_id = 'eve@company.com'").first()
    assert (none.policy_source, none.monthly_limit, none.daily_limit, none.enforcement_mode) == \
        ("builtin", 100000000, 5000000, "alert")


def test_exceeded_message_golden(spark):
    checked = spark.createDataFrame(
        [("u", 500000234, 500000000, True, 10, 20000000, False, False)],
        "user_id string, monthly_usage long, monthly_limit long, monthly_exceeded boolean, daily_usage long, "
        "daily_limit long, daily_exceeded boolean, allowed boolean")
    r = K.quota_exceeded_messages(checked).first()
    assert r.message == "Monthly quota exceeded (500000234/500000000 tokens)"
    assert (r.status, r.retry_after) == (429, 3600)


def brute_force(calls, limits):
    """The sequential protocol: check, then add, one call at a time per user."""
    used_m, used_d, out = defaultdict(int), defaultdict(int), {}
    for rid, ts, user, tokens, failed in sorted(calls, key=lambda c: (c[1], c[0])):
        ml, dl, mode = limits[user]
        mk, dk = (user, ts.strftime("%Y-%m")), (user, ts.date())
        mu, du = used_m[mk], used_d[dk]
        allowed = not (mu >= ml or du >= dl) if mode == "block" else True
        charged = tokens if allowed and not failed else 0
        used_m[mk] += charged
        used_d[dk] += charged
        status = 429 if not allowed else (500 if failed else 200)
        out[rid] = (allowed, mu, du, status)
    return out


import pytest


@pytest.mark.parametrize("chunk_seconds", [60, 3600])
def test_replay_equals_sequential_loop(spark, chunk_seconds):
    rnd = random.Random(7)
    users, pols, calls, limits = [], [], [], {}
    base = dt.datetime(2024, 1, 30, 22, 0, 0)
    for u in range(60):
        user = f"u{u}"
        ml, dl = rnd.choice([0, 5, 40, 80, 400]), rnd.choice([0, 10, 30, 1000])
        mode = rnd.choice(["block", "block", "alert"])
        users.append((user, "g", "t", "d"))
        pols.append(("user", user, ml, dl, mode))
        limits[user] = (ml, dl, mode)
        for i in range(rnd.randint(1, 40)):
            # Minutes around a day and month boundary, duplicates included.
            ts = base + dt.timedelta(minutes=rnd.choice([0, 5, 90, 119, 120, 121, 1500, 2000, 2880]),
                                     milliseconds=rnd.choice([0, 0, 999]))
            calls.append((f"r{u}-{i:03d}", ts, user, rnd.choice([0, 1, 3, 8, 15]), rnd.random() < 0.1))
    calls_df = spark.createDataFrame(calls, "request_id string, ts timestamp_ntz, user_id string, tokens long, "
                                            "failed boolean").select(
        "request_id", "ts", "user_id", F.col("tokens").alias("input_tokens"),
        F.lit(0).cast("long").alias("output_tokens"), "failed")
    got = {r.request_id: (r.allowed, r.monthly_usage, r.daily_usage, r.status)
           for r in K.quota_replay(calls_df, users_df(spark, users), policies_df(spark, pols), chunk_seconds).collect()}
    assert got == brute_force(calls, limits)


def test_usage_equal_to_limit_blocks_and_unknown_user(spark):
    users = users_df(spark, [("a", "g", "t", "d")])
    pols = policies_df(spark, [("user", "a", 10, 100, "block")])
    t0 = dt.datetime(2024, 2, 1, 12)
    calls = spark.createDataFrame(
        [("r1", t0, "a", 10, 0, False), ("r2", t0 + dt.timedelta(seconds=1), "a", 1, 0, False),
         ("r3", t0, "ghost", 1, 0, False), ("r4", t0, None, 1, 0, False)],
        "request_id string, ts timestamp_ntz, user_id string, input_tokens long, output_tokens long, failed boolean")
    got = {r.request_id: r.status for r in K.quota_replay(calls, users, pols).collect()}
    assert got == {"r1": 200, "r2": 429, "r3": 404, "r4": 400}


def test_counters_ttl_and_initialize(spark):
    inv = spark.createDataFrame(
        [("a", dt.datetime(2024, 2, 14, 10), dt.date(2024, 2, 14), None, 5, 6),
         ("a", dt.datetime(2024, 1, 31, 23, 59, 59), dt.date(2024, 1, 31), None, 1, 1),
         ("a", dt.datetime(2024, 2, 14, 11), dt.date(2024, 2, 14), "Err", 100, 100)],
        "user_id string, ts timestamp_ntz, usage_day date, error_type string, input_tokens long, output_tokens long")
    c = {r.metric_period: r for r in K.usage_counters(inv).collect()}
    assert c["monthly_2024-02"].tokens_used == 11 and c["daily_2024-01-31"].tokens_used == 2
    feb = int(dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc).timestamp())
    assert c["monthly_2024-02"].ttl == feb + 60 * 86400
    kept = {r.metric_period for r in K.expire_counters(K.usage_counters(inv), dt.datetime(2024, 2, 10)).collect()}
    assert kept == {"monthly_2024-01", "monthly_2024-02", "daily_2024-02-14"}
    users = users_df(spark, [("a", "g", "t", "d"), ("b", "g", "t", "d")])
    init = K.initialize_counters(users, K.usage_counters(inv), dt.datetime(2024, 2, 14, 12))
    rows = {(r.user_email, r.metric_period): r.tokens_used for r in init.collect()}
    assert rows[("a", "daily_2024-02-14")] == 11 and rows[("b", "daily_2024-02-14")] == 0
    assert rows[("b", "monthly_2024-02")] == 0 and len(rows) == 6


def test_low_quota_override_and_restore(spark):
    """Temporary override (monthly = current + 1000, daily = 500, block), ten calls, restore."""
    from quotalake.sources.dims import upsert_dimension

    user = "john.doe@company.com"
    users = users_df(spark, [(user, "engineering", "tenant_a", "platform")])
    original = policies_df(spark, [("user", user, 500000000, 20000000, "block"),
                                   ("group", "engineering", 500000000, 20000000, "block")])
    history = [("h0", dt.datetime(2024, 3, 1, 9), user, 150000350, 0, False)]
    calls = history + [(f"c{i}", dt.datetime(2024, 3, 2, 10, 0, i), user, 100, 13, False) for i in range(10)]
    calls_df = spark.createDataFrame(calls, "request_id string, ts timestamp_ntz, user_id string, "
                                            "input_tokens long, output_tokens long, failed boolean")
    override = policies_df(spark, [("user", user, 150000350 + 1000, 500, "block")]).withColumn(
        "updatedAt", F.lit("2024-03-02"))
    low = upsert_dimension(original, override, ["policy_type", "identifier"])
    got = {r.request_id: r.status for r in K.quota_replay(calls_df, users, low).collect()}
    assert [got[f"c{i}"] for i in range(10)] == [200] * 5 + [429] * 5
    blocked = K.quota_exceeded_messages(K.quota_replay(calls_df, users, low).where("request_id = 'c5'")).first()
    assert blocked.message == "Daily quota exceeded (565/500 tokens)"
    restored = upsert_dimension(low, original.where("policy_type = 'user'").withColumn(
        "updatedAt", F.lit("2024-03-03")), ["policy_type", "identifier"])
    again = {r.request_id: r.status for r in K.quota_replay(calls_df, users, restored).collect()}
    assert all(again[f"c{i}"] == 200 for i in range(10))


def test_counter_expiry_boundary(spark):
    c = spark.createDataFrame([("a", "daily_2024-02-10", 1, None, 1707955200), ("a", "daily_2024-02-09", 1, None, 1707955199)],
                              "user_email string, metric_period string, tokens_used long, last_updated timestamp_ntz, ttl long")
    kept = [r.metric_period for r in K.expire_counters(c, dt.datetime(2024, 2, 15)).collect()]
    assert kept == ["daily_2024-02-10"]     # ttl == now is not yet expired


def test_hot_user_with_a_third_of_calls(spark):
    """One user holds a third of all calls: the chunked path spreads it and agrees exactly."""
    from quotalake.plans.scan import with_chunk
    from quotalake.sources import fixtures as fx

    sf = "/root/testdata/sf0.01"
    hot_user = "user1@company.com"
    calls = fx.gateway_calls(spark, sf).withColumn(
        "user_id", F.when(F.pmod(F.xxhash64("request_id"), F.lit(3)) == 0, F.lit(hot_user)).otherwise(F.col("user_id")))
    users, pols = fx.user_metadata(spark, sf), fx.quota_policies(spark, sf)
    limits = {r.user_id: (r.monthly_limit, r.daily_limit, r.enforcement_mode) for r in K.resolve_policy(users, pols).collect()}
    rows = [(r.request_id, r.ts, r.user_id, 0 if r.failed else r.input_tokens + r.output_tokens, r.failed)
            for r in calls.collect() if r.user_id in limits]
    got = {r.request_id: (r.allowed, r.monthly_usage, r.daily_usage, r.status)
           for r in K.quota_replay(calls, users, pols).where("status <> 404").collect()}
    assert got == brute_force(rows, limits)
    # Partition each hot row would get in the (user, chunk) exchange: hash
    # partitioning is pmod(murmur3(keys), n), i.e. F.hash (AQE would merge
    # these tiny partitions here; at scale it keeps them at its advisory size).
    parts = (with_chunk(calls.where(F.col("user_id") == hot_user), "ts", 60)
             .select(F.pmod(F.hash("user_id", "_chunk"), F.lit(200)).alias("p")).distinct().count())
    assert parts >= 150


def test_policy_order_and_builtin(spark):
    users = users_df(spark, [("a", "g", "t", "d"), ("b", "g", "t", "d"), ("c", "other", "t", "d"), ("e", None, "t", "d")])
    rows = [("user", "a", None, 7, None), ("group", "g", 10, 20, "alert"), ("default", "default", 1, 2, "block")]
    source = lambda pols: {r.user_id: (r.policy_source, r.monthly_limit, r.metric_monthly_limit, r.daily_limit)
                           for r in K.resolve_policy(users, policies_df(spark, pols)).collect()}
    assert source(rows) == {"a": ("user", 0, 1, 7), "b": ("group", 10, 10, 20), "c": ("default", 1, 1, 2), "e": ("default", 1, 1, 2)}
    assert source(rows[:1])["c"] == ("builtin", K.BUILTIN_MONTHLY_LIMIT, K.BUILTIN_MONTHLY_LIMIT, K.BUILTIN_DAILY_LIMIT)


def test_counters_read_the_calls_once(spark):
    """One scan of the fact table, also behind a filter on one counter."""
    inv = spark.createDataFrame([("a", dt.datetime(2024, 2, 1), dt.date(2024, 2, 1), None, 1, 1)],
                                "user_id string, ts timestamp_ntz, usage_day date, error_type string, input_tokens long, output_tokens long")
    plan = K.usage_counters(inv).where("metric_period = 'monthly_2024-02'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def _prepared_calls(spark, n=400):
    rng = random.Random(11)
    rows = [(f"r{k}", dt.datetime(2024, 1, 30) + dt.timedelta(minutes=rng.randrange(4000)), f"u{min(rng.randrange(4), rng.randrange(4))}",
             rng.choice([0, 5, 20, 60]), rng.random() < 0.1) for k in range(n)]
    calls = spark.createDataFrame([(r, t, u, x, 0, f) for r, t, u, x, f in rows],
                                  "request_id string, ts timestamp_ntz, user_id string, input_tokens long, output_tokens long, failed boolean")
    users = users_df(spark, [(f"u{k}", "sales" if k % 2 else "finance", "t", "d") for k in range(4)])
    policies = policies_df(spark, [("group", "sales", 900, 400, "block"), ("user", "u2", 700, None, "alert"), ("group", "finance", 5000, 300, "block")])
    return K.prepare_calls(calls, users, policies).where("status is null").withColumns(
        {"_carry_d": F.lit(30).cast("long"), "_carry_m": F.when(F.col("_month") < "2024-02-01", F.lit(200)).otherwise(F.lit(30)).cast("long")})


def test_calls_are_sent_once_to_be_decided(spark):
    calls = _prepared_calls(spark).localCheckpoint()
    plan = K.decide_calls(calls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FileScan" not in plan


def test_months_of_many_calls_are_decided_alike(spark, monkeypatch):
    calls = _prepared_calls(spark)
    columns = ["request_id", "user_id", "allowed", "charged_tokens", "monthly_usage", "daily_usage", "status"]
    decide = lambda: sorted(map(tuple, K.decide_calls(calls).select(*columns).collect()))
    in_order = decide()
    assert len(in_order) == 400 and {r[-1] for r in in_order} == {200, 429, 500}
    for most in (0, 100):  # all of them, and some, spread over tasks
        monkeypatch.setattr(K, "HOT_CALLS", most)
        assert decide() == in_order
