import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotalake.operators import quota as K
from quotalake.plans.asof import in_force, neighbour
from quotalake.schema import QUOTA_POLICIES
from quotalake.sources import dims as DM
from tests.test_quota import users_df

CALLS = "request_id string, ts timestamp_ntz, user_id string, input_tokens long, output_tokens long, failed boolean"
T0 = dt.datetime(2024, 1, 30)


def at_call(puts, user, group, ts):
    """(since, monthly, daily, mode) by the definition: newest put of the user, else the group, else the default."""
    for kind, key in (("user", user), ("group", group), ("default", "default")):
        mine = [p for p in puts if p[0] == kind and p[1] == key and p[5] <= ts]
        if mine:
            p = max(mine, key=lambda x: x[5])
            return p[2] or 0, p[3] or 0, p[4] or "block"
    return K.BUILTIN_MONTHLY_LIMIT, K.BUILTIN_DAILY_LIMIT, K.BUILTIN_MODE


def sequential(calls, groups, puts):
    month, day, out = defaultdict(int), defaultdict(int), {}
    for rid, ts, user, tokens, _, failed in sorted(calls, key=lambda c: (c[1], c[0])):
        if user not in groups:
            out[rid] = (None, None, None, 404 if user else 400)
            continue
        ml, dl, mode = at_call(puts, user, groups[user], ts)
        mk, dk = (user, ts.month), (user, ts.date())
        ok = mode != "block" or (month[mk] < ml and day[dk] < dl)
        out[rid] = (ok, month[mk], day[dk], 429 if not ok else 500 if failed else 200)
        if ok and not failed:
            month[mk] += tokens
            day[dk] += tokens
    return out


def puts_df(spark, puts):
    return spark.createDataFrame([(t, i, m, d, e, "", None, at.isoformat() + "Z") for t, i, m, d, e, at in puts], QUOTA_POLICIES)


def inputs(seed, n_calls=900):
    rnd = random.Random(seed)
    groups = {f"u{k}": f"g{k % 3}" for k in range(9)}
    when = lambda: T0 + dt.timedelta(seconds=rnd.randrange(4 * 86400))
    # A third of all calls by one user.
    calls = [(f"r{k:04d}", when() if k % 5 else T0 + dt.timedelta(hours=k % 96), "u0" if k % 3 == 0 else f"u{rnd.randrange(9)}",
              rnd.choice([0, 1, 4, 9]), 0, rnd.random() < 0.1) for k in range(n_calls)]
    calls += [("nobody", when(), "stranger", 1, 1, False), ("none", when(), None, 1, 1, False)]
    puts = [("default", "default", 120, 60, "block", T0 + dt.timedelta(hours=5))]
    puts += [(rnd.choice(["group", "user"]), None, rnd.choice([None, 0, 40, 90, 400]), rnd.choice([0, 15, 60, 500]),
              rnd.choice(["block", "block", "alert", None]), T0 + dt.timedelta(hours=rnd.randrange(-20, 96))) for _ in range(25)]
    seen, named = set(), []
    for kind, ident, *rest in puts:
        ident = ident or (f"g{rnd.randrange(3)}" if kind == "group" else f"u{rnd.randrange(9)}")
        if (kind, ident, rest[-1]) not in seen:  # puts of one time have no order here
            seen.add((kind, ident, rest[-1]))
            named.append((kind, ident, *rest))
    return groups, calls, named


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_with_changing_limits_equals_the_protocol(spark, seed):
    groups, calls, puts = inputs(seed)
    users = users_df(spark, [(u, g, "t", "d") for u, g in groups.items()])
    versions = DM.policy_versions(puts_df(spark, puts))
    got = K.quota_replay_versions(spark.createDataFrame(calls, CALLS), users, versions, chunk_seconds=3600)
    assert {r.request_id: (r.allowed, r.monthly_usage, r.daily_usage, r.status) for r in got.collect()} == sequential(calls, groups, puts)


def test_raised_and_restored_limit(spark):
    """Refused calls of the low limit use nothing of the raised one; after the restore the usage stands above the limit."""
    hour = lambda h: T0 + dt.timedelta(hours=h)
    calls = [(f"r{h:02d}", hour(h), "u", 10, 0, False) for h in range(12)]
    puts = [("user", "u", 10**6, 20, "block", T0 - dt.timedelta(days=1)), ("user", "u", 10**6, 50, "block", hour(6)),
            ("user", "u", 10**6, 20, "block", hour(11))]
    users = users_df(spark, [("u", "g", "t", "d")])
    got = K.quota_replay_versions(spark.createDataFrame(calls, CALLS), users, DM.policy_versions(puts_df(spark, puts)))
    allowed = [r.allowed for r in got.orderBy("ts").collect()]
    assert allowed == [True] * 2 + [False] * 4 + [True] * 3 + [False] * 3


def test_one_version_equals_plain_replay(spark):
    groups, calls, _ = inputs(7)
    puts = [("default", "default", 150, 40, "block", T0 - dt.timedelta(days=9)), ("group", "g1", 90, 30, "alert", T0 - dt.timedelta(days=9))]
    users, df = users_df(spark, [(u, g, "t", "d") for u, g in groups.items()]), spark.createDataFrame(calls, CALLS)
    key = lambda x: sorted(map(str, x.select("request_id", "allowed", "charged_tokens", "monthly_usage", "daily_usage", "status").collect()))
    assert key(K.quota_replay_versions(df, users, DM.policy_versions(puts_df(spark, puts)))) == key(K.quota_replay(df, users, puts_df(spark, puts)))


def test_versions_close_each_other_and_skip_puts_without_change(spark):
    d = lambda k: T0 + dt.timedelta(days=k)
    puts = [("user", "a", 1, 1, "block", d(0)), ("user", "a", 1, 1, "block", d(1)), ("user", "a", 2, 1, None, d(2)),
            ("user", "a", None, 1, None, d(40)), ("user", "b", 5, 5, "block", d(3))]
    df = puts_df(spark, puts).unionByName(spark.createDataFrame([("user", "c", 1, 1, "block", "", None, "no time")], QUOTA_POLICIES))
    got = [(r.identifier, r.monthly_limit, r.valid_from, r.valid_to) for r in DM.policy_versions(df).orderBy("identifier", "valid_from").collect()]
    assert got == [("a", 1, d(0), d(2)), ("a", 2, d(2), d(40)), ("a", None, d(40), None), ("b", 5, d(3), None),
                   ("c", 1, dt.datetime(1, 1, 1), None)]
    assert DM.policy_versions(df.where("false")).count() == 0


def test_in_force_by_chunk_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["a", "a", "a", "b", None, "c"]), T0 + dt.timedelta(seconds=rnd.randrange(0, 7200, 60))) for k in range(400)]
    cuts = sorted({(rnd.choice("ab"), T0 + dt.timedelta(seconds=rnd.randrange(-3600, 7200, 60))) for _ in range(40)})
    versions = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(cuts)], "key string, valid_from timestamp_ntz, v int")
    got = in_force(spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz"), "key",
                   versions.select("key", "valid_from", F.struct("v").alias("row")), "found", chunk_seconds=600).collect()
    want = {i: max(((t, v) for v, (k2, t) in enumerate(cuts) if k2 == k and t <= ts), default=(None, None))[1] for i, k, ts in rows}
    assert len(got) == len(rows) and {r.id: r.found and r.found.v for r in got} == want


def test_neighbours_across_chunks(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), h) for h in (0, 1, 30, 31, 200)] + [("b", T0, 9)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v int")
    back = {(r.k, r.v): r.n and r.n.v for r in neighbour(df, ["k"], "at", F.struct("v"), "n").collect()}
    assert back == {("a", 0): None, ("a", 1): 0, ("a", 30): 1, ("a", 31): 30, ("a", 200): 31, ("b", 9): None}
    on = {(r.k, r.v): r.n and r.n.v for r in neighbour(df, ["k"], "at", F.struct("v"), "n", later=True).collect()}
    assert on == {("a", 0): 1, ("a", 1): 30, ("a", 30): 31, ("a", 31): 200, ("a", 200): None, ("b", 9): None}
