import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotalake.operators import alarms as AL

T0 = dt.datetime(2024, 1, 31, 22)
RULES = ("notBreaching", "breaching", "ignore", "missing")


def step_by_step(points, threshold, n, missing):
    """Each period from the first to the last with data, one after another: (minute, value, previous, state)."""
    state, run, out = "OK", 0, []
    for minute in range(min(points), max(points) + 1):
        value = points.get(minute)
        before = state
        if value is None and missing == "ignore":
            pass
        else:
            breaching = missing == "breaching" if value is None else value > threshold
            run = run + 1 if breaching else 0
            state = "INSUFFICIENT_DATA" if value is None and missing == "missing" else "ALARM" if run >= n else "OK"
        out.append((minute, value, before, state))
    return out


def series(seed):
    rnd = random.Random(seed)
    out, at = {}, 0
    for _ in range(60):
        at += rnd.choice([1, 1, 1, 2, 3, 5, 9])
        out[at] = float(rnd.choice([1, 9]))
    return out


@pytest.mark.parametrize("missing", RULES)
@pytest.mark.parametrize("n", [1, 2, 3])
def test_rules_equal_step_by_step(spark, missing, n):
    rows = [(name, T0 + dt.timedelta(minutes=m), v) for name, seed in (("a", 1), ("b", 2)) for m, v in series(seed).items()]
    df = spark.createDataFrame(rows, "name string, period_start timestamp_ntz, value double")
    want = [(name, T0 + dt.timedelta(minutes=m), v, p, s) for name, seed in (("a", 1), ("b", 2))
            for m, v, p, s in step_by_step(series(seed), 5, n, missing)]
    got = AL.alarm_transitions(df, 5, 60, n, ["name"], missing=missing).collect()
    assert sorted(map(tuple, got), key=str) == sorted((w for w in want if w[3] != w[4]), key=str)
    points = AL.evaluate_alarm(df, 5, 60, n, ["name"], missing=missing).collect()
    assert sorted((r.name, r.period_start, r.state, r.changed) for r in points) == sorted((a, b, s, p != s) for a, b, v, p, s in want if v is not None)


def test_empty_series_and_unknown_rule(spark):
    df = spark.createDataFrame([], "period_start timestamp_ntz, value double")
    for rule in RULES:
        assert AL.evaluate_alarm(df, 1, 60, missing=rule).count() == AL.alarm_transitions(df, 1, 60, missing=rule).count() == 0
    with pytest.raises(ValueError):
        AL.evaluate_alarm(df, 1, 60, missing="none")
