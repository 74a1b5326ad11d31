import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotalake.operators import rollups as R

T0 = dt.datetime(2024, 1, 30)
DIMS, MEASURES = ["tenant", "user_id"], ["tokens", "latency_ms"]


def _rows(spark):
    rng = random.Random(4)
    rows = [("hot" if k % 3 else rng.choice(["a", None]), f"u{rng.randrange(5)}", T0 + dt.timedelta(seconds=rng.randrange(70 * 86400)),
             rng.choice([None, 1, 2**53 + 1]), rng.randrange(1000)) for k in range(3000)]
    return spark.createDataFrame(rows + [("a", "u1", None, 1, 1)], "tenant string, user_id string, ts timestamp_ntz, tokens long, latency_ms long")


def _direct(rows, dims, start, end, *over):
    inside = rows.where((F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(end)).cast("timestamp_ntz")))
    parts = [f(m) for m in MEASURES for f in (F.count, F.sum, F.min, F.max)]
    return inside.groupBy(*dims, *over).agg(F.count(F.lit(1)), *parts, *[F.sum(m) / F.nullif(F.count(m), F.lit(0)) for m in MEASURES])


def _same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def _got(spark, path, dims, start, end, period=None):
    over = ["period_start"] if period else []
    parts = [f"{m}_{p}" for m in MEASURES for p in ("n", "sum", "min", "max")]
    return R.rollup_series(spark, path, dims, MEASURES, start, end, period).select(*dims, *over, "calls", *parts, *[f"{m}_avg" for m in MEASURES])


def test_spans_and_series_equal_the_direct_form(spark, tmp_dir):
    rows = _rows(spark).cache()
    R.write_rollups(rows, tmp_dir, DIMS, MEASURES)
    start, end = T0 + dt.timedelta(hours=10, minutes=17), T0 + dt.timedelta(days=64, hours=3, minutes=2)
    assert [p[0] for p in R.cover(start, end)] == ["minute", "hour", "day", "month", "day", "hour", "minute"]
    _same(_got(spark, tmp_dir, ["tenant"], start, end), _direct(rows, ["tenant"], start, end))
    _same(_got(spark, tmp_dir, [], start, end), _direct(rows, [], start, end))
    _same(_got(spark, tmp_dir, DIMS, start, end, "day"), _direct(rows, DIMS, start, end, F.to_date("ts").cast("timestamp_ntz")))
    _same(_got(spark, tmp_dir, ["tenant"], start, end, "month"), _direct(rows, ["tenant"], start, end, F.trunc(F.to_date("ts"), "MM").cast("timestamp_ntz")))
    assert _got(spark, tmp_dir, [], start, start).first().calls == 0
    # Days that are written again replace themselves on every level.
    again = rows.where(F.to_date("ts") == F.lit("2024-02-11").cast("date"))
    R.write_rollups(again.unionByName(again), tmp_dir, DIMS, MEASURES)
    _same(_got(spark, tmp_dir, DIMS, start, end), _direct(rows.unionByName(again), DIMS, start, end))


def test_cover_is_disjoint_whole_and_coarse():
    rng = random.Random(5)
    for _ in range(300):
        start = T0 + dt.timedelta(minutes=rng.randrange(200_000))
        end = start + dt.timedelta(minutes=rng.choice([0, 1, 59, 60, 1440, rng.randrange(200_000)]))
        pieces = R.cover(start, end, rng.choice(R.LEVELS))
        assert all(a < b and R._floor(a, lv) == a and R._floor(b, lv) == b for lv, a, b in pieces)
        assert [p[1] for p in pieces] + [end] == [start] + [p[2] for p in pieces]
        assert all(sum(p[0] == lv for p in pieces) <= 2 for lv in R.LEVELS)
    with pytest.raises(ValueError):
        R.cover(T0, T0 + dt.timedelta(seconds=1))
