import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalake.llm import topk

SCHEMA = "vec_id long, vector array<double>, length string, asks int, block int, data string"


def slow(rows, wanted, k):
    width = max(len(v) for _, v in rows)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = []
    for q in np.flatnonzero(wanted(ids)):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out += [(int(ids[q]), r, int(ids[j]), float(score[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def found(spark, rows, k, queries):
    frame = spark.createDataFrame([(i, v, "x", 1, 1, "y") for i, v in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, topk.top_k(frame, queries, k).collect()))


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "STEP", 32)
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 60, (900, 16)) * rng.lognormal(0, 1, (900, 1)))
    x[200:260] = x[199]  # many ties
    x[300:310] = 0
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(3000)[:900], x)]
    assert found(spark, rows, 5, F.col("vec_id") % 10 == 0) == slow(rows, lambda i: i % 10 == 0, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [3.0]), (1, []), (2, [-1.0, 5.0, 2.0]), (100, [0.0, 0.0]), (3, [3.0]), (3, [3.0]), (50, [4.0, 1.0])]
    bad = [(4, None), (5, [1.0, None]), (6, [float("nan")]), (150, [float("inf")]), (None, [9.0])]
    assert found(spark, rows + bad, 3, F.col("vec_id") % 50 == 0) == slow(rows, lambda i: i % 50 == 0, 3)
    assert found(spark, rows, 50, F.col("vec_id") == 0) == slow(rows, lambda i: i == 0, 50)  # fewer than k
    assert found(spark, rows, 3, F.col("vec_id") == 77) == []
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True), 3).count() == 0
    with pytest.raises(ValueError):
        found(spark, [(1, [0.0] * 5000)], 1, F.lit(True))


def test_sortable_text_of_whole_numbers():
    numbers = [0, 1, 9, 10, 99, 12345, 10**40, 10**40 + 1, -1, -9, -10, -12, -10**40, -10**40 - 1]
    assert sorted(numbers) == sorted(numbers, key=topk.sortable)


@pytest.mark.parametrize("large", [[], [1e30], [3e38, -3e38, 1e12, 1e12, 7e4]])
def test_query_is_exact_for_components_of_any_size(spark, tmp_path, monkeypatch, large):
    """Whole table through the registered query: huge, equal and ordinary vectors against Python integers, and its SQL."""
    import duckdb

    from quotalake.llm.queries import op10_topk
    from quotalake.llm.sql import ORACLES

    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 8)).astype(np.float32)
    for n, v in enumerate(large):
        x[n * 50, n % 8] = v      # a query
        x[n * 50 + 7, (n + 1) % 8] = v
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, None]), (450, [float("inf")] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = [[int(np.floor(256 * float(c))) for c in v] for v in x]
    want, limit = [], 2**63 - 1
    for q in range(0, 400, 50):
        scores = sorted(((sum(a * b for a, b in zip(whole[q], w)), -i) for i, w in enumerate(whole) if i != q), reverse=True)[:5]
        want += [(q, r, -i, max(-limit, min(limit, s))) for r, (s, i) in enumerate(scores, 1)]
    got = sorted(map(tuple, op10_topk(spark, str(tmp_path)).collect()))
    assert got == want
    if len(large) < 2:
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(r[0] for r in con.execute(ORACLES["op10_topk"]).fetchall()) == [r[0] for r in want]
