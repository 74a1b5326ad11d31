import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quotalake.llm import clusters
from quotalake.llm.queries import op12_clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, near int, vector string, n int"


def brute_force(rows, k, rounds, width, scale, seed):
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    def order(row):
        key = (1, "") if row[0] is None else (0, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest())
        return key, row[1]
    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept]
    cut = lambda n: min(n, 2 ** 63 - 1)
    return sorted(((i, j, cut(d), cut(sum(d2 for _, d2, j2 in last if j2 == j)), cut(sum(x[1] for x in last)),
                    hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, "y", 3) for i, v in rows], SCHEMA)


ODD = [(900, None), (901, []), (902, [1.0]), (903, [None, 1.0, 2.0, 3.0]), (904, [float("nan"), 1.0, 2.0, 3.0]),
       (905, [float("-inf"), 1.0, 2.0, 3.0]), (906, [1.0] * 5), (None, [0.5, 0.5, 0.5, 0.25]), (907, [-0.0, 1e-320, -1e-9, 0.0])]


def vectors(seed, n=150):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(k % 3, 0.3) for _ in range(4)]) for k in range(n)]
    return rows + rows[:7] + [(n + k, rows[3][1]) for k in range(30)] + [(4, rows[9][1])] + ODD


@pytest.mark.parametrize("seed", [3, 8])
def test_equals_brute_force(spark, seed):
    rows = vectors(seed)
    got = clusters.cluster(table(spark, rows), k=6, rounds=5, width=4, scale=1024, seed=seed)
    assert found(got) == brute_force(rows, 6, 5, 4, 1024, seed)


@pytest.mark.parametrize("large", [1e6, -3e15, 1e30, 1.7e308])
def test_large_components_are_exact_and_do_not_fail(spark, large):
    rows = vectors(2, 40) + [(500, [large, 1.0, 2.0, 3.0]), (501, [large * 0.9, -large * 0.5, 1.0, 0.5])]
    for k in (3, 200):  # 200: the large vectors are centroids
        got = clusters.cluster(table(spark, rows), k=k, rounds=3, width=4, scale=1024, seed=3)
        assert found(got) == brute_force(rows, k, 3, 4, 1024, 3)


def test_equal_vectors_go_to_the_smallest_number_and_empty_centroids_stay(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(50)]
    got = clusters.cluster(table(spark, rows), k=4, rounds=3, width=4).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [0.0, 0.0, 0.0, 0.0])]
    assert {(r.vec_id, r.distance) for r in clusters.cluster(table(spark, rows), k=8, width=4).collect()} == {(1, 0), (2, 0)}
    assert clusters.cluster(table(spark, ODD[:5]), width=4).count() == 0
    assert clusters.cluster(table(spark, []), width=4).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_rounds_run_without_python(spark):
    got = op12_clusters(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert got.agg(F.sum("distance")).first()[0] == got.first().inertia
