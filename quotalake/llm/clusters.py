"""Exact integer k-means over a table of vectors.

Vectors are turned into whole numbers once.  A round is one job over all of
them: literal centroid arrays meet each vector in ``zip_with`` and
``aggregate``, ``array_min`` over (distance, number) structs chooses the
cluster, and column sums per cluster, partial in each task, give the new
centroids.  Only k rows of sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalake.llm.common import stored

# Whole components below this have squared distances within a long at WIDTH components or fewer.
NARROW = 1 << 27
WIDTH = 64
LARGEST = (1 << 63) - 1
ASSIGNED = "vec_id long, cluster int, distance long"


def _whole(x: float, scale: int) -> int:
    scaled = x * scale
    return floor(scaled) if abs(scaled) < 1e300 else int(x) * scale


def _nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid to ``vector``; the smaller number wins a tie."""
    options = []
    for number, centroid in enumerate(centroids):
        apart = F.zip_with("vector", F.expr(f"array({', '.join(f'{c}L' for c in centroid)})"), lambda x, c: (x - c) * (x - c))
        distance = F.aggregate(apart, F.lit(0).cast("long"), lambda total, x: total + x)
        options.append(F.struct(distance.alias("distance"), F.lit(number).alias("cluster")))
    return F.array_min(F.array(*options))


class _Narrow:
    """Rounds over ``rows(vec_id, vector array<int>)`` whose distances fit a long: JVM expressions only."""

    def __init__(self, rows: DataFrame, width: int, largest: int, count: int):
        self.rows, self.width = rows, width
        self.total = "long" if largest * count < LARGEST else "decimal(38,0)"

    def start(self, k: int, seed: int) -> list[list[int]]:
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = self.rows.orderBy(key.asc_nulls_last(), "vector").limit(k)
        return [list(r.vector) for r in first.collect()]

    def sums(self, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
        found = (self.rows.select(_nearest(centroids)["cluster"].alias("cluster"), "vector").groupBy("cluster")
                 .agg(F.count("*").alias("n"), *[F.expr(f"sum(cast(vector[{i}] as {self.total})) as s{i}") for i in range(self.width)]))
        return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in found.collect()}

    def assigned(self, centroids: list[list[int]]) -> DataFrame:
        return (self.rows.select("vec_id", _nearest(centroids).alias("near"))
                .select("vec_id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance")))

    def inertia(self, centroids: list[list[int]]) -> dict[int, int]:
        found = self.assigned(centroids).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")))
        return {r[0]: int(r[1]) for r in found.collect()}


def _whole_vectors(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    return np.array([[_whole(x, scale) for x in v] for v in column.to_pylist()], dtype=object).reshape(-1, width)


def _nearest_exactly(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance as Python integers); what fits a long is computed as one."""
    small = np.array([all(abs(x) < NARROW for x in v) for v in vectors], dtype=bool)
    apart = np.empty((len(vectors), len(centroids)), dtype=object)
    plain = vectors[small].astype(np.int64)
    for number, centroid in enumerate(centroids):
        fits = all(abs(c) < NARROW for c in centroid)
        if fits:
            apart[small, number] = ((plain - np.array(centroid)) ** 2).sum(1).astype(object)
        for row in np.flatnonzero(~small) if fits else range(len(vectors)):
            apart[row, number] = sum((int(x) - c) ** 2 for x, c in zip(vectors[row], centroid))
    chosen = np.array([min(range(len(centroids)), key=lambda c: (int(row[c]), c)) for row in apart], dtype=np.int32)
    return chosen, apart[np.arange(len(vectors)), chosen]


class _Wide:
    """The same rounds where a component is NARROW or more: Python integers for the vectors and centroids that need them."""

    def __init__(self, rows: DataFrame, width: int, scale: int):
        self.rows, self.width, self.scale = rows, width, scale

    def start(self, k: int, seed: int) -> list[list[int]]:
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = self.rows.orderBy(key.asc_nulls_last(), "vector").limit(k)
        return [[_whole(x, self.scale) for x in r.vector] for r in first.collect()]

    def _partial(self, centroids: list[list[int]], measure: bool) -> dict[int, tuple[int, list[int]]]:
        """Counts and exact sums (of components, or of distances) per cluster, from one row per task and cluster."""
        width, scale = self.width, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                vectors = _whole_vectors(batch.column(0), width, scale)
                chosen, distance = _nearest_exactly(vectors, centroids)
                for c in set(chosen.tolist()):
                    mine = (distance[:, None] if measure else vectors)[chosen == c]
                    had = total.get(c, [0, [0] * mine.shape[1]])
                    total[c] = [had[0] + len(mine), [a + int(b) for a, b in zip(had[1], mine.sum(0))]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()),
                 pa.array([[str(x) for x in s] for _, s in total.values()], pa.list_(pa.string()))], ["cluster", "n", "sums"])

        found: dict[int, tuple[int, list[int]]] = {}
        for r in self.rows.select("vector").mapInArrow(run, "cluster int, n long, sums array<string>").collect():
            n, had = found.get(r.cluster, (0, [0] * len(r.sums)))
            found[r.cluster] = (n + r.n, [a + int(b) for a, b in zip(had, r.sums)])
        return found

    def sums(self, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
        return self._partial(centroids, measure=False)

    def inertia(self, centroids: list[list[int]]) -> dict[int, int]:
        return {c: s[0] for c, (_, s) in self._partial(centroids, measure=True).items()}

    def assigned(self, centroids: list[list[int]]) -> DataFrame:
        width, scale = self.width, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen, distance = _nearest_exactly(_whole_vectors(batch.column(1), width, scale), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(chosen, pa.int32()), pa.array([min(int(x), LARGEST) for x in distance], pa.int64())],
                    ["vec_id", "cluster", "distance"])

        return self.rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(run, ASSIGNED)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = WIDTH, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of ``vectors(vec_id, embedding)``.

    Kept are vectors of exactly ``width`` components, none null or
    non-finite; component x becomes floor(scale * x), ``scale`` a power of
    two.  The first centroids are the ``k`` vectors whose SHA-256 of
    ``seed:vec_id`` is smallest in hexadecimal (null ids last, equal ids by
    the vector); fewer vectors give fewer clusters, none gives no rows.  Each
    round moves every centroid that has vectors to the componentwise floor of
    their mean.  Repeated rows count each.  All sums are exact.  If a whole
    component is 2**27 or more, Python integers take over where longs could
    overflow; a distance or inertia that exceeds a long is given as 2**63 - 1.
    Other columns are ignored.
    """
    if width > WIDTH:
        raise ValueError(f"vectors have at most {WIDTH} components")
    sane = F.expr(f"embedding is not null and size(embedding) = {width} "
                  "and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    kept = (vectors.where(F.coalesce(sane, F.lit(False)))
            .select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")))
    top, count = kept.agg(F.max(F.array_max(F.transform("vector", F.abs))), F.count("*")).first()
    if top is None or top * scale < NARROW - 1:
        whole = F.transform("vector", lambda x: F.floor(x * scale).cast("int"))
        largest = int((top or 0) * scale) + 1
        job = _Narrow(stored(kept.select("vec_id", whole.alias("vector"))), width, largest, count)
    else:
        job = _Wide(stored(kept), width, scale)
    centroids = job.start(k, seed)
    if not centroids:
        centroids = [[0] * width]
    for _ in range(rounds):
        found = job.sums(centroids)
        moved = [[s // found[c][0] for s in found[c][1]] if c in found else centroid for c, centroid in enumerate(centroids)]
        if moved == centroids:  # every later round would find the same
            break
        centroids = moved
    inertia = job.inertia(centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.array(*[F.lit(v) for v in values])[F.col("cluster")]
    whole = min(sum(inertia.values()), LARGEST)
    return job.assigned(centroids).select(
        "vec_id", "cluster", "distance",
        of_cluster([min(inertia.get(c, 0), LARGEST) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256"))
