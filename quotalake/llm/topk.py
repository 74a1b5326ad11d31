"""Exact inner-product search over vectors in order of descending length.

Vectors are range-partitioned by length and packed into blocks; all vectors
are turned by the principal axes of the whole table, so the first coordinates
carry most of a product.  A block of queries meets each block of vectors
once: partial sums over growing prefixes of the turned coordinates, plus the
Cauchy-Schwarz bound of what is left, drop vectors that cannot reach a
query's k-th best product so far, and the survivors' products are taken from
the vectors as given.  Thresholds start from the longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotalake.llm.common import stored

BLOCK = 4_096
QUERY_BLOCK = 2_048
SEEDS = 1_024
STEP = 1_024
MAX_WIDTH = 4_096
BLOCKS = "block long, longest double, ids binary, asks binary, data binary"
# Slack of the bounds against rounding, relative to the product of the lengths.
SLACK = 1e-9
# A shard of queries meets the blocks in so many groups, each of which can be a task of its own.
GROUPS = 64
# Products of whole vectors whose lengths multiply to less than this are exact in doubles.
EXACT = float(1 << 52)


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, width)


def _longest_first(rows: DataFrame, width: int) -> DataFrame:
    """Blocks (block, longest, ids, asks, data) of at most BLOCK rows, longest vectors first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            at = batch.column(3)
            flat = batch.column(1)
            sizes = np.diff(flat.offsets.to_numpy())
            dense = np.zeros((len(ids), width))
            dense[np.repeat(np.arange(len(ids)), sizes),
                  np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
            for k in range(0, len(ids), BLOCK):
                some = dense[k:k + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [at.slice(k, 1), pa.array([float(np.sqrt((some * some).sum(1)).max())]),
                     pa.array([ids[k:k + BLOCK].tobytes()], pa.binary()),
                     pa.array([asks[k:k + BLOCK].tobytes()], pa.binary()), pa.array([some.tobytes()], pa.binary())],
                    ["block", "longest", "ids", "asks", "data"])

    return (rows.repartitionByRange(F.desc("length"), F.col("vec_id"))
            .sortWithinPartitions(F.desc("length"), F.col("vec_id"))
            .select("vec_id", "vector", "asks", F.monotonically_increasing_id().alias("at"))
            .mapInArrow(run, BLOCKS))


def _axes(blocks: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all vectors, strongest first; width * width sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = _matrix(raw, width)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "v"])

    cells = blocks.select("data").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    gram = np.zeros(width * width)
    for r in cells.collect():
        gram[r.cell] = r.v
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


def sortable(score: int) -> str:
    """Text of a whole number of any size that sorts like the number."""
    digits = str(abs(score))
    if score >= 0:
        return f"p{len(digits):06d}{digits}"
    return f"n{999_999 - len(digits):06d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _products(q: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    """Row by row products; of ``whole`` vectors as Python integers where doubles would round."""
    found = np.einsum("ij,ij->i", q, x)
    if not whole:
        return found
    large = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)) >= EXACT
    found = np.array([*map(int, np.where(large, 0, found))], dtype=object)
    for n in np.flatnonzero(large):
        found[n] = sum(int(a) * int(b) for a, b in zip(q[n], x[n]))
    return found


class _Best:
    """The k best (score, smaller id first) of each query of a block, filled from batches of candidates.

    With ``whole``, scores are Python integers, and ``floor`` has the k-th as doubles.
    """

    def __init__(self, n: int, k: int, whole: bool = False):
        self.k = k
        self.score = np.full((n, k), -np.inf, dtype=object if whole else float)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1].astype(float)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        score = np.concatenate([score, self.score[touched].ravel()])
        if score.dtype == object:
            order = np.array(sorted(range(len(query)), key=lambda r: (query[r], -score[r], ids[r])))
        else:
            order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = rank < self.k
        at = order[keep]
        self.score[query[keep], rank[keep]] = score[at]
        self.ids[query[keep], rank[keep]] = ids[at]


def _search(best: _Best, q: np.ndarray, q_turned: np.ndarray, x: np.ndarray, x_turned: np.ndarray,
            ids: np.ndarray, own: np.ndarray, floor: np.ndarray, stops: list[int], whole: bool = False) -> None:
    """Adds to ``best`` all of x that may be among the queries' k best; ``own``: a query's row of x, or -1."""
    q_left = [np.sqrt((q_turned[:, s:] ** 2).sum(1)) for s in [0, *stops]]
    for k in range(0, len(x), STEP):
        some, turned = x[k:k + STEP], x_turned[k:k + STEP]
        left = [np.sqrt((turned[:, s:] ** 2).sum(1)) for s in [0, *stops]]
        need = np.maximum(floor, best.floor()) - SLACK * (q_left[0] * left[0].max() + 1)
        live = np.flatnonzero(q_left[0] * left[0].max() >= need)
        if not len(live):
            continue
        bound = q_turned[live, :stops[0]] @ turned[:, :stops[0]].T
        i, j = np.nonzero(bound + np.outer(q_left[1][live], left[1]) >= need[live, None])
        part, i = bound[i, j], live[i]
        for n, (a, b) in enumerate(zip(stops, stops[1:]), start=2):
            part = part + np.einsum("ij,ij->i", q_turned[i, a:b], turned[j, a:b])
            keep = part + q_left[n][i] * left[n][j] >= need[i]
            part, i, j = part[keep], i[keep], j[keep]
        keep = own[i] != j + k
        i, j = i[keep], j[keep]
        best.add(i, ids[k:k + STEP][j], _products(q[i], some[j], whole))


def _questions(blocks: DataFrame, width: int, k: int, shards: int) -> DataFrame:
    """(shard, block, at, query_id, floor, reach, vector) per query.

    ``floor`` is the k-th best product with the longest vectors (bounded in
    number), ``reach`` the shortest length that can still beat it.
    """
    first = blocks.orderBy(F.desc("longest"), "block").limit(1).collect()
    block = first[0].block if first else -1
    seeds = _matrix(first[0].data, width)[:SEEDS] if first else np.zeros((0, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_block, ids, asks, data in zip(*(batch.column(c).to_pylist() for c in range(4))):
                at = np.flatnonzero(np.frombuffer(asks, dtype=bool))
                q = _matrix(data, width)[at]
                score = q @ seeds.T
                if at_block == block:
                    mine = at < len(seeds)
                    score[np.flatnonzero(mine), at[mine]] = -np.inf
                floor = np.full(len(at), -np.inf)
                if score.shape[1] >= k:
                    floor = np.partition(score, -k, axis=1)[:, -k]
                length = np.sqrt((q * q).sum(1))
                reach = np.where(length > 0, floor / np.maximum(length, 1e-300), np.where(floor <= 0, -np.inf, np.inf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), at_block)), pa.array(at),
                     pa.array(np.frombuffer(ids, dtype=np.int64)[at]), pa.array(floor), pa.array(reach),
                     pa.array([v.tobytes() for v in q], pa.binary())],
                    ["block", "at", "query_id", "floor", "reach", "vector"])

    return (blocks.select("block", "ids", "asks", "data")
            .mapInArrow(run, "block long, at long, query_id long, floor double, reach double, vector binary")
            .withColumn("shard", F.pmod(F.xxhash64("block", "at"), F.lit(shards)).cast("int")))


def top_k(vectors: DataFrame, queries: Column, k: int, whole: bool = False) -> DataFrame:
    """The ``k`` rows with the largest inner product for each row where ``queries`` holds.

    ``vectors(vec_id, vector array<double>)``; returns query_id, rank (from 1),
    vec_id, score (double), ties to the smaller vec_id.  All rows but the
    query's own are candidates; repeated rows are candidates, and queries, of
    their own.  Vectors that are null or hold null or non-finite components
    take no part, nor do rows with a null vec_id; a shorter vector counts as
    if filled up with zeros, an empty one as zero.  Other columns are ignored;
    an empty table gives no rows.  With ``whole``, all components are whole
    numbers of any size, products are exact, and ``exact`` has their digits.
    The sum of a vector's squares must be a finite double.
    """
    sane = F.expr("vec_id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) "
                  "or abs(x) = double('infinity'))")
    rows = (vectors.withColumn("asks", F.coalesce(queries, F.lit(False))).select("vec_id", "vector", "asks")
            .where(F.coalesce(sane, F.lit(False)))
            .withColumn("length", F.expr("aggregate(vector, double(0), (s, x) -> s + x * x)")))
    shape = rows.agg(F.max(F.size("vector")).alias("width"), F.count_if("asks").alias("asked"), F.max("length").alias("longest")).first()
    width = max(1, shape.width or 1)
    if width > MAX_WIDTH:
        raise ValueError(f"vectors are longer than {MAX_WIDTH}")
    large = whole and (shape.longest or 0) >= EXACT
    blocks = stored(_longest_first(rows, width))
    axes = _axes(blocks, width)
    shards = max(1, ceil(shape.asked / QUERY_BLOCK))
    group = F.pmod(F.xxhash64("block"), F.lit(GROUPS)).cast("int").alias("group")
    asked = stored(_questions(blocks, width, k, shards).groupBy("shard")
                   .agg(F.min("reach").alias("reach"), F.collect_list(F.struct("block", "at", "query_id", "floor", "vector"))
                        .alias("asked")))  # a hash share of the queries, about QUERY_BLOCK rows
    # Which block meets which shard is settled on ids and lengths; only then do the vectors follow.
    meets = (blocks.select("block", "longest").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
             .join(asked.select("shard", "reach"), "shard").where(F.col("longest") * (1 + SLACK) + SLACK >= F.col("reach"))
             .select("block", "shard"))
    pairs = (blocks.select("block", "ids", "data", group).join(meets, "block")
             .join(asked.select("shard", "asked", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group")), ["shard", "group"]))
    stops = sorted({max(1, width // 4), max(1, width // 2), width})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, raw_ids, data = (batch.column(c)[row].as_py() for c in range(3))
                asked = batch.column(3)[row].values
                q_block, q_at, q_id, floor = (asked.field(c).to_numpy(zero_copy_only=False) for c in range(4))
                q = np.array([np.frombuffer(v, dtype=np.float64) for v in asked.field(4).to_pylist()])
                x, ids = _matrix(data, width), np.frombuffer(raw_ids, dtype=np.int64)
                best = _Best(len(q), k, large)
                _search(best, q, q @ axes, x, x @ axes, ids, np.where(q_block == block, q_at, -1), floor, stops, large)
                at, rank = np.nonzero(best.score > -np.inf)
                score = best.score[at, rank]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_block[at]), pa.array(q_at[at]), pa.array(q_id[at]), pa.array(best.ids[at, rank]),
                     pa.array(score.astype(float)), pa.array([sortable(s) for s in score] if large else [None] * len(at), pa.string()),
                     pa.array([str(s) for s in score] if large else [None] * len(at), pa.string())],
                    ["block", "at", "query_id", "vec_id", "score", "by", "exact"])

    found = pairs.select("block", "ids", "data", "asked").mapInArrow(
        run, "block long, at long, query_id long, vec_id long, score double, by string, exact string")
    # A pure order of the numbers: doubles where they are exact, else their sortable digits.
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("by"), F.desc("score"), "vec_id"))
    exact = [F.coalesce("exact", F.format_string("%.0f", "score")).alias("exact")] if whole else []
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *exact))
