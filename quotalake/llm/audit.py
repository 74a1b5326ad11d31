"""What each filter of a set removes, in every order of the filters.

Documents are counted once per part and set of failed filters.  The removal
game of a part gives a coalition of filters the number of documents that fail
any of them; every order's steps are differences of that game between nested
coalitions.  Shares come from its Hart-Mas-Colell potential, found by
recursion over the coalitions: a filter's Shapley value is the potential of
all filters less the potential without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalake.llm.common import stored, words

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
STEPS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) per row of ``docs``: bit i of ``failed`` is set if filter i of FILTERS rejects the text.

    A null text counts as empty, a null source as the part ``''``.  A text is
    a copy (E) if the same text has a row with a smaller doc_id; rows with a
    null doc_id are neither copies nor originals, and rows that share the
    smallest doc_id are none of them copies.  Only a digest of the text is
    shuffled, and no group of equal texts meets in one task: the smallest
    doc_id of a digest is aggregated, and found again by digest and doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words(text).alias("words"))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words"))
    upper, length = F.regexp_count("text", F.lit("[A-Z]")).cast("long"), F.length("text")
    tests = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * length,
             F.col("text").rlike(SYMBOLS)]
    failed = sum(F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests))
    rows = stored(read.select("doc_id", "part", failed.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(first, ["digest", "doc_id"], "left")
            .select("doc_id", "part", (F.col("failed") + F.when(copy, 1 << len(tests)).otherwise(0)).alias("failed")))


def outcomes(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents per part and set of failed filters; at most 32 rows a part.

    A document is good (toxic) if any row of ``labels`` with its doc_id has
    quality 1 (toxic 1).
    """
    marked = (labels.groupBy("doc_id")
              .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
              .where("good or toxic"))
    return (failed.join(marked, "doc_id", "left").groupBy("part", "failed")
            .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))


def removal_game(counts: np.ndarray) -> np.ndarray:
    """Value of every coalition: documents that fail any of its filters; ``counts[part, set of failed filters]``."""
    sets = np.arange(counts.shape[1])
    return counts @ (sets[:, None] & sets[None, :] != 0).astype(np.int64)


def potentials(game: np.ndarray) -> np.ndarray:
    """Hart-Mas-Colell potentials of all coalitions, times the factorial of the number of filters, which keeps them whole.

    P(empty) = 0 and ``|S| P(S) = v(S) + sum of P(S without i) over i in S``.
    """
    n = game.shape[1].bit_length() - 1
    scale, found = factorial(n), np.zeros_like(game)
    for s in sorted(range(1, 1 << n), key=int.bit_count):
        found[:, s] = (scale * game[:, s] + sum(found[:, s & ~(1 << i)] for i in range(n) if s >> i & 1)) // s.bit_count()
    return found


def audit(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, counts) for every part, every order of ``names`` and every step of it.

    ``counted`` is ``outcomes``.  ``kept`` counts documents left after the
    step, ``removed`` those that its filter takes here, ``redundant`` those
    that fail it but went earlier, ``unique_fails`` those that fail it alone,
    ``good_lost`` and ``toxic_lost`` the labelled among ``removed``;
    ``shapley`` is what the filter removes summed over all orders.  Without
    documents there is no part and no row.
    """
    size = len(names)
    orders = ["".join(names[i] for i in order) for order in permutations(range(size))]
    at = np.array(list(permutations(range(size))))  # filter of (order, step)
    after = np.bitwise_or.accumulate(1 << at, axis=1)
    before, whole = after & ~(1 << at), (1 << size) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, profile = (batch.column(c).to_pylist() for c in range(2))
            counts = np.zeros((3, len(parts), 1 << size), dtype=np.int64)
            for p, rows in enumerate(profile):
                for r in rows:
                    counts[:, p, r["failed"]] += (r["n"], r["good"], r["toxic"])
            every, good, toxic = map(removal_game, counts)
            taken = [v[:, after] - v[:, before] for v in (every, good, toxic)]
            p = potentials(every)
            share = p[:, whole, None] - p[:, whole & ~(1 << np.arange(size))]
            alone = every[:, whole, None] - every[:, whole & ~(1 << np.arange(size))]
            columns = [counts[0].sum(1)[:, None, None] - every[:, after], taken[0], every[:, 1 << at] - taken[0], alone[:, at],
                       taken[1], taken[2], share[:, at]]
            per = at.size
            for k, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * per), pa.array(np.repeat(orders, size).tolist()),
                     pa.array(np.tile(np.arange(1, size + 1), len(orders)), pa.int32()),
                     *[pa.array(c[k].ravel(), pa.int64()) for c in columns]], ["part", "filter_order", "step", *COUNTS])

    profiles = counted.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("profile"))
    return profiles.mapInArrow(run, STEPS)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of this module on whole ``docs``, audited per source; see ``failures`` and ``audit`` for odd rows."""
    return audit(outcomes(failures(docs), labels))
