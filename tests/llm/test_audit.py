import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalake.llm import audit


def brute_force(docs, labels):
    """Every order played through, document by document."""
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append((d, source or "", {x for x, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), d is not None and first[t] < d)) if bad}))
    found = {}
    for part in {p for _, p, _ in fails}:
        mine, total = [f for f in fails if f[1] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[2]]
                left = [f for f in left if x not in f[2]]
                total[x] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f[2] for f in mine) - len(gone), sum(f[2] == {x} for f in mine),
                    sum(f[0] in good for f in gone), sum(f[0] in toxic for f in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def as_dict(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in rows}
    assert len(found) == len(rows)
    return found


LABELS = [(0, 1, 0), (1, 1, 0), (1, 0, 1), (20, 1, 0), (24, 0, 1), (25, 1, 1), (33, 1, 0), (40, None, 1), (None, 1, 1), (999, 1, 1)]


def test_equals_every_order_played_through(spark, odd_docs, odd_rows):
    rng = np.random.default_rng(5)
    more = [(int(100 + k), " ".join(rng.choice(["Ab", "c", "DEF", "g#", "h", "i\x0bj"], int(rng.integers(0, 90)))),
             None if k % 7 == 0 else f"s{k % 3}") for k in range(60)]
    more += [(200 + k, more[k][1], "") for k in range(0, 60, 4)]
    docs = odd_docs.select("doc_id", "text", "source", "fp", "gone", F.lit(1).alias("part"), F.lit("x").alias("words"), F.lit(2).alias("digest"))
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = spark.createDataFrame(LABELS + [(100 + k, k % 2, k % 3) for k in range(60)], "doc_id long, quality int, toxic int")
    want = brute_force([(d, t, s) for d, t, s in odd_rows] + more, LABELS + [(100 + k, k % 2, k % 3) for k in range(60)])
    assert as_dict(audit.audit_filters(docs, labels)) == want


def test_no_documents_and_no_labels(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(no_docs, labels).count() == 0
    rows = audit.audit_filters(odd_docs, labels).agg(F.count("*"), F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(rows) == (4 * 600, 0, 0)


def test_potential_of_known_games():
    """Two players who need each other share alike; a player who adds nothing gets nothing."""
    both = np.array([[0, 0, 0, 6, 0, 0, 0, 6]])
    p = audit.potentials(both)[0]
    assert [int(p[7] - p[7 & ~(1 << i)]) for i in range(3)] == [18, 18, 0]  # times 3!


@pytest.mark.parametrize("seed", range(4))
def test_shares_are_mean_marginal_contributions(seed):
    game = np.random.default_rng(seed).integers(0, 1000, (3, 32))
    game[:, 0] = 0
    p = audit.potentials(game)
    for i in range(5):
        total = np.zeros(3, dtype=int)
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[:order.index(i)])
            total += game[:, before | 1 << i] - game[:, before]
        assert (p[:, 31] - p[:, 31 & ~(1 << i)] == total).all()
