import random
from itertools import combinations
from math import ceil

import duckdb

from quotalake.llm import decontaminate
from quotalake.llm.sql import ORACLES
from tests.llm.conftest import prose


def test_exact_substituted_and_clean(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 40)) for k in range(20)] + [(100, prose(rng, 10)), (101, "too short"), (102, None), (103, ""), (0, "x")]
    rows, expected = [], set()
    for d in range(200):
        words = prose(rng, 150).split()
        if d % 2:
            k = d % 20
            passage = items[k][1].split()
            for at in range(3, len(passage), 9 if d % 4 == 1 else 1000):
                passage[at] = "changed"
            at = rng.randrange(100)
            words[at:at] = passage
            expected.add((d, k))
        rows.append((d, " ".join(words).replace(" w1 ", " W1, ").capitalize()))
    rows += [(900, items[20][1]), (901, "so " + items[20][1] + " so"), (902, None), (903, ""), (None, "x " + items[3][1]), (904, "too short")]
    expected |= {(900, 100), (901, 100), (None, 3)}
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, hits string, item_id int, words string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for part_seeds in (decontaminate.PART_SEEDS, 300):  # one list of seeds, and several
        found = decontaminate.overlaps(docs.selectExpr("doc_id", "0 as row", "text"), benchmark, part_seeds)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    left = decontaminate.remove_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in expected}


def test_three_of_thirteen_words_changed_is_no_match(spark):
    item = [f"i{k}" for k in range(13)]
    two, three = list(item), list(item)
    two[0] = two[12] = "x"
    three[0] = three[1] = three[12] = "x"
    docs = spark.createDataFrame([(1, "a " + " ".join(two)), (2, " ".join(three))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.matched, r.overlap) for r in decontaminate.contaminated(docs, benchmark).collect()] == [(1, 11, 13)]


def test_masks_fit_between_any_allowed_changes():
    for window, masks in decontaminate.MASKS.items():
        assert all(m[0] == 0 and m[-1] < window for m in masks)
        for changed in combinations(range(window), window - ceil(window * decontaminate.SIMILARITY)):
            assert any(not {at + k for k in m} & set(changed) for m in masks for at in range(window - m[-1])), (window, changed)


def most_equal(doc, item):
    """Most equal words of all windows of an item against a document, laid in all ways; no seeds."""
    window = min(decontaminate.OVERLAP, len(item))
    equal = lambda at: sum(0 <= at + k < len(doc) and doc[at + k] == w for k, w in part)
    best = 0
    for s in range(len(item) - window + 1):
        part = list(enumerate(item[s:s + window]))
        best = max([best, *(equal(at) for at in range(1 - window, len(doc)))])
    return best


def test_every_place_and_every_allowed_change_is_found(spark):
    rows, expected, items = [], {}, {n: [f"i{n}x{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20)}
    for n, item in items.items():
        window = min(n, decontaminate.OVERLAP)
        allowed = window - ceil(window * decontaminate.SIMILARITY)
        for at in (0, 1, 4):
            for changed in [c for k in range(allowed + 2) for c in combinations(range(window), k)]:
                if len(changed) == allowed + 1 and sum(changed) % 5:
                    continue
                passage = ["new" if k in changed else w for k, w in enumerate(item[:window])]
                words = [f"a{k}" for k in range(at)] + passage + ["z"] * (at % 3)
                best = most_equal(words, item)
                if n >= 3 and best >= ceil(window * decontaminate.SIMILARITY):
                    expected[len(rows), n] = (best, window)
                rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): (r.matched, r.overlap) for r in found} == expected
    assert len(found) == len(expected)


def test_sql_finds_what_lies_off_stride_and_short_items(spark):
    """OP3's SQL against the operator: short items, two changes, odd places, equal ids, items cut at a document's ends."""
    rng = random.Random(8)
    items = [(n, prose(rng, n, 90)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 30)] + [(30, "twice " + prose(rng, 9)), (50, None)]
    rows = [(1, "a b c " + items[7][1] + " d"), (2, "a " + items[4][1]), (2, prose(rng, 40)), (None, items[3][1]), (60, None), (61, "")]
    for k in range(150):
        words = items[rng.randrange(2, 16)][1].split()
        for at in rng.sample(range(len(words)), min(len(words), rng.randrange(4))):
            words[at] = "new"
        rows.append((100 + k, " ".join(prose(rng, rng.randrange(4), 90).split() + words[rng.randrange(2):] + ["z"] * rng.randrange(3))))
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", benchmark.toPandas())
    want = sorted(con.execute(ORACLES["op3_decontaminate"]).fetchall(), key=str)
    got = decontaminate.contaminated(docs, benchmark).select("doc_id", "item_id", "matched", "overlap").collect()
    assert sorted(map(tuple, got), key=str) == want and len(want) > 60


def test_empty_tables(no_docs, odd_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert decontaminate.contaminated(no_docs, some).count() == 0
    assert decontaminate.contaminated(odd_docs, none).count() == 0
    assert decontaminate.remove_contaminated(odd_docs, none).count() == odd_docs.count()
