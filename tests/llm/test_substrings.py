import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quotalake.llm import substrings


def slow(rows):
    """doc rows -> (n_words, n_removed, kept) by a dictionary of all windows."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - 12):
            if d is not None:
                key = tuple(w[i:i + 13])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i:i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=str)


def check(spark, rows):
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == slow(rows)


def test_odd_rows(spark, odd_rows, odd_docs, no_docs):
    check(spark, [(d, t) for d, t, _ in odd_rows])
    assert substrings.dedup_substrings(no_docs).count() == 0
    assert substrings.dedup_substrings(odd_docs).columns == ["doc_id", "n_words", "n_removed", "kept"]


def test_random_splices(spark, monkeypatch):
    """Few words and many copied stretches of all lengths, also below a window, and periodic texts."""
    rng = random.Random(8)
    rows = [(0, "a b " * 40), (1, "a b " * 7 + "x " + "b a " * 9), (2, "z " * 100), (3, "z " * 12), (4, "z " * 13)]
    for d in range(5, 60):
        own = [rng.choice("abcdefghij") for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            source = rng.choice(rows)[1].split()
            if source:
                at = rng.randrange(len(source))
                cut = rng.randrange(len(own) + 1)
                own[cut:cut] = source[at:at + rng.randrange(8, 40)]
        rows.append((d, " ".join(own)))
    rng.shuffle(rows)
    check(spark, rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for d in range(120):
        own = list(base)
        own[rng.randrange(150)] = f"new{d}"
        rows.append((d, " ".join(own)))
    check(spark, rows)


def test_automata_find_every_occurrence():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(80)] for _ in range(5)] + [[], [b"a"]]
    known = substrings.WordHashes()
    hashes = [known.of(words) for words in texts]
    chosen = {tuple(texts[k][p:p + substrings.PHRASE]) for k in range(5) for p in rng.sample(range(77), 3)}
    codes = np.array([substrings.phrase_codes(known.of(list(c)))[0] for c in chosen])
    for words, got in zip(texts, substrings._locate(codes, hashes), strict=True):
        assert got.tolist() == [p for p in range(len(words) - 3) if tuple(words[p:p + 4]) in chosen]
    assert all(len(got) == 0 for got in substrings._locate(codes[:0], hashes))


def test_places_come_from_the_automata(spark, monkeypatch):
    """Nothing but whole copies is found once the automata find nothing."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"one {passage} two"), (2, f"three {passage} four"), (3, f"one {passage} two"), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def removed():
        return {d: n for d, _, n, _ in substrings.dedup_substrings(docs).collect()}

    assert removed() == {1: 0, 2: 30, 3: 32, 4: 0}
    monkeypatch.setattr(substrings, "_locate", _no_places)
    assert removed() == {1: 0, 2: 0, 3: 32, 4: 0}


def _no_places(phrases, texts):
    return [np.zeros(0, dtype=np.int64) for _ in texts]


def test_key_phrases_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 50, 400).astype(np.uint64)
    order = substrings._mixed(codes)
    at, first, n = substrings.key_phrases(codes)
    assert n.sum() == len(codes) - 9 and (first == np.cumsum(n) - n).all()
    for a, f, m in zip(at, first, n):
        assert all(order[w:w + 10].argmin() + w == a for w in range(f, f + m))


def test_parts_of_a_batch_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(substrings, "PART_ROWS", 4)
    monkeypatch.setattr(substrings, "PART_BYTES", 10)
    texts = ["abc", None, "", "défg", "x" * 50, "y", None, None, None, None, None, "z" * 10, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(13)), pa.array(texts)], ["doc_id", "text"])
    parts = list(substrings._parts(iter([batch.slice(1), batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch.slice(1), batch]))
    for p in parts:
        size = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert 1 <= len(size) <= 4 and (len(size) == 1 or sum(size) <= 10)


class Mapped:
    """Takes the place of a DataFrame and keeps the function that it is mapped with."""

    dtypes = [("doc_id", "bigint")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_batch_of_long_texts_is_not_unpacked_at_once():
    texts = pa.array([" ".join(f"w{(k * 7 + i) % 900}" for i in range(2_500)) for k in range(4)] * 1_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000)), texts], ["doc_id", "text"])
    run = substrings.phrase_lists(Mapped())
    tracemalloc.start()
    first = next(run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first.num_rows and most < batch.nbytes / 3
