import random

import numpy as np
import pyarrow as pa
import xxhash

from quotalake.llm import common, simhash


def slow_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_fingerprints_by_definition(odd_rows):
    for _, text, _ in odd_rows:
        assert simhash.fingerprint(text, 4) == slow_fingerprint(text, 4)


def test_every_pair_meets(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(300)]
    values = set(base)
    for b in base[:150]:
        for bits in range(1, 7):
            flips = rng.sample(range(64), bits)
            values.add(b ^ sum(1 << f for f in flips))
    values = sorted(values)
    array = np.array(values, dtype=np.uint64)
    links = [(i, j) for i in range(len(values)) for j in (np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4)).tolist() if i < j]
    frame = spark.createDataFrame([(int(v),) for v in array.view(np.int64)], "fp long")
    for segments in (simhash.SEGMENTS, ((simhash.GOLAY,), (simhash.GOLAY,), (simhash.HAMMING, simhash.HAMMING, *[simhash.BIT] * 4))):
        edges = simhash.link_forest(frame, 4, segments).collect()
        at = {int(v): k for k, v in enumerate(array.view(np.int64))}
        got = components([(at[e.a], at[e.b]) for e in edges], range(len(values)))
        assert got == components(links, range(len(values)))
        assert len(edges) < 6 * len(values)


def test_copies_of_an_anchor_are_not_held(monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for anchor, tile, homes, copies in ((1, 0, 3, 0), (2, 0, 40, 5000), (2, 1, 25, 5000), (3, 0, 0, 700), (4, 0, 1, 1), (5, 0, 90, 10)):
        fps = rng.choice(1 << 13, homes + copies, replace=False)
        rows += [(anchor, tile, int(f), k < homes) for k, f in enumerate(fps)]
    expected = {frozenset((a[2], b[2])) for a in rows if a[3] for b in rows
                if a[:2] == b[:2] and 0 < (a[2] ^ b[2]).bit_count() <= 2}
    # All links instead of a forest, and the rows that are looked at together.
    monkeypatch.setattr(simhash, "_forest", lambda x, y: (x, y))
    links, sizes = simhash._links, []
    monkeypatch.setattr(simhash, "_links", lambda key, *rest: (sizes.append(len(key)), links(key, *rest))[1])
    for size in (1, 7, 64, 100):
        sizes.clear()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
        table = pa.Table.from_arrays(columns, ["anchor", "tile", "fp", "home"])
        got = [frozenset(map(int, p)) for a, b in simhash._link_batches(iter(table.to_batches(size)), 2) for p in zip(a, b)]
        assert set(got) == expected and max(sizes) <= 90 + size


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 199)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 150)}, 199: 199, 200: 199}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = simhash.simhash_near_duplicates(odd_docs, 4, 4).collect()
    prints = [simhash.fingerprint(t, 4) for _, t, _ in odd_rows]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = components(links, range(len(prints)))
    least = {}
    for k, (d, _, _) in enumerate(odd_rows):
        if d is not None:
            least[root[k]] = min(d, least.get(root[k], d))
    expected = sorted((str(d), f"{prints[k]:016x}", least.get(root[k])) for k, (d, _, _) in enumerate(odd_rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == expected
    assert simhash.simhash_near_duplicates(no_docs, 4, 4).count() == 0


def test_one_of_each_group_stays(odd_docs):
    kept = simhash.keep_one(odd_docs, 4, 4)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 20 not in ids and 25 not in ids and 24 in ids and 30 in ids and 31 not in ids
