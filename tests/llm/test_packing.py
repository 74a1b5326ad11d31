import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotalake.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_tokenizers(reference, odd_rows):
    rng = random.Random(5)
    texts = [t for _, t, _ in odd_rows] + ["<|endoftext|> I'm  here\t\n\n  ", "中文 🙂 é \x00 \x85 ", "1234567 .,;  x" * 9]
    texts += ["".join(rng.choice("aZ é\n\t'.1中🙂") for _ in range(200)) for _ in range(50)]
    encode = packing.encoder(public_tokenizers.path(packing.RANKS))
    for t in texts:
        assert [*encode.encode_ordinary(t or ""), 1] == reference(t)


def test_added_tokens_inside_texts_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}\n x", f"a{end}b  {end}  ", "<|endoftext|", f"<|{end}|>", "no such string"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source")
    found = defaultdict(list)
    for p in sorted(packing.pack(docs).collect(), key=lambda p: p.start):
        found[p.doc_id] += np.frombuffer(p.ids, "<u2").tolist()
    assert [found[k] for k in range(len(texts))] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_every_token_once_in_full_sequences(odd_docs, odd_rows, reference, no_docs):
    pieces = packing.pack(odd_docs, window=256, grain=32).collect()
    expected = Counter((d, tuple(reference(t))) for d, t, _ in odd_rows)
    streams, whole = defaultdict(dict), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == p.length and p.offset + p.length <= 256 and p.start + p.length <= p.doc_tokens
        for k, i in enumerate(ids.tolist()):
            place = p.sequence_id * 256 + p.offset + k
            assert place not in streams
            streams[place] = i
        whole[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
    assert sorted(streams) == list(range(len(streams)))
    total = Counter()
    for d, parts in whole.items():
        own = Counter(i for _, ids, _ in parts for i in ids)
        for (e, ids), n in expected.items():
            if e == d:
                own.subtract({i: c * n for i, c in Counter(ids).items()})
        assert not +own and not -own
        total[d] += 1
    assert len(streams) == sum(len(ids) * n for (_, ids), n in expected.items())
    assert packing.pack(no_docs).count() == 0


def served(totals, weights, grain):
    """Sources in the order in which a simulation by exact times serves grains."""
    from fractions import Fraction
    order = sorted((Fraction(2 * k + 1, int(w)), s, k) for s, (n, w) in enumerate(zip(totals, weights)) for k in range(-(-n // grain)))
    return [(s, k) for _, s, k in order]


def test_places_are_the_simulated_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        totals = rng.integers(1, 4000, rng.integers(1, 7))
        weights = rng.integers(1, 50, len(totals))
        order, at = served(totals, weights, 64), 0
        places = packing.grain_places(np.array([s for s, _ in order]), np.array([k for _, k in order]), totals, weights, 64)
        for (s, k), place in zip(order, places):
            assert place == at
            at += min(64, totals[s] - 64 * k)


def test_mixture_follows_the_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(300)), "ab"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    source = dict((d, s) for d, _, s in rows)
    shares = defaultdict(Counter)
    for p in packing.pack(docs, {"a": 3, "b": 1}, window=512, grain=64).collect():
        shares[p.sequence_id][source[p.doc_id]] += p.length
    mixed = [c for k, c in sorted(shares.items()) if c["a"] and c["b"]]
    assert len(mixed) > 40 and all(abs(c["a"] - 384) <= 64 for c in mixed[:-1])
    with pytest.raises(ValueError):
        packing.pack(docs, {"a": -1})


def test_deficits_stay_bounded_until_queues_run_dry():
    """Round-robin with credit: each grain served earns every source its share; the balance stays within the stated bound."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = int(rng.integers(2, 8))
        weights = rng.integers(1, 60, n)
        totals = weights * 64 * int(rng.integers(20, 60)) + rng.integers(0, 640, n)
        grains = [(s, k) for s in range(n) for k in range(int(-(-totals[s] // 64)))]
        places = packing.grain_places(np.array([s for s, _ in grains]), np.array([k for _, k in grains]), totals, weights, 64)
        assert len(set(places.tolist())) == len(grains)
        credit, left, share = np.zeros(n), -(-totals // 64), weights / weights.sum()
        for (s, k), _ in sorted(zip(grains, places.tolist()), key=lambda x: x[1]):
            credit += share
            credit[s] -= 1
            left[s] -= 1
            if (left == 0).any():
                break
            assert (np.abs(credit) <= 0.5 + share * n / 2 + 1e-9).all()


def test_digest_is_of_the_tokenizers_ids_in_order(spark):
    """Default settings of the tokenizer, whole documents, pieces in order: start, length, doc_tokens and CRC-32."""
    import struct
    import zlib

    from quotalake.llm.queries import op4_packing

    sf = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    parts = defaultdict(list)
    for p in op4_packing(spark, sf).collect():
        parts[p.doc_id].append(p)
    assert set(parts) == set(docs)
    for d, text in docs.items():
        ids, at = [*plain.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(parts[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            some = ids[at:at + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(some)}I", *some))
            at += p.length
        assert at == len(ids)
