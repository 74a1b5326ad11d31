import random
import re

import numpy as np

from quotalake.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and slow_luhn(digits) or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_by_definition():
    rng = random.Random(4)
    texts = ["a@b.c_d@e.f", "x@@y.z", "@a.b", "a@b", "a.@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2.3.0004", "4111 1111 1111 1111 9",
             "+1 (555) 123-4567", "+1" + " " * 50, "a@b.c@d.e", "", "\U0001f600 me@x.org 4111111111111111"]
    texts += ["".join(rng.choice("a1.@+- (2_é3%") for _ in range(rng.randrange(60))) for _ in range(6000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "+1" + " " * 200_000):
        pii.base_spans(t)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(1, 100, (3, 7)), np.array([[0, 1, 2, 2, 0, 0, 3], [0] * 7, [5, 6, 0, 7, 8, 8, 0]])
    model = pii.train(np.ones((1, 7), np.uint8), np.ones((1, 7), np.uint8), steps=1)
    weights = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grads = pii.Tagger(weights).gradients(codes, tags)
    for name, w in weights.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name == "emb":
                at = (int(codes[0, 1]), at[1])
            losses = []
            for step in (1e-3, -1e-3):
                moved = {**weights, name: w.copy()}
                moved[name][at] += step
                losses.append(pii.Tagger(moved).gradients(codes, tags)[0])
            assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 1e-3, name


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    model = pii.train(np.ones((1, 7), np.uint8), np.ones((1, 7), np.uint8), steps=1)
    codes = rng.integers(1, 100, (1, 3))
    best = min(((a, b, c) for a in range(9) for b in range(9) for c in range(9)),
               key=lambda t: model.gradients(codes, np.array([t]))[0])
    assert tuple(model.decode(codes)[0]) == best


def synthetic(rng, n):
    texts = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(40)]
        words[5] = rng.choice(["me.you@host.org", "10.20.30.40", "4111 1111 1111 1111", "+49 30 1234567", "12", "1999"])
        words[25] = rng.choice(["a_b@mail.example.com", "1.2.3.4", "5500-0000-0000-0004", "+1 (555) 010-9999", "7 of 9"])
        texts.append(" ".join(words))
    return texts


def test_model_finds_what_patterns_miss(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(synthetic(rng, 300))], "doc_id long, text string")
    model = pii.train(*pii.training_windows(docs))
    held = synthetic(rng, 80)
    found = pii.model_spans(model, held)
    labelled = [(k, s) for k, t in enumerate(held) for s in pii.base_spans(t)]
    assert np.mean([s in found[k] for k, s in labelled]) > 0.9
    written = [pii.rewritten(t, pii.base_spans(t)) for t in held]
    hits = [any(a < e and s < b and kind == k2 for a, k2, b in got)
            for (_, spans), got in zip(written, pii.model_spans(model, [t for t, _ in written])) for s, kind, e in spans]
    assert np.mean(hits) > 0.7
    plain = [" ".join(w for w in t.split() if w.isalpha()) + " 1999 page 12 of 345" for t in held]
    assert sum(map(len, pii.model_spans(model, plain))) <= 2


def test_spans_over_window_borders(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(synthetic(random.Random(3), 200))], "doc_id long, text string")
    model = pii.train(*pii.training_windows(docs))
    text = "bad cabbage " * 7 + "me.you@host.mail.example.com" + " deaf egg" * 30
    assert pii.base_spans(text)[0] in pii.model_spans(model, [text])[0]


class EveryAddress:
    """Stands in for a model: tags the rewritten address wherever a window holds a part of it."""

    def __init__(self, own):
        self.own = own

    def decode(self, windows):
        tags = np.zeros(windows.shape, np.uint8)
        codes = pii.codes_of(self.own)
        for row, window in zip(tags, windows):
            for at in range(1 - len(codes), pii.SIZE):
                low, high = max(0, at), min(pii.SIZE, at + len(codes))
                # Long enough a part to tell it, at the window's border or whole.
                if high - low >= 9 and (window[low:high] == codes[low - at:high - at]).all():
                    row[low:high] = 2
                    if at >= 0:
                        row[at] = 1
                    break
        return tags


def test_long_spans_are_whole_at_every_place():
    for own in ("press.office @ communications.faculty.example-university.org", "a.long.name.of.an.office @ x.example.org",
                "me @ " + "very-long-name." * 20 + "org", "first.name." * 25 + "x @ example.org"):
        for before in range(0, 150):
            text = "z" * before + " " + own + " " + "plain words " * 12
            assert pii.model_spans(EveryAddress(own), [text, "nothing", text]) == [[(before + 1, 0, before + 1 + len(own))], [], [(before + 1, 0, before + 1 + len(own))]]


def all_windows(model, text):
    """Spans from all windows of a text."""
    codes, last = pii.codes_of(text), max(0, -(-(len(text) - pii.SIZE) // pii.STRIDE))
    tags = np.zeros(len(text), np.uint8)
    for w, own in enumerate(model.decode(np.array([pii._window(codes, w * pii.STRIDE) for w in range(last + 1)]))):
        low = w * pii.STRIDE + 24 if w else 0
        high = len(text) if w == last else w * pii.STRIDE + 72
        tags[low:high] = own[low - w * pii.STRIDE:high - w * pii.STRIDE]
    at = np.flatnonzero(tags)
    found = []
    for start, kind, end in pii._runs(tags[at], at):
        own = text[start:end]
        start, end = start + len(own) - len(own.lstrip()), start + len(own.rstrip())
        if pii._plausible(kind, text[start:end]):
            found.append((start, kind, end))
    return found


def test_spans_are_those_of_all_windows(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(synthetic(rng, 200))], "doc_id long, text string")
    model = pii.train(*pii.training_windows(docs))
    texts = [pii.rewritten(t, pii.base_spans(t))[0] for t in synthetic(rng, 40)]
    texts += ["deaf egg " * rng.randrange(40) + "press.office @ communications.faculty.example-university.org " + "bad cab " * 20
              for _ in range(30)] + ["1", "@", "x" * 96 + "1", "1" + "x" * 95, "x" * 97 + "@"]
    assert pii.model_spans(model, texts) == [all_windows(model, t) for t in texts]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    model = pii.train(*pii.training_windows(odd_docs))
    rows = pii.find_personal_data(odd_docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _, _ in odd_rows)
    assert all(not [s for s in r.spans if s.base] for r in rows)
    assert pii.find_personal_data(no_docs, None).count() == 0
    assert pii.train(*pii.training_windows(no_docs)) is None
