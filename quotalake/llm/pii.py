"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions on top.

The model is trained in numpy on windows of characters whose spans the
patterns label, some rewritten to forms that the patterns miss.  Texts are
read in overlapping windows; each character takes its tag from the window in
whose middle it lies, so spans across window borders come out whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SIZE, STRIDE = 96, 48
# At most so many windows with and without a span train the model, from about so many texts.
WINDOWS, TEXTS = 1_500, 3_000
EMBED, HIDDEN, STEPS, BATCH, RATE, SEED = 10, 16, 320, 64, 0.02, 5
DECODE = 512
CODES = 130  # padding, ASCII, anything else
N_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does, as a run is always taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each ``@`` in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, sorted; failing matches are dropped."""
    out = [(a, 0, b) for a, b in _email_spans(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text)
                if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# What a span that only the model found must look like as a whole.
_LOOSE = tuple(map(re.compile, (
    r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+", r"[0-9]+(?: ?\. ?[0-9]+){3}",
    r"[0-9](?:[ .-]?[0-9])+", r"\+?[0-9(][0-9 ().-]+[0-9]")))


def _plausible(kind: int, text: str) -> bool:
    """Check of a span that only the model found."""
    if not _LOOSE[kind].fullmatch(text):
        return False
    digits = _digits(text)
    if kind == 1:
        return all(map(_small, re.findall("[0-9]+", text)))
    return kind == 0 or (12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15)


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, points + 1, CODES - 1).astype(np.uint8)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of n characters; where spans of two kinds overlap, the later begins after the earlier."""
    tags, free = np.zeros(n, dtype=np.uint8), 0
    for start, kind, end in spans:
        if start >= free:
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
            free = end
    return tags


def _window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or ``@``, for training."""
    hits = np.flatnonzero(((codes >= 49) & (codes <= 58)) | (codes == 65))
    if not len(hits):
        return hits
    last = max(0, -(-(len(codes) - SIZE) // STRIDE))
    low, high = np.maximum(0, (hits - SIZE) // STRIDE + 1), np.minimum(hits // STRIDE, last)
    return np.unique(np.concatenate([np.minimum(low, high), high])) * STRIDE


def _owners(n: int, at: np.ndarray) -> np.ndarray:
    """Numbers of the windows in whose middle the characters ``at`` of a text of n lie; the outer ones own the ends."""
    return np.clip((at - (SIZE - STRIDE) // 2) // STRIDE, 0, max(0, -(-(n - SIZE) // STRIDE)))


def _window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(SIZE, dtype=np.uint8)
    some = codes[start:start + SIZE]
    out[:len(some)] = some
    return out


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """Text whose spans are written in forms that the patterns miss, with the moved spans."""
    out, moved, done = [], [], 0
    for start, kind, end in spans:
        if start < done:
            continue
        own = text[start:end]
        own = {0: own.replace("@", " @ "), 1: own.replace(".", " . "),
               2: own.replace(" ", ".").replace("-", "."), 3: "00" + own[1:]}[kind]
        out += [text[done:start], own]
        begin = sum(map(len, out)) - len(own)
        moved.append((begin, kind, begin + len(own)))
        done = end
    return "".join([*out, text[done:]]), moved


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags) of a bounded sample of labelled windows, the same at every run."""
    digits = docs.where(F.col("text").rlike("[0-9@]"))
    total = max(1, digits.count())
    share = int(min(1.0, TEXTS / total) * 1_000_000) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for t, s in ([(text, spans), rewritten(text, spans)] if spans else [(text, spans)]):
                    codes, tags = codes_of(t), tags_of(len(t), s)
                    rows += [(_window(codes, k).tobytes(), _window(tags, k).tobytes()) for k in _window_starts(codes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["codes", "tags"])

    some = (digits.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).select("text")
            .mapInArrow(run, "codes binary, tags binary").distinct())
    hollow = F.col("tags") == F.lit(bytes(SIZE))
    order = [F.xxhash64("codes"), F.col("codes"), F.col("tags")]
    rows = [r for keep in (hollow, ~hollow) for r in some.where(keep).orderBy(*order).limit(WINDOWS).collect()]
    return tuple(np.array([np.frombuffer(r[k], dtype=np.uint8) for r in rows]).reshape(-1, SIZE) for k in (0, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(gates: np.ndarray, wh: np.ndarray) -> tuple:
    """gates (T, N, 4H): what the inputs give.  Returns the states and what the way back needs."""
    steps, n, width = gates.shape
    h = width // 4
    hs, cs = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32)
    acts = np.empty_like(gates)
    for t in range(steps):
        z = gates[t] + hs[t] @ wh
        a = acts[t]
        a[:, :3 * h], a[:, 3 * h:] = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
        cs[t + 1] = a[:, h:2 * h] * cs[t] + a[:, :h] * a[:, 3 * h:]
        hs[t + 1] = a[:, 2 * h:3 * h] * np.tanh(cs[t + 1])
    return hs, cs, acts


def _lstm_back(dh_out: np.ndarray, wh: np.ndarray, hs: np.ndarray, cs: np.ndarray, acts: np.ndarray) -> tuple:
    steps, n, h = dh_out.shape
    dgates, dwh = np.empty_like(acts), np.zeros_like(wh)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (acts[t][:, k * h:(k + 1) * h] for k in range(4))
        dh = dh + dh_out[t]
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz = dgates[t]
        dz[:, :h], dz[:, h:2 * h] = dc * g * i * (1 - i), dc * cs[t] * f * (1 - f)
        dz[:, 2 * h:3 * h], dz[:, 3 * h:] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
        dwh += hs[t].T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dgates, dwh


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass(frozen=True)
class Tagger:
    """Weights by name: emb, and wx, wh, b of the forward (f) and backward (r) pass, wo, bo, trans, first."""

    w: dict

    def emissions(self, codes: np.ndarray) -> tuple:
        """(T, N, tags) scores of windows (N, T), and the states of both passes."""
        w, kept = self.w, []
        for d in "fr":
            table = w["emb"] @ w["wx" + d] + w["b" + d]
            own = codes.T if d == "f" else codes.T[::-1]
            kept.append((own, *_lstm(table[own], w["wh" + d])))
        states = np.concatenate([kept[0][1][1:], kept[1][1][1:][::-1]], axis=2)
        return states @ w["wo"] + w["bo"], states, kept

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags (N, T) of windows (N, T)."""
        scores = self.emissions(codes)[0]
        steps, n, _ = scores.shape
        best, back = self.w["first"] + scores[0], np.empty(scores.shape, dtype=np.uint8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.w["trans"]
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        tags = np.empty((n, steps), dtype=np.uint8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradients."""
        w = self.w
        scores, states, kept = self.emissions(codes)
        steps, n, k = scores.shape
        trans, gold, rows = w["trans"], tags.T.astype(np.int64), np.arange(n)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = w["first"] + scores[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _logsum(alpha[-1], 1)
        d_scores = np.exp(alpha + beta - log_z[None, :, None])
        loss = log_z - w["first"][gold[0]]
        d_trans = np.zeros_like(trans)
        for t in range(steps):
            loss = loss - scores[t][rows, gold[t]]
            d_scores[t][rows, gold[t]] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t] - log_z[:, None])[:, None, :])
                d_trans += pair.sum(axis=0)
                np.subtract.at(d_trans, (gold[t - 1], gold[t]), 1)
                loss = loss - trans[gold[t - 1], gold[t]]
        d_scores /= n
        grads = {"trans": d_trans / n, "first": d_scores[0].sum(0), "bo": d_scores.sum((0, 1)),
                 "wo": states.reshape(-1, states.shape[2]).T @ d_scores.reshape(-1, k), "emb": np.zeros_like(w["emb"])}
        d_states = d_scores @ w["wo"].T
        h = d_states.shape[2] // 2
        for d, part, (own, hs, cs, acts) in zip("fr", (d_states[:, :, :h], d_states[::-1, :, h:]), kept):
            dg, grads["wh" + d] = _lstm_back(part, w["wh" + d], hs, cs, acts)
            d_table = np.zeros((CODES, dg.shape[2]), np.float32)
            np.add.at(d_table, own.ravel(), dg.reshape(-1, dg.shape[2]))
            grads["wx" + d], grads["b" + d] = w["emb"].T @ d_table, d_table.sum(0)
            grads["emb"] += d_table @ w["wx" + d].T
        return float(loss.mean()), grads


def train(codes: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> Tagger | None:
    """Adam on the CRF likelihood; None without a labelled span."""
    if not tags.any():
        return None
    rng = np.random.default_rng(SEED)
    shapes = {"emb": (CODES, EMBED), "wo": (2 * HIDDEN, N_TAGS), "bo": (N_TAGS,), "trans": (N_TAGS, N_TAGS), "first": (N_TAGS,)}
    shapes |= {k + d: s for d in "fr" for k, s in (("wx", (EMBED, 4 * HIDDEN)), ("wh", (HIDDEN, 4 * HIDDEN)), ("b", (4 * HIDDEN,)))}
    w = {k: (rng.normal(0, s[0] ** -0.5 if len(s) > 1 else 0.01, s)).astype(np.float32) for k, s in shapes.items()}
    for d in "fr":
        w["b" + d][HIDDEN:2 * HIDDEN] += 1  # remember at first
    mean, var, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    while step < steps:
        order = rng.permutation(len(codes))
        for part in np.array_split(order, max(1, len(order) // BATCH))[:steps - step]:
            _, grads = Tagger(w).gradients(codes[part], tags[part])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                mean[k], var[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * var[k] + 0.001 * g * g
                w[k] = (w[k] - RATE * 0.1 ** (step / steps) * (mean[k] / (1 - 0.9 ** step))
                        / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Tagger(w)


def _runs(tags: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of runs of one kind among the tagged characters at positions ``at``."""
    start = None
    for p, t in zip([*at.tolist(), -1], [*tags.tolist(), 0]):
        if start is not None and (t == 0 or p != last + 1 or t % 2 == 1 or (t - 1) // 2 != kind):
            yield start, kind, last + 1
            start = None
        if t and start is None:
            start, kind = p, (t - 1) // 2
        last = p


def model_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the model finds in each whole text.

    Decodes the windows that own a digit or ``@``, without which no span is
    plausible, and from there on the next ones while a tagged character lies
    at the border of what is decoded: the same spans as from all windows.
    """
    out: list[list] = [[] for _ in texts]
    codes: dict[int, np.ndarray] = {}
    queue: list[tuple[int, int]] = []

    def decoded(wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, window number, first character owned, tags of the characters owned)."""
        for k in range(0, len(wanted), DECODE):
            part = wanted[k:k + DECODE]
            for (d, w), tags in zip(part, model.decode(np.array([_window(codes[d], w * STRIDE) for d, w in part]))):
                n, s, edge = len(codes[d]), w * STRIDE, (SIZE - STRIDE) // 2
                low, high = s + edge if w else 0, n if s + SIZE >= n else s + edge + STRIDE
                yield d, w, low, tags[low - s:high - s]

    def flush() -> None:
        held: dict[int, dict[int, tuple[int, np.ndarray]]] = {d: {} for d in codes}
        wanted = queue
        while wanted:
            more = set()
            for d, w, low, tags in decoded(wanted):
                held[d][w] = low, tags
                if tags[0] and low:
                    more.add((d, w - 1))
                if tags[-1] and low + len(tags) < len(codes[d]):
                    more.add((d, w + 1))
            wanted = sorted((d, w) for d, w in more if w not in held[d])
        for d, parts in held.items():
            at = np.concatenate([np.arange(low, low + len(tags)) for _, (low, tags) in sorted(parts.items())])
            own = np.concatenate([tags for _, (_, tags) in sorted(parts.items())])
            for start, kind, end in _runs(own[own > 0], at[own > 0]):
                text = texts[d][start:end]
                start, end = start + len(text) - len(text.lstrip()), end - (len(text) - len(text.rstrip()))
                if _plausible(kind, texts[d][start:end]):
                    out[d].append((start, kind, end))
        codes.clear(), queue.clear()

    for d, text in enumerate(texts):
        if _TRIGGER.search(text):
            codes[d] = codes_of(text)
            hits = np.flatnonzero(((codes[d] >= 49) & (codes[d] <= 58)) | (codes[d] == 65))
            queue += [(d, w) for w in np.unique(_owners(len(text), hits)).tolist()]
        if len(queue) >= 16 * DECODE:
            flush()
    flush()
    return out


def find_personal_data(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id and spans (kind, start, end, base), sorted, for every row of ``docs(doc_id, text)``.

    Places are code points, ends exclusive.  ``base`` spans are the patterns'
    matches; the others the model added where no base span lies.  Null and
    empty texts have none; repeated rows and null doc_ids each give a row;
    other columns are ignored; without a model only base spans are found.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, more in zip(texts, model_spans(model, texts) if model else [()] * len(texts)):
                base = base_spans(text)
                found = [(s, k, e, True) for s, k, e in base]
                found += [(s, k, e, False) for s, k, e in more if not any(a < e and s < b for a, _, b in base)]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
