"""Mixture-controlled packing of token streams by deficit round-robin.

Each source is a queue of its documents' tokens, cut into grains.  A source
earns credit in proportion to its target share of the tokens; a grain is
served as soon as half of it has been earned.  The balance of a source with
share p of n sources, carried from window to window and from partition to
partition, stays within (1 + p n) / 2 grains until queues run dry; then the
rest share what is left.  The order of
service is a closed form of (source, grain number): grain k of source s with
weight p_s is served at time (2k + 1) / p_s, ties in source order.  So each
task finds the place of its own grains in the packed stream from the sources'
totals alone, in exact integer arithmetic, and the stream is cut into full
windows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotalake.llm.common import stored

WINDOW = 2048
GRAIN = 256
END_ID = 1
# Rows of the table of sources that the driver reads and sends to every task.
MAX_SOURCES = 10_000
WEIGHT_STEPS = 1 << 20
CELLS = 4_000_000
# Ranks of the public vocabulary byte_bpe_50k.json: the same ids, found faster.
RANKS = "byte_bpe_50k.tiktoken"
# Added tokens of byte_bpe_50k.json, which the rank file lacks; they are matched inside texts.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    """Byte-level BPE of a rank file with the added tokens ``SPECIAL``."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_queues(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, queue, part, start, ids) per document: its ids and its place in its partition's part of the queue."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(ranks_path), TaskContext.get().partitionId(), {}
        for batch in batches:
            queues = batch.column(1).to_pylist()
            ids, starts = [], []
            for text, queue in zip(batch.column(2).to_pylist(), queues):
                own = np.append(encode.encode_to_numpy(text or "", allowed_special="all"), END_ID).astype("<u2")
                starts.append(at.get(queue, 0))
                at[queue] = starts[-1] + len(own)
                ids.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "start", "ids"])

    return (docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), "text")
            .mapInArrow(run, f"doc_id {id_type}, queue string, part int, start long, ids binary"))


def mixture_weights(totals: dict[str, int], targets: dict[str, float] | None) -> np.ndarray:
    """Integer weight of each source in name order; the corpus's own token shares without ``targets``."""
    wanted = np.array([float(totals[s] if targets is None else targets.get(s, 0.0)) for s in sorted(totals)])
    if (wanted < 0).any() or not np.isfinite(wanted).all():
        raise ValueError("target proportions must be finite and not negative")
    return np.maximum(1, np.rint(wanted / max(wanted.sum(), 1e-300) * WEIGHT_STEPS)).astype(np.int64)


def grain_places(source: np.ndarray, grain_no: np.ndarray, totals: np.ndarray, weights: np.ndarray,
                 grain: int) -> np.ndarray:
    """Place in the packed stream of the first token of each (source, grain number)."""
    out = np.empty(len(source), dtype=np.int64)
    others = np.arange(len(totals))
    step = max(1, CELLS // len(totals))
    for k in range(0, len(source), step):
        s, n = source[k:k + step, None], grain_no[k:k + step, None]
        # Grain j of t comes before if (2j + 1) / p_t < (2n + 1) / p_s; equal times go by source.
        time = (2 * n + 1) * weights[None, :] - (others[None, :] >= s)
        before = (time // weights[s] + 1) // 2
        before = np.where(others[None, :] == s, n, before)
        out[k:k + step] = np.minimum(before * grain, totals[None, :]).sum(axis=1)
    return out


def cut_pieces(place: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs of the packed stream at window borders: (run number, offset in the run, length)."""
    first, last = place // window, (place + size - 1) // window
    count = last - first + 1
    run = np.repeat(np.arange(len(place)), count)
    which = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(place[run], which * window)
    end = np.minimum(place[run] + size[run], (which + 1) * window)
    return run, begin - place[run], end - begin


def pack(docs: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW,
         grain: int = GRAIN, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of a document in a packed sequence of ``window`` tokens.

    Columns: doc_id, start (ids of the document before the piece), length,
    ids (little-endian unsigned 16-bit), doc_tokens, sequence_id and offset in the
    sequence.  All sequences but the last are full.  Without ``targets`` the
    sources keep the corpus's token shares in every window; sources missing
    from ``targets`` come as late as they can.

    A null or empty text is the end id alone; a null source is a queue of its
    own, shared with the empty name; repeated rows and null doc_ids are
    packed like any other row; other columns are ignored; an empty table
    gives no rows.  Every token lies in exactly one piece.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    queued = stored(token_queues(docs, ranks_path or public_tokenizers.path(RANKS)), compression="zstd")
    parts = (queued.groupBy("queue", "part")
             .agg(F.max(F.col("start") + F.expr("octet_length(ids) div 2")).alias("tokens")))
    parts = stored(parts)
    found = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total_of = {r.queue: r.tokens for r in found}
    names = {s: k for k, s in enumerate(sorted(total_of))}
    totals = np.array([total_of[s] for s in names], dtype=np.int64)
    weights = mixture_weights(total_of, targets) if found else np.zeros(0, dtype=np.int64)
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            source = np.array([names[s] for s in batch.column(1).to_pylist()], dtype=np.int64)
            ids = [np.frombuffer(b, dtype="<u2") for b in batch.column(2).to_pylist()]
            tokens = np.array([len(x) for x in ids], dtype=np.int64)
            at = batch.column(3).to_numpy()
            first = at // grain
            count = (at + tokens - 1) // grain - first + 1
            doc = np.repeat(np.arange(len(ids)), count)
            number = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(at[doc], number * grain)
            size = np.minimum(at[doc] + tokens[doc], (number + 1) * grain) - begin
            place = grain_places(source[doc], number, totals, weights, grain) + begin - number * grain
            piece, inner, length = cut_pieces(place, size, window)
            doc, start, place = doc[piece], (begin - at[doc])[piece] + inner, place[piece] + inner
            # Grains that follow each other in both the document and the sequence are one piece.
            joined = np.zeros(len(doc), dtype=bool)
            joined[1:] = ((doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + length[:-1]) & (place[1:] % window != 0))
            head = np.flatnonzero(~joined)
            length = np.add.reduceat(length, head)
            doc, start, place = doc[head], start[head], place[head]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
                 pa.array([ids[d][a:a + n].tobytes() for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist())],
                          pa.binary()),
                 pa.array(tokens[doc]), pa.array(place // window), pa.array(place % window)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return (queued.join(bases, ["queue", "part"])
            .select("doc_id", "queue", "ids", (F.col("base") + F.col("start")).alias("at"))
            .mapInArrow(run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, "
                             "sequence_id long, offset long"))


def with_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their little-endian 32-bit ids in place of the ids."""
    columns = [c for c in pieces.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(b, dtype="<u2").astype("<u4")) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(crc, pa.int64())],
                                             [*columns, "ids_crc32"])

    kinds = dict(pieces.dtypes)
    return pieces.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", ids_crc32 long")
