"""SimHash near-duplicates, linked through the anchor points of a covering code.

A fingerprint of ``BITS`` bits is cut into segments.  Two fingerprints that
differ in at most ``max_bits`` bits differ in at most
``max_bits // len(segments)`` bits in one segment at least.  In each segment
the anchors are the code words of a product of perfect codes (Golay 23,
Hamming 7, single bits), whose covering radius is the sum of the parts'.  A
fingerprint has one home anchor (within the covering radius) and is copied to
every anchor within radius plus threshold, so both members of a linked pair
meet at a home anchor of either.  Anchors are compared with bit counts in
blocks, and each block gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalake.llm.common import connected_components, without_rows
from quotalake.session import cut_lineage

BITS = 64
HASH_SEED = 42
# Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY_POLY = 0b101011100011
# Fixed value: generator polynomial of the Hamming code of length 7.
HAMMING_POLY = 0b1011
# (length, generator polynomial, covering radius) of the parts of each segment.
GOLAY, HAMMING, BIT = (23, GOLAY_POLY, 3), (7, HAMMING_POLY, 1), (1, 0b1, 0)
SEGMENTS = ((GOLAY, HAMMING, BIT, BIT), (GOLAY, HAMMING, BIT, BIT))
# Homes of one anchor compared in one task, and pairs compared at once.
HOME_BLOCK = 65_536
PAIR_BLOCK = 4_000_000
SHINGLE_BLOCK = 65_536


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - shingle + 1)
    sizes = list(map(len, parts))
    starts = list(accumulate(sizes[:n - 1], lambda at, size: at + size + 1, initial=0))
    first_end = sum(sizes[:shingle]) + min(shingle, len(parts)) - 1
    ends = list(accumulate(sizes[shingle:], lambda at, size: at + size + 1, initial=first_end))
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, SHINGLE_BLOCK):
        h = np.array([digest(joined[a:b], HASH_SEED)
                      for a, b in zip(starts[k:k + SHINGLE_BLOCK], ends[k:k + SHINGLE_BLOCK])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, fp long) per row of ``docs(doc_id, row, text)``; every word of every text counts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "row", "fp"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {id_type}, row long, fp long")


def _remainders(values: np.ndarray, length: int, poly: int) -> np.ndarray:
    """Remainders of bit polynomials of ``length`` bits modulo ``poly`` (the syndromes)."""
    out, degree = values.copy(), poly.bit_length() - 1
    for top in range(length - 1, degree - 1, -1):
        out ^= ((out >> top) & 1) * (poly << (top - degree))
    return out


@lru_cache(maxsize=4)
def _patterns(parts: tuple, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error patterns sorted by syndrome, home first; start and end of each syndrome's run).

    ``x ^ pattern`` for the patterns of x's syndrome are the anchors whose
    distance beyond the covering radius, summed over the parts, is at most
    ``threshold``; exactly one of them is the home.
    """
    error, syndrome, excess = (np.zeros(1, dtype=np.int64) for _ in range(3))
    at = s_at = 0
    for length, poly, radius in parts:
        e = np.arange(1 << length, dtype=np.int64)
        beyond = np.maximum(0, np.bitwise_count(e).astype(np.int64) - radius)
        e, beyond = e[beyond <= threshold], beyond[beyond <= threshold]
        s = _remainders(e, length, poly)
        pieces = []
        for i, left in ((np.nonzero(excess == x)[0], threshold - x) for x in range(threshold + 1)):
            j = np.nonzero(beyond <= left)[0]
            pieces.append((np.repeat(i, len(j)), np.tile(j, len(i))))
        i, j = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
        error, syndrome = error[i] | (e[j] << at), syndrome[i] | (s[j] << s_at)
        excess = excess[i] + beyond[j]
        at, s_at = at + length, s_at + poly.bit_length() - 1
    order = np.lexsort((excess, syndrome))
    error, syndrome = error[order], syndrome[order]
    edges = np.searchsorted(syndrome, np.arange((1 << s_at) + 1))
    return error, edges[:-1], edges[1:]


def _anchors(fps: np.ndarray, segments: tuple, max_bits: int, homes_only: bool) -> Iterator[tuple]:
    """For each segment: (segment, row number, anchor, is home) of the anchors of ``fps``."""
    shift = 0
    for number, parts in enumerate(segments):
        width = sum(p[0] for p in parts)
        errors, start, end = _patterns(parts, max_bits // len(segments))
        value = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome, at, s_at = np.zeros_like(value), 0, 0
        for length, poly, _ in parts:
            syndrome |= _remainders((value >> at) & ((1 << length) - 1), length, poly) << s_at
            at, s_at = at + length, s_at + poly.bit_length() - 1
        first = start[syndrome]
        count = np.ones_like(first) if homes_only else end[syndrome] - first
        row = np.repeat(np.arange(len(fps)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield number, row, value[row] ^ errors[first[row] + step], step == 0
        shift += width


def _replicas(fps: DataFrame, segments: tuple, max_bits: int, homes_only: bool) -> DataFrame:
    """(anchor long with the segment in its upper bits, fp, home) per anchor of each fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, row, anchor, home in _anchors(fp, segments, max_bits, homes_only):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor | (number << 56)), pa.array(fp[row].view(np.int64)), pa.array(home)],
                    ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) that connect exactly what the links (a, b) connect."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[:len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int, met: int = 0) -> Iterator[tuple]:
    """Forests of the links within runs of equal ``key``; pairs are enumerated in bounded blocks.

    The first ``met`` rows are homes of the first key that have met each other.
    """
    cut = np.flatnonzero(np.diff(key)) + 1
    begin = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([begin, [len(key)]]))
    group = np.repeat(np.arange(len(begin)), size)
    rows = np.flatnonzero(home & (size[group] > 1))
    begin[0], size[0] = met, size[0] - met
    work = np.cumsum(size[group[rows]])
    at = 0
    while at < len(rows):
        upto = max(at + 1, np.searchsorted(work, (work[at - 1] if at else 0) + PAIR_BLOCK, side="right"))
        mine = rows[at:upto]
        n = size[group[mine]]
        left = np.repeat(mine, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[group[mine]], n)
        x, y = fp[left], fp[right]
        hit = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
        if hit.any():
            yield _forest(x[hit], y[hit])
        at = upto


def _link_batches(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[tuple]:
    """Forests of the links in ``batches(anchor, tile, fp, home)``, sorted by anchor and tile, homes first.

    Of the rows seen, only the homes of the last anchor and tile are held.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, tile, fp, home = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        now = [anchor * 1_000_003 + tile, fp.view(np.uint64), home]
        # Homes of a key that the batch does not go on with have met all its rows.
        met = len(held[0]) if held is not None and len(held[0]) and held[0][0] == now[0][0] else 0
        if met:
            now = [np.concatenate(p) for p in zip(held, now)]
        yield from _links(*now, max_bits, met)
        open_homes = (now[0] == now[0][-1]) & now[2]
        held = [x[open_homes] for x in now]


def link_forest(fps: DataFrame, max_bits: int, segments: tuple = SEGMENTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within ``max_bits`` bits.

    Fingerprints at an anchor with more than ``HOME_BLOCK`` homes are dealt
    over tiles (each tile has a share of the homes and all copies).  A task
    holds a tile's homes and one batch of its copies at a time, so none holds
    an unbounded anchor.  The list of such anchors has at most
    ``len(segments) / HOME_BLOCK`` rows per fingerprint and is broadcast.
    """
    spark = fps.sparkSession
    heavy = (_replicas(fps, segments, max_bits, True).groupBy("anchor").agg(F.count("*").alias("homes"))
             .where(F.col("homes") > HOME_BLOCK)
             .select("anchor", F.expr(f"cast(ceil(homes / {HOME_BLOCK}) as int)").alias("tiles")))
    copies = _replicas(fps, segments, max_bits, False).join(F.broadcast(heavy), "anchor", "left")
    own = F.expr("pmod(xxhash64(fp), coalesce(tiles, 1))").cast("int")
    tiled = (copies.withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
             .select("anchor", F.col("at").alias("tile"), "fp", (F.col("home") & (own == F.col("at"))).alias("home")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _link_batches(batches, max_bits):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return (tiled.repartition(parts, "anchor", "tile").sortWithinPartitions("anchor", "tile", F.desc("home"))
            .mapInArrow(run, "a long, b long"))


def fingerprint_components(docs: DataFrame, shingle: int, max_bits: int, segments: tuple) -> DataFrame:
    """(doc_id, row, fp, component_id) per row; ``row`` is a hash of the text."""
    if sum(p[0] for parts in segments for p in parts) > BITS:
        raise ValueError("segments are longer than the fingerprint")
    marked = cut_lineage(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), shingle))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    roots = connected_components(link_forest(distinct, max_bits, segments))
    rooted = cut_lineage(distinct.join(roots, distinct.fp == roots.node, "left")
                         .select("fp", "least_doc", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    of_fp = rooted.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(of_fp, marked.fp == of_fp.of_fp).select("doc_id", "row", "fp", "component_id")


def simhash_near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 3,
                            segments: tuple = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs(doc_id, text)``.

    Null, empty and blank texts have fingerprint zero, which links like any
    other.  Repeated rows each give a row.  Rows with a null doc_id give a
    row too; ``component_id`` is the smallest doc_id that is not null (null
    if there is none).  Other columns are ignored; an empty table gives an
    empty result.
    """
    return fingerprint_components(docs, shingle, max_bits, segments).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, max_bits: int = 3, segments: tuple = SEGMENTS) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of their near-duplicate group.

    Rows with a null doc_id stay only in groups without any other doc_id.
    """
    found = fingerprint_components(docs, shingle, max_bits, segments)
    return without_rows(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
                        .selectExpr("doc_id as of", "row as of_row"))
