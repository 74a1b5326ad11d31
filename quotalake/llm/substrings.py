"""Substring dedup: words covered by windows that an earlier document has too.

A window is ``WINDOW`` consecutive words.  Each window has a key phrase, the
one of its ``PHRASE``-word phrases with the smallest hash; equal windows have
equal key phrases.  Key phrases of two or more documents are confirmed by
counting; only those go on.  Aho-Corasick automata, compiled from the
confirmed phrases of one shard of documents at a time, then read the shard's
texts, and their hits alone say where confirmed phrases lie; the windows of
which such a place is the key phrase form a passage.  Documents in which no
confirmed phrase was counted can have no repeated window and are not read
again.  (With shards by phrase, each document would pass through all of
them, and their number grows with the corpus.)  Equal passages are matched across documents by hash; where
passages around a phrase differ (at the ends of a copied stretch) the
distinct ones are matched window by window.  All counts and matches are
partial aggregations and equi-joins on hashes, so no group of copies meets in
one task, and pairs of documents never appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalake.llm.common import member_split, stored
from quotalake.session import stage_scope

WINDOW = 13
PHRASE = 4
# Phrases compiled into one automaton, and words streamed through it, before the next shard of documents.
SHARD_PHRASES = 100_000
SHARD_WORDS = 400_000
# A word is coded by 16 bits of its hash, a phrase by those of its four words.  Words that share a code
# only add candidates, as windows are compared by a hash of their own.
WORD_BITS = 64 // PHRASE
# In an automaton a word is four letters of four bits, which keeps its nodes narrow.
LETTERS = WORD_BITS // 4
# Fixed odd multiplier of the rolling hash (the golden ratio's 64 bits).
MULTIPLIER = 0x9E3779B97F4A7C15
# Windows are compared by the code of their key phrase and 48 bits of their own.
WINDOW_BYTES = 6
# Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 17
# Rows of a batch, and bytes of their texts, unpacked at a time.
PART_ROWS = 1024
PART_BYTES = 1 << 21
ALL = 2**31 - 1


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into slices of a few rows and, unless a row alone has more, of few bytes in column ``text``."""
    for batch in batches:
        end = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = end[at - 1] if at else 0
            size = int(np.searchsorted(end, before + PART_BYTES, "right")) - at
            size = min(max(1, size), PART_ROWS)
            yield batch.slice(at, size)
            at += size


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MULTIPLIER)
    return x ^ (x >> np.uint64(29))


def window_hashes(one: np.ndarray) -> np.ndarray:
    """Hash of the window that starts at each word."""
    n = max(0, len(one) - WINDOW + 1)
    out, power = np.zeros(n, dtype=np.uint64), 1
    for k in range(WINDOW):
        out += one[k:k + n] * np.uint64(power)
        power = power * (MULTIPLIER + 2) % (1 << 64)
    return _mixed(out)


class WordHashes(dict):
    """Hashes of words, those seen lately from memory."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def phrase_codes(one: np.ndarray) -> np.ndarray:
    """Code of the phrase that starts at each word: its words' codes, the first one lowest."""
    n = max(0, len(one) - PHRASE + 1)
    short = one >> np.uint64(64 - WORD_BITS)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(PHRASE):
        out |= short[k:k + n] << np.uint64(WORD_BITS * k)
    return out


def key_phrases(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the key phrase, first window, number of windows) of the runs of windows with one key phrase.

    The key phrase has the smallest mixed code, the first of equal ones.
    """
    per = WINDOW - PHRASE + 1
    n = len(codes) - per + 1
    if n < 1:
        return (np.zeros(0, dtype=np.int64),) * 3
    order = _mixed(codes)
    least, width = order, 1
    while width < per:   # minimum of twice the width, or of two that overlap
        step = min(width, per - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.zeros(n, dtype=np.int8)
    for k in range(per - 1, -1, -1):
        np.copyto(at, k, where=order[k:k + n] == least)
    at = at + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return at[first], first, np.diff(np.concatenate([first, [n]]))


def phrase_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, phrases): the distinct key phrases of each row of ``docs`` that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _parts(batches, 1):
            found = []
            for text in batch.column(1).to_pylist():
                codes = phrase_codes(known.of(split_words(text)))
                found.append(np.unique(codes[key_phrases(codes)[0]]))
            size = np.array([len(f) for f in found], dtype=np.int64)
            some = np.flatnonzero(size)
            offsets = np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32)
            values = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "phrases"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, phrases array<long>")


def _spelled(codes: np.ndarray, words: int) -> str:
    """Codes of ``words`` words each as letters.  Each place of a word has letters of its own: phrases match at whole words only."""
    number = LETTERS * words
    fours = (codes[:, None] >> (np.arange(number, dtype=np.uint64) * np.uint64(4))).astype(np.uint8) & 15
    return (fours + (48 + 16 * (np.arange(number) % LETTERS)).astype(np.uint8)).tobytes().decode("ascii")


def _locate(phrases: np.ndarray, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Positions in each text (hashes of its words) at which one of ``phrases`` (codes) begins."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    size = LETTERS * PHRASE
    patterns = _spelled(phrases, PHRASE)
    for k in range(0, len(patterns), size):
        automaton.add_word(patterns[k:k + size], True)
    automaton.make_automaton()
    for one in texts:
        hits = automaton.iter(_spelled(one >> np.uint64(64 - WORD_BITS), 1)) if len(phrases) else ()
        yield (np.array([end for end, _ in hits], dtype=np.int64) + 1) // LETTERS - PHRASE


def passages(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(doc_id, row, phrase, first, windows) of each passage around a confirmed phrase.

    ``confirmed(of, phrases)`` lists the confirmed phrases of each document
    that has any; ``windows`` has the hashes of the passage's windows,
    the first of which starts at word ``first``.
    """
    some = member_split(docs, F.xxhash64("doc_id"), confirmed.select(F.xxhash64("of")))[0]
    listed = (some.join(confirmed, F.col("doc_id") == F.col("of"))
              .select("doc_id", "row", "text", "phrases"))

    def located(batch: pa.RecordBatch, numbers: list[int], texts: list[np.ndarray], wanted: list[np.ndarray]) -> pa.RecordBatch:
        row, phrase, start, size, data = [], [], [], [], []
        for number, one, places in zip(numbers, texts, _locate(np.unique(np.concatenate(wanted)), texts)):
            codes = phrase_codes(one)
            at, first, n = key_phrases(codes)
            hit = np.zeros(len(codes), dtype=bool)
            hit[places] = True
            found = hit[at]
            windows = window_hashes(one).view(np.uint8).reshape(-1, 8)[:, :WINDOW_BYTES]
            row.append(np.full(found.sum(), number))
            phrase.append(codes[at[found]])
            start.append(first[found])
            size.append(n[found])
            data.append(windows[np.repeat(found, n)].tobytes())
        row = pa.array(np.concatenate(row))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(size)) * WINDOW_BYTES]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(phrase).view(np.int64)),
             pa.array(np.concatenate(start).astype(np.int32)),
             pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])],
            ["doc_id", "row", "phrase", "first", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _parts(batches, 2):
            shard, phrases, size = ([], [], []), 0, 0
            for number, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                one = known.of(split_words(text))
                codes = wanted.values.to_numpy().view(np.uint64)
                for column, value in zip(shard, (number, one, codes)):
                    column.append(value)
                phrases, size = phrases + len(codes), size + len(one)
                if phrases >= SHARD_PHRASES or size >= SHARD_WORDS:
                    yield located(batch, *shard)
                    shard, phrases, size = ([], [], []), 0, 0
            if shard[0]:
                yield located(batch, *shard)

    return listed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, phrase long, first int, windows binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, first, n): n windows from word ``first`` on that also start in a document with a smaller doc_id.

    ``docs(doc_id, row, text)`` without null doc_ids.  Whole copies of an
    earlier text have one span over everything.
    """
    digest = docs.select("doc_id", "row", F.sha2("text", 256).alias("digest"))
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"))
    judged = stored(digest.join(least, "digest").select("doc_id", "row", (F.col("doc_id") > F.col("least")).alias("copy")).distinct())
    copies = judged.where("copy").select("doc_id", "row")
    done = judged.groupBy("doc_id").agg(F.bool_and("copy").alias("all")).where("all").select("doc_id")
    # The earliest document of a text stands for its copies here, too.
    lists = stored(phrase_lists(docs).join(done, "doc_id", "left_anti"), compression="zstd")
    rows = lists.select("doc_id", F.explode("phrases").alias("phrase"))
    counted = rows.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase")
    confirmed = (rows.join(counted, "phrase", "left_semi")
                 .groupBy("doc_id").agg(F.collect_list("phrase").alias("phrases"))  # of one document
                 .withColumnRenamed("doc_id", "of"))
    found = stored(passages(docs, stored(confirmed)), compression="zstd").withColumn("passage", F.xxhash64("windows"))
    name = ["phrase", "passage"]
    least = stored(found.groupBy(*name).agg(F.min("doc_id").alias("least"), F.first("windows").alias("windows")))
    # Phrases with several distinct passages: their windows one by one, in a few per passage.
    several = least.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase")
    each = (least.join(several, "phrase")
            .select(*name, "least", F.posexplode(F.expr(
                f"transform(sequence(0, octet_length(windows) div {WINDOW_BYTES} - 1), i -> substring(windows, {WINDOW_BYTES} * i + 1, {WINDOW_BYTES}))")).alias("at", "window")))
    each = stored(each)
    best = each.groupBy("phrase", "window").agg(F.min("least").alias("best"))
    partly = (each.join(best, ["phrase", "window"]).where("best < least")
              .groupBy(*name).agg(F.collect_list("at").alias("at")))
    marked = (least.select(*name, "least").join(partly, name, "left"))
    spans = (found.select(*name, "doc_id", "row", "first", F.expr(f"cast(octet_length(windows) div {WINDOW_BYTES} as int)").alias("n"))
             .join(marked, name))
    whole = spans.where("doc_id > least").select("doc_id", "row", "first", "n")
    some = (spans.where("doc_id = least and at is not null")
            .select("doc_id", "row", "first", F.explode("at").alias("at"))
            .select("doc_id", "row", F.expr("first + at as first"), F.lit(1).alias("n")))
    return (whole.unionByName(some)
            .unionByName(copies.select("doc_id", "row", F.lit(0).alias("first"), F.lit(ALL).alias("n"))))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a word goes if a window
    that covers it also starts in a document with a smaller doc_id, judged on
    the input; ``kept`` joins the others by one space.  Null, empty and short
    texts have no windows.  Rows with a null doc_id lose no words and count
    as no document; rows with equal doc_ids do not remove each other's words.
    Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    with stage_scope(docs.sparkSession) as tables:
        spans = (repeated_spans(keyed.where("doc_id is not null")).groupBy("doc_id", "row")
                 .agg(F.collect_list(F.struct("first", "n")).alias("spans"))  # of one document
                 .selectExpr("doc_id as of", "row as of_row", "spans"))
        spans = stored(spans, compression="zstd")
        tables.pop()
    some, rest = member_split(keyed, F.xxhash64("doc_id", "row"), spans.select(F.xxhash64("of", "of_row")))
    # A null doc_id meets no spans and keeps all its words.
    touched = some.join(spans, (F.col("doc_id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    rest = rest.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    both = touched.select("doc_id", "text", "spans").unionByName(rest.select("doc_id", "text", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = split_words(text)
                n = len(words)
                if spans.is_valid and n >= WINDOW:
                    first = spans.values.field("first").to_numpy().astype(np.int64)
                    end = np.minimum(n, first + spans.values.field("n").to_numpy() + WINDOW - 1)
                    depth = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, end, -1)
                    stays = np.cumsum(depth[:n]) == 0
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string")
