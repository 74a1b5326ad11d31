"""Benchmark decontamination with spaced seeds.

A seed is the hash of some words of a short run; a mask lists their places.
Seeds at every position of the benchmark meet seeds at every position of the
documents; a hit fixes how item and document lie against each other, and the
words around it are compared one to one: a window of ``OVERLAP`` words (all
words of a shorter item) with at least ``SIMILARITY`` of them equal is
contamination.  The masks of each window size leave no such window without a
hit, wherever its changed words lie.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalake.llm.common import member_split, stored, without_rows

# Fixed values, by window size: for every choice of as many changed words as SIMILARITY allows, some mask
# fits between them at some place of the window (the tests try all choices).
MASKS = {
    3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2), (0, 1, 3)), 6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 2, 3), (0, 1, 3, 4)), 8: ((0, 1, 2, 4, 5), (0, 1, 3, 4, 5)), 9: ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    10: ((0, 1, 2, 3), (0, 1, 2, 4)), 11: ((0, 1, 3, 5, 6), (0, 1, 2, 5, 6)), 12: ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    13: ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))}
# Items with fewer words are no evidence.
LEAST_WORDS = min(MASKS)
OVERLAP = 13
SIMILARITY = 0.8
# Benchmark seeds sent to every task at once; a larger benchmark is met in parts of this size.
PART_SEEDS = 2_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits; one empty word for a text without any."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), " ")


def _seeds(words: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """(keep..., at, seed) per mask at every position of ``words(keep..., words)`` where it fits."""
    least = min(m[-1] for m in masks) + 1
    starts = F.expr(f"if(size(words) < {least}, cast(array() as array<int>), sequence(0, size(words) - {least}))")
    placed = words.select(*keep, "words", F.explode(starts).alias("at"))
    hashes = [F.when(F.col("at") + m[-1] < F.size("words"),
                     F.xxhash64(F.lit("".join(map(str, m))), *[F.get("words", F.col("at") + p) for p in m])) for m in masks]
    return placed.select(*keep, "at", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, part_seeds: int = PART_SEEDS) -> DataFrame:
    """(doc_id, row, item_id, matched, overlap): documents that hold a passage of an item.

    One row per input row of ``docs(doc_id, row, text)`` and item with a
    window of ``OVERLAP`` words (all words of a shorter item) of which at
    least ``SIMILARITY`` are equal: the most equal words and the window's
    size.  ``row`` tells input rows with equal doc_ids apart.
    Items with fewer than ``LEAST_WORDS`` words are no evidence.  Documents'
    words never leave the task that scans them, but for the few around a hit.
    """
    items = (benchmark.select("item_id", word_list(F.col("text")).alias("words"))
             .withColumn("window", F.least(F.lit(OVERLAP), F.size("words"))).where(F.col("window") >= LEAST_WORDS))
    sizes = sorted(r[0] for r in items.select("window").distinct().collect()) or [OVERLAP]
    seeds = stored(reduce(DataFrame.unionByName, [
        _seeds(items.where(F.col("window") == n), MASKS[n], ["item_id"]) for n in sizes])
        .select("seed", "item_id", F.col("at").alias("item_at")).distinct())
    parts = max(1, ceil(seeds.count() / part_seeds))
    placed = _seeds(docs.select("doc_id", "row", word_list(F.col("text")).alias("words")),
                    sorted({m for n in sizes for m in MASKS[n]}), ["doc_id", "row"])
    # Each part has about part_seeds rows, as the hash deals them out evenly: bounded, so it is broadcast.
    hits = reduce(DataFrame.unionByName, [
        placed.join(F.broadcast(seeds.where(F.pmod(F.xxhash64("item_id", "item_at"), F.lit(parts)) == k)), "seed") for k in range(parts)])
    # Hits that lay item and document against each other in the same way are compared as one.
    laid = (hits.groupBy("doc_id", "row", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
            .agg(F.min("item_at").alias("low"), F.max("item_at").alias("high")))
    listed = stored(laid.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item_id", "shift", "low", "high")).alias("hits")))
    some = member_split(docs, F.xxhash64("doc_id", "row"), listed.select(F.xxhash64("doc_id", "row")))[0]
    base = F.expr(f"greatest(hit.shift + hit.low - {OVERLAP - 1}, 0)")
    around = (some.alias("d").join(
        listed.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.row") == F.col("l.row")))
        .select("d.doc_id", "d.row", word_list(F.col("d.text")).alias("words"), "l.hits")
        .select("doc_id", "row", "words", F.explode("hits").alias("hit"))
        .select("doc_id", "row", "hit.*", base.alias("base"),
                F.slice("words", base + 1, F.expr(f"hit.high - hit.low + {2 * OVERLAP - 1}")).alias("some")))
    # Windows of the item that hold a word of a seed begin from first to last.
    near = (around.join(items.withColumnRenamed("words", "item"), "item_id")
            .withColumn("first", F.expr("greatest(0, low + 1 - window)")).withColumn("last", F.expr("least(high, size(item) - window)"))
            .where("first <= last"))
    # Bound to a name inside the expression, so that the comparison is made once and not for every window.
    equal = "transform(sequence(first, last + window - 1), i -> coalesce(get(item, i) = get(some, shift + i - base), false))"
    count = "transform(sequence(0, last - first), s -> size(filter(slice(e, s + 1, window), x -> x)))"
    scored = near.withColumn("found", F.expr(f"transform(array({equal}), e -> {count})[0]"))
    wanted = F.ceil(F.col("window") * F.lit(SIMILARITY)).cast("int")
    return (scored.select("doc_id", "row", "item_id", "window", F.array_max("found").alias("matched")).where(F.col("matched") >= wanted)
            .groupBy("doc_id", "row", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("overlap")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, overlap of every document and item that overlap.

    Null, empty and short texts overlap nothing; rows with a null doc_id are
    found like any other; repeated rows count once per (doc_id, item_id);
    repeated items each count; other columns are ignored; empty tables give
    no rows.
    """
    return (overlaps(docs.select("doc_id", F.lit(0).alias("row"), "text"), benchmark)
            .select("doc_id", "item_id", "matched", "overlap"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no benchmark item; rows with a null doc_id are judged by text."""
    found = overlaps(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), benchmark)
    return without_rows(docs, found.selectExpr("doc_id as of", "row as of_row"))
