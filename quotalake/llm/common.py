"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.session import cut_lineage

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for a null or blank text.

    Splits at a single character, which needs no regular expression.
    """
    plain = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)``: one row (node, root) per node with an edge.

    ``root`` is the smallest node of the component.  Alternates large-star
    and small-star steps; every round is a partial aggregation and an
    equi-join (so a hot node is split by AQE) and is stored in the shared
    checkpoint folder.  The driver sees one checksum per round only.
    """
    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        table = cut_lineage(df)
        seen = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return table, tuple(seen)

    current, seen = checked(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    while seen[0]:
        both = current.unionByName(current.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").selectExpr("b a", "m b")
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").selectExpr("b a", "m b").where("a <> b")
                 .unionByName(low.selectExpr("a", "m b"))
                 .selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
        current, now = checked(small)
        if now == seen:
            break
        seen = now
    return (current.groupBy("a").agg(F.min("b").alias("root"))
            .unionByName(current.selectExpr("b a", "b root").distinct())
            .groupBy("a").agg(F.min("root").alias("root")).withColumnRenamed("a", "node"))


# Bits of the table that keeps rows out of shuffles: 2 MB at any scale, so it is broadcast.
MEMBER_BITS = 1 << 24


def member_split(rows: DataFrame, value: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a hash ``value`` among the one column of ``keys``, rows that surely have not).

    A table of ``MEMBER_BITS`` bits, broadcast as bitmaps of 4 KB.  It fills
    up as keys grow, and then clears fewer rows.  For keeping rows out of a
    shuffle whose join decides.
    """
    number = lambda h: F.pmod(h, F.lit(MEMBER_BITS))
    slot = number(F.col(keys.columns[0]))
    table = (keys.select(F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit"))
             .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    own = number(value)
    byte = F.conv(F.hex(F.substr(F.col("__bits"), (F.shiftright("__at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)), F.lit(2)) == 1, F.lit(False))
    marked = (rows.withColumn("__bucket", F.bitmap_bucket_number(own)).withColumn("__at", F.bitmap_bit_position(own))
              .join(F.broadcast(table), "__bucket", "left").withColumn("__maybe", hit).select(*rows.columns, "__maybe"))
    return marked.where("__maybe").drop("__maybe"), marked.where("not __maybe").drop("__maybe")


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """All columns of the rows of ``docs`` whose (doc_id, hash of the text) is not in ``gone(of, of_row)``.

    Only rows that a filter of bounded size cannot clear are shuffled for the join.
    """
    gone = stored(gone.distinct().selectExpr("of as __of", "of_row as __of_row"))
    row = F.xxhash64("text")
    maybe, rest = member_split(docs, F.xxhash64(F.col("doc_id"), row), gone.select(F.xxhash64("__of", "__of_row")))
    match = F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__row") == F.col("__of_row"))
    judged = maybe.withColumn("__row", row).join(gone, match, "left_anti").drop("__row")
    return judged.unionByName(rest)


stored = cut_lineage
