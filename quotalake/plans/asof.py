"""Versions of a keyed row: the one before, and the one in force at a time.

Both keep a hot key spread over many tasks: rows are handled inside (key,
time chunk), and only one small row per key and chunk is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalake.functions.timecols import bucket_start


def neighbour(df: DataFrame, keys: Sequence[str], at: str, row: Column, out: str, later: bool = False,
              chunk_seconds: int = 86400) -> DataFrame:
    """``df`` with the struct ``row`` of the previous (``later``: next) row of its key by time ``at``; null if there is none.

    ``at`` must be distinct within a key; null is a key like any other.  Rows see their neighbour inside
    the chunk; the edges of chunks meet in a window over one row per key and
    non-empty chunk.
    """
    keys = list(keys)
    order = F.col(at).desc() if later else F.col(at).asc()
    marked = df.withColumn("_chunk", bucket_start(F.col(at), chunk_seconds)).withColumn("_own", row)
    inside = marked.withColumn("_near", F.lag("_own").over(Window.partitionBy(*keys, "_chunk").orderBy(order)))
    edge = (F.min_by if later else F.max_by)("_own", F.col(at))
    edges = marked.groupBy(*keys, "_chunk").agg(edge.alias("_edge"))
    chunk_order = F.col("_chunk").desc() if later else F.col("_chunk").asc()
    across = edges.select(*keys, "_chunk", F.lag("_edge").over(Window.partitionBy(*keys).orderBy(chunk_order)).alias("_across"))
    left, right = inside.alias("l"), across.alias("r")
    met = F.lit(True)
    for k in (*keys, "_chunk"):
        met = met & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, met).select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("l._near", "r._across").alias(out))


def in_force(rows: DataFrame, key: str, versions: DataFrame, out: str, ts: str = "ts", chunk_seconds: int = 3600) -> DataFrame:
    """``rows`` with ``out``: the struct of the newest of ``versions(key, valid_from, row)`` of its key with ``valid_from <= ts``.

    ``valid_from`` must be distinct within a key.  Null where the key is null
    or has no version yet.  The time of every key is cut into pieces, at the
    starts of the chunks in which it has rows and at its versions; rows join
    the pieces of their own (key, chunk), so a key with a third of all rows
    is joined by chunk, and the window that carries versions from chunk to
    chunk holds one row per non-empty chunk and per version.
    """
    chunked = rows.withColumn("_chunk", bucket_start(F.col(ts), chunk_seconds))
    starts = (chunked.where(F.col(key).isNotNull() & F.col("_chunk").isNotNull()).select(key, "_chunk").distinct()
              .select(key, F.col("_chunk").alias("_at"), F.lit(False).alias("_version")))
    steps = starts.unionByName(versions.select(key, F.col("valid_from").alias("_at"), F.lit(True).alias("_version"), "row"),
                               allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_version")
    pieces = (steps.select(key, "_at", F.last("row", ignorenulls=True).over(w).alias(out), F.lead("_at").over(w).alias("_next"))
              .withColumn("_chunk", bucket_start(F.col("_at"), chunk_seconds))
              .withColumn("_until", F.least("_next", F.timestamp_add("SECOND", F.lit(chunk_seconds), F.col("_chunk"))))
              .where(F.col(out).isNotNull() & (F.col("_at") < F.col("_until")))
              .select(key, "_chunk", "_at", "_until", out))
    left, right = chunked.alias("l"), pieces.alias("r")
    met = ((F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._chunk") == F.col("r._chunk"))
           & (F.col(f"l.{ts}") >= F.col("r._at")) & (F.col(f"l.{ts}") < F.col("r._until")))
    return left.join(right, met, "left").select(*[F.col(f"l.{c}") for c in rows.columns], F.col(f"r.{out}").alias(out))
