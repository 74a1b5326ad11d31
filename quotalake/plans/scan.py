"""Distributed prefix sums that survive one very hot key.

A running sum over ``Window.partitionBy(user)`` puts all rows of a user in
one task; if one user holds a third of the data that task never ends.
``prefix_sums`` splits each key's ordered sequence into time chunks
(default one minute):

1. rows are summed inside (key, chunk) windows - the data is hash
   partitioned on (key, chunk), so a hot key spreads over all tasks;
2. chunk totals are aggregated from the same exchange (one row per key
   and chunk, no further shuffle of the rows);
3. a window over those small rows, per (key, period), gives each chunk
   its carry-in from earlier chunks of the same period;
4. one join on (key, chunk) adds the carry back.

No task ever holds more than one key's chunk of raw rows, or one key's
chunk totals of one period (at most 44,640 one-minute chunks a month).
Several sums sharing the partitioning are computed in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalake.functions.timecols import bucket_start
from quotalake.session import cut_lineage

DEFAULT_CHUNK_SECONDS = 60


def with_chunk(df: DataFrame, ts: str = "ts", seconds: int = DEFAULT_CHUNK_SECONDS,
               name: str = "_chunk") -> DataFrame:
    """Add the chunk column (start of the ``seconds`` bucket of ``ts``).

    ``seconds`` must divide a day so that no chunk straddles a day or month.
    """
    if 86400 % int(seconds):
        raise ValueError("chunk seconds must divide 86400")
    return df.withColumn(name, bucket_start(F.col(ts), seconds))


def prefix_sums(df: DataFrame, key: str, order: Sequence[Column],
                specs: Sequence[tuple[str, str, str]], chunk: str = "_chunk",
                inclusive: bool = False, materialize: bool = True) -> DataFrame:
    """Add running sums over earlier rows of the same key and period.

    ``specs`` holds ``(value_col, period_col, out_col)``: ``out`` is the sum
    of ``value`` over rows of the same ``key`` and ``period`` that come
    before this row in ``order`` (this row too if ``inclusive``).
    ``order`` must start with the time column the chunk was built from, and
    each period column must be constant within a chunk (day, month).  Key
    must be non-NULL; NULL values count as 0.

    The input is read twice (row windows and chunk totals).  With
    ``materialize`` it is first written as a reliable checkpoint in the
    shared ``spark.checkpoint.dir``, so both branches read stored rows and
    chained steps neither recompute nor double their lineage.
    """
    if materialize:
        df = cut_lineage(df)
    df = df.repartition(F.col(key), F.col(chunk))
    frame_end = Window.currentRow if inclusive else -1
    local_w = (Window.partitionBy(key, chunk).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, frame_end))
    values = sorted({v for v, _, _ in specs})
    periods = sorted({p for _, p, _ in specs})
    local = df.select("*", *[F.coalesce(F.sum(v).over(local_w), F.lit(0)).alias(f"_local_{v}")
                             for v in values])
    totals = df.groupBy(key, chunk).agg(
        *[F.first(p).alias(p) for p in periods],
        *[F.coalesce(F.sum(v), F.lit(0)).alias(f"_total_{v}") for v in values])
    carry_cols = []
    for v, p, out in specs:
        w = Window.partitionBy(key, p).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        carry_cols.append(F.coalesce(F.sum(f"_total_{v}").over(w), F.lit(0)).alias(f"_carry_{out}"))
    carry = totals.select(key, chunk, *carry_cols)
    joined = local.join(carry, on=[key, chunk], how="inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"_carry_{out}") + F.col(f"_local_{v}")).cast("bigint").alias(out) for v, _, out in specs])
