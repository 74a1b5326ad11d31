"""Chat formatting into budgeted, turn-aligned windows.

Turns are written between markers; control strings inside a text (or a role)
are escaped, so that the output can be read back exactly.  Prefix sums of the
turns' tokens put each turn into one window as new; a window starts with the
system turn and with some turns of the window before.  Only new turns of the
assistant are under the loss mask, so a repeated target is never trained
twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 1_024
HISTORY = 128
# Fixed template: <turn ROLE>, line break, TEXT, </turn>, line break.
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "</turn>\n"
# In order: a control string and what stands for it.  Every backslash of an
# escaped text is followed by its code, so replacing back in reverse order is exact.
ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("<turn ", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (">", "\\3"), ("\n", "\\4"))
# Pieces that tokenizers split before merging; a cheap bound-free count of tokens.
PIECE = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
TURN_OVERHEAD = 4
LEARNED_ROLE, KEPT_ROLE = "assistant", "system"


def escaped(text: Column, table: tuple = ESCAPES) -> Column:
    for plain, code in table:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, table: tuple = ESCAPES) -> Column:
    for plain, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, n_repeated, n_new, text, loss) of ``turns(conv_id, turn, role, text)``.

    ``loss`` lists (start, length) in code points of ``text``, in order.  The
    first ``n_repeated`` turns of a window were new in an earlier one: the
    conversation's opening system turn, then turns of the window before that
    begin within its last ``history`` tokens.  A window holds ``budget``
    tokens or less, repeated ones included.  A turn that would not fit beside
    system turn and history has a window of its own without history; only
    where system turn and turn alone have more does a window hold more, as
    turns are never cut or dropped.

    New tokens are dealt out by prefix sums: with ``cap`` tokens left beside
    system turn and history, a window opens at every half of ``cap``, and
    around every turn of more than that; so none holds more than ``cap``.

    Rows are taken by turn, then role, then text (nulls first); null role or
    text counts as empty; repeated rows are turns of their own; null conv_ids
    form one conversation; other columns are ignored; an empty table gives
    no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text", "salt")
    opening = (F.col("no") == 1) & (F.col("role") == KEPT_ROLE)
    rows = (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("salt"))
            .withColumn("tokens", F.regexp_count("text", F.lit(PIECE)) + TURN_OVERHEAD)
            .withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
            .withColumn("no", F.row_number().over(order))
            .withColumn("kept", F.first(F.when(opening, F.col("tokens")).otherwise(0)).over(order))
            .withColumn("cap", F.greatest(F.lit(budget - history) - F.col("kept"), F.lit(1)))
            .withColumn("half", F.greatest(F.expr("cap div 2"), F.lit(1)))
            .withColumn("large", ~opening & (F.col("tokens") > F.col("cap") - F.col("half")))
            .withColumn("bucket", F.expr("greatest(before - kept, 0) div half"))
            .withColumn("opens", ((F.col("no") == 1) | (F.col("bucket") != F.lag("bucket").over(order)) | F.col("large")
                                  | F.lag("large").over(order)).cast("int"))
            .withColumn("window", F.sum("opens").over(order) - 1)
            .withColumn("next", F.min(F.when(F.col("opens") == 1, F.struct("before", "tokens")))
                        .over(order.rowsBetween(1, Window.unboundedFollowing)))
            .withColumn("last", F.max("window").over(whole.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    recent = F.col("next").isNotNull() & (F.col("before") >= F.col("next.before") - history) & (F.col("next.tokens") <= F.col("cap"))
    copies = F.when(opening, F.expr("sequence(window, last)")).when(recent, F.expr("array(window, window + 1)")) \
        .otherwise(F.array("window"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(HEAD_END))
    body = escaped(F.col("text"))
    pieces = (rows.select("conv_id", "no", "role", head.alias("head"), body.alias("body"), F.col("window").alias("own"),
                          F.explode(copies).alias("window"))
              .select("conv_id", "window", F.struct(
                  "no", (F.col("window") != F.col("own")).alias("repeated"),
                  F.concat("head", "body", F.lit(CLOSE)).alias("text"), F.length("head").alias("skip"),
                  F.length("body").alias("size"),
                  ((F.col("window") == F.col("own")) & (F.col("role") == LEARNED_ROLE)).alias("learned")).alias("piece")))
    packed = pieces.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    spans = F.expr("""aggregate(p, struct(0L as at, cast(array() as array<struct<start:bigint,length:int>>) as spans),
        (s, x) -> struct(s.at + length(x.text) as at,
                         if(x.learned, concat(s.spans, array(struct(s.at + x.skip as start, x.size as length))), s.spans) as spans),
        s -> s.spans)""")
    return packed.select("conv_id", "window", F.expr("cast(size(filter(p, x -> x.repeated)) as int)").alias("n_repeated"),
                         F.expr("cast(size(filter(p, x -> not x.repeated)) as int)").alias("n_new"),
                         F.array_join("p.text", "").alias("text"), spans.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns in order and the text under the loss mask.

    Columns conv_id, turns (array of role and text), learned (array of
    texts), formatted_chars.
    """
    raw = F.slice(F.split("text", CLOSE), F.col("n_repeated") + 1, F.col("n_new"))
    turn = lambda x: F.struct(
        unescaped(F.substr(x, F.lit(len(OPEN) + 1), F.position(F.lit(HEAD_END), x) - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
        unescaped(F.substr(x, F.position(F.lit(HEAD_END), x) + len(HEAD_END))).alias("text"))
    learned = F.transform("loss", lambda x: unescaped(F.substr(F.col("text"), (x["start"] + 1).cast("int"), x["length"])))
    parts = windows.select("conv_id", F.struct("window", F.transform(raw, turn).alias("turns"), learned.alias("learned"),
                                               F.length("text").cast("long").alias("size")).alias("w"))
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return joined.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.learned").alias("learned"),
                         F.expr("aggregate(w, 0L, (s, x) -> s + x.size)").alias("formatted_chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what ``read_back`` found."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return conversations.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")
