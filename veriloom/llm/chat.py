"""Chat formatting by perspective rotation.

A dialogue of several speakers is rendered once for each of them: that speaker's
turns are the assistant's and are trained on, the others are users with their
names, system turns stay system turns.  One output row is one rendered turn of
one perspective, with its place in the whole rendering, so a dialogue of any
length is spread over tasks: places are sums before chunks of CHUNK turn numbers,
plus sums within a chunk.

A text that holds the marks of a turn can't end its own or begin another: a blank breaks
up each mark in it.

Results in the odd cases: null text counts as empty; a null or empty speaker is
called ``unknown``; line ends and angle brackets in names become spaces; a null
conversation id is one conversation, a null turn comes first; rows of the same
turn follow in order of speaker and text, repeated rows each count; a dialogue of
system turns alone has no perspective and no rows; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(f"< {mark[1:]}"))
    return text


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, pos, turn, speaker, chat_role, rendered, char_start, char_end, mask_start, mask_end.

    Characters are counted in the whole rendering of the perspective; the mask is
    the part that is trained on (text and end mark of the assistant's turns).
    """
    name = F.regexp_replace(F.coalesce(F.col(speaker_col).cast("string"), F.lit("")), r"[\r\n<>]", " ")
    said = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(name == "", "unknown").otherwise(name).alias("speaker"),
        _plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    )
    speakers = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    tail = F.lit(f"{END}\n")
    rows = rows.withColumn("chat_role", role).withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", tail)).withColumn("size", F.length("rendered").cast("long"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    per = rows.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    rows = rows.join(per, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("chunk") == F.col("k")))
    order = Window.partitionBy("conv_id", "perspective", "chunk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    end = F.col("chars_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("pos", F.col("n_before") + F.row_number().over(order) - 1).withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.col("size"))
    trained = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "pos", "turn", "speaker", "chat_role", "rendered", "char_start", "char_end",
        F.when(trained, F.col("char_start") + F.col("head")).alias("mask_start"),
        F.when(trained, F.col("char_end") - 1).alias("mask_end"),
    )
