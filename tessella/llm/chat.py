"""Chat formatting: prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it are the context, and only its reply
(with its end mark) is trainable.  Turns are ordered by (turn, role, text), nulls first.  A turn is rendered as
``<|role|>\\n`` + text + ``<|end|>\\n``; an example's ``text`` is its context, the reply's header, and the reply, and ``[train_start,
train_end)`` is the trainable span in characters.

Defined results: turns that tie in all of (turn, role, text) are alike, so their order doesn't matter; a very long conversation gives its
whole context each time; a null text is an empty one (a reply can be empty); a null role is rendered as ``unknown`` and is no assistant; rows of
a null conv_id form no conversation and give nothing; repeated rows are turns of their own; conversations without an assistant turn
and empty tables give nothing; other columns, whatever their names, are ignored.

Plan: one shuffle by conversation; the turns of a conversation are collected once and sliced for each reply, so what a task holds is a
conversation and one example at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, position, n_context, context, reply, text, train_start, train_end) of every assistant turn."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    talks = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    talks = talks.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(header(t["role"]), F.coalesce(t["text"], F.lit("")), F.lit(END))).alias("said"))
    each = talks.select("conv_id", "said", F.posexplode("turns").alias("at", "t")).where("t.role = 'assistant'")
    each = each.select("conv_id", F.col("t.turn").alias("turn"), F.col("at").cast("long").alias("position"), F.array_join(F.slice("said", F.lit(1), F.col("at")), "").alias("context"), F.coalesce("t.text", F.lit("")).alias("reply"))
    head = F.concat("context", F.lit("<|assistant|>\n"))
    return each.select(
        "conv_id", "turn", "position", F.col("position").alias("n_context"), "context", "reply",
        F.concat(head, "reply", F.lit(END)).alias("text"),
        F.length(head).cast("long").alias("train_start"),
        (F.length(head) + F.length("reply") + len(END)).cast("long").alias("train_end"),
    )
