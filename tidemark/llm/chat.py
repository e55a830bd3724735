"""Chat formatting from event logs, in DataFrame functions only.

An event has conv_id, seq, op, message, role, text. op `message` (or null) opens a message,
`delta` appends to it, `edit` replaces its text, `regenerate` starts its text again and discards
the messages that followed it until then, `delete` removes it. fold() gives the final messages,
render() the formatted conversation and the loss mask, parse() reads a formatted string back.

Template, for each turn: <|im_start|> role <|im_sep|> text <|im_end|>, without the spaces.
Wherever a text or role has a control string (these, or those of other common templates) one
backslash goes behind its first character; where backslashes stand there already, one is added.
That can be undone, and no control string is left inside a turn.

Defined results: null texts and roles are empty; events tied in seq go by op, role, text, message;
an event without a message id is a message of its own; repeated rows are repeated turns; a
conversation whose messages are all gone has no row; null conv_id is a conversation like any
other; other columns stay behind; an empty log gives an empty table. One conversation is one
output row, so its turns meet in one task at last, whatever the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First character of a control string, backslashes put there, the rest of the control string.
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
_PLAIN = r"([<\[])(\\*)" + _CONTROL
_ESCAPED = r"([<\[])\\(\\*)" + _CONTROL
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def as_events(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text), each a message of its own, as events."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("string").alias("message"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the messages that remain, place being the order of their openings."""
    order = [F.col("seq").asc_nulls_first(), "op", "role", "text", "message"]
    conv = Window.partitionBy("conv_id")
    e = events.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.lower("op"), F.lit("message")).alias("op"),
        F.col("message").cast("string").alias("message"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("n", F.row_number().over(conv.orderBy(*order)))
    e = e.withColumn("id", F.when(F.col("message").isNull(), F.struct(F.col("n"), F.lit("").alias("name"))).otherwise(F.struct(F.lit(0).alias("n"), F.col("message").alias("name"))))
    own = Window.partitionBy("conv_id", "id")
    e = e.withColumn("first", F.min("n").over(own))
    e = e.withColumn("reset", F.max(F.when(F.col("op").isin("message", "edit", "regenerate"), F.col("n"))).over(own))
    # A regeneration stands at the opening of its message: what opened after that and before it is gone.
    restarted = F.max(F.when(F.col("op") == "regenerate", F.col("n"))).over(conv.orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("cut", F.coalesce(restarted, F.lit(0)))
    chunks = F.sort_array(F.collect_list(F.when((F.col("n") >= F.coalesce("reset", F.lit(0))) & (F.col("op") != "delete"), F.struct("n", "text"))))
    return (
        e.groupBy("conv_id", "id")
        .agg(F.min("first").alias("place"), F.min_by("role", "n").alias("role"), F.array_join(F.transform(chunks, lambda c: c["text"]), "").alias("text"), F.max("cut").alias("cut"), F.max(F.col("op") == "delete").alias("gone"))
        .filter(~F.col("gone") & (F.col("cut") <= F.col("place")))
        .select("conv_id", F.col("place").cast("long").alias("place"), "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: per turn start and end (code points) of the text that the loss
    covers, empty unless the assistant's, and skip and take, the same within the turn."""
    head = F.concat(F.lit(START), F.col("r"), F.lit(SEP))
    seg = messages.select("conv_id", "place", (F.col("role") == TRAINED_ROLE).alias("trained"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    seg = seg.select("conv_id", "place", F.concat(head, "t", F.lit(END)).alias("segment"), F.length(head).alias("skip"), F.when(F.col("trained"), F.length("t")).otherwise(0).alias("take"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("start", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)) + F.col("skip"))
    listed = F.sort_array(F.collect_list(F.struct("place", "segment", "start", (F.col("start") + F.col("take")).alias("end"), "skip", "take")))
    return (
        seg.groupBy("conv_id")
        .agg(listed.alias("x"))
        .select("conv_id", F.array_join(F.col("x.segment"), "").alias("formatted"), F.transform("x", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["skip"].alias("skip"), s["take"].alias("take"))).alias("turns"))
    )


def parse(formatted: Column) -> Column:
    """Array of struct(role, text), read back from a formatted conversation."""

    def turn(piece: Column) -> Column:
        whole = F.split(F.split(piece, r"<\|im_end\|>", -1)[0], r"<\|im_sep\|>", 2)
        return F.struct(unescape(whole[0]).alias("role"), unescape(whole[1]).alias("text"))

    return F.transform(_pieces(formatted), turn)


def _pieces(formatted: Column) -> Column:
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def loss_text(formatted: Column, turns: Column) -> Column:
    """All text under the loss mask, in order, unescaped: cut out of the formatted string turn by turn."""
    cut = F.zip_with(_pieces(formatted), turns, lambda p, m: unescape(F.substring(p, m["skip"] - len(START) + 1, m["take"])))
    return F.array_join(cut, "")


def format_rows(rows: DataFrame) -> DataFrame:
    return render(fold(as_events(rows)))
