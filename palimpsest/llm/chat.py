"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A conversation is written once as a run of marked turns; every assistant turn then gives an
example: all text up to its end, of which only the reply itself is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
# Strings that mean something to this template or to others; inside texts they are broken up.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]"]


def escape(c: Column) -> Column:
    """Double every backslash, then put one after the first character of each control string.

    Between those two characters only a control string has exactly one backslash, as a
    backslash of the text has become two; so unescape finds its own marks and no others.
    """
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for s in reversed(CONTROL):
        c = F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, ends, assistant): one row for each conversation of turns(conv_id, turn, role, text).

    Turns are in the order of turn (null first), then role and text, so repeated rows and equal
    turn numbers have a fixed place. Null roles and texts are empty; null conv_ids are one
    conversation. ``ends`` are the code points up to the end of each turn, ``assistant`` the
    (start, end) of each reply's text in code points, end mark included.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    rows = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    body = F.transform("ts", lambda t: F.struct(F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT)).alias("head"), F.concat(escape(t["text"]), F.lit(END)).alias("body"), t["role"].alias("role")))
    rows = rows.select("conv_id", body.alias("ts"))
    spot = F.aggregate(
        "ts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,reply:boolean>>").alias("spots")),
        lambda s, t: F.struct(
            (s["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("at"),
            F.concat(s["spots"], F.array(F.struct((s["at"] + F.char_length(t["head"])).alias("start"), (s["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end"), (t["role"] == "assistant").alias("reply")))).alias("spots"),
        ),
        lambda s: s["spots"],
    )
    return rows.select("conv_id", F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"])), "").alias("formatted"), spot.alias("spots"))


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): every assistant turn as its own example.

    ``text`` is the conversation up to the end of the reply, which is the only trainable part:
    code points loss_start to loss_end - 1, the end mark among them. Turns after the last reply
    are nobody's context; they come as a last example with an empty loss, so no turn is lost, and
    so does a conversation without replies. ``text`` is cut from one shared string as it is
    read, so a long conversation does not hold a copy of itself for each reply.
    """
    rows = formatted(turns)
    last = F.element_at("spots", -1)
    replies = F.filter("spots", lambda s: s["reply"])
    rest = F.when(~last["reply"], F.array(F.struct(last["end"].alias("start"), last["end"].alias("end"), F.lit(False).alias("reply")))).otherwise(F.array().cast("array<struct<start:int,end:int,reply:boolean>>"))
    rows = rows.select("conv_id", "formatted", F.posexplode(F.concat(replies, rest)).alias("example", "s"))
    return rows.select("conv_id", "example", F.expr("substring(formatted, 1, s.end)").alias("text"), F.col("s.start").alias("loss_start"), F.col("s.end").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(ROLE) + 1, 1 << 30), TEXT, 1)).alias("role"), unescape(F.substring_index(p, TEXT, -1)).alias("text")))
