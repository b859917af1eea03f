"""Chat formatting with Spark expressions: collected turns are sorted, neighbours of the same role merged, texts concatenated.

The template: each block of turns with one role is <|turn|>ROLE<|text|>TEXT<|end|>, and the texts of merged turns stand
between <|more|>. In roles and texts every control string is broken up after its first character by an escape mark,
and the mark itself is marked, so no text can pass for a control string and all of them can be read back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
#: Control strings that texts must not contain: the template's and those that tokenizers commonly give a meaning.
CONTROL = (TURN, TEXT, MORE, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Marks an escape; followed by 0 it stands for itself, by 1 for nothing.
MARK = "␛"


def escape(text: Column, control=CONTROL) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK + "0")), f"({heads})", f"$1{MARK}1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, segments (array of text, loss) and formatted, their concatenation; loss marks the texts of the role learn.

    Rows are ordered by turn (nulls first), then role, then text, so ties and repeated rows have one result; all count
    as turns. Null texts and roles are empty. Rows without an id are one conversation with a null id. Other columns are
    ignored; an empty table has no conversations. A conversation is one row of the result, so its turns meet in one
    task, as the contract of one string for each asks for; work and memory grow with its length only.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = turns.select(F.col(id_col).alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns_"))
    last = F.size("turns_") - 1
    gathered = gathered.withColumn("starts_", F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(F.col("turns_"), i)["role"] != F.get(F.col("turns_"), i - 1)["role"])))
    begin = lambda s: F.get(F.col("turns_"), s)
    end = lambda k: F.coalesce(F.get(F.col("starts_"), k + 1), last + 1)
    merged = F.transform("starts_", lambda s, k: F.struct(begin(s)["role"].alias("role"), F.transform(F.slice(F.col("turns_"), s + 1, end(k) - s), lambda t: t["text"]).alias("texts")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def block(b):
        body = F.transform(b["texts"], lambda t, i: F.array(segment(F.when(i == 0, F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT))).otherwise(MORE), F.lit(False)), segment(escape(t), b["role"] == learn)))
        return F.concat(F.flatten(body), F.array(segment(F.lit(END), F.lit(False))))

    segments = F.flatten(F.transform(merged, block))
    out = gathered.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, in order, as they were before merging and escaping."""

    def turns(block):
        return _let(
            F.split(block, re.escape(TEXT), -1),
            lambda p: F.transform(F.split(F.regexp_replace(F.get(p, 1), re.escape(END) + r"\z", ""), re.escape(MORE), -1), lambda t: F.struct(unescape(F.get(p, 0)).alias("role"), unescape(t).alias("text"))),
        )

    blocks = _let(F.split(formatted, re.escape(TURN), -1), lambda b: F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))))
    return F.flatten(F.transform(blocks, turns))


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from format_chats' output."""
    back = chats.withColumn("turns_", read_turns(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = back.withColumn("loss_", loss)
    lines = F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns_").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_").cast("long").alias("loss_chars"),
        F.sha2("loss_", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
