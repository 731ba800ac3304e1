"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, adjacent turns of one role merged into
one block and joined. Control strings inside texts are escaped so that the
formatted text reads back to the very turns:

    <|im_start|>role NEWLINE text [<|im_sep|> text ...] <|im_end|> NEWLINE ...

A backslash becomes two, ``<|`` becomes ``<\\|`` and, in roles, a line end
becomes ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Escapes are read left to right: the doubled backslashes part the rest."""
    parts = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def unescape_text(text: Column) -> Column:
    """As ``unescape``, for texts, where line ends are not escaped."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(x, F.lit("<\\|"), F.lit("<|"))), "\\")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv, formatted, segments)`` per conversation.

    segments: array of (text, loss) whose texts, joined, are ``formatted``; loss
    marks what the model learns, the texts of ``loss_role`` without the marks
    around them. Turns are ordered by turn, then role, then text; repeated rows
    stay; a null turn comes first; a null role or text counts as empty; rows with
    a null conversation id form one conversation. An empty table gives no rows;
    other columns are ignored.
    """
    role, text = F.coalesce(turns[role_col].cast("string"), F.lit("")), F.coalesce(turns[text_col].cast("string"), F.lit(""))
    rows = turns.select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(turns: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            same = F.coalesce(F.get(turns, i - 1)["role"] == x["role"], F.lit(False))
            head = F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(""), F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
            mark = F.struct(F.when(same, F.lit(SEP)).otherwise(head).alias("text"), F.lit(False).alias("loss"))
            return F.array(mark, F.struct(escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss")))

        tail = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
        return F.concat(F.flatten(F.transform(turns, pair)), tail)

    made = sorted_turns.select("conv", segments(F.col("turns")).alias("segments"))
    return made.select("conv", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, len(START) + 1, 2**31 - 1)
        role = unescape(F.substring_index(body, "\n", 1))
        texts = F.split(F.substring(body, F.length(F.substring_index(body, "\n", 1)) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape_text(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape_text(s["text"])), "")
