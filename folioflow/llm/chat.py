r"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>\n"

The parser below is deterministic: it cuts at the end mark, and in each piece takes the start mark, the role up to the
first line feed and the rest as text. It undoes escapes: in role and text `<\|` (any number of backslashes, at least
one) loses one backslash; in a role then `\n` is a line feed and `\b` a backslash. A turn is rendered as it is, then
with its text escaped, then with its role escaped too: the first rendering that the parser reads back as the very turn
is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def escape_role(x: Column) -> Column:
    return escape(F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(x: Column) -> Column:
    return F.replace(F.replace(unescape(x), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; a piece that the grammar doesn't allow is null."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.lit(2**31 - 1))
        allowed = piece.startswith(START) & body.contains("\n") & ~body.contains(START) & ~body.contains(END)
        return F.when(allowed, F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))

    # behind the last end mark there is nothing
    return F.when(F.element_at(pieces, -1) == "", F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn))


def escaped(turn: Column) -> Column:
    """The role and text as rendered: the first form that is read back as the turn."""
    forms = F.array(
        F.struct(turn["role"].alias("role"), turn["text"].alias("text")),
        F.struct(turn["role"].alias("role"), escape(turn["text"]).alias("text")),
        F.struct(escape_role(turn["role"]).alias("role"), escape(turn["text"]).alias("text")),
    )
    source = F.array(F.struct(turn["role"].alias("role"), turn["text"].alias("text")))
    return F.get(F.filter(forms, lambda x: parse(render(x["role"], x["text"])).eqNullSafe(source)), F.lit(0))


def format_conversations(df: DataFrame, conversation: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """A row for each conversation: conv, turns (the source), formatted, loss and same.

    Turns are in order of turn, those of equal (or null) turns by role and text; repeated rows stay. A null role or
    text is empty; rows with a null conversation form one. loss has the begin (from 0) and length, in code points, of
    each assistant text in formatted. same tells that the whole of formatted, read by the parser, gives the source.
    A conversation is one row, so it has to fit a task; no other group is gathered.
    """
    clean = F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = df.select(conversation.alias("conv"), clean.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rows = rows.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    rows = rows.withColumn("forms", F.transform("turns", escaped))
    rows = rows.withColumn("formatted", F.array_join(F.transform("forms", lambda x: render(x["role"], x["text"])), ""))
    lead = lambda x: F.length(x["role"]) + len(START) + 1
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,size:int>>").alias("loss"))
    step = lambda a, x: F.struct(
        (a["at"] + lead(x) + F.length(x["text"]) + len(END) + 1).alias("at"),
        F.when(x["role"] == "assistant", F.array_append(a["loss"], F.struct((a["at"] + lead(x)).alias("first"), F.length(x["text"]).alias("size")))).otherwise(a["loss"]).alias("loss"),
    )
    return rows.select("conv", "turns", "formatted", F.aggregate("forms", empty, step)["loss"].alias("loss"), parse(F.col("formatted")).eqNullSafe(F.col("turns")).alias("same"))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, without escapes."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["first"] + 1, s["size"])))
