"""Chat formatting with Spark expressions only, and reading the formatted text back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT, LINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|im_line|>"


def escape(text: Column) -> Column:
    """``text`` without any control string: each ``<|`` gets one backslash inside, and each that has
    backslashes inside already gets one more, so that ``unescape`` gives every text back."""
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<\\")), F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")).otherwise(text)


def format_chats(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss_spans``, the (start, length) in code points
    of each text of role ``learn`` in it. Start counts from 0.

    The turns of a conversation are collected as structs and sorted. Adjacent turns of one role
    become one block ``<|im_start|>role\\ntext<|im_end|>\\n`` whose texts are parted by
    ``<|im_next|>``, so that the turns can be read back one by one. Texts and roles are escaped; a
    line break in a role is written as ``<|im_line|>``.

    A NULL text or role reads as empty. A NULL turn number sorts first, equal numbers by role, then
    text; repeated rows stay repeated turns. Rows with a NULL conversation form one conversation.
    Other columns are not read. An empty table gives an empty table. The turns of one conversation
    meet in one row, as its text has to.
    """
    turns = F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))))
    rows = df.groupBy(F.col(conversation)).agg(turns.alias("turns"))
    # The places where a role begins, with the number of turns behind them as the last one.
    begins = F.expr("""concat(filter(sequence(0, size(turns) - 1),
        i -> i = 0 or turns[i].role <> turns[greatest(i - 1, 0)].role), array(size(turns)))""")
    rows = rows.withColumn("begins", begins)
    blocks = F.transform(F.sequence(F.lit(0), F.size("begins") - 2), lambda b: F.struct(
        F.get(F.col("turns"), F.get("begins", b))["role"].alias("role"),
        F.transform(
            F.slice("turns", F.get("begins", b) + 1, F.get("begins", b + 1) - F.get("begins", b)),
            lambda t: escape(t["text"])).alias("texts")))
    rows = rows.select(conversation, blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    tail = F.lit(END + "\n")
    whole = F.array_join(F.transform(
        "blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), tail)), "")
    # All pieces in order with their length; those of role ``learn`` are kept with their start.
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.length(head(b)).alias("n"), F.lit(False).alias("learned"))),
        F.flatten(F.transform(b["texts"], lambda t, i: F.concat(
            F.when(i > 0, F.array(F.struct(F.lit(len(NEXT)).alias("n"), F.lit(False).alias("learned")))).otherwise(
                F.filter(F.array(F.struct(F.lit(0).alias("n"), F.lit(False).alias("learned"))), lambda _: F.lit(False))),
            F.array(F.struct(F.length(t).alias("n"), (b["role"] == F.lit(learn)).alias("learned")))))),
        F.array(F.struct(F.lit(len(END) + 1).alias("n"), F.lit(False).alias("learned"))))))
    none = "cast(array() as array<struct<start:int,length:int>>)"
    spans = F.aggregate(
        pieces, F.expr(f"struct(0 as at, {none} as spans)"),
        lambda s, p: F.struct((s["at"] + p["n"]).alias("at"), F.when(p["learned"], F.concat(
            s["spans"], F.array(F.struct(s["at"].alias("start"), p["n"].alias("length"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return rows.select(conversation, whole.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn, read from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    body = lambda b: F.substring(b, F.locate("\n", b) + 1, F.length(b))
    role = lambda b: unescape(F.replace(
        F.substring(b, F.lit(len(START) + 1), F.locate("\n", b) - len(START) - 1), F.lit(LINE), F.lit("\n")))
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(body(b), r"<\|im_next\|>", -1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
