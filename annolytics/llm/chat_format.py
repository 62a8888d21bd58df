"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged with
array functions, and everything is concatenated to one training text with its loss spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template.  A merged message is OPEN role BODY text (NEXT text)* CLOSE.
OPEN, BODY, NEXT, CLOSE = "<s>[INST]", "[/INST]", "<|next|>", "</s>"
# Strings that mean something to the template or to common chat readers.  In a text each becomes
# the mark and a digit; the mark itself becomes the mark and 0.  No control string begins with the
# tail of another, so an escaped text next to a control string cannot form a new one.
CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]", "<|next|>", "<<SYS>>", "<</SYS>>")
MARK = "\\"


def escape(text: Column) -> Column:
    marked = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    steps = enumerate(CONTROLS, start=1)
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(f"{MARK}{x[0]}")), steps, marked)


def unescape(text: Column) -> Column:
    steps = enumerate(CONTROLS, start=1)
    plain = reduce(lambda c, x: F.replace(c, F.lit(f"{MARK}{x[0]}"), F.lit(x[1])), steps, text)
    return F.replace(plain, F.lit(MARK + "0"), F.lit(MARK))


def merge_adjacent(turns: Column) -> Column:
    """array<struct<role, texts>>: runs of one role become one message with all their texts.

    A run starts where the role differs from the one before.  Each run is a slice between two
    starts, so the work is linear in the number of turns.
    """
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1)
        | (F.element_at(turns, i.cast("int"))["role"]
           != F.element_at(turns, F.greatest(i - 1, F.lit(1)).cast("int"))["role"]),
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n + 1))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda r: F.struct(
            F.element_at(turns, r["a"].cast("int"))["role"].alias("role"),
            F.transform(F.slice(turns, r["a"], r["b"] - r["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def in_blocks(items: Column) -> Column:
    """An array in slices of about the square root of its size; no slices of an empty one.  `items`
    should be a column, not an expression, as every slice refers to it."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.greatest(size, F.lit(1))), lambda i: i <= F.size(items))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def format_chats(
    rows: DataFrame, id_column: str = "conv_id", learn_from: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: its id, formatted, loss_spans (start, length in code points).

    `rows` has `turn`, `role` and `text`.  Turns are ordered by turn, then role and text, nulls
    first; rows alike in all three stay as several turns.  Null roles and texts count as empty, a
    null id is a conversation of its own, other columns are ignored, and no rows give no rows.
    The loss covers the texts of the roles in `learn_from`, not the strings around them.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(F.col(id_column).alias("_id")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    messages = turns.select("_id", merge_adjacent(F.col("turns")).alias("messages"))

    def message(m: Column) -> Column:
        texts = F.transform(m["texts"], escape)
        return F.concat(F.lit(OPEN), escape(m["role"]), F.lit(BODY), F.array_join(texts, NEXT), F.lit(CLOSE))

    formatted = F.array_join(F.transform("messages", message), "")

    # Pieces of the output in order, as (length, counts for the loss): running sums give the spans.
    def pieces(m: Column) -> Column:
        learn = m["role"].isin(*learn_from)
        head = F.struct(
            F.length(F.concat(F.lit(OPEN + BODY), escape(m["role"]))).alias("n"), F.lit(False).alias("loss")
        )
        body = F.flatten(F.transform(m["texts"], lambda t: F.array(
            F.struct(F.length(escape(t)).alias("n"), learn.alias("loss")),
            F.struct(F.lit(len(NEXT)).alias("n"), F.lit(False).alias("loss")),
        )))
        body = F.slice(body, F.lit(1), F.size(body) - 1)
        tail = F.struct(F.lit(len(CLOSE)).alias("n"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), body, F.array(tail))

    cut = messages.select(
        "_id", formatted.alias("formatted"), F.flatten(F.transform("messages", pieces)).alias("pieces")
    )
    # Appending to an array copies it, so spans are gathered in blocks and the blocks joined at the end.
    def step(acc: Column, p: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), p["n"].alias("length"))
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    none = F.array().cast("array<struct<start:int,length:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,length:int>>>").alias("blocks"))

    def block(acc: Column, part: Column) -> Column:
        ends = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.struct(ends["at"].alias("at"), F.concat(acc["blocks"], F.array(ends["spans"])).alias("blocks"))

    spans = F.flatten(F.aggregate(in_blocks(F.col("pieces")), zero, block)["blocks"])
    return cut.select(F.col("_id").alias(id_column), "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text, as they were before merging."""
    blocks = F.split(formatted, r"</s>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(OPEN) + 1)), r"\[/INST\]")
        role = unescape(F.element_at(parts, 1))
        texts = F.split(F.element_at(parts, 2), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_texts(formatted: Column, spans: Column) -> Column:
    """array<string>: what the loss mask covers, span by span, unescaped.

    Finding a place in a text takes time in proportion to the place, so a block of spans is cut out
    as one stretch first, and its spans from there.
    """
    def stretch(part: Column) -> Column:
        first, last = F.element_at(part, 1), F.element_at(part, -1)
        length = last["start"] + last["length"] - first["start"]
        return F.struct(
            part.alias("spans"), first["start"].alias("start"), F.substr(formatted, first["start"] + 1, length).alias("text")
        )

    return F.flatten(F.transform(
        F.transform(in_blocks(spans), stretch),
        lambda x: F.transform(
            x["spans"], lambda s: unescape(F.substr(x["text"], s["start"] - x["start"] + 1, s["length"]))
        ),
    ))
