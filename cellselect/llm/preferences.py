"""Preference formatting: one prompt and two masked completions per pair of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as
the prompt; what follows becomes two completions whose trained spans are the assistant's words (and
the mark that ends them). Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = "<|im_start|>"
END = "<|im_end|>"


def turns(conversations: DataFrame, key: str = "conv_id", name: str = "turns") -> DataFrame:
    """(key, turns): each conversation's turns in order of (turn, role, text), null role and text as
    empty. A conversation becomes one row, as a training example has to."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (conversations.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_t"))
            .select(key, F.transform("_t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias(name)))


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    short = F.least(F.size(a), F.size(b))
    places = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
    other = F.filter(places, lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.coalesce(F.array_min(other) - 1, short)


def _segments(turn_list: Column, trained: str) -> Column:
    """(text, train) pieces: header, body with end mark, line break."""
    return F.flatten(F.transform(turn_list, lambda t: F.array(
        F.struct(F.concat(F.lit(HEAD), t.role, F.lit("\n")).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(t.text, F.lit(END)).alias("text"), (t.role == trained).alias("train")),
        F.struct(F.lit("\n").alias("text"), F.lit(False).alias("train")))))


def _text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def _spans(segments: Column) -> Column:
    """Trained character ranges [start, end) of the joined pieces."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, s):
        end = acc["at"] + F.length(s.text)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s.train, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """``pairs`` (pair_id, chosen array of (role, text), rejected likewise) → prompt, completions, masks.

    n_common counts the shared turns. ``chosen_spans`` / ``rejected_spans`` are the trained character
    ranges of each completion. Equal conversations give two empty completions; a null side counts as a
    conversation without turns. One row for each row; other columns are dropped.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    p = p.withColumn("n_common", _common(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    p = p.select("pair_id", "n_common", _segments(F.slice("c", F.lit(1), F.col("n_common")), trained).alias("head"),
                 _segments(rest(F.col("c")), trained).alias("cs"), _segments(rest(F.col("r")), trained).alias("rs"))
    return p.select("pair_id", "n_common", _text(F.col("head")).alias("prompt"),
                    _text(F.col("cs")).alias("chosen"), _spans(F.col("cs")).alias("chosen_spans"),
                    _text(F.col("rs")).alias("rejected"), _spans(F.col("rs")).alias("rejected_spans"))


def swapped_tails(conversations: DataFrame) -> DataFrame:
    """Preference pairs made of a plain conversation table: a conversation is chosen over itself with
    the second half of its turns taken from the conversation with the next id (none: cut short)."""
    own = turns(conversations)
    other = own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("other"))
    half = F.ceil(F.size("turns") / F.lit(2)).cast("int")
    tail = F.coalesce(F.slice("other", half + 1, F.greatest(F.size("other") - half, F.lit(0))),
                      F.array().cast("array<struct<role:string,text:string>>"))
    return own.join(other, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), half), tail).alias("rejected"))
