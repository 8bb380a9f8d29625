"""Turn tables: merged turns and the last turn of a role."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_text


def merge_turns(turns: DataFrame) -> DataFrame:
    """Consecutive turns of one role as one, their texts joined by a newline (null counts as empty)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    change = (~F.lag("role").over(w).eqNullSafe(F.col("role"))).cast("int")
    island = F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = turns.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("change", change).withColumn("island", island)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return parts.groupBy("conv_id", "island", "role").agg(F.count(F.lit(1)).alias("turns"), joined.alias("text"))


def final_turn(turns: DataFrame, role: str) -> DataFrame:
    """The text of the last turn of a role; empty where a conversation has none."""
    last = F.max(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return turns.groupBy("conv_id").agg(F.coalesce(last["text"], F.lit("")).alias("text"))


def final_reasoning(turns: DataFrame, role: str = "assistant", reasoning: str = "reasoning") -> DataFrame:
    """The reasoning of the last turn of a role, ``conv_id, reasoning``; empty where that turn has none, whatever earlier turns hold."""
    last = F.max(F.when(F.col("role") == role, F.struct("turn", F.coalesce(reasoning, F.lit("")).alias("r"))))
    return turns.groupBy("conv_id").agg(F.coalesce(last["r"], F.lit("")).alias("reasoning"))


def has_roles(turns: DataFrame, roles: list[str], most_chars: int | None = None, of: str = "system") -> DataFrame:
    """``conv_id`` of the conversations whose turns have exactly these roles in this order, the texts of one role at most ``most_chars`` long together.

    Turns of equal number are ordered by role. Conversations of another number of turns go before any turn is gathered, so what
    is gathered has ``len(roles)`` entries.
    """
    n = F.count(F.lit(1)).alias("n")
    length = F.coalesce(F.sum(F.when(F.col("role") == of, F.length("text"))), F.lit(0))
    right = turns.groupBy("conv_id").agg(n, length.alias("chars")).filter(F.col("n") == len(roles))
    right = right if most_chars is None else right.filter(F.col("chars") <= most_chars)
    order = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"))))
    found = turns.join(right.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(order.alias("o"))
    return found.filter(F.transform("o", lambda x: x["role"]) == F.array(*[F.lit(r) for r in roles])).select("conv_id")


def render_dialogue(turns: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """``ROLE: text`` blocks of a conversation in order, blank lines between them."""
    kept = turns if roles is None else turns.filter(F.col("role").isin(roles))
    block = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))), lambda x: x["block"])
    return kept.groupBy("conv_id").agg(F.array_join(blocks, "\n\n").alias("dialogue"))


def text_views(turns: DataFrame, n: int, roles: list[str] | None = None, answer: str = "assistant", mode: str = "tail") -> DataFrame:
    """``conv_id, output, context, both``: the last turn of the answering role, the dialogue of the given roles before and without that turn,
    at most n characters of it by ``truncate_text``, and both with a blank line between them. Without an answer the output is empty.
    """
    kept = turns if roles is None else turns.filter(F.col("role").isin(*roles, answer))
    text = F.coalesce("text", F.lit(""))
    order = F.struct("turn", text.alias("text"))
    last = kept.groupBy("conv_id").agg(F.max(F.when(F.col("role") == answer, order)).alias("l"))
    before = kept.join(last, "conv_id").filter(F.col("l").isNull() | (F.col("turn") < F.col("l.turn")))
    before = before if roles is None or answer in roles else before.filter(F.col("role") != answer)
    dialogue = render_dialogue(before.select(*turns.columns)).withColumn("context", truncate_text(F.col("dialogue"), n, mode, "... "))
    output, context = F.coalesce("l.text", F.lit("")), F.coalesce("context", F.lit(""))
    return last.join(dialogue, "conv_id", "left").select("conv_id", output.alias("output"), context.alias("context"), F.concat_ws("\n\n", F.nullif(context, F.lit("")), F.nullif(output, F.lit(""))).alias("both"))


def filter_structure(turns: DataFrame, role: str, least_chars: int, least_sentences: int) -> DataFrame:
    """Conversations whose last turn of a role is long enough and has enough sentence ends."""
    ends = F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0)))
    return final_turn(turns, role).filter((F.length("text") >= least_chars) & (ends >= least_sentences)).select("conv_id", F.length("text").alias("chars"), ends.alias("ends"))


def expand_conditions(turns: DataFrame, role: str) -> DataFrame:
    """Each conversation as given, and without the turns of a role: one row per condition."""
    original = render_dialogue(turns).select("conv_id", F.lit("original").alias("condition"), "dialogue")
    removed = render_dialogue(turns.filter(F.col("role") != role)).select("conv_id", F.lit("removed").alias("condition"), "dialogue")
    return original.unionByName(removed)


def route(df: DataFrame, rules: list[tuple[str, str]], text: str) -> DataFrame:
    """The first rule whose pattern a text matches; ``none`` where no rule does."""
    name = F.lit("none")
    for label, pattern in reversed(rules):
        name = F.when(F.col(text).rlike(pattern), label).otherwise(name)
    return df.withColumn("route", name)
