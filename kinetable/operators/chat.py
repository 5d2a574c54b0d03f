"""Conversation validation and expansion for fine-tuning data (turn tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .chunks import by_chunk, chunked, core, halo

ROLES = ("system", "user", "assistant")
BLOCK = 64


def _with_previous_role(turns: DataFrame) -> DataFrame:
    wide = halo(turns, "turn", 1, 0)
    return core(wide.withColumn("_before", F.lag("role").over(by_chunk(["conv_id"], "turn")))).drop("_chunk")


def _error() -> Column:
    return (
        F.when(F.col("role").isNull() | ~F.col("role").isin(*ROLES), "unknown role")
        .when(F.col("text").isNull() | ~F.col("text").rlike(r"\S"), "no text")
        .when((F.col("role") == "assistant") & ~F.coalesce(F.col("_before") == "user", F.lit(False)),
              "answer without a question before it")
    )


def validate_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, error) for every broken turn."""
    return _with_previous_role(turns).select("conv_id", "turn", _error().alias("error")).where("error IS NOT NULL")


def empty_conversations(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    return conversations.join(turns, "conv_id", "left_anti").select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("no turns").alias("error")
    )


def valid_conversations(turns: DataFrame) -> DataFrame:
    """The turns of conversations without a broken turn."""
    broken = validate_turns(turns).select("conv_id").distinct()
    return turns.join(broken, "conv_id", "left_anti")


def expand_assistant_turns(turns: DataFrame) -> DataFrame:
    """One sample per assistant turn of a valid conversation: all turns before it as prompt, the turn itself as completion.

    Turns count from 0; a system turn may stand before them at -1.  A prompt holds all earlier turns by its meaning, so
    samples grow with the square of the turns of a conversation.

    Turns are packed into blocks of a few dozen; a sample asks for its blocks by an equi-join on
    (conversation, block) and is put together from them.  No task sees a whole conversation unless
    it is the prompt of one sample.
    """
    rows = _with_previous_role(turns).withColumn("_error", _error())
    broken = rows.where("_error IS NOT NULL").select("conv_id").distinct()
    # conversations without samples ask for no blocks, so only the targets are filtered
    targets = rows.where("role = 'assistant' AND _error IS NULL").join(broken, "conv_id", "left_anti").select(
        "conv_id", F.col("turn").alias("target"), F.col("text").alias("completion")
    )
    asked = targets.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.floor((F.col("target") - 1) / F.lit(BLOCK))))
    )
    blocks = (
        chunked(turns, "turn", BLOCK)
        .groupBy("conv_id", "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    )
    part = F.filter("_turns", lambda t: t["turn"] < F.col("target"))
    return (
        asked.join(blocks, ["conv_id", "_chunk"])
        .select("conv_id", "target", "completion", "_chunk", part.alias("_part"))
        .groupBy("conv_id", "target")
        .agg(
            F.first("completion").alias("completion"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_part"))), lambda b: b["_part"])).alias("prompt"),
        )
        .withColumnRenamed("target", "turn")
    )


def valid_questions(turns: DataFrame, question: str = "question_id") -> DataFrame:
    """Per conversation whether its question id was seen before and whether it ends with a user."""
    convs = turns.groupBy("conv_id", question).agg(F.max_by("role", "turn").alias("last_role"))
    first = convs.groupBy(question).agg(F.min("conv_id").alias("_first"))
    return convs.join(first, question).select(
        "conv_id", question,
        (F.col("conv_id") > F.col("_first")).alias("duplicate"),
        F.coalesce(F.col("last_role") == "user", F.lit(False)).alias("ends_with_user"),
    )


def prepend_system(turns: DataFrame, prompt: str) -> DataFrame:
    """A system turn -1 in front of every conversation."""
    heads = turns.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(heads)


def dataset_check(turns: DataFrame, dataset: str) -> DataFrame:
    """Assistant turns per dataset; a dataset without any is rejected."""
    return turns.groupBy(dataset).agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns")
    ).withColumn("usable", F.col("assistant_turns") > 0)
