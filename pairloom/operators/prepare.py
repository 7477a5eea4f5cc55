"""Training records, exact splits and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.fixed_values import CHARS_PER_TOKEN
from pairloom.functions.prompts import chat_text, training_completion, training_prompt

CONVERSATION_SPAN = 64


def metadata() -> Column:
    return F.struct(
        F.col("resume_id").cast("bigint").alias("resume_id"),
        F.col("job_id").cast("bigint").alias("job_id"),
        F.col("similarity_score").cast("double").alias("similarity_score"),
    ).alias("metadata")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def training_records(examples: DataFrame, form: str = "instruction", keep: tuple[str, ...] = ()) -> DataFrame:
    """Instruction records ``(instruction, output, metadata)`` or chat records
    ``(messages, metadata)``, plus carried columns."""
    if form == "instruction":
        columns = [training_prompt().alias("instruction"), training_completion().alias("output")]
    elif form == "chat":
        columns = [
            F.array(
                _message("user", training_prompt()), _message("assistant", training_completion())
            ).alias("messages")
        ]
    else:
        raise ValueError(f"unknown form: {form}")
    return examples.select(*columns, metadata(), *keep)


def chat_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    span: int = CONVERSATION_SPAN,
) -> DataFrame:
    """Records of whole conversations: ``(<id_col>, part, messages, answered)``.

    A record holds the messages of ``span`` turn numbers in a row, so a conversation of any length is cut
    into records of bounded size by its turn numbers alone, and no task gathers more than that.
    Messages stand in order of turn, then role and text. Neighbours of one role become one message, with a blank
    line between, so that roles alternate. Turns without text or role carry nothing and are left out;
    all others are kept, answered or not. ``answered``: the first message that is not the system's is
    the user's, and the last is the assistant's. Turns of a null conversation make records of their own, by
    turn; turns without a number come first, in part null.
    """
    part = F.floor(F.col(turn_col) / span).cast("bigint")
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    kept = turns.filter((F.length(text_col) > 0) & (F.length(role_col) > 0))
    ordered = kept.groupBy(F.col(id_col), part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def joined(messages: Column, x: Column) -> Column:
        last = F.try_element_at(messages, F.lit(-1))
        both = F.struct(x["role"].alias("role"), F.concat(last["content"], F.lit("\n\n"), x["content"]).alias("content"))
        own = F.struct(x["role"].alias("role"), x["content"].alias("content"))
        return F.when(
            last["role"] == x["role"],
            F.concat(F.slice(messages, F.lit(1), F.size(messages) - 1), F.array(both)),
        ).otherwise(F.concat(messages, F.array(own)))

    none = F.array().cast("array<struct<role: string, content: string>>")
    records = ordered.select(id_col, "part", F.aggregate("turns", none, joined).alias("messages"))
    spoken = F.filter("messages", lambda m: m["role"] != "system")
    answered = (F.get(spoken, F.lit(0))["role"] == "user") & (F.element_at("messages", -1)["role"] == "assistant")
    return records.withColumn("answered", F.coalesce(answered, F.lit(False)))


def chat_texts(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Instruction records as one tagged chat text each."""
    return records.select(chat_text(F.col("instruction"), F.col("output")).alias("text"), *keep)


def split_counts(split_df: DataFrame, total: Column | None = None) -> DataFrame:
    """Rows per split and their percentage."""
    counts = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("examples"))
    if total is None:
        total = counts.agg(F.sum("examples")).scalar()
    return counts.withColumn(
        "percentage", F.try_divide(F.col("examples").cast("double"), total.cast("double")) * 100
    )


def length_stats(examples: DataFrame) -> DataFrame:
    """Prompt and completion lengths and the token estimate, in one pass.

    The generator keeps each text from being built once per aggregate.
    """
    lengths = F.struct(
        F.length(training_prompt()).alias("prompt"),
        F.length(training_completion()).alias("completion"),
    )
    prompt_tokens = F.avg("prompt") / CHARS_PER_TOKEN
    completion_tokens = F.avg("completion") / CHARS_PER_TOKEN
    return examples.select(F.inline(F.array(lengths))).agg(
        F.count(F.lit(1)).alias("examples"),
        F.avg("prompt").alias("prompt_mean"), F.min("prompt").alias("prompt_min"),
        F.max("prompt").alias("prompt_max"),
        F.avg("completion").alias("completion_mean"), F.min("completion").alias("completion_min"),
        F.max("completion").alias("completion_max"),
        prompt_tokens.alias("prompt_tokens"), completion_tokens.alias("completion_tokens"),
        (prompt_tokens + completion_tokens).alias("total_tokens"),
    )
