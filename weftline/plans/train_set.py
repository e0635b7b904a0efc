"""The training table: answered prompts and checked translations in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from weftline import fixed_values as fixed
from weftline.functions.text import TokenCounter
from weftline.functions.turns import (
    CHAT,
    ChatTemplate,
    alternates,
    chat_tokens,
    free_of,
    length_ratio_ok,
    reasoning_system,
    turns_match,
    two_turns,
    typed_messages,
    well_formed_messages,
    with_thinking,
)
from weftline.operators.sampling import shuffle

TRAINING = [
    "prompt_id",
    "conv_id",
    "lang_name",
    "topic",
    "scenario",
    "prompt_type",
    "num_tokens",
    "system",
    "messages",
]
PUBLISHED = ["generation_method", "prompt_type", "scenario", "topic", "system", "messages"]


def stack_subsets(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Subsets under each other; a column one of them lacks is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def require_subsets(prompts: DataFrame) -> None:
    """Topic and scenario prompts have to be there; contextual ones may be missing."""
    needed = ["topic", "scenario"]
    # at most one row for each that is needed, however many subsets there are
    found = prompts.filter(F.col("subset").isin(needed)).select("subset").distinct().collect()
    missing = set(needed) - {row["subset"] for row in found}
    if missing:
        raise ValueError(f"no prompts of subset {', '.join(sorted(missing))}")


def answered_rows(
    prompts: DataFrame,
    observation: Observation | None = None,
    counter: TokenCounter | None = None,
    template: ChatTemplate = CHAT,
) -> DataFrame:
    """Rows with prompt and response as two-turn ``messages``, without banned tokens.

    ``num_tokens`` counts the whole chat as ``template`` writes it.
    ``observation`` counts rows seen and rows lacking an answer or a reasoning.
    """
    if observation is not None:
        no_answer = F.col("final_prompt").isNull() | F.col("response").isNull()
        prompts = prompts.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(no_answer).alias("no_answer"),
            F.count_if(~no_answer & F.col("reasoning").isNull()).alias("no_reasoning"),
        )
    # checks on the two texts themselves, before any array is made of them
    final, response = F.col("final_prompt"), F.col("response")
    kept = prompts.filter(final.isNotNull() & response.isNotNull() & free_of(final) & free_of(response))
    turns = two_turns(final, response)
    return kept.withColumns({"messages": turns, "num_tokens": chat_tokens(turns, template, counter)})


def with_reasoning(
    df: DataFrame, start: str = fixed.TRAIN_THINK_START, end: str = fixed.TRAIN_THINK_END
) -> DataFrame:
    """Reasoning put before the response; rows without reasoning are left out."""
    said = with_thinking(F.col("reasoning"), F.col("response"), start, end)
    kept = df.filter(F.col("reasoning").isNotNull())
    return kept.withColumns(
        {
            "messages": two_turns(F.col("final_prompt"), said),
            "system": reasoning_system(start, end),
        }
    )


def generated_rows(
    prompts: DataFrame,
    observation: Observation | None = None,
    start: str = fixed.TRAIN_THINK_START,
    end: str = fixed.TRAIN_THINK_END,
    counter: TokenCounter | None = None,
    template: ChatTemplate = CHAT,
) -> DataFrame:
    return with_reasoning(answered_rows(prompts, observation, counter, template), start, end)


def translated_rows(
    translated: DataFrame,
    low: float = fixed.MIN_LENGTH_RATIO,
    high: float = fixed.MAX_LENGTH_RATIO,
    counter: TokenCounter | None = None,
) -> DataFrame:
    """Translations that are readable, well formed, complete and of plausible length.

    Cheap checks come first.  The typed messages leave a generator as a list of one or
    none, so they are built once per row; what cannot pass is gone before tokens
    are counted.
    """
    original, parsed = F.col("messages"), F.col("translated_messages")
    shaped = well_formed_messages(parsed) & turns_match(parsed, original)
    typed = F.array_compact(F.array(F.when(shaped, typed_messages(parsed))))
    rows = translated.select("*", F.explode(typed).alias("_typed")).drop("translated_messages")
    rows = rows.filter(alternates(F.col("_typed")))
    rows = rows.filter(length_ratio_ok(original, F.col("_typed"), low, high, counter))
    return (
        rows.drop("messages")
        .withColumnRenamed("_typed", "messages")
        .withColumn("system", F.lit(fixed.TRANSLATED_SYSTEM))
    )


def train_set(
    generated: DataFrame,
    translations: DataFrame,
    id_cols: list[str],
    seed: int,
    columns: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Both kinds of rows, in random order.

    Only ``columns`` travel through the shuffle, where given: working columns such as the
    single texts the messages were made of need not.
    """
    rows = stack_subsets(generated, translations)
    return shuffle(rows.select(*columns) if columns else rows, id_cols, seed, partitions)


def with_provenance(df: DataFrame) -> DataFrame:
    """``generation_method``, told by which columns are filled."""
    return df.withColumn(
        "generation_method",
        F.when(F.col("prompt_type").isNotNull(), "context")
        .when(F.col("scenario").isNotNull(), "scenario")
        .when(F.col("topic").isNotNull(), "topic")
        .otherwise("translated"),
    )


def published(df: DataFrame) -> DataFrame:
    return with_provenance(df).select(*PUBLISHED)
