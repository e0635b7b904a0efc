"""Translating sampled English conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from weftline import fixed_values as fixed
from weftline.functions.answers import with_message_list
from weftline.functions.text import TokenCounter, within_tokens
from weftline.functions.turns import map_roles, roles_known
from weftline.operators.exchange import attach, request_id, to_batch
from weftline.operators.sampling import sample_n
from weftline.plans import requests as ask
from weftline.sources.jsonl import freeze

JOB = "translations"


def english_sample(
    conversations: DataFrame, seed: int, n: int = fixed.TRANSLATION_ROWS, id_col: str = "conv_id"
) -> DataFrame:
    """Exactly ``n`` conversations detected as English; fewer are an error."""
    return sample_n(english_only(conversations), n, [id_col], seed, strict=True)


def english_only(rows: DataFrame, column: str = "langdetect") -> DataFrame:
    """Rows whose detected language is English."""
    return rows.filter(F.col(column) == "en")


def for_languages(conversations: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every conversation once per language to translate it into."""
    targets = F.array(*[F.lit(name) for name in names])
    return conversations.withColumn("lang_name", F.explode(targets))


def with_messages(conversations: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Source turns as ``messages``; conversations with an unknown role are left out.

    ``observation`` counts the conversations seen and those left out.
    """
    mapped = conversations.withColumn("messages", map_roles(F.col("conversations")))
    known = roles_known(F.col("messages"))
    if observation is not None:
        mapped = mapped.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~known).alias("unknown_role"),
        )
    return mapped.filter(known)


def token_limit(
    df: DataFrame, n: int = fixed.TRANSLATION_MAX_INPUT_TOKENS, counter: TokenCounter | None = None
) -> DataFrame:
    """Conversations of at most ``n`` tokens in the form they are sent in."""
    return df.filter(within_tokens(F.to_json("messages"), n, counter))


def translation_requests(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One request per conversation and ``lang_name``."""
    keyed = df.withColumns({"attempt": F.lit(0), "req_id": request_id(JOB, "lang_name", id_col)})
    return ask.translation_requests(keyed)


def translation_batch(requests: DataFrame, model: str, **settings) -> DataFrame:
    """Batch lines of translation requests, with the longer output that translations need."""
    longest = settings.pop("max_tokens", fixed.TRANSLATION_MAX_OUTPUT_TOKENS)
    return to_batch(requests, model, max_tokens=longest, **settings)


def english_requests(
    conversations: DataFrame,
    names: Sequence[str],
    path: str,
    seed: int,
    n: int = fixed.TRANSLATION_ROWS,
    limit: int = fixed.TRANSLATION_MAX_INPUT_TOKENS,
    id_col: str = "conv_id",
    counter: TokenCounter | None = None,
) -> DataFrame:
    """The head of the job: exact sample of the English conversations, frozen at ``path``, and
    requests for those within the token limit, one per language."""
    frozen = freeze(english_sample(conversations, seed, n, id_col), path)
    limited = token_limit(with_messages(frozen), limit, counter)
    return translation_requests(for_languages(limited, names), id_col)


def translated(
    requests: DataFrame, responses: DataFrame, python_literals: bool = True
) -> DataFrame:
    """Conversations with ``translated_messages_str`` and its parsed form."""
    answered = attach(requests.drop("prompt", "system_prompt"), responses)
    answered = answered.withColumnRenamed("response", "translated_messages_str").drop("reasoning")
    return with_message_list(
        answered, "translated_messages_str", "translated_messages", python_literals
    )
