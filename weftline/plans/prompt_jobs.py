"""Revising a share of the prompts, and answering all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.answers import string_value, with_parsed_answer
from weftline.operators.exchange import attach, coalesce_update, one_answer, request_id
from weftline.operators.sampling import sample_frac
from weftline.plans import requests as ask

REVISION_JOB = "revisions"
ANSWER_JOB = "answers"


def revision_requests(
    prompts: DataFrame,
    seed: int,
    share: float = fixed.REVISED_SHARE,
    template: str = fixed.REVISION_SYSTEM,
) -> DataFrame:
    """Requests for ``share`` of the prompts of every language and subset.

    The share is of all rows; sampled rows without a prompt have nothing to revise.
    """
    sampled = sample_frac(prompts, share, ["prompt_id"], seed, by=["lang_name", "subset"])
    keyed = sampled.select(
        "prompt_id",
        "lang_name",
        "text",
        F.col("prompt").alias("initial_prompt"),
        (F.col("subset") == "contextual").alias("has_context"),
        F.lit(0).alias("attempt"),
        request_id(REVISION_JOB, "prompt_id").alias("req_id"),
    )
    return ask.revision_requests(keyed, template).filter(F.col("prompt").isNotNull())


def combine_revisions(prompts: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """All prompts with ``revised_prompt``: the new one, else one they had, else null."""
    answered = with_parsed_answer(attach(requests.select("req_id", "prompt_id"), responses), "response")
    revised = answered.select(
        "prompt_id", string_value(F.col("parsed"), "improved_prompt").alias("revised_prompt")
    )
    return coalesce_update(prompts, revised, "prompt_id", ["revised_prompt"])


def answer_requests(prompts: DataFrame, template: str = fixed.ANSWER_SYSTEM) -> DataFrame:
    """Requests for every prompt that has a final form; ``prompt`` holds that form."""
    placed = prompts.withColumn("has_context", F.col("subset") == "contextual")
    final = ask.answer_requests(placed, template).filter(F.col("final_prompt").isNotNull())
    return final.select(
        request_id(ANSWER_JOB, "prompt_id").alias("req_id"),
        "prompt_id",
        "lang_name",
        F.lit(0).alias("attempt"),
        "system_prompt",
        F.col("final_prompt").alias("prompt"),
    )


def combine_responses(
    prompts: DataFrame, responses: DataFrame, template: str = fixed.ANSWER_SYSTEM
) -> DataFrame:
    """All prompts with ``final_prompt``, ``system_prompt``, ``response``, ``reasoning``.

    The request id follows from the prompt id, so the answers are joined to the
    prompts themselves and the request table is not read again.  Of several answers to one
    request the same one counts as in ``attach``.
    """
    placed = prompts.withColumn("has_context", F.col("subset") == "contextual")
    final = ask.answer_requests(placed, template)
    final = final.withColumn("_key", request_id(ANSWER_JOB, "prompt_id"))
    answers = one_answer(responses).withColumnRenamed("req_id", "_key")
    return coalesce_update(final, answers, "_key", ["response", "reasoning"]).drop("_key")
