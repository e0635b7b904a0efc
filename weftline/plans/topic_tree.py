"""Topics: seeds, macrotopics, topics, prompts — for all languages in one job.

A round is a pair of functions around the exchange with the teacher.  Levels are
0 (seeds), 1 (macrotopics) and 2 (topics); branch ``general`` asks without,
``target`` with the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.answers import string_list, string_or_list, with_parsed_answer
from weftline.operators.explode import explode_strings
from weftline.operators.sampling import with_hash_index
from weftline.operators.exchange import attach, request_id
from weftline.plans import requests as ask

TOPIC_JOB = "topics"
PROMPT_JOB = "topic_prompts"


def seeds(langs: DataFrame) -> DataFrame:
    """Level 0 topics (``lang_name, branch, level, topic_id, topic``)."""
    topics = ask.seed_topics(langs).withColumn("level", F.lit(0))
    return topics.withColumn("topic_id", request_id("seed", "lang_name", "branch", "topic"))


def topics_wanted(
    general: tuple[int, int] = (fixed.GENERAL_MACROTOPICS, fixed.GENERAL_TOPICS),
    target: tuple[int, int] = (fixed.TARGET_MACROTOPICS, fixed.TARGET_TOPICS),
) -> Column:
    """How many topics to ask for, by branch and level."""
    is_seed = F.col("level") == 0
    return F.when(
        F.col("branch") == "general", F.when(is_seed, general[0]).otherwise(general[1])
    ).otherwise(F.when(is_seed, target[0]).otherwise(target[1]))


def topic_requests(topics: DataFrame, n: Column | int | None = None) -> DataFrame:
    keyed = topics.withColumns(
        {
            "target_lang": F.when(F.col("branch") == "target", F.col("lang_name")),
            "attempt": F.lit(0),
            "req_id": request_id(TOPIC_JOB, "topic_id"),
        }
    )
    return ask.topic_requests(keyed, topics_wanted() if n is None else n)


def grow(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Topics of the next level; duplicates stay, other entries than strings go."""
    answered = with_parsed_answer(attach(requests, responses), "response")
    found = explode_strings(answered, string_list(F.col("parsed"), "topics"), "found")
    return found.select(
        "lang_name",
        "branch",
        F.col("found").alias("topic"),
        (F.col("level") + 1).alias("level"),
        request_id("topic", "topic_id", "pos").alias("topic_id"),
    )


def distinct_topics(*levels: DataFrame) -> DataFrame:
    """``lang_name, topic`` of all levels and branches, each once."""
    return _stack(*levels).select("lang_name", "topic").distinct()


def _stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def prompt_requests(
    topics: DataFrame, n: int = fixed.PROMPTS_PER_TOPIC, template: str = fixed.PROMPT_SYSTEM, seed: int = 0
) -> DataFrame:
    """Requests for prompts, one per topic; ``index`` numbers the topics of a language from 0, in random order."""
    numbered = with_hash_index(topics, ["topic"], seed, "index", by=["lang_name"])
    keyed = numbered.withColumns(
        {"attempt": F.lit(0), "req_id": request_id(PROMPT_JOB, "lang_name", "topic")}
    )
    return ask.topic_prompt_requests(keyed, n, template)


def topic_prompts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts per topic; a topic without a usable answer keeps one row with a null prompt."""
    answered = with_parsed_answer(attach(requests.drop("prompt"), responses), "response")
    rows = explode_strings(answered, string_or_list(F.col("parsed"), "prompts"), "prompt", outer=True)
    return rows.select(
        request_id("prompt", "req_id", "pos").alias("prompt_id"),
        F.lit("topic").alias("subset"),
        "lang_name",
        "index",
        "topic",
        "prompt",
    )
