"""Scenarios: broad ones without a seed, detailed ones under them, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.answers import string_list, string_or_list, with_parsed_answer
from weftline.operators.exchange import attach, request_id, retry
from weftline.operators.explode import explode_strings
from weftline.operators.sampling import with_hash_index
from weftline.plans import requests as ask

SCENARIO_JOB = "scenarios"
PROMPT_JOB = "scenario_prompts"


def roots(langs: DataFrame) -> DataFrame:
    """Level 0: no scenario yet, one row per language and branch."""
    branches = F.array(F.lit("general"), F.lit("target"))
    rows = langs.select("lang_name", F.explode(branches).alias("branch"))
    return rows.withColumns(
        {
            "level": F.lit(0),
            "scenario": F.lit(None).cast("string"),
            "scenario_id": request_id("root", "lang_name", "branch"),
        }
    )


def scenarios_wanted() -> Column:
    """How many scenarios a request asks for: broad ones at the root, detailed ones below."""
    return F.when(F.col("level") == 0, fixed.BROAD_SCENARIOS).otherwise(fixed.DETAILED_SCENARIOS)


def scenario_requests(scenarios: DataFrame, n: Column | int | None = None) -> DataFrame:
    n = scenarios_wanted() if n is None else n
    keyed = scenarios.withColumns(
        {
            "target_lang": F.when(F.col("branch") == "target", F.col("lang_name")),
            "attempt": F.lit(0),
            "req_id": request_id(SCENARIO_JOB, "scenario_id"),
        }
    )
    return ask.scenario_requests(keyed, n)


def retry_broad(requests: DataFrame, responses: DataFrame, max_attempts: int) -> DataFrame:
    """Ask again where a broad request has no readable answer; detailed ones are not repeated."""
    broad = requests.filter(F.col("level") == 0)
    parsed = with_parsed_answer(attach(broad.select("req_id"), responses), "response")
    readable = parsed.filter(F.col("parsed").isNotNull() & ~F.is_variant_null("parsed"))
    return retry(broad, readable, SCENARIO_JOB, ["scenario_id"], max_attempts)


def grow(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Scenarios named in the answers, duplicates kept."""
    answered = with_parsed_answer(attach(requests, responses), "response")
    found = explode_strings(answered, string_list(F.col("parsed"), "scenarios"), "found")
    return found.select(
        "lang_name",
        "branch",
        (F.col("level") + 1).alias("level"),
        F.col("found").alias("scenario"),
        request_id("scenario", "scenario_id", "pos").alias("scenario_id"),
    )


def all_scenarios(*levels: DataFrame) -> DataFrame:
    """Scenarios of all levels and branches, duplicates kept."""
    first, *others = levels
    for other in others:
        first = first.unionByName(other)
    return first


def prompt_requests(
    scenarios: DataFrame, n: int = fixed.PROMPTS_PER_SCENARIO, template: str = fixed.PROMPT_SYSTEM, seed: int = 0
) -> DataFrame:
    """Requests for prompts, one per scenario; ``index`` numbers the scenarios of a language from 0, in random order."""
    numbered = with_hash_index(scenarios, ["scenario_id"], seed, "index", by=["lang_name"])
    keyed = numbered.withColumns(
        {"attempt": F.lit(0), "req_id": request_id(PROMPT_JOB, "scenario_id")}
    )
    return ask.scenario_prompt_requests(keyed, n, template)


def scenario_prompts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts per scenario; one row with a null prompt where there are none."""
    answered = with_parsed_answer(attach(requests.drop("prompt"), responses), "response")
    rows = explode_strings(answered, string_or_list(F.col("parsed"), "prompts"), "prompt", outer=True)
    return rows.select(
        request_id("prompt", "req_id", "pos").alias("prompt_id"),
        F.lit("scenario").alias("subset"),
        "lang_name",
        "index",
        "scenario",
        "prompt",
    )
