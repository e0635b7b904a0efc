"""Request texts as projections: ``system_prompt`` and ``prompt`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.text import render

LANG = "lang_name"


def _lang() -> Column:
    return F.col(LANG)


def seed_topics(langs: DataFrame) -> DataFrame:
    """The 8 general and 8 language seeds of every language (``lang_name``), one row each."""
    general = [
        F.struct(F.lit("general").alias("branch"), F.lit(topic).alias("topic"))
        for topic in fixed.GENERAL_SEED_TOPICS
    ]
    target = [
        F.struct(F.lit("target").alias("branch"), render(topic, lang_name=_lang()).alias("topic"))
        for topic in fixed.TARGET_SEED_TOPICS
    ]
    return langs.select(LANG, F.inline(F.array(*general, *target)))


def topic_requests(df: DataFrame, n: Column | int) -> DataFrame:
    """Ask for ``n`` topics under ``topic``; ``target_lang`` adds the language clause if not null."""
    request = render(fixed.TOPIC_REQUEST, n=n, macrotopic=F.col("topic"))
    clause = render(fixed.TOPIC_LANGUAGE_CLAUSE, lang_name=F.col("target_lang"))
    return df.withColumns(
        {
            "system_prompt": F.lit(fixed.TOPIC_SYSTEM),
            "prompt": F.concat(request, F.coalesce(clause, F.lit(""))),
        }
    )


def topic_prompt_requests(
    df: DataFrame,
    n: Column | int = fixed.PROMPTS_PER_TOPIC,
    template: str = fixed.PROMPT_SYSTEM,
    min_n: int = 1,
    is_problem: Column | bool = False,
) -> DataFrame:
    """Ask for prompts (or problems) about ``topic``."""
    problem = is_problem if isinstance(is_problem, Column) else F.lit(is_problem)
    kind = F.when(problem, "problem").otherwise("prompt")
    ending = F.when(problem, fixed.TOPIC_PROBLEM_ENDING).otherwise(fixed.TOPIC_PROMPT_ENDING)
    request = render(
        fixed.TOPIC_PROMPT_REQUEST, min_n=min_n, n=n, lang_name=_lang(), kind=kind, topic=F.col("topic")
    )
    return df.withColumns(
        {"system_prompt": render(template, lang_name=_lang()), "prompt": F.concat(request, ending)}
    )


def scenario_requests(df: DataFrame, n: Column | int) -> DataFrame:
    """Ask for ``n`` scenarios: under ``scenario``, or the most popular ones where it is null."""
    seeded = render(fixed.SCENARIO_SEEDED, n=n, scenario=F.col("scenario"))
    unseeded = render(fixed.SCENARIO_UNSEEDED, n=n)
    clause = render(fixed.SCENARIO_LANGUAGE_CLAUSE, lang_name=F.col("target_lang"))
    request = F.concat(
        F.coalesce(seeded, unseeded), F.lit(fixed.SCENARIO_RULES), F.coalesce(clause, F.lit(""))
    )
    return df.withColumns({"system_prompt": F.lit(fixed.SCENARIO_SYSTEM), "prompt": request})


def scenario_prompt_requests(
    df: DataFrame,
    n: Column | int = fixed.PROMPTS_PER_SCENARIO,
    template: str = fixed.PROMPT_SYSTEM,
) -> DataFrame:
    request = render(
        fixed.SCENARIO_PROMPT_REQUEST, n=n, lang_name=_lang(), scenario=F.col("scenario")
    )
    return df.withColumns(
        {"system_prompt": render(template, lang_name=_lang()), "prompt": request}
    )


def context_prompt_requests(
    df: DataFrame,
    n: Column | int = fixed.PROMPTS_PER_TEXT,
    template: str = fixed.PROMPT_SYSTEM,
) -> DataFrame:
    """Ask for prompts about ``text`` with the task ``prompt_type``."""
    request = render(
        fixed.CONTEXT_PROMPT_REQUEST,
        n=n,
        lang_name=_lang(),
        text=F.col("text"),
        prompt_type=F.col("prompt_type"),
    )
    return df.withColumns(
        {"system_prompt": render(template, lang_name=_lang()), "prompt": request}
    )


def revision_requests(df: DataFrame, template: str = fixed.REVISION_SYSTEM) -> DataFrame:
    """Ask for a better ``initial_prompt``; rows with ``has_context`` carry their ``text``."""
    system = render(template, lang_name=_lang())
    with_context = F.concat(system, F.lit(fixed.REVISION_CONTEXT_CLAUSE))
    plain_request = render(fixed.REVISION_REQUEST, prompt=F.col("initial_prompt"))
    context_request = render(
        fixed.REVISION_CONTEXT_REQUEST, text=F.col("text"), prompt=F.col("initial_prompt")
    )
    return df.withColumns(
        {
            "system_prompt": F.when(F.col("has_context"), with_context).otherwise(system),
            "prompt": F.when(F.col("has_context"), context_request).otherwise(plain_request),
        }
    )


def translation_requests(df: DataFrame) -> DataFrame:
    """Ask for the translation of ``messages``, sent as JSON."""
    return df.withColumns(
        {
            "system_prompt": render(fixed.TRANSLATION_SYSTEM, lang_name=_lang()),
            "prompt": F.to_json("messages"),
        }
    )


def final_prompt(prompt: Column, revised: Column, text: Column, has_context: Column) -> Column:
    """The revised prompt if there is one, else the first one; context rows put their text before."""
    chosen = F.coalesce(revised, prompt)
    return F.when(has_context, F.concat(text, F.lit("\n\n"), chosen)).otherwise(chosen)


def answer_requests(df: DataFrame, template: str = fixed.ANSWER_SYSTEM) -> DataFrame:
    """``final_prompt`` and its system text; rows without a prompt are not asked."""
    return df.withColumns(
        {
            "final_prompt": final_prompt(
                F.col("prompt"), F.col("revised_prompt"), F.col("text"), F.col("has_context")
            ),
            "system_prompt": render(template, lang_name=_lang()),
        }
    )
