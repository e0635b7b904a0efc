"""Web texts: sample, cut, deal out tasks, ask for prompts, choose among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.answers import string_list, string_or_list, with_parsed_answer
from weftline.functions.text import TokenCutter, truncate_tokens
from weftline.operators.exchange import attach, request_id
from weftline.operators.explode import explode_strings, pick_or_list
from weftline.operators.sampling import assign_round_robin, cap_rows, sample_n
from weftline.plans import requests as ask
from weftline.session import stored

JOB = "context_prompts"


def task_types(qa_weighting: int = fixed.QA_WEIGHTING) -> list[str]:
    return [*fixed.TASK_TYPES, *[fixed.QUESTION_TASK] * qa_weighting]


def context_requests(
    corpus: DataFrame,
    seed: int,
    num_contexts: int = fixed.NUM_CONTEXTS,
    first_n_tokens: int = fixed.FIRST_N_TOKENS,
    qa_weighting: int = fixed.QA_WEIGHTING,
    n: int = fixed.PROMPTS_PER_TEXT,
    template: str = fixed.PROMPT_SYSTEM,
    id_col: str = "doc_id",
    cutter: TokenCutter | None = None,
) -> DataFrame:
    """Requests for up to ``num_contexts`` texts per language of ``lang_name, <id>, text``.

    Texts are cut to ``first_n_tokens`` by ``cutter``, after the sample: a tokenizer sees the chosen texts only.  ``corpus_rows`` counts the language's corpus; the choice among the prompts depends on it.
    """
    sample = sample_n(
        corpus, num_contexts, [id_col], seed, by=["lang_name"], total_name="corpus_rows"
    )
    cut = sample.withColumn("text", truncate_tokens(F.col("text"), first_n_tokens, cutter))
    dealt = assign_round_robin(
        cut, task_types(qa_weighting), [id_col], seed, "prompt_type", by=["lang_name"]
    )
    keyed = dealt.withColumns({"attempt": F.lit(0), "req_id": request_id(JOB, "lang_name", id_col)})
    return ask.context_prompt_requests(keyed, n, template)


def context_prompts(
    requests: DataFrame,
    responses: DataFrame,
    seed: int,
    num_contexts: int = fixed.NUM_CONTEXTS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Prompts of the texts: one per text if the corpus is larger than ``num_contexts``.

    Otherwise all prompts, capped at ``num_contexts`` per language.  In the first case
    there are at most that many rows already, so one plan serves both.
    """
    answered = with_parsed_answer(attach(requests.drop("prompt"), responses), "response")
    parsed = F.col("parsed")
    listed = answered.select(
        "*",
        F.inline(
            F.array(
                F.struct(
                    string_or_list(parsed, "prompts").alias("prompts"),
                    string_list(parsed, "prompts").isNotNull().alias("is_list"),
                )
            )
        ),
    )
    offered = pick_or_list(
        F.col("prompts"), F.col("is_list"), F.col("corpus_rows"), num_contexts, ["req_id"], seed
    )
    exploded = explode_strings(listed, offered, "prompt", outer=True)
    rows = exploded.select(
        request_id("prompt", "req_id", "pos").alias("prompt_id"),
        "lang_name",
        "text",
        "prompt_type",
        "prompts",
        "prompt",
        *keep,
    )
    capped = cap_rows(stored(rows, "context-prompts"), num_contexts, ["prompt_id"], seed, by=["lang_name"])
    return capped.select(
        "prompt_id",
        F.lit("contextual").alias("subset"),
        "lang_name",
        "text",
        "prompt_type",
        "prompts",
        "prompt",
        *keep,
    )
