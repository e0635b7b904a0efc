"""Assembly of the training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.conversations import SQL_KEPT, translated_table
from queries.inputs import (
    SEED,
    SQL_FINAL_PROMPTS,
    SQL_REASONING,
    SQL_RESPONSE,
    answer_responses,
    new_folder,
    prompts,
    sql_render,
    quoted,
    sql_chat,
    sql_tokens,
)
from queries.registry import query
from weftline import fixed_values as fixed
from weftline.plans import prompt_jobs, train_set
from weftline.session import stored
from weftline.sources.jsonl import write_jsonl


def answered_prompts(spark, sf_dir):
    """Prompts of all subsets with their answers."""
    base = prompts(spark, sf_dir)
    return prompt_jobs.combine_responses(base, answer_responses(prompt_jobs.answer_requests(base)))


def stacked_prompts(spark, sf_dir):
    """The same from one table per subset, each with its own columns only."""
    answered = stored(answered_prompts(spark, sf_dir), "answered")
    shared = ["prompt_id", "subset", "lang_name", "final_prompt", "response", "reasoning"]
    contextual = answered.filter("subset = 'contextual'").select(*shared, "prompt_type")
    scenario = answered.filter("subset = 'scenario'").select(*shared, "scenario")
    topic = answered.filter("subset = 'topic'").select(*shared, "topic")
    return train_set.stack_subsets(contextual, scenario, topic)


SQL_ANSWERED = f"""
SELECT * FROM (SELECT *, {SQL_RESPONSE} AS response, {SQL_REASONING} AS reasoning FROM ({SQL_FINAL_PROMPTS}))
WHERE response IS NOT NULL AND NOT regexp_matches(final_prompt, '<(image|video|audio)>')
"""
SQL_WITH_REASONING = f"SELECT * FROM ({SQL_ANSWERED}) WHERE reasoning IS NOT NULL"
_SAID = sql_render("<think> {reasoning} </think> {response}", reasoning="reasoning", response="response")
_SYSTEM = quoted(fixed.REASONING_SYSTEM.format(start="<think>", end="</think>"))


@query(
    f"""SELECT prompt_id, topic, scenario, prompt_type, md5(final_prompt) AS user_md5, response AS assistant,
    CAST({sql_tokens(sql_chat("'user'", 'final_prompt') + ' || ' + sql_chat("'assistant'", 'response'))} AS BIGINT) AS num_tokens
    FROM ({SQL_ANSWERED})"""
)
def train_generated(spark, sf_dir):
    rows = train_set.answered_rows(stacked_prompts(spark, sf_dir))
    return rows.select(
        "prompt_id",
        "topic",
        "scenario",
        "prompt_type",
        F.md5(F.col("messages")[0]["content"]).alias("user_md5"),
        F.col("messages")[1]["content"].alias("assistant"),
        "num_tokens",
    )


@query(
    f"""SELECT prompt_id, md5(final_prompt) AS user_md5, {_SAID} AS assistant, {_SYSTEM} AS system
    FROM ({SQL_WITH_REASONING})"""
)
def reasoning_messages(spark, sf_dir):
    rows = train_set.generated_rows(answered_prompts(spark, sf_dir))
    return rows.select(
        "prompt_id",
        F.md5(F.col("messages")[0]["content"]).alias("user_md5"),
        F.col("messages")[1]["content"].alias("assistant"),
        "system",
    )


def full_train_set(spark, sf_dir):
    generated = train_set.generated_rows(answered_prompts(spark, sf_dir))
    translations = train_set.translated_rows(translated_table(spark, sf_dir))
    return train_set.train_set(
        generated, translations, ["prompt_id", "conv_id"], SEED, train_set.TRAINING
    )


SQL_TRAIN_SET = f"""
SELECT prompt_id, CAST(NULL AS BIGINT) AS conv_id, topic, scenario, prompt_type, {_SYSTEM} AS system,
       CAST(2 AS BIGINT) AS n_messages, md5('user:' || final_prompt || '|assistant:' || {_SAID}) AS messages_md5
FROM ({SQL_WITH_REASONING})
UNION ALL
SELECT NULL, c.conv_id, NULL, NULL, NULL, '{fixed.TRANSLATED_SYSTEM}', count(*),
       md5(string_agg(c.role || ':' || c.text || ' ok', '|' ORDER BY turn))
FROM conversations c JOIN ({SQL_KEPT}) k ON c.conv_id = k.conv_id GROUP BY c.conv_id
"""


def _flat_messages(df):
    lines = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return df.withColumns(
        {
            "n_messages": F.size("messages").cast("long"),
            "messages_md5": F.md5(F.array_join(lines, "|")),
        }
    )


@query(SQL_TRAIN_SET)
def train_set_(spark, sf_dir):
    """Written as JSON lines, as a trainer reads it, and read back."""
    path = new_folder(spark, "train")
    write_jsonl(full_train_set(spark, sf_dir), path, max_records=100_000)
    schema = (
        "prompt_id STRING, conv_id BIGINT, topic STRING, scenario STRING, prompt_type STRING, "
        "num_tokens BIGINT, system STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>"
    )
    rows = _flat_messages(spark.read.schema(schema).json(path))
    return rows.select(
        "prompt_id", "conv_id", "topic", "scenario", "prompt_type", "system", "n_messages", "messages_md5"
    )


@query(
    f"""SELECT generation_method, count(*) AS n_rows, CAST(sum(n_messages) AS BIGINT) AS n_messages FROM (
        SELECT *, CASE WHEN prompt_type IS NOT NULL THEN 'context' WHEN scenario IS NOT NULL THEN 'scenario'
                       WHEN topic IS NOT NULL THEN 'topic' ELSE 'translated' END AS generation_method
        FROM ({SQL_TRAIN_SET}))
    GROUP BY generation_method"""
)
def generation_method(spark, sf_dir):
    rows = _flat_messages(train_set.with_provenance(full_train_set(spark, sf_dir)))
    return rows.groupBy("generation_method").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_messages").alias("n_messages")
    )


@query(
    f"""SELECT CASE WHEN prompt_type IS NOT NULL THEN 'context' WHEN scenario IS NOT NULL THEN 'scenario'
                    WHEN topic IS NOT NULL THEN 'topic' ELSE 'translated' END AS generation_method,
    prompt_type, scenario, topic, system, messages_md5 FROM ({SQL_TRAIN_SET})"""
)
def published_set(spark, sf_dir):
    rows = _flat_messages(train_set.published(full_train_set(spark, sf_dir)))
    return rows.select("generation_method", "prompt_type", "scenario", "topic", "system", "messages_md5")
