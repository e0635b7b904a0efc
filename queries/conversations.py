"""Checks on conversations and their translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.inputs import (
    RUN_LANGUAGE,
    SQL_FINAL_PROMPTS,
    SQL_RESPONSE,
    SQL_SERIALISED,
    answer_responses,
    prompts,
    source_turns,
    sql_tokens,
    table,
    translation_responses,
)
from queries.registry import query
from weftline import fixed_values as fixed
from weftline.functions.answers import with_message_list
from weftline.functions.turns import (
    conversation_tokens,
    length_ratio_ok,
    map_role,
    no_banned_tokens,
    turns_match,
    two_turns,
    typed_messages,
    well_formed_messages,
)
from weftline.operators.turn_tables import check_turns, gather_turns
from weftline.plans import prompt_jobs, train_set, translation
from weftline.plans.requests import answer_requests

_LIMIT = fixed.TRANSLATION_MAX_INPUT_TOKENS


def translation_inputs(spark, sf_dir):
    """Conversations sent for translation: mapped, within the limit, with request ids."""
    source = gather_turns(source_turns(spark, sf_dir), _LIMIT)
    limited = translation.token_limit(translation.with_messages(source), _LIMIT)
    return translation.translation_requests(limited.withColumn("lang_name", F.lit(RUN_LANGUAGE)))


def translated_table(spark, sf_dir, python_literals=True):
    requests = translation_inputs(spark, sf_dir)
    return translation.translated(requests, translation_responses(requests), python_literals)


SQL_SENT = f"SELECT conv_id, n_turns, payload FROM ({SQL_SERIALISED}) WHERE {sql_tokens('payload')} <= {_LIMIT}"

SQL_VALID = f"""
SELECT conv_id, count(*) AS n_turns, CAST(sum({sql_tokens('text')}) AS BIGINT) AS n_tokens,
       bool_and(role = CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END AND text IS NOT NULL) AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
GROUP BY conv_id
"""


@query(SQL_VALID)
def valid_conversations(spark, sf_dir):
    return check_turns(table(spark, sf_dir, "conversations"))


@query(
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS role,
    md5(text) AS content_md5 FROM conversations"""
)
def role_map(spark, sf_dir):
    return source_turns(spark, sf_dir).select(
        "conv_id", "turn", map_role(F.col("role")).alias("role"), F.md5("text").alias("content_md5")
    )


@query(f"SELECT conv_id, n_turns FROM ({SQL_SERIALISED}) WHERE {sql_tokens('payload')} <= 300")
def token_limit(spark, sf_dir):
    source = translation.with_messages(gather_turns(source_turns(spark, sf_dir), 300))
    return translation.token_limit(source, 300).select(
        "conv_id", F.size("messages").cast("long").alias("n_turns")
    )


@query(
    f"""SELECT prompt_id, CAST({sql_tokens('final_prompt')} + {sql_tokens('response')} AS BIGINT) AS num_tokens
    FROM (SELECT *, {SQL_RESPONSE} AS response FROM ({SQL_FINAL_PROMPTS})) WHERE response IS NOT NULL"""
)
def conversation_tokens_(spark, sf_dir):
    base = prompts(spark, sf_dir)
    answered = prompt_jobs.combine_responses(base, answer_responses(prompt_jobs.answer_requests(base)))
    rows = answered.filter(F.col("response").isNotNull())
    messages = two_turns(F.col("final_prompt"), F.col("response"))
    return rows.select("prompt_id", conversation_tokens(messages).alias("num_tokens"))


@query(
    f"""SELECT prompt_id, md5(final_prompt) AS final_md5 FROM ({SQL_FINAL_PROMPTS})
    WHERE final_prompt IS NOT NULL AND NOT contains(final_prompt, '<image>')
      AND NOT contains(final_prompt, '<video>') AND NOT contains(final_prompt, '<audio>')"""
)
def bad_token_filter(spark, sf_dir):
    placed = prompts(spark, sf_dir).withColumn("has_context", F.col("subset") == "contextual")
    final = answer_requests(placed).filter(F.col("final_prompt").isNotNull())
    clean = final.filter(no_banned_tokens(two_turns(F.col("final_prompt"), F.lit("fine"))))
    return clean.select("prompt_id", F.md5("final_prompt").alias("final_md5"))


@query(
    f"""SELECT c.conv_id, count(*) AS n_messages, md5(string_agg(c.role || ':' || c.text ||
        CASE WHEN c.conv_id % 4 = 3 THEN ' \\(x\\)' ELSE '' END, '|' ORDER BY turn)) AS messages_md5
    FROM conversations c JOIN ({SQL_SENT}) k ON c.conv_id = k.conv_id GROUP BY c.conv_id"""
)
def message_list_literals(spark, sf_dir):
    """Translations written as Python, by ``conv_id % 4``: a tuple, a trailing comma, adjacent strings, a formula."""
    k = F.col("conv_id") % 4

    def literal(text):
        for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(raw), F.lit(escaped))
        return F.concat(F.lit("'"), text, F.lit("'"))

    def written(message):
        content = message["content"]
        half = (F.length(content) / 2).cast("int")
        tail = F.substring(content, half + 1, F.length(content))
        formula = F.concat(F.substring(literal(content), F.lit(1), F.length(literal(content)) - 1), F.lit(" \\(x\\)'"))
        adjacent = F.concat_ws(" ", literal(F.substring(content, F.lit(1), half)), literal(tail))
        value = F.when(k == 2, adjacent).when(k == 3, formula).otherwise(literal(content))
        return F.concat(F.lit("{'role': "), literal(message["role"]), F.lit(", 'content': "), value, F.lit("}"))

    body = F.array_join(F.transform("messages", written), ", ")
    tuples = F.concat(F.lit("("), body, F.lit(",)"))
    answer = F.when(k == 0, tuples).otherwise(F.concat(F.lit("["), body, F.when(k == 1, ",").otherwise(""), F.lit("]")))
    answers = translation_inputs(spark, sf_dir).select("conv_id", answer.alias("answer"))
    found = with_message_list(answers, "answer", "found").filter(well_formed_messages(F.col("found")))
    lines = F.transform(typed_messages(F.col("found")), lambda m: F.concat_ws(":", m["role"], m["content"]))
    return found.select(
        "conv_id",
        F.size("found").cast("long").alias("n_messages"),
        F.md5(F.array_join(lines, "|")).alias("messages_md5"),
    )


@query(
    f"""SELECT conv_id, conv_id % 16 <> 0 AS same_turns FROM ({SQL_SENT})
    WHERE conv_id % 16 NOT IN (4, 5, 6, 7)"""
)
def turn_count_match(spark, sf_dir):
    rows = translated_table(spark, sf_dir).filter(well_formed_messages(F.col("translated_messages")))
    return rows.select(
        "conv_id", turns_match(F.col("messages"), F.col("translated_messages")).alias("same_turns")
    )


@query(
    f"""SELECT conv_id, conv_id % 16 NOT IN (1, 2) AS ratio_ok FROM ({SQL_SENT})
    WHERE conv_id % 16 NOT IN (4, 5, 6, 7)"""
)
def turn_length_ratio(spark, sf_dir):
    rows = translated_table(spark, sf_dir).filter(well_formed_messages(F.col("translated_messages")))
    typed = rows.withColumn("typed", typed_messages(F.col("translated_messages")))
    return typed.select("conv_id", length_ratio_ok(F.col("messages"), F.col("typed")).alias("ratio_ok"))


SQL_KEPT = f"""
SELECT s.conv_id, s.n_turns FROM ({SQL_SENT}) s JOIN ({SQL_VALID}) v ON s.conv_id = v.conv_id
WHERE v.valid AND s.conv_id % 16 >= 8
"""


@query(
    f"""SELECT c.conv_id, count(*) AS n_messages, md5(string_agg(c.role || ':' || c.text || ' ok', '|' ORDER BY turn)) AS messages_md5,
    '{fixed.TRANSLATED_SYSTEM}' AS system
    FROM conversations c JOIN ({SQL_KEPT}) k ON c.conv_id = k.conv_id GROUP BY c.conv_id"""
)
def train_translated(spark, sf_dir):
    rows = train_set.translated_rows(translated_table(spark, sf_dir))
    lines = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return rows.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.md5(F.array_join(lines, "|")).alias("messages_md5"),
        "system",
    )
