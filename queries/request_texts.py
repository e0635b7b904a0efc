"""Request texts: every kind of request over whole tables, compared by md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.inputs import (
    SQL_FINAL_PROMPTS,
    SQL_LANGUAGES,
    SQL_NAMED_PARTS,
    SQL_PROMPTS,
    SQL_SERIALISED,
    languages,
    named_parts,
    prompts,
    quoted,
    source_turns,
    sql_render,
    table,
    sql_tokens,
)
from queries.registry import query
from weftline import fixed_values as fixed
from weftline.functions.text import render
from weftline.functions.turns import chat_payload
from weftline.operators.turn_tables import gather_turns
from weftline.plans import requests as ask
from weftline.plans import translation


def _texts(df, *keys):
    return df.select(
        *keys, F.md5("system_prompt").alias("system_md5"), F.md5("prompt").alias("prompt_md5")
    )


_SEEDS = ", ".join(
    [f"('general', {quoted(t)})" for t in fixed.GENERAL_SEED_TOPICS]
    + [f"('target', {quoted(t)})" for t in fixed.TARGET_SEED_TOPICS]
)


@query(
    f"""SELECT lang_name, branch, replace(seed, '{{lang_name}}', lang_name) AS topic
    FROM ({SQL_LANGUAGES}) l, (VALUES {_SEEDS}) s(branch, seed)"""
)
def seed_topics(spark, sf_dir):
    return ask.seed_topics(languages(spark, sf_dir))


_PARTS = f"({SQL_NAMED_PARTS})"


@query(
    f"""SELECT p_partkey, md5({quoted(fixed.TOPIC_SYSTEM)}) AS system_md5,
    md5({sql_render(fixed.TOPIC_REQUEST, n="CASE branch WHEN 'general' THEN 20 ELSE 10 END", macrotopic='name')}
        || CASE branch WHEN 'target' THEN {sql_render(fixed.TOPIC_LANGUAGE_CLAUSE, lang_name='lang_name')} ELSE '' END)
    AS prompt_md5 FROM {_PARTS}"""
)
def topic_requests(spark, sf_dir):
    topics = named_parts(spark, sf_dir).withColumn("topic", F.col("name"))
    target = F.when(F.col("branch") == "target", F.col("lang_name"))
    n = F.when(F.col("branch") == "general", 20).otherwise(10)
    return _texts(ask.topic_requests(topics.withColumn("target_lang", target), n), "p_partkey")


@query(
    f"""SELECT p_partkey, md5({sql_render(fixed.PROMPT_SYSTEM, lang_name='lang_name')}) AS system_md5,
    md5({sql_render(fixed.TOPIC_PROMPT_REQUEST, min_n='1', n='3', lang_name='lang_name',
                    kind="CASE WHEN branch = 'target' THEN 'problem' ELSE 'prompt' END", topic='name')}
        || CASE WHEN branch = 'target' THEN {quoted(fixed.TOPIC_PROBLEM_ENDING)}
                ELSE {quoted(fixed.TOPIC_PROMPT_ENDING)} END) AS prompt_md5 FROM {_PARTS}"""
)
def topic_prompt_requests(spark, sf_dir):
    topics = named_parts(spark, sf_dir).withColumn("topic", F.col("name"))
    asked = ask.topic_prompt_requests(topics, is_problem=F.col("branch") == "target")
    return _texts(asked, "p_partkey")


@query(
    f"""SELECT p_partkey, md5({quoted(fixed.SCENARIO_SYSTEM)}) AS system_md5,
    md5(CASE WHEN p_partkey % 3 = 0 THEN {sql_render(fixed.SCENARIO_UNSEEDED, n='30')}
             ELSE {sql_render(fixed.SCENARIO_SEEDED, n='30', scenario='name')} END
        || {quoted(fixed.SCENARIO_RULES)}
        || CASE branch WHEN 'target' THEN {sql_render(fixed.SCENARIO_LANGUAGE_CLAUSE, lang_name='lang_name')} ELSE '' END)
    AS prompt_md5 FROM {_PARTS}"""
)
def scenario_requests(spark, sf_dir):
    parts = named_parts(spark, sf_dir).withColumns(
        {
            "scenario": F.when(F.col("p_partkey") % 3 != 0, F.col("name")),
            "target_lang": F.when(F.col("branch") == "target", F.col("lang_name")),
        }
    )
    return _texts(ask.scenario_requests(parts, 30), "p_partkey")


@query(
    f"""SELECT p_partkey, md5({sql_render(fixed.PROMPT_SYSTEM, lang_name='lang_name')}) AS system_md5,
    md5({sql_render(fixed.SCENARIO_PROMPT_REQUEST, n='5', lang_name='lang_name', scenario='name')}) AS prompt_md5
    FROM {_PARTS}"""
)
def scenario_prompt_requests(spark, sf_dir):
    scenarios = named_parts(spark, sf_dir).withColumn("scenario", F.col("name"))
    return _texts(ask.scenario_prompt_requests(scenarios), "p_partkey")


@query(
    f"""SELECT doc_id, md5({sql_render(fixed.PROMPT_SYSTEM, lang_name='lang')}) AS system_md5,
    md5({sql_render(fixed.CONTEXT_PROMPT_REQUEST, n='3', lang_name='lang', text='text', prompt_type='source')})
    AS prompt_md5 FROM documents"""
)
def context_prompt_requests(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumns(
        {"lang_name": F.col("lang"), "prompt_type": F.col("source")}
    )
    return _texts(ask.context_prompt_requests(documents), "doc_id")


_CONTEXT = "subset = 'contextual'"


@query(
    f"""SELECT doc_id, md5({sql_render(fixed.REVISION_SYSTEM, lang_name='lang_name')}
        || CASE WHEN {_CONTEXT} THEN {quoted(fixed.REVISION_CONTEXT_CLAUSE)} ELSE '' END) AS system_md5,
    md5(CASE WHEN {_CONTEXT} THEN {sql_render(fixed.REVISION_CONTEXT_REQUEST, text='text', prompt='prompt')}
             ELSE {sql_render(fixed.REVISION_REQUEST, prompt='prompt')} END) AS prompt_md5
    FROM ({SQL_PROMPTS})"""
)
def revision_requests(spark, sf_dir):
    asked = prompts(spark, sf_dir).withColumns(
        {"initial_prompt": F.col("prompt"), "has_context": F.col("subset") == "contextual"}
    )
    return _texts(ask.revision_requests(asked), "doc_id")


@query(
    f"""SELECT conv_id, lang_name, md5({sql_render(fixed.TRANSLATION_SYSTEM, lang_name='lang_name')}) AS system_md5,
    md5(payload) AS prompt_md5 FROM ({SQL_SERIALISED}), (VALUES ('Basque'), ('Javanese')) l(lang_name)
    WHERE {sql_tokens('payload')} <= 2048"""
)
def translation_requests(spark, sf_dir):
    source = gather_turns(source_turns(spark, sf_dir), fixed.TRANSLATION_MAX_INPUT_TOKENS)
    limited = translation.token_limit(translation.with_messages(source))
    asked = translation.translation_requests(translation.for_languages(limited, ["Basque", "Javanese"]))
    return _texts(asked, "conv_id", "lang_name")


@query(f"SELECT doc_id, md5(final_prompt) AS final_md5 FROM ({SQL_FINAL_PROMPTS}) WHERE final_prompt IS NOT NULL")
def final_prompt(spark, sf_dir):
    final = ask.final_prompt(
        F.col("prompt"), F.col("revised_prompt"), F.col("text"), F.col("subset") == "contextual"
    )
    rows = prompts(spark, sf_dir).withColumn("final_prompt", final)
    return rows.filter(F.col("final_prompt").isNotNull()).select("doc_id", F.md5("final_prompt").alias("final_md5"))


@query(
    f"""SELECT doc_id, 0 AS pos, 'system' AS role, md5({sql_render(fixed.ANSWER_SYSTEM, lang_name='lang')}) AS content_md5
    FROM documents
    UNION ALL SELECT doc_id, 1 AS pos, 'user' AS role, md5(text) AS content_md5 FROM documents"""
)
def chat_payload_(spark, sf_dir):
    system = render(fixed.ANSWER_SYSTEM, lang_name=F.col("lang"))
    payload = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(chat_payload(system, F.col("text"))).alias("pos", "message")
    )
    return payload.select(
        "doc_id", "pos", F.col("message.role").alias("role"), F.md5("message.content").alias("content_md5")
    )
