"""Parsing of teacher answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.inputs import (
    RUN_LANGUAGE,
    SQL_SERIALISED,
    list_answer,
    raw_answer,
    source_turns,
    sql_list,
    sql_tokens,
    table,
    translation_responses,
)
from queries.registry import query
from weftline import fixed_values as fixed
from weftline.functions.answers import (
    finish_gate,
    single_output,
    split_reasoning,
    string_list,
    string_or_list,
    with_parsed_answer,
)
from weftline.operators.explode import explode_strings
from weftline.operators.sampling import with_row_index
from weftline.operators.turn_tables import gather_turns
from weftline.plans import translation


def _answers(spark, sf_dir, key):
    return table(spark, sf_dir, "documents").select(
        "doc_id", list_answer("doc_id", key).alias("answer")
    )


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (0, 1, 4) THEN 1 ELSE 0 END AS readable,
    array_to_string({sql_list('doc_id', lone=True)}, '|') AS prompts FROM documents"""
)
def parse_answer(spark, sf_dir):
    parsed = with_parsed_answer(_answers(spark, sf_dir, "prompts"), "answer")
    return parsed.select(
        "doc_id",
        F.col("parsed").isNotNull().cast("int").alias("readable"),
        F.array_join(string_or_list(F.col("parsed"), "prompts"), "|").alias("prompts"),
    )


@query(
    """SELECT doc_id,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'r' || doc_id END AS reasoning,
       CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS has_response,
       CASE WHEN doc_id % 7 <> 0 AND doc_id % 10 = 0 THEN 'nothing'
            WHEN doc_id % 7 <> 0 AND doc_id % 10 = 1 THEN 'not json' END AS plain_response
    FROM documents"""
)
def split_reasoning_(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array(raw_answer("doc_id"))).alias("answer")
    )
    split = answers.select("doc_id", F.inline(F.array(split_reasoning(F.col("answer")))))
    plain = F.when(F.col("doc_id") % 10 <= 1, F.col("response"))
    return split.select(
        "doc_id",
        "reasoning",
        F.col("response").isNotNull().cast("int").alias("has_response"),
        plain.alias("plain_response"),
    )


@query(
    """SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS text_md5,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 5 <> 0 THEN source END AS only_sample FROM documents"""
)
def finish_gate_(spark, sf_dir):
    reason = F.when(F.col("doc_id") % 13 == 0, "length").otherwise("stop")
    sample = F.struct(F.col("source").alias("text"), reason.alias("finish_reason"))
    samples = F.array_repeat(sample, F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(finish_gate(F.col("text"), reason)).alias("text_md5"),
        single_output(samples).alias("only_sample"),
    )


def _sql_exploded(name):
    return f"""SELECT doc_id, CAST(unnest(range(1, len(found) + 1)) - 1 AS INTEGER) AS pos, unnest(found) AS {name}
    FROM (SELECT doc_id, {sql_list('doc_id', lone=False)} AS found FROM documents)"""


@query(_sql_exploded("topic"))
def explode_topics(spark, sf_dir):
    parsed = with_parsed_answer(_answers(spark, sf_dir, "topics"), "answer")
    rows = explode_strings(parsed, string_list(F.col("parsed"), "topics"), "topic")
    return rows.select("doc_id", "pos", "topic")


@query(_sql_exploded("scenario"))
def explode_scenarios(spark, sf_dir):
    parsed = with_parsed_answer(_answers(spark, sf_dir, "scenarios"), "answer")
    rows = explode_strings(parsed, string_list(F.col("parsed"), "scenarios"), "scenario")
    return rows.select("doc_id", "pos", "scenario")


@query(
    f"""WITH listed AS (
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_index,
               {sql_list('doc_id', lone=True)} AS found FROM documents)
    SELECT CAST(source_index AS BIGINT) AS source_index, unnest(found) AS prompt FROM listed
    UNION ALL
    SELECT CAST(source_index AS BIGINT), NULL FROM listed WHERE found IS NULL OR len(found) = 0"""
)
def explode_prompts(spark, sf_dir):
    numbered = with_row_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "source_index")
    answers = numbered.withColumn("answer", list_answer("doc_id", "prompts"))
    parsed = with_parsed_answer(answers, "answer")
    rows = explode_strings(parsed, string_or_list(F.col("parsed"), "prompts"), "prompt", outer=True)
    return rows.select("source_index", "prompt")


@query(
    f"""SELECT conv_id, CAST(n_turns - CASE WHEN conv_id % 16 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_messages
    FROM ({SQL_SERIALISED})
    WHERE {sql_tokens('payload')} <= 2048 AND conv_id % 16 NOT IN (5, 6)"""
)
def parse_translation(spark, sf_dir):
    source = gather_turns(source_turns(spark, sf_dir), fixed.TRANSLATION_MAX_INPUT_TOKENS)
    limited = translation.token_limit(translation.with_messages(source))
    requests = translation.translation_requests(limited.withColumn("lang_name", F.lit(RUN_LANGUAGE)))
    parsed = translation.translated(requests, translation_responses(requests))
    return parsed.filter(F.col("translated_messages").isNotNull()).select(
        "conv_id", F.size("translated_messages").cast("long").alias("n_messages")
    )
