"""Topic and scenario trees and the job on web texts, from requests to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from queries.inputs import (
    SEED,
    SQL_NAMED_PARTS,
    languages,
    list_responses,
    named_parts,
    sql_key,
    sql_list,
    sql_request_id,
    SQL_LANGUAGES,
    quoted,
    table,
)
from queries.registry import query
from weftline.functions.text import TOKEN_PATTERN
from weftline.operators.exchange import request_id
from weftline.plans import context_job, scenario_tree, topic_tree
from weftline.session import stored

# The teacher's rules go by a number; here it is the beginning of the request id.


def numbered(requests: DataFrame) -> DataFrame:
    return requests.withColumn("number", F.conv(F.substring("req_id", 1, 6), 16, 10).cast("bigint"))


def responses(requests: DataFrame, key: str) -> DataFrame:
    return list_responses(numbered(requests), "number", key)


SQL_NUMBER = "CAST('0x' || substr(req_id, 1, 6) AS BIGINT)"


def sql_answered(source: str, lone: bool) -> str:
    """Rows of ``source`` (with req_id) with the list ``found`` that its answer holds."""
    return f"""SELECT *, CASE WHEN number % 17 <> 0 THEN {sql_list('number', lone)} END AS found
    FROM (SELECT *, {SQL_NUMBER} AS number FROM ({source}))"""


def sql_grow(source: str, job: str, kind: str) -> str:
    asked = f"SELECT *, {sql_request_id(job, 'node_id')} AS req_id FROM ({source})"
    return f"""SELECT lang_name, branch, CAST(level + 1 AS INTEGER) AS level, node,
      {sql_request_id(kind, 'node_id', 'pos')} AS node_id
    FROM (SELECT lang_name, branch, level, node_id, unnest(found) AS node, unnest(range(0, len(found))) AS pos
          FROM ({sql_answered(asked, lone=False)}))"""


# --- Topics --------------------------------------------------------------------------


def topic_levels(spark, sf_dir) -> list[DataFrame]:
    """Parts as level 0 and the two levels grown from them, each stored between the stages."""
    level0 = named_parts(spark, sf_dir).select(
        "lang_name",
        "branch",
        F.lit(0).alias("level"),
        F.col("name").alias("topic"),
        request_id("seed", "p_partkey").alias("topic_id"),
    )
    levels = [level0]
    for _ in range(2):
        requests = stored(topic_tree.topic_requests(levels[-1]), "topic-requests")
        levels.append(topic_tree.grow(requests, responses(requests, "topics")))
    return levels


_LEVEL0 = f"""SELECT lang_name, branch, 0 AS level, name AS node, {sql_request_id('seed', 'p_partkey')} AS node_id
FROM ({SQL_NAMED_PARTS})"""
_TOPICS1 = sql_grow(_LEVEL0, topic_tree.TOPIC_JOB, "topic")
_TOPICS2 = sql_grow(_TOPICS1, topic_tree.TOPIC_JOB, "topic")


@query(f"SELECT lang_name, branch, level, node AS topic, node_id AS topic_id FROM ({_TOPICS2})")
def topic_tree_round(spark, sf_dir):
    return topic_levels(spark, sf_dir)[2].select("lang_name", "branch", "level", "topic", "topic_id")


_ALL_TOPICS = f"""SELECT DISTINCT lang_name, node AS topic FROM (
    SELECT lang_name, node FROM ({_LEVEL0}) UNION ALL SELECT lang_name, node FROM ({_TOPICS1})
    UNION ALL SELECT lang_name, node FROM ({_TOPICS2}))"""


@query(_ALL_TOPICS)
def topic_union_distinct(spark, sf_dir):
    return topic_tree.distinct_topics(*topic_levels(spark, sf_dir))


_TOPIC_ASKED = f"""SELECT *, {sql_request_id(topic_tree.PROMPT_JOB, 'lang_name', 'topic')} AS req_id,
    row_number() OVER (PARTITION BY lang_name ORDER BY {sql_key('topic', seed=0)}) - 1 AS ordinal FROM ({_ALL_TOPICS})"""


@query(
    f"""WITH answered AS ({sql_answered(_TOPIC_ASKED, lone=True)})
    SELECT lang_name, topic, ordinal AS "index", unnest(found) AS prompt FROM answered
    UNION ALL SELECT lang_name, topic, ordinal, NULL FROM answered WHERE found IS NULL OR len(found) = 0"""
)
def topic_prompts(spark, sf_dir):
    topics = topic_tree.distinct_topics(*topic_levels(spark, sf_dir))
    requests = stored(topic_tree.prompt_requests(topics), "topic-prompt-requests")
    return topic_tree.topic_prompts(requests, responses(requests, "prompts")).select(
        "lang_name", "topic", "index", "prompt"
    )


# --- Scenarios -----------------------------------------------------------------------


def broad_scenarios(spark, sf_dir) -> DataFrame:
    """Parts as broad scenarios."""
    return named_parts(spark, sf_dir).select(
        "lang_name",
        "branch",
        F.lit(1).alias("level"),
        F.col("name").alias("scenario"),
        request_id("broad", "p_partkey").alias("scenario_id"),
    )


_BROAD = f"""SELECT lang_name, branch, 1 AS level, name AS node, {sql_request_id('broad', 'p_partkey')} AS node_id
FROM ({SQL_NAMED_PARTS})"""
_DETAILED = sql_grow(_BROAD, scenario_tree.SCENARIO_JOB, "scenario")


def scenario_levels(spark, sf_dir) -> list[DataFrame]:
    broad = broad_scenarios(spark, sf_dir)
    requests = stored(scenario_tree.scenario_requests(broad), "scenario-requests")
    return [broad, scenario_tree.grow(requests, responses(requests, "scenarios"))]


@query(f"SELECT lang_name, branch, level, node AS scenario, node_id AS scenario_id FROM ({_DETAILED})")
def scenario_tree_round(spark, sf_dir):
    return scenario_levels(spark, sf_dir)[1].select(
        "lang_name", "branch", "level", "scenario", "scenario_id"
    )


_ALL_SCENARIOS = f"SELECT * FROM ({_DETAILED}) UNION ALL SELECT lang_name, branch, level, node, node_id FROM ({_BROAD})"


@query(f"SELECT lang_name, level, node AS scenario FROM ({_ALL_SCENARIOS})")
def scenario_union_all(spark, sf_dir):
    broad, detailed = scenario_levels(spark, sf_dir)
    return scenario_tree.all_scenarios(detailed, broad).select("lang_name", "level", "scenario")


_SCENARIO_ASKED = f"""SELECT *, {sql_request_id(scenario_tree.PROMPT_JOB, 'node_id')} AS req_id,
    row_number() OVER (PARTITION BY lang_name ORDER BY {sql_key('node_id', seed=0)}) - 1 AS ordinal FROM ({_ALL_SCENARIOS})"""


@query(
    f"""WITH answered AS ({sql_answered(_SCENARIO_ASKED, lone=True)})
    SELECT lang_name, node AS scenario, ordinal AS "index", unnest(found) AS prompt FROM answered
    UNION ALL SELECT lang_name, node, ordinal, NULL FROM answered WHERE found IS NULL OR len(found) = 0"""
)
def scenario_prompts(spark, sf_dir):
    broad, detailed = scenario_levels(spark, sf_dir)
    scenarios = scenario_tree.all_scenarios(detailed, broad)
    requests = stored(scenario_tree.prompt_requests(scenarios), "scenario-prompt-requests")
    return scenario_tree.scenario_prompts(requests, responses(requests, "prompts")).select(
        "lang_name", "scenario", "index", "prompt"
    )


_ROOTS = f"""SELECT lang_name, branch, {sql_request_id('root', 'lang_name', 'branch')} AS scenario_id
FROM ({SQL_LANGUAGES}), (VALUES ('general'), ('target')) b(branch)"""
_ROOTS_ASKED = f"SELECT *, {sql_request_id(scenario_tree.SCENARIO_JOB, 'scenario_id')} AS req_id FROM ({_ROOTS})"


@query(
    f"""SELECT lang_name, branch, {sql_request_id(scenario_tree.SCENARIO_JOB, 'scenario_id', attempt='1')} AS req_id,
    1 AS attempt FROM (SELECT *, {SQL_NUMBER} AS number FROM ({_ROOTS_ASKED}))
    WHERE number % 17 = 0 OR number % 10 IN (0, 1, 4)"""
)
def retry_broad_scenarios(spark, sf_dir):
    requests = scenario_tree.scenario_requests(scenario_tree.roots(languages(spark, sf_dir)))
    requests = stored(requests, "broad-requests")
    again = scenario_tree.retry_broad(requests, responses(requests, "scenarios"), max_attempts=5)
    return again.select("lang_name", "branch", "req_id", "attempt")


# --- Web texts -----------------------------------------------------------------------


def context_stage(spark, sf_dir, num_contexts: int) -> DataFrame:
    corpus = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("lang_name"))
    requests = stored(
        context_job.context_requests(corpus, SEED, num_contexts, first_n_tokens=100), "context-requests"
    )
    answers = list_responses(requests, "doc_id", "prompts")
    rows = context_job.context_prompts(requests, answers, SEED, num_contexts, keep=["doc_id"])
    return rows.select("lang_name", "doc_id", F.md5("text").alias("text_md5"), "prompt_type", "prompt")


_TYPES = "[" + ", ".join(quoted(t) for t in context_job.task_types()) + "]"


def sql_context(num_contexts: int) -> str:
    sampled = f"""SELECT lang AS lang_name, doc_id, total,
        array_to_string(regexp_extract_all(text, {quoted(TOKEN_PATTERN)})[1:100], '') AS text,
        ({_TYPES})[(rank - 1) % 8 + 1] AS prompt_type, {sql_request_id(context_job.JOB, 'lang', 'doc_id')} AS req_id,
        CASE WHEN doc_id % 17 <> 0 THEN {sql_list('doc_id', lone=False)} END AS listed,
        CASE WHEN doc_id % 17 <> 0 THEN {sql_list('doc_id', lone=True)} END AS found
      FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {sql_key('doc_id')}) AS rank,
                   count(*) OVER (PARTITION BY lang) AS total FROM documents)
      WHERE rank <= {num_contexts}"""
    draw = f"CAST('0x' || substr({sql_key('req_id')}, 1, 8) AS BIGINT) % CASE WHEN len(listed) > 0 THEN len(listed) END + 1"
    offered = f"""SELECT *, CASE WHEN total > {num_contexts} THEN [listed[{draw}]] ELSE found END AS offered FROM ({sampled})"""
    rows = f"""SELECT * EXCLUDE (offered), unnest(offered) AS prompt, CAST(unnest(range(0, len(offered))) AS VARCHAR) AS pos
      FROM ({offered})
      UNION ALL SELECT * EXCLUDE (offered), NULL, NULL FROM ({offered}) WHERE offered IS NULL OR len(offered) = 0"""
    identified = f"SELECT *, {sql_request_id('prompt', 'req_id', 'pos')} AS prompt_id FROM ({rows})"
    return f"""SELECT lang_name, doc_id, md5(text) AS text_md5, prompt_type, prompt FROM (
        SELECT *, row_number() OVER (PARTITION BY lang_name ORDER BY {sql_key('prompt_id')}) AS place FROM ({identified}))
      WHERE place <= {num_contexts}"""


@query(sql_context(120))
def context_job_(spark, sf_dir):
    """Languages above and below the wanted number of texts: one prompt per text, or all, capped."""
    return context_stage(spark, sf_dir, 120)
