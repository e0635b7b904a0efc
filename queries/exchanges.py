"""Sources, sinks, batches, joins of answers to requests, language codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.inputs import (
    new_folder,
    SEED,
    SQL_FINAL_PROMPTS,
    SQL_PROMPTS,
    SQL_REASONING,
    SQL_RESPONSE,
    SQL_REVISED,
    answer_responses,
    batch_lines,
    list_responses,
    prompts,
    quoted,
    revision_responses,
    sql_arrived,
    sql_batch_ok,
    sql_key,
    sql_render,
    sql_request_id,
    table,
)
from queries.registry import query
from weftline import fixed_values as fixed
from weftline.functions.answers import with_parsed_answer
from weftline.operators import langs
from weftline.operators.exchange import attach, from_batch, one_answer, pending, request_id, retry, teacher_map
from weftline.plans import prompt_jobs
from weftline.plans import requests as ask
from weftline.schemas import BATCH_REQUEST, TEACHER_ANSWER
from weftline.session import stored
from weftline.sources import batches
from weftline.sources.jsonl import read_jsonl, read_prompts, write_jsonl, write_prompts
from weftline.streaming.collect import collect_stream

_ID = sql_request_id("context_prompts", "lang", "doc_id")


def context_requests(spark, sf_dir):
    """One request per document."""
    documents = table(spark, sf_dir, "documents").withColumns(
        {
            "lang_name": F.col("lang"),
            "prompt_type": F.lit("summarize"),
            "attempt": F.lit(0),
            "req_id": request_id("context_prompts", "lang", "doc_id"),
        }
    )
    return ask.context_prompt_requests(documents)


# --- Files ---------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    path = new_folder(spark, "jsonl")
    write_jsonl(table(spark, sf_dir, "documents"), path)
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    back = read_jsonl(spark, path, schema)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@query(
    f"""SELECT lang_name AS lang, subset, subset = 'contextual' AS has_context, count(*) AS n_rows,
    count(prompt) AS n_prompts FROM ({SQL_PROMPTS}) GROUP BY lang_name, subset"""
)
def subset_discovery(spark, sf_dir):
    root = new_folder(spark, "prompts")
    write_prompts(prompts(spark, sf_dir), root)
    shards = read_prompts(spark, root)
    return shards.groupBy("lang", "subset", "has_context").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("prompt").alias("n_prompts")
    )


@query(
    f"""SELECT 'r-' || {_ID} AS custom_id, 'teacher' AS model, 2048 AS max_tokens,
    CAST(1.0 AS DOUBLE) AS temperature,
    md5({sql_render(fixed.CONTEXT_PROMPT_REQUEST, n='3', lang_name='lang', text='text', prompt_type="'summarize'")}) AS user_md5
    FROM documents"""
)
def batch_requests(spark, sf_dir):
    path = new_folder(spark, "requests")
    batches.write_requests(context_requests(spark, sf_dir), path, model="teacher")
    lines = spark.read.schema(BATCH_REQUEST).json(path)
    body = F.col("body")
    return lines.select(
        "custom_id",
        body["model"].alias("model"),
        body["max_tokens"].alias("max_tokens"),
        body["temperature"].alias("temperature"),
        F.md5(body["messages"][1]["content"]).alias("user_md5"),
    )


@query(
    f"""SELECT {_ID} AS req_id,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 29 <> 0 THEN 'because ' || doc_id END AS reasoning,
    CASE WHEN doc_id % 13 <> 0 AND doc_id % 29 <> 0 THEN 'Answer ' || doc_id END AS response
    FROM documents, range(CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 2 ELSE 1 END)"""
)
def batch_results(spark, sf_dir):
    path = new_folder(spark, "results")
    batch_lines(context_requests(spark, sf_dir), "doc_id").write.json(path)
    return batches.read_results(spark, path)


# --- Joins by request id -------------------------------------------------------------


@query(
    f"""SELECT doc_id, CASE WHEN {sql_batch_ok('doc_id')} THEN 'because ' || doc_id END AS reasoning,
    CASE WHEN {sql_batch_ok('doc_id')} THEN 'Answer ' || doc_id END AS response FROM documents"""
)
def attach_responses(spark, sf_dir):
    requests = context_requests(spark, sf_dir).select("req_id", "doc_id")
    responses = from_batch(batch_lines(requests, "doc_id"))
    return attach(requests, responses).select("doc_id", "reasoning", "response")


@query("SELECT doc_id FROM documents WHERE doc_id % 17 = 0")
def pending_requests(spark, sf_dir):
    requests = context_requests(spark, sf_dir).select("req_id", "doc_id")
    return pending(requests, from_batch(batch_lines(requests, "doc_id"))).select("doc_id")


@query(
    f"""SELECT doc_id, {sql_request_id('context_prompts', 'lang', 'doc_id', attempt='1')} AS req_id, 1 AS attempt
    FROM documents WHERE NOT ({sql_arrived('doc_id')}) OR doc_id % 10 IN (0, 1, 4)"""
)
def retry_requests(spark, sf_dir):
    requests = context_requests(spark, sf_dir).select("req_id", "doc_id", "lang", "attempt")
    responses = list_responses(requests, "doc_id", "scenarios")
    readable = with_parsed_answer(responses, "response").filter(F.col("parsed").isNotNull())
    again = retry(requests, readable, "context_prompts", ["lang", "doc_id"], max_attempts=3)
    return again.select("doc_id", "req_id", "attempt")


_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY lang_name, subset ORDER BY {sql_key('prompt_id')}) AS rank,
    count(*) OVER (PARTITION BY lang_name, subset) AS total FROM ({SQL_PROMPTS})"""


@query(
    f"""SELECT prompt_id, lang_name, subset,
    coalesce(CASE WHEN rank <= round_even(0.5 * total, 0) AND prompt IS NOT NULL THEN {SQL_REVISED} END,
             revised_prompt) AS revised_prompt FROM ({_RANKED})"""
)
def combine_revisions(spark, sf_dir):
    base = prompts(spark, sf_dir)
    requests = stored(prompt_jobs.revision_requests(base, SEED), "revision-requests")
    combined = prompt_jobs.combine_revisions(base, requests, revision_responses(requests))
    return combined.select("prompt_id", "lang_name", "subset", "revised_prompt")


@query(
    f"""SELECT prompt_id, md5(final_prompt) AS final_md5, {SQL_RESPONSE} AS response, {SQL_REASONING} AS reasoning
    FROM ({SQL_FINAL_PROMPTS})"""
)
def combine_responses(spark, sf_dir):
    base = prompts(spark, sf_dir)
    responses = answer_responses(prompt_jobs.answer_requests(base))
    answered = prompt_jobs.combine_responses(base, responses)
    return answered.select("prompt_id", F.md5("final_prompt").alias("final_md5"), "response", "reasoning")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN 'seen ' || length(text) END AS reasoning,
    CASE WHEN doc_id % 13 <> 0 THEN upper(source) END AS response FROM documents"""
)
def teacher_map_(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("req_id"),
        F.concat_ws(" ", F.col("doc_id").cast("string"), "source").alias("system_prompt"),
        F.col("text").alias("prompt"),
    )

    def make_client():
        def ask_teacher(system, prompt):
            number, source = system.split(" ")
            if int(number) % 13 == 0:
                raise RuntimeError("no answer")
            return {"reasoning": f"seen {len(prompt)}", "response": source.upper()}

        return ask_teacher

    answers = teacher_map(requests, make_client, partitions=8)
    return answers.select(F.col("req_id").cast("bigint").alias("doc_id"), "reasoning", "response")


_OK = sql_batch_ok("doc_id")


@query(
    f"""SELECT doc_id, CASE WHEN {_OK} THEN 'because ' || doc_id END AS reasoning,
    CASE WHEN {_OK} THEN 'Answer ' || doc_id END AS response
    FROM documents WHERE {sql_arrived('doc_id')}"""
)
def collect_stream_(spark, sf_dir):
    """Results arrive in two lots; the second repeats a part of the first and holds unknown ids."""
    ids = context_requests(spark, sf_dir).select("req_id", "doc_id")
    folder = new_folder(spark, "collect")
    requests = stored(ids, "collect-requests")
    lines = batch_lines(requests, "doc_id").join(
        requests.select(F.concat(F.lit("r-"), "req_id").alias("custom_id"), "doc_id"), "custom_id"
    )
    # the first lot has some results of the second cut off before their end
    early = lines.filter((F.col("doc_id") % 2 == 1) & (F.col("doc_id") % 5 == 1))
    cut = F.transform("response.body.choices", lambda c: c.withField("finish_reason", F.lit("length")))
    early = early.withColumn("response", F.struct(F.struct(cut.alias("choices")).alias("body")))
    stranger = F.concat(F.lit("r-"), F.md5(F.reverse("custom_id")))
    lots = [
        lines.filter(F.col("doc_id") % 2 == 0).unionByName(early),
        lines.filter((F.col("doc_id") % 2 == 1) | (F.col("doc_id") % 3 == 0)).unionByName(
            lines.withColumn("custom_id", stranger)
        ),
    ]
    for lot in lots:
        lot.drop("doc_id").write.mode("append").json(f"{folder}/results")
        run = collect_stream(
            spark, f"{folder}/results", requests, f"{folder}/answers", f"{folder}/checkpoint", partitions=8
        )
        run.awaitTermination()
    answers = spark.read.schema(TEACHER_ANSWER).parquet(f"{folder}/answers")
    return requests.join(one_answer(answers), "req_id").select("doc_id", "reasoning", "response")


# --- Languages -----------------------------------------------------------------------


def source_codes(spark, sf_dir):
    """A code table out of the documents: each source is a code of its languages."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("lang").alias("name"), F.col("source").alias("code"))
        .agg(F.min("doc_id").alias("ord"))
    )


SQL_SOURCE_CODES = "SELECT lang AS name, source AS code, min(doc_id) AS ord FROM documents GROUP BY 1, 2"


@query(f"SELECT name, string_agg(code, ',' ORDER BY ord) AS codes FROM ({SQL_SOURCE_CODES}) GROUP BY name")
def lang_codes_by_name(spark, sf_dir):
    named = langs.codes_by_name(source_codes(spark, sf_dir))
    return named.select("name", F.array_join("codes", ",").alias("codes"))


@query(
    """WITH present AS (SELECT lang || '_' || source AS code, lang AS name, min(doc_id) AS ord FROM documents GROUP BY 1, 2),
    chosen AS (SELECT name, min_by(code, ord) AS code FROM present GROUP BY name)
    SELECT name AS lang_name, doc_id FROM documents JOIN chosen ON lang || '_' || source = code"""
)
def corpus_first_code(spark, sf_dir):
    """Each language also lists a code before the others that the corpus does not have."""
    corpus = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat_ws("_", "lang", "source").alias("code")
    )
    present = corpus.groupBy(F.col("lang").alias("name"), "code").agg(F.min("doc_id").alias("ord"))
    absent = present.select("name", F.concat(F.lit("absent_"), "name").alias("code"), F.lit(-1).alias("ord")).distinct()
    codes = present.unionByName(absent)
    return langs.corpus_of_languages(corpus, "code", codes).select("lang_name", "doc_id")


def _values(codes):
    listed = ", ".join(f"({i}, {quoted(c)}, {quoted(n)})" for i, (c, n) in enumerate(codes))
    return f"(VALUES {listed})"


@query(
    f"""WITH two AS (SELECT * FROM {_values(fixed.TWO_LETTER_CODES)} t(ord, code, name)),
    three AS (SELECT * FROM {_values(fixed.THREE_LETTER_CODES)} t(ord, code, name)),
    named AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Simplified Chinese' WHEN doc_id % 7 = 0 THEN 'Wolof'
                                  ELSE (SELECT name FROM two WHERE code = lang) END AS lang_name FROM documents)
    SELECT doc_id, lang_name,
      (SELECT max_by(code, ord) FROM three WHERE name = lang_name) AS three_letter_code,
      CASE WHEN lang_name IN (SELECT name FROM three)
           THEN coalesce((SELECT max_by(code, ord) FROM two WHERE name = lang_name),
                         (SELECT max_by(code, ord) FROM three WHERE name = lang_name)) END AS short_code
    FROM named"""
)
def shortest_lang_code(spark, sf_dir):
    two, three = langs.two_letter_codes(spark), langs.three_letter_codes(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    names = documents.join(F.broadcast(two), F.col("lang") == F.col("code"), "left").select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, "Simplified Chinese")
        .when(F.col("doc_id") % 7 == 0, "Wolof")
        .otherwise(F.col("name"))
        .alias("lang_name"),
    )
    coded = langs.shortest_code(names, "lang_name", two, three)
    return coded.select("doc_id", "lang_name", "three_letter_code", "short_code")
