"""Text functions, samples, shuffles and row numbers over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.inputs import (
    new_folder,
    SEED,
    documents,
    list_answer,
    quoted,
    sql_key,
    sql_list,
    sql_tokens,
    table,
)
from queries.registry import query
from weftline.functions.answers import string_list, with_parsed_answer
from weftline.functions.text import TOKEN_PATTERN, filesafe, token_count, truncate_tokens
from weftline.operators.explode import explode_strings, pick_one
from weftline.operators.sampling import (
    assign_round_robin,
    cap_rows,
    sample_frac,
    shuffle,
    sample_n,
    with_row_index,
)
from weftline.plans.context_job import task_types
from weftline.plans.translation import english_only
from weftline.sources.jsonl import freeze

DOC_KEY = sql_key("doc_id")


@query(f"SELECT doc_id, CAST({sql_tokens('text')} AS BIGINT) AS n_tokens FROM documents")
def token_count_(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", token_count(F.col("text")).alias("n_tokens")
    )


@query(
    f"""SELECT doc_id, array_to_string(regexp_extract_all(text, {quoted(TOKEN_PATTERN)})[1:50], '') AS head
    FROM documents"""
)
def truncate_tokens_(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", truncate_tokens(F.col("text"), 50).alias("head")
    )


@query(
    """SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_]', '', 'g') AS url_name FROM pages"""
)
def filesafe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filesafe(F.col("url")).alias("url_name"))


@query(f"SELECT doc_id, lang FROM documents ORDER BY {DOC_KEY} LIMIT 100")
def sample_n_(spark, sf_dir):
    return sample_n(table(spark, sf_dir, "documents"), 100, ["doc_id"], SEED).select("doc_id", "lang")


@query(
    f"""SELECT doc_id, lang FROM (
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DOC_KEY}) AS rank,
               count(*) OVER (PARTITION BY lang) AS total FROM documents)
    WHERE rank <= round_even(0.5 * total, 0)"""
)
def sample_frac_(spark, sf_dir):
    half = sample_frac(table(spark, sf_dir, "documents"), 0.5, ["doc_id"], SEED, by=["lang"])
    return half.select("doc_id", "lang")


@query(
    f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY {DOC_KEY}) - 1 AS BIGINT) AS place FROM documents"""
)
def shuffle_order(spark, sf_dir):
    """The order of the written table: by file, and by place in the file."""
    path = new_folder(spark, "shuffled")
    shuffle(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SEED).write.parquet(path)
    where = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    written = spark.read.schema("doc_id BIGINT").parquet(path).select("doc_id", *where)
    return with_row_index(written, ["file", "row"], "place").select("doc_id", "place")


@query(
    """SELECT lang, source, doc_id,
       CAST(row_number() OVER (ORDER BY lang, source, doc_id) - 1 AS BIGINT) AS row_index FROM documents"""
)
def row_index(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return with_row_index(ids, ["lang", "source", "doc_id"])


_TYPES = "[" + ", ".join(quoted(t) for t in task_types()) + "]"


@query(
    f"""SELECT lang, doc_id, ({_TYPES})[(rank - 1) % 8 + 1] AS prompt_type FROM (
        SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {DOC_KEY}) AS rank FROM documents)"""
)
def task_round_robin(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return assign_round_robin(ids, task_types(), ["doc_id"], SEED, "prompt_type", by=["lang"])


@query(
    f"""SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE lang = 'en'
    ORDER BY {DOC_KEY} LIMIT 100"""
)
def frozen_sample(spark, sf_dir):
    english = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    path = new_folder(spark, "frozen")
    freeze(sample_n(english, 100, ["doc_id"], SEED).select("doc_id", "text"), path)
    # a second call with another sample has to find the first one
    again = freeze(sample_n(english, 50, ["doc_id"], SEED + 1).select("doc_id", "text"), path)
    return again.select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def source_lang_filter(spark, sf_dir):
    return english_only(table(spark, sf_dir, "documents"), "lang").select("doc_id", "n_chars")


_PICK = (
    f"CAST('0x' || substr({DOC_KEY}, 1, 8) AS BIGINT) % CASE WHEN len(prompts) > 0 THEN len(prompts) END + 1"
)


@query(
    f"""SELECT doc_id, prompts[{_PICK}] AS prompt FROM (
        SELECT doc_id, {sql_list('doc_id', lone=False)} AS prompts FROM documents)"""
)
def pick_one_prompt(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select(
        "doc_id", list_answer("doc_id", "prompts").alias("answer")
    )
    listed = with_parsed_answer(answers, "answer").select(
        "doc_id", string_list(F.col("parsed"), "prompts").alias("prompts")
    )
    return listed.select("doc_id", pick_one(F.col("prompts"), ["doc_id"], SEED).alias("prompt"))


@query(
    f"""SELECT doc_id, pos, prompt FROM (
        SELECT doc_id, CAST(unnest(range(1, len(prompts) + 1)) - 1 AS INTEGER) AS pos, unnest(prompts) AS prompt
        FROM (SELECT doc_id, {sql_list('doc_id', lone=False)} AS prompts FROM documents))
    ORDER BY {sql_key('doc_id', 'pos')} LIMIT 150"""
)
def cap_prompts(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select(
        "doc_id", list_answer("doc_id", "prompts").alias("answer")
    )
    parsed = with_parsed_answer(answers, "answer").select("doc_id", "parsed")
    rows = explode_strings(parsed, string_list(F.col("parsed"), "prompts"), "prompt").drop("parsed")
    return cap_rows(rows, 150, ["doc_id", "pos"], SEED)
