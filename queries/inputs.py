"""Pipeline inputs derived from the given tables, in Spark and as SQL text.

The teacher is played by rules on the row ids, so that every kind of answer occurs:
failed, unreadable, fenced, with a tail, with entries of other kinds and so on.
The SQL states the expected outcome of each rule directly; it does not parse.
"""

from __future__ import annotations

import tempfile
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline import fixed_values as fixed, session
from weftline.functions.text import TOKEN_PATTERN
from weftline.functions.turns import map_role

SEED = 7
RUN_LANGUAGE = "Basque"


SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


def own_shared_dir(spark: SparkSession) -> None:
    """A folder for stage tables where the session names none (tests, a local trial)."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="weftline-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder."""
    own_shared_dir(spark)
    return session.new_folder(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, by its known schema: no job to find it out."""
    own_shared_dir(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, as their files are split."""
    return table(spark, sf_dir, "documents")


# --- SQL text ------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_render(template: str, **values: str) -> str:
    """The SQL twin of ``render``: literals and expressions joined by ``||``."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if name is not None:
            parts.append(f"({values[name]})")
    return "(" + " || ".join(parts) + ")"


def sql_tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(TOKEN_PATTERN)}))"


def sql_chat(role: str, content: str) -> str:
    """A turn as ``ChatTemplate`` writes it by default."""
    return f"('<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10))"


def sql_key(*ids: str, seed: int = SEED) -> str:
    return "md5(concat_ws('|', " + ", ".join([quoted(str(seed)), *ids]) + "))"


def sql_request_id(job: str, *key: str, attempt: str = "0") -> str:
    texts = [f"coalesce(CAST({k} AS VARCHAR), '')" for k in (*key, attempt)]
    return "md5(concat_ws('|', " + ", ".join([quoted(job), *texts]) + "))"


# --- The played teacher: lists -------------------------------------------------------


def _entry(id_col: str, number: int) -> Column:
    return F.concat(F.lit("P"), F.col(id_col).cast("string"), F.lit(f"-{number}"))


def _json_list(*entries: Column) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.array(*[F.concat(F.lit('"'), e, F.lit('"')) for e in entries]), ", "), F.lit("]")
    )


def list_answer(id_col: str, key: str) -> Column:
    """An answer that should hold a list of strings under ``key``, by the last digit of the id."""
    p1, p2, p3 = (_entry(id_col, i) for i in (1, 2, 3))
    head, fence, close = F.lit(f'{{"{key}": '), F.lit("```json\n"), F.lit("\n```")
    digit = F.col(id_col) % 10
    return (
        F.when(digit == 1, "not json")
        .when(digit == 2, F.concat(fence, head, F.lit("[]}"), close))
        .when(digit == 3, F.concat(F.lit("\njson "), head, _json_list(p1, p2), F.lit("}")))
        .when(digit == 4, F.concat(head, _json_list(p1), F.lit("} tail")))
        .when(digit == 5, F.concat(head, F.lit('["'), p1, F.lit('", 7, null]}')))
        .when(digit == 6, F.concat(F.lit('{"other": '), _json_list(p1), F.lit("}")))
        .when(
            digit == 7,
            F.concat(
                fence, head, F.lit('["draft"]}'), close, F.lit("\nor better\n"),
                fence, head, _json_list(p1, p2), F.lit("}"), close,
            ),
        )
        .when(digit == 8, F.concat(head, F.lit('"'), p1, F.lit('"}')))
        .when(digit == 9, F.concat(fence, head, _json_list(p1, p2, p3), F.lit("}"), close))
    )


def sql_list(id_sql: str, lone: bool) -> str:
    """Expected strings of ``list_answer``; ``lone`` counts a bare string as a list."""
    p1, p2, p3 = (f"'P' || {id_sql} || '-{i}'" for i in (1, 2, 3))
    bare = f"WHEN 8 THEN [{p1}]" if lone else ""
    return (
        f"CASE {id_sql} % 10 WHEN 2 THEN CAST([] AS VARCHAR[]) WHEN 3 THEN [{p1}, {p2}] "
        f"WHEN 5 THEN [{p1}] WHEN 7 THEN [{p1}, {p2}] {bare} WHEN 9 THEN [{p1}, {p2}, {p3}] END"
    )


def list_responses(requests: DataFrame, id_col: str, key: str) -> DataFrame:
    """Responses to requests that carry ``id_col``; some lost, some sent twice."""
    answers = requests.select(
        "req_id",
        F.concat(F.lit("r"), F.col(id_col).cast("string")).alias("reasoning"),
        list_answer(id_col, key).alias("response"),
        F.when(F.col(id_col) % 17 == 0, 0).when(F.col(id_col) % 19 == 0, 2).otherwise(1).alias("copies"),
    )
    copies = F.array_repeat(F.lit(1), F.col("copies"))
    return answers.select("req_id", "reasoning", "response", F.explode(copies)).drop("col")


def sql_arrived(id_sql: str) -> str:
    return f"{id_sql} % 17 <> 0"


# --- The played teacher: texts -------------------------------------------------------


def raw_answer(id_col: str) -> Column:
    """A raw answer with thinking markers; some without the end marker, some with two."""
    number = F.col(id_col).cast("string")
    thought = F.concat(F.lit(" analysis r"), number)
    plain = F.coalesce(list_answer(id_col, "prompts"), F.lit("nothing"))
    end = F.lit(fixed.TEACHER_THINK_END)
    return (
        F.when(F.col(id_col) % 7 == 0, thought)
        .when(F.col(id_col) % 11 == 0, F.concat(thought, end, F.lit(" second thought "), end, plain))
        .otherwise(F.concat(thought, end, plain))
    )


def batch_lines(requests: DataFrame, id_col: str) -> DataFrame:
    """Result lines of a batch; cut off, empty, lost and repeated ones among them."""
    number = F.col(id_col)
    choice = F.struct(
        F.when(number % 13 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.struct(
            F.concat(F.lit("because "), number.cast("string")).alias("reasoning"),
            F.concat(F.lit("Answer "), number.cast("string")).alias("content"),
        ).alias("message"),
    )
    choices = F.when(number % 29 == 0, F.slice(F.array(choice), 1, 0)).otherwise(F.array(choice))
    copies = F.when(number % 17 == 0, 0).when(number % 19 == 0, 2).otherwise(1)
    return requests.select(
        F.concat(F.lit("r-"), "req_id").alias("custom_id"),
        F.struct(F.struct(choices.alias("choices")).alias("body")).alias("response"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def sql_batch_ok(id_sql: str) -> str:
    return f"({id_sql} % 13 <> 0 AND {id_sql} % 17 <> 0 AND {id_sql} % 29 <> 0)"


# --- Languages, topics, prompts ------------------------------------------------------


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.concat_ws(" ", "lang", "source").alias("lang_name")).distinct()


SQL_LANGUAGES = "SELECT DISTINCT lang || ' ' || source AS lang_name FROM documents"


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as topics or scenarios, each with the name of a nation as its language."""
    parts = table(spark, sf_dir, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("lang_name"))
    return parts.join(nations, "n_nationkey").select(
        "p_partkey",
        "lang_name",
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 2 == 0, "general").otherwise("target").alias("branch"),
    )


SQL_NAMED_PARTS = """
SELECT p_partkey, n_name AS lang_name, p_name AS name,
       CASE WHEN p_size % 2 = 0 THEN 'general' ELSE 'target' END AS branch
FROM part JOIN nation ON n_nationkey = p_partkey % 25
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts of the three subsets, with all columns the jobs use."""
    number = F.col("doc_id")
    subset = F.element_at(
        F.array(*[F.lit(s) for s in fixed.SUBSETS]), (number % 3 + 1).cast("int")
    )
    banned = F.when(number % 23 == 0, "<image>").otherwise("")
    is_context = F.col("subset") == "contextual"
    prompt = F.when(is_context, F.concat(F.lit("Discuss D"), number.cast("string"))).otherwise(F.col("text"))
    return (
        documents(spark, sf_dir)
        .withColumn("subset", subset)
        .select(
            "doc_id",
            F.concat(F.lit("d"), number.cast("string")).alias("prompt_id"),
            "subset",
            F.col("lang").alias("lang_name"),
            F.when(F.col("subset") == "topic", F.col("source")).alias("topic"),
            F.when(F.col("subset") == "scenario", F.col("source")).alias("scenario"),
            F.when(is_context, F.col("text")).alias("text"),
            F.when(is_context, "summarize").alias("prompt_type"),
            F.when(number % 10 != 1, F.concat(banned, prompt)).alias("prompt"),
            F.when(number % 7 == 3, F.concat(F.lit("Old revision "), number.cast("string"))).alias("revised_prompt"),
        )
    )


SQL_PROMPTS = """
SELECT doc_id, 'd' || doc_id AS prompt_id, subset, lang AS lang_name,
       CASE WHEN subset = 'topic' THEN source END AS topic,
       CASE WHEN subset = 'scenario' THEN source END AS scenario,
       CASE WHEN subset = 'contextual' THEN text END AS text,
       CASE WHEN subset = 'contextual' THEN 'summarize' END AS prompt_type,
       CASE WHEN doc_id % 10 <> 1 THEN
            (CASE WHEN doc_id % 23 = 0 THEN '<image>' ELSE '' END)
            || (CASE WHEN subset = 'contextual' THEN 'Discuss D' || doc_id ELSE text END) END AS prompt,
       CASE WHEN doc_id % 7 = 3 THEN 'Old revision ' || doc_id END AS revised_prompt
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'contextual' WHEN 1 THEN 'scenario' ELSE 'topic' END AS subset
      FROM documents)
"""

SQL_FINAL_PROMPTS = f"""
SELECT *, CASE WHEN subset = 'contextual' THEN text || chr(10) || chr(10) || coalesce(revised_prompt, prompt)
               ELSE coalesce(revised_prompt, prompt) END AS final_prompt
FROM ({SQL_PROMPTS})
"""


def revision_responses(requests: DataFrame) -> DataFrame:
    """Revisions by the number in the prompt id; some failed or of the wrong kind."""
    number = F.substring("prompt_id", 2, 20).cast("long")
    better = F.concat(F.lit('```json\n{"improved_prompt": "Better '), number.cast("string"), F.lit('"}\n```'))
    response = (
        F.when(number % 10 == 1, "not json")
        .when(number % 10 == 4, F.concat(better, F.lit("tail")))
        .when(number % 10 == 5, '{"improved_prompt": 7}')
        .when(number % 10 != 0, better)
    )
    copies = F.when(number % 17 == 0, 0).otherwise(1)
    return requests.select(
        "req_id",
        F.lit(None).cast("string").alias("reasoning"),
        response.alias("response"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


SQL_REVISED = "CASE WHEN doc_id % 10 NOT IN (0, 1, 4, 5) AND doc_id % 17 <> 0 THEN 'Better ' || doc_id END"


def answer_responses(requests: DataFrame) -> DataFrame:
    """Answers by the number in the prompt id; cut off, lost, repeated, without reasoning."""
    number = F.substring("prompt_id", 2, 20).cast("long")
    copies = F.when(number % 17 == 0, 0).when(number % 19 == 0, 2).otherwise(1)
    return requests.select(
        "req_id",
        "prompt_id",
        F.when((number % 13 != 0) & (number % 11 != 0), F.concat(F.lit("because "), number.cast("string"))).alias(
            "reasoning"
        ),
        F.when(number % 13 != 0, F.concat(F.lit("Answer "), number.cast("string"))).alias("response"),
        F.posexplode(F.array_repeat(F.lit(1), copies)).alias("nth", "copy"),
    ).select("req_id", "reasoning", later_copy("response", number).alias("response"))


def later_copy(text: str, number: Column) -> Column:
    """Copies differ: the first of two is another text, or was cut off."""
    again = F.concat(text, F.lit(" again"))
    other = F.when(number % 2 == 0, again)
    return F.when((number % 19 == 0) & (F.col("nth") == 0), other).otherwise(F.col(text))


SQL_RESPONSE = (
    "CASE WHEN final_prompt IS NOT NULL AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 "
    "THEN 'Answer ' || doc_id END"
)
SQL_REASONING = (
    "CASE WHEN final_prompt IS NOT NULL AND doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0 "
    "THEN 'because ' || doc_id END"
)


# --- Conversations -------------------------------------------------------------------


def source_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a source corpus names them: user is human, assistant is gpt."""
    named = (
        F.when(F.col("role") == "user", "human")
        .when(F.col("role") == "assistant", "gpt")
        .otherwise(F.col("role"))
    )
    return table(spark, sf_dir, "conversations").withColumn("role", named)


def mapped_role(role: Column) -> Column:
    return map_role(role)


SQL_SERIALISED = """
SELECT conv_id, count(*) AS n_turns,
       '[' || string_agg('{"role":"' || role || '","content":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn) || ']' AS payload
FROM conversations
GROUP BY conv_id
HAVING bool_and(role IN ('user', 'assistant'))
"""


def translation_responses(requests: DataFrame) -> DataFrame:
    """Translations by ``conv_id % 16``, sound ones from 8 on; 9 and 10 are written as Python."""
    k = F.col("conv_id") % 16
    ok = F.transform(
        "messages",
        lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit(" ok")).alias("content")),
    )
    first, rest = F.element_at(ok, 1), F.slice(ok, F.lit(2), F.greatest(F.size(ok) - 1, F.lit(0)))
    original = F.col("messages")[0]["content"]
    tokens = F.regexp_extract_all(original, F.lit(TOKEN_PATTERN), F.lit(0))
    half = F.array_join(F.slice(tokens, F.lit(1), F.floor(F.size(tokens) / 2).cast("int")), "")

    def with_first(role: Column, content: Column) -> Column:
        return F.concat(F.array(F.struct(role.alias("role"), content.alias("content"))), rest)

    def text_after_first(head: str) -> Column:
        tail = F.to_json(rest)
        return F.concat(
            F.lit(head),
            F.when(F.size(rest) > 0, F.concat(F.lit(","), F.substring(tail, 2, 2_147_483_647))).otherwise("]"),
        )

    single_quoted = F.replace(
        F.replace(F.to_json(ok), F.lit('"role":"user","content":'), F.lit("'role': 'user', 'content': ")),
        F.lit('"role":"assistant","content":'),
        F.lit("'role': 'assistant', 'content': "),
    )
    response = (
        F.when(k == 0, F.to_json(F.slice(ok, F.lit(1), F.greatest(F.size(ok) - 1, F.lit(0)))))
        .when(k == 1, F.to_json(with_first(first["role"], F.array_join(F.array_repeat(original, 30), " "))))
        .when(k == 2, F.to_json(with_first(first["role"], half)))
        .when(k == 3, F.to_json(with_first(F.lit("system"), first["content"])))
        .when(k == 4, text_after_first('[{"role":"user","content":"a","lang":"x"}'))
        .when(k == 6, "Sorry, no.")
        .when(k == 7, text_after_first('[{"role":"user","content":5}'))
        .when(k == 9, single_quoted)
        .when(k == 10, F.concat(F.substring(single_quoted, F.lit(1), F.length(single_quoted) - 1), F.lit(",]")))
        .when(k != 5, F.to_json(ok))
    )
    return requests.select("req_id", F.lit(None).cast("string").alias("reasoning"), response.alias("response"))
