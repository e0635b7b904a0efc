"""Explicit schemas, as DDL: files are never read with inferred types."""

MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"

PROMPTS = (
    "prompt_id STRING, lang_name STRING, index BIGINT, topic STRING, scenario STRING, text STRING, "
    "prompt_type STRING, prompts ARRAY<STRING>, prompt STRING, revised_prompt STRING, "
    "final_prompt STRING, system_prompt STRING, response STRING, reasoning STRING"
)
SOURCE_CONVERSATIONS = (
    "conv_id BIGINT, langdetect STRING, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>"
)
TRANSLATED = (f"conv_id BIGINT, messages {MESSAGES}, translated_messages_str STRING")
BATCH_REQUEST = (
    f"custom_id STRING, body STRUCT<model: STRING, messages: {MESSAGES}, "
    "max_tokens: INT, temperature: DOUBLE>"
)
BATCH_RESULT = (
    "custom_id STRING, response STRUCT<body: STRUCT<choices: ARRAY<STRUCT<"
    "finish_reason: STRING, message: STRUCT<reasoning: STRING, content: STRING>>>>>"
)
TEACHER_ANSWER = ("req_id STRING, reasoning STRING, response STRING")
CODES = ("ord INT, code STRING, name STRING")
