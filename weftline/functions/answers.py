"""Teacher answers: fences, strict JSON, key extraction, reasoning, finish reason.

All native columns.  Python is used in one place only, for translated
messages that are neither JSON nor plain literals
(:func:`literal_messages`); no other row is sent to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline import fixed_values as fixed
from weftline.functions.text import strip
from weftline.session import stored

MESSAGE_MAPS = "array<map<string,variant>>"
_JSON_READ = {"allowBackslashEscapingAnyCharacter": "true"}


def clean_json_answer(answer: Column) -> Column:
    """The JSON part of an answer: text after the last ```` ```json ````, fences removed.

    An answer that begins with the word json, whatever its case, is stripped and
    loses that word first.
    """
    bare = strip(answer)
    has_word = F.lower(F.substring(bare, 1, 4)) == "json"
    cut = F.when(has_word, F.substring(bare, F.lit(5), F.length(bare))).otherwise(answer)
    return F.replace(F.split_part(cut, F.lit("```json"), F.lit(-1)), F.lit("```"), F.lit(""))


def parse_json_strict(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else null.

    The JSON reader tolerates a tail after the first value.  A tail would have to
    continue both an array and an object to survive both wraps, which nothing does.
    """
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(as_element.isNotNull(), F.try_variant_get(as_member, "$.v", "variant"))


def _is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def string_value(parsed: Column, key: str) -> Column:
    """The string under ``key``, null for any other kind of value."""
    value = F.try_variant_get(parsed, f"$.{key}", "variant")
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string"))


def string_list(parsed: Column, key: str) -> Column:
    """The string entries of the list under ``key``; null when it is not a list."""
    entries = F.try_variant_get(parsed, f"$.{key}", "array<variant>")
    return F.transform(
        F.filter(entries, _is_string), lambda entry: F.try_variant_get(entry, "$", "string")
    )


def string_or_list(parsed: Column, key: str) -> Column:
    """Like :func:`string_list`, with a lone string as a list of one."""
    lone = string_value(parsed, key)
    return F.coalesce(string_list(parsed, key), F.when(lone.isNotNull(), F.array(lone)))


def with_parsed_answer(df: DataFrame, answer: str, name: str = "parsed") -> DataFrame:
    """Add the strict JSON value of an answer column.

    Values come out of one-element ``explode``s: a generator is evaluated once, so
    later filters and projections do not parse the answer again.
    """
    cleaned = df.select("*", F.explode(F.array(clean_json_answer(F.col(answer)))).alias("_clean"))
    parsed = F.explode(F.array(parse_json_strict(F.col("_clean")))).alias(name)
    return cleaned.select("*", parsed).drop("_clean")


def split_reasoning(
    answer: Column,
    start: str | None = fixed.TEACHER_THINK_START,
    end: str | None = fixed.TEACHER_THINK_END,
) -> Column:
    """STRUCT<reasoning, response> of a raw answer with thinking markers.

    Reasoning is what precedes the first end marker, the response what follows
    the last one.  Without an end marker both are null.
    """
    if not end:
        nothing = F.lit(None).cast("string")
        return F.struct(nothing.alias("reasoning"), nothing.alias("response"))
    bare = strip(answer)
    if start:
        # stripping twice changes nothing where the marker is absent
        bare = strip(F.regexp_replace(bare, f"^{re.escape(start)}", ""))
    has_end = answer.contains(end)
    return F.struct(
        F.when(has_end, F.split_part(bare, F.lit(end), F.lit(1))).alias("reasoning"),
        F.when(has_end, F.split_part(bare, F.lit(end), F.lit(-1))).alias("response"),
    )


def finish_gate(text: Column, finish_reason: Column) -> Column:
    """The text of an answer that came to its own end, else null."""
    return F.when(finish_reason == "stop", text)


def single_output(outputs: Column) -> Column:
    """Text of the only sample of an ARRAY<STRUCT<text, finish_reason>>; null for several."""
    only = F.try_element_at(outputs, F.lit(1))
    return F.when(F.size(outputs) == 1, finish_gate(only["text"], only["finish_reason"]))


def parse_message_list(text: Column) -> Column:
    """ARRAY<MAP<STRING, VARIANT>> of a JSON or single-quoted message list, else null.

    Read inside a list and inside an object, as in :func:`parse_json_strict`.
    """
    in_list = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), f"array<{MESSAGE_MAPS}>", _JSON_READ
    )
    in_object = F.from_json(
        F.concat(F.lit('{"w":'), text, F.lit("}")), "map<string,variant>", _JSON_READ
    )
    return F.when(in_object.isNotNull(), F.try_element_at(in_list, F.lit(1)))


#: escapes that JSON and Python read alike
_SAME = r"""\\(?:[\\'"nrtbf]|u[0-9A-Fa-f]{4})"""
#: a backslash that Python keeps, as it escapes nothing there
_KEPT = r"""[^\\'"nrtbfavxNuU0-7\x00-\x1f]"""
#: inside of a quoted literal: no line breaks, no other escapes
_ESCAPE = rf"(?:{_SAME}|\\{_KEPT})"
_PLAIN = r"\x00-\x08\x0a-\x1f\\"
#: pieces of a literal; the last alternative takes all the rest, from the first piece that is none
_PIECE = "|".join(
    [
        rf"'[^'{_PLAIN}]*+(?:{_ESCAPE}[^'{_PLAIN}]*+)*+'",
        rf'"[^"{_PLAIN}]*+(?:{_ESCAPE}[^"{_PLAIN}]*+)*+"',
        r"[\[\](){},:]",
        r"(?:0|-?[1-9][0-9]{0,17})(?![0-9A-Za-z_.])",
        r"(?:True|False|None)(?![0-9A-Za-z_])",
        r"[ \t\r\n]++",
        r"[\s\S]++",
    ]
)
_QUOTES = "['\"]"
_PAIR = rf"{_QUOTES}++:(?:{_QUOTES}++|[-0-9TFN])"
_MAP = rf"\{{(?:{_PAIR}(?:,{_PAIR})*+,?+)?+\}}"
_MAPS = rf"(?:{_MAP}(?:,{_MAP})*+,?+)?+"
#: first characters of the pieces of a list or a tuple of flat maps
_MESSAGES = rf"^(?:\[{_MAPS}\]|\((?:{_MAP},{_MAPS})?+\))$"


def with_plain_literals(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the message list of Python literals that are a list or tuple of flat maps, else null.

    Read without Python: strings in either quotes, adjacent strings, backslashes that escape nothing (as in formulas), whole
    numbers, ``True``, ``False`` and ``None``, trailing commas, tuples.  The text is cut into pieces that know of quotes; the first characters of the
    pieces show whether it is such a list, and each piece then becomes JSON by itself and its neighbours.
    Null, and so left to :func:`literal_messages`, is all that might mean something else there: other escapes,
    triple quotes, other numbers, comments, nested values, keys that are no strings or stand twice.
    """
    whole = F.col(text)
    may_be = whole.rlike(r"^[ \t]*+[\[(]") & ~whole.contains("'''") & ~whole.contains('"""')
    pieces = F.filter(
        F.regexp_extract_all(F.when(may_be, whole), F.lit(f"({_PIECE})"), F.lit(0)),
        lambda piece: ~F.substring(piece, 1, 1).isin(" ", "\t", "\r", "\n"),
    )
    df = df.select("*", F.explode(F.array(pieces)).alias("_pieces"))
    shape = F.array_join(F.transform("_pieces", lambda piece: F.substring(piece, 1, 1)), "")
    df = df.withColumn("_pieces", F.when(shape.rlike(_MESSAGES), F.col("_pieces")))

    def quoted(piece: Column) -> Column:
        return F.coalesce(F.substring(piece, 1, 1).isin("'", '"'), F.lit(False))

    def inside(piece: Column) -> Column:
        bare = F.replace(F.substring(piece, F.lit(2), F.length(piece) - 2), F.lit("\t"), F.lit("\\t"))
        bare = F.regexp_replace(bare, rf"\G([^\\]*+(?:{_SAME}[^\\]*+)*+)\\({_KEPT})", r"$1\\\\$2")
        unquoted = F.regexp_replace(bare, r'\G([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"', r'$1\\"')
        return F.when(F.substring(piece, 1, 1) == "'", unquoted).otherwise(bare)

    def as_json(piece: Column, i: Column) -> Column:
        before, behind = F.get("_pieces", i - 1), F.get("_pieces", i + 1)
        opening = F.when(quoted(before), "").otherwise('"')
        closing = F.when(quoted(behind), "").otherwise('"')
        return (
            F.when(quoted(piece), F.concat(opening, inside(piece), closing))
            .when((piece == ",") & behind.isin("]", "}", ")"), "")
            .when(piece == "(", "[")
            .when(piece == ")", "]")
            .when(piece == "True", "true")
            .when(piece == "False", "false")
            .when(piece == "None", "null")
            .otherwise(piece)
        )

    found = parse_message_list(F.array_join(F.transform("_pieces", as_json), ""))
    df = df.select("*", F.explode(F.array(found)).alias(name)).drop("_pieces")
    once = F.forall(name, lambda m: F.size(F.array_distinct(F.map_keys(m))) == F.size(m))
    return df.withColumn(name, F.when(once, F.col(name)))


def literal_messages(text: Column) -> Column:
    """JSON text of a Python-literal message list; null where there is nothing to read."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ast
        import json
        import warnings

        warnings.simplefilter("ignore", SyntaxWarning)

        def to_json(value):
            if value is None:
                return None
            try:
                return json.dumps(ast.literal_eval(value))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        for batch in batches:
            yield batch.map(to_json)

    return F.pandas_udf(read, "string")(text)


def with_message_list(
    df: DataFrame, text: str, name: str, python_literals: bool = True
) -> DataFrame:
    """Add the parsed message list of a translated answer.

    With ``python_literals`` the answers that are no JSON are read as literals, the plain
    ones natively; so are those with an escape that JSON does not have, as the JSON
    reader would drop its backslash.  The table is then stored, so that only rows whose answer is
    still unread enter Python, and nothing before is done twice for them.
    """
    answer = F.col(text)
    if python_literals:
        json_only = rf"^[^\\]*+(?:(?:{_SAME}|\\/)[^\\]*+)*+$"
        answer = F.when(answer.rlike(json_only), answer)
    parsed = df.select("*", F.explode(F.array(parse_message_list(answer))).alias(name))
    if not python_literals:
        return parsed
    other = parsed.withColumn("_other", F.when(F.col(name).isNull(), F.col(text)))
    plain = with_plain_literals(other, "_other", "_plain")
    read = plain.withColumn(name, F.coalesce(F.col(name), F.col("_plain")))
    unread = F.col(text).isNotNull() & F.col(name).isNull()
    rows = stored(read.withColumn("_unread", unread).drop("_other", "_plain"), "message-lists")
    residue = rows.filter("_unread").withColumn("_literal", literal_messages(F.col(text)))
    rescued = residue.withColumn(name, parse_message_list(F.col("_literal"))).drop("_literal")
    return rows.filter("NOT _unread").unionByName(rescued).drop("_unread")
