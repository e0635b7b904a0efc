"""Edge tables of answer parsing, conversation checks and request texts."""

import json

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from weftline.functions.answers import (
    clean_json_answer,
    parse_json_strict,
    parse_message_list,
    single_output,
    split_reasoning,
    string_list,
    string_or_list,
    string_value,
    with_message_list,
    with_parsed_answer,
    with_plain_literals,
)
from weftline.functions.text import filesafe, is_sound_text, render, strip, token_count, truncate_tokens
from weftline.functions.turns import (
    alternates,
    length_ratio_ok,
    map_roles,
    no_banned_tokens,
    typed_messages,
    well_formed_messages,
)


def one_column(spark, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, x {kind}").repartition(2)


def results(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_split_reasoning(spark):
    cases = {
        None: (None, None),
        "hello": (None, None),
        "analysis think assistantfinal hi": ("think ", " hi"),
        " analysis a assistantfinal b assistantfinal c": ("a ", " c"),
        "x assistantfinal": ("x ", ""),
        "\n analysis\n deep assistantfinal ok ": ("deep ", " ok"),
    }
    df = one_column(spark, list(cases))
    got = results(df, split_reasoning(F.col("x")))
    assert [tuple(g) for g in got] == list(cases.values())
    no_marker = results(df, split_reasoning(F.col("x"), "analysis", None))
    assert all(tuple(g) == (None, None) for g in no_marker)


STRICT = {
    '{"a":1}': True,
    '{"a":1} tail': False,
    '{"a":1}]': False,
    '{"a":1}}': False,
    '{"a":1},{"b":2}': False,
    '{"a":1},"w":1': False,
    "": False,
    " ": False,
    "1": True,
    '"x"': True,
    '{"a":1}] [': False,
    "null": True,
    '{"a":[1,}': False,
    '\n  {"a":1}  \n': True,
    "1],[2": False,
    "{'a': 1}": False,
}


def test_strict_json_agrees_with_json_module(spark):
    def loads(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    assert {t: loads(t) for t in STRICT} == STRICT
    got = results(one_column(spark, list(STRICT)), parse_json_strict(F.col("x")).isNotNull())
    assert dict(zip(STRICT, got)) == STRICT


CLEANED = {
    '```json\n{"a": 1}\n```': '\n{"a": 1}\n',
    ' JSON {"a": 1}  ': ' {"a": 1}',
    '  json\n{"a":\n 1}': '\n{"a":\n 1}',
    "```json\n1\n``` and ```json\n2\n```": "\n2\n",
    "``` [1] ```": " [1] ",
    "plain": "plain",
    "```JSON {}```": "JSON {}",
    "json": "",
    "": "",
}


def test_clean_answer(spark):
    got = results(one_column(spark, list(CLEANED)), clean_json_answer(F.col("x")))
    assert dict(zip(CLEANED, got)) == CLEANED


def test_blanks_inside_an_answer_take_linear_time(spark):
    import time

    text = 'json {"k": "a' + " " * 300_000 + 'b"} ' + " " * 300_000
    frame = one_column(spark, [text])
    frame.select(clean_json_answer(F.col("x"))).collect()
    start = time.perf_counter()
    (got,) = results(frame, clean_json_answer(F.col("x")))
    assert time.perf_counter() - start < 2
    assert got == ' {"k": "a' + " " * 300_000 + 'b"}'


def test_lists_and_strings_under_a_key(spark):
    cases = [
        '{"k": ["a", 7, null, "b", ["c"]]}',
        '{"k": "lone"}',
        '{"k": {"a": "b"}}',
        '{"other": ["a"]}',
        '["a"]',
        '{"k": []}',
        '{"k": 5}',
        None,
    ]
    parsed = with_parsed_answer(one_column(spark, cases), "x")
    assert results(parsed, string_list(F.col("parsed"), "k")) == [["a", "b"], None, None, None, None, [], None, None]
    assert results(parsed, string_or_list(F.col("parsed"), "k"))[1] == ["lone"]
    assert results(parsed, string_value(F.col("parsed"), "k")) == [None, "lone"] + [None] * 6


def test_single_output(spark):
    kind = "array<struct<text:string,finish_reason:string>>"
    cases = [[("a", "stop")], [("a", "length")], [("a", "stop"), ("b", "stop")], [], None]
    assert results(one_column(spark, cases, kind), single_output(F.col("x"))) == ["a", None, None, None, None]


def test_message_lists(spark):
    ok = '[{"role": "user", "content": "a"}]'
    cases = {
        ok: 1,
        "[{'role': 'user', 'content': 'it\\'s'}]": 1,
        "[]": 0,
        ok + " tail": None,
        "Sorry, no.": None,
        "[{'role': 'user', 'content': 'a'},]": 1,
        "[{'role': 'user', 'content': 'a' 'b'}]": 1,
        "[{'role': 'user'": None,
        None: None,
    }
    df = one_column(spark, list(cases))
    got = results(with_message_list(df, "x", "m"), F.expr("if(m is null, null, size(m))"))
    assert got == list(cases.values())
    native = results(with_message_list(df, "x", "m", python_literals=False), F.col("m").isNotNull())
    assert native == [True, True, True, False, False, False, False, False, False]


def test_only_unread_messages_enter_python(spark):
    """Sound rows of every kind are read before the Python node, which stands behind a filter of its own."""
    sound = [
        '[{"role": "user", "content": "a"}]',
        "[{'role': 'user', 'content': 'a'}]",
        "[{'role': 'user', 'content': 'a'},]",
        "({'role': 'user', 'content': 'a' \"it's\"},)",
        "()",
        "[{'role': 'user', 'content': '\\(x^2\\) \\\\ \\\"'}]",
    ]
    odd = ["[{'role': 'user', 'content': '\\x41'}]", "[{'role': 'user', 'content': '''b'''}]", "Sorry, no.", "[{'a': 1, 'a': 2}]"]
    df = one_column(spark, [*sound, *odd, None])
    parsed = with_message_list(df, "x", "m")
    assert results(parsed, F.expr("size(m)"))[:6] == [1, 1, 1, 1, 0, 1]
    assert results(parsed, F.expr("get(m, 0)['content'] :: string"))[5:8] == ['\\(x^2\\) \\ "', "A", "b"]
    assert results(parsed, F.expr("size(get(m, 0))"))[8:] == [None, 1, None]
    plan = plan_of(parsed)
    below = plan[plan.index("ArrowEvalPython") :]
    assert plan.count("ArrowEvalPython") == 1 and "_unread" in below[: below.index("Scan")]
    stored_rows = parsed.inputFiles()
    marked = spark.read.parquet(*stored_rows).filter("_unread").count()
    assert marked == len(odd)
    assert parsed.columns == ["i", "x", "m"]


def test_a_long_literal_needs_no_deep_stack(spark):
    many = "(" + "{'role': 'user', 'content': 'a' \"b\",}, " * 20_000 + ")"
    open_quote = "[" + "{'role': 'user', 'content': 'a'}, " * 20_000 + "{'role': 'x"
    one = "[{'role': 'user', 'content': '" + "\"\\'x" * 100_000 + "',}]"
    df = with_plain_literals(one_column(spark, [many, open_quote, one]), "x", "m")
    assert results(df, F.expr("size(m)")) == [20_000, None, 1]
    assert results(df, F.expr("length(get(m, 0)['content'] :: string)")) == [2, None, 300_000]


def test_conversation_format(spark):
    user, assistant = '{"role":"user","content":"u"}', '{"role":"assistant","content":"a"}'
    cases = {
        "[]": True,
        f"[{user}]": True,
        f"[{user},{assistant}]": True,
        f"[{user},{assistant},{user}]": True,
        f"[{assistant}]": False,
        f"[{user},{user}]": False,
        '[{"role":"system","content":"s"}]': False,
        '[{"role":"user"}]': False,
        '[{"role":"user","content":"u","x":"y"}]': False,
        '[{"role":"user","content":5}]': False,
        '[{"role":"user","content":null}]': False,
        '["text"]': False,
        '{"role":"user","content":"u"}': False,
        "5": False,
    }
    df = one_column(spark, list(cases)).withColumn("m", parse_message_list(F.col("x")))
    shaped = well_formed_messages(F.col("m"))
    verdict = F.coalesce(F.when(shaped, alternates(typed_messages(F.col("m")))), F.lit(False))
    assert dict(zip(cases, results(df, verdict))) == cases


MESSAGES = "array<struct<role:string,content:string>>"


def test_length_ratio_bounds(spark):
    def turn(n):
        return [("user", " ".join(["w"] * n))]

    pairs = [(4, 3, True), (100, 74, False), (1, 25, True), (10, 251, False), (0, 3, False), (4, 4, True)]
    rows = [(i, turn(o), turn(t)) for i, (o, t, _) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"i int, o {MESSAGES}, t {MESSAGES}")
    assert results(df, length_ratio_ok(F.col("o"), F.col("t"))) == [ok for *_, ok in pairs]
    empty = spark.createDataFrame([(0, [], [])], f"i int, o {MESSAGES}, t {MESSAGES}")
    assert results(empty, length_ratio_ok(F.col("o"), F.col("t"))) == [True]


def test_roles_and_banned_tokens(spark):
    source = [[("human", "a"), ("gpt", "b"), ("system", "c")]]
    df = one_column(spark, source, "array<struct<`from`:string,value:string>>")
    (mapped,) = results(df, map_roles(F.col("x")))
    assert [m["role"] for m in mapped] == ["user", "assistant", None]
    texts = [[("user", "see <image>")], [("user", "see <IMAGE>")], [("user", "a"), ("assistant", "<audio>")], []]
    got = results(one_column(spark, texts, MESSAGES), no_banned_tokens(F.col("x")))
    assert got == [False, True, False, True]


def test_text_functions(spark):
    names = {"Acehnese (Jawi script)": "AcehneseJawiscript", "a_b-c": "a_bc", "Kabiyè": "Kabiy"}
    assert results(one_column(spark, list(names)), filesafe(F.col("x"))) == list(names.values())
    spaced = ["  a b \n", "\x1c　x", ""]
    assert results(one_column(spark, spaced), strip(F.col("x"))) == [s.strip() for s in spaced]
    text = "Don't  stop, été 42!\n"
    df = one_column(spark, [text])
    assert results(df, token_count(F.col("x"))) == [8]
    assert results(df, truncate_tokens(F.col("x"), 4)) == ["Don't  stop"]
    assert results(one_column(spark, ["ok", None]), is_sound_text(F.col("x"))) == [True, False]


def test_render_fills_in_one_pass(spark):
    df = one_column(spark, ["{b} and {{x}}"])
    assert results(df, render("<{a}> {b}", a=F.col("x"), b=5)) == ["<{b} and {{x}}> 5"]
    assert results(one_column(spark, [None]), render("<{a}>", a=F.col("x"))) == [None]


@pytest.mark.parametrize("builder", ["python_counter"])
def test_python_counter_hook(spark, builder):
    from weftline.functions.text import python_counter
    from weftline.functions.turns import conversation_tokens

    counter = python_counter(lambda: lambda text: len(text.split()))
    df = one_column(spark, [[("user", "a b c"), ("assistant", "d")], []], MESSAGES)
    assert results(df, conversation_tokens(F.col("x"), counter)) == [4, 0]
    assert results(one_column(spark, ["one two", None]), token_count(F.col("x"), counter)) == [2, None]
