"""Answer parsing against a plain Python model, over many random texts in one job."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.answers import (
    clean_json_answer,
    parse_json_strict,
    split_reasoning,
    string_or_list,
    with_message_list,
    with_parsed_answer,
    with_plain_literals,
)
from weftline.functions.text import strip


def random_texts(pieces, count, longest, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(count)})


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(8)


def model_loads(text):
    """JSON value, or the marker for unreadable; numbers out of the ordinary are left out of the texts."""

    def no_repeats(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    try:
        return json.loads(text, object_pairs_hook=no_repeats)
    except ValueError:
        return Ellipsis


def known_answer(rng):
    """An answer put together from known parts, and the part that has to be found in it."""
    payload = rng.choice(['{"k": ["a", 7, "b"]}', '{"k": "lone"}', '{"k": 5}', "[1, 2]", "null", "1", "{", "text", '{"k": ["x"]} tail'])
    payload = rng.choice(["", " ", "\n"]) + payload + rng.choice(["", "\n"])
    kind = rng.randrange(4)
    if kind == 0:  # bare; nothing is cut
        return payload, payload
    if kind == 1:  # the word first, white space around: the end is cut, the space behind the word stays
        word = rng.choice(["json", "JSON", "Json"])
        blank = rng.choice(["", " ", "\n \t"])
        return blank + word + payload + blank, payload.rstrip()
    before = rng.choice(["Here it is: ", "", "```json\n{}\n``` or "])
    if kind == 2:  # a fence, closed or not
        return f"{before}```json{payload}{rng.choice(['```', ''])}", payload
    # fences without the word only disappear
    lead = rng.choice(["Here: ", "so "])
    return f"{lead}```{payload}```", f"{lead}{payload}"


def test_json_answers(spark):
    rng = random.Random(1)
    pairs = dict(known_answer(rng) for _ in range(12000))
    texts = list(pairs)
    parsed = with_parsed_answer(frame(spark, texts), "x")
    rows = parsed.select(
        "i", clean_json_answer(F.col("x")), F.col("parsed").isNotNull(), string_or_list(F.col("parsed"), "k")
    ).collect()
    assert len(rows) == len(texts)
    lists = {'{"k": ["a", 7, "b"]}': ["a", "b"], '{"k": "lone"}': ["lone"]}
    readable = 0
    for i, cleaned, is_readable, found in rows:
        part = pairs[texts[i]]
        assert cleaned == part, repr(texts[i])
        assert is_readable == (model_loads(part) is not Ellipsis), repr(texts[i])
        assert found == lists.get(part.strip()), repr(texts[i])
        readable += is_readable
    assert readable > 50


def test_strict_json_on_tails(spark):
    tails = random_texts(["{", "}", "[", "]", ",", ":", '"v"', "1", " ", '{"a":1}', "//", "#", "'"], 4000, 6, seed=2)
    rows = frame(spark, tails).select("i", parse_json_strict(F.col("x")).isNotNull()).collect()
    for i, is_readable in rows:
        assert is_readable == (model_loads(tails[i]) is not Ellipsis), repr(tails[i])


def test_reasoning_and_strip(spark):
    """Answers out of a thinking part, markers and what is said; the parts are what has to come out."""
    rng = random.Random(3)
    blanks = ["", " ", "\n", "\u3000"]
    known = {}
    for _ in range(3000):
        thinking = rng.choice(["a", "a b\nc", "final", "assist"])
        said = rng.choice(["x", "x y", "final"])
        middle = "".join(f"m{k}assistantfinal" for k in range(rng.randrange(3)))
        start, around = rng.choice(["analysis", ""]), rng.choice(blanks)
        text = f"{around}{start}{thinking}assistantfinal{middle}{said}{around}"
        known[text] = (thinking, said)
        known[f"{around}{start}{thinking}{said}{around}"] = (None, None)
    texts = list(known)
    for i, pair, stripped in frame(spark, texts).select("i", split_reasoning(F.col("x")), strip(F.col("x"))).collect():
        assert tuple(pair) == known[texts[i]], repr(texts[i])
        assert stripped == texts[i].strip()


def test_message_lists(spark):
    rng = random.Random(4)
    messages = [
        "{'role': 'user', 'content': 'a'}", '{"role": "user", "content": "b"}', "'c'", "7",
        "{'role': 'assistant', 'content': \"it's\"}", "{'role': 'user', 'content': 'it\\'s'}",
    ]

    def text():
        opening, closing = rng.choice(["[]", "[]", "[]", "()", "[)"])
        body = rng.choice([",", ", ", ",", " "]).join(rng.choices(messages, [4, 4, 1, 1, 4, 4], k=rng.randint(0, 3)))
        return rng.choice(["", " ", "\n"]) + opening + body + rng.choice(["", "", ","]) + closing + rng.choice(["", " ", "x", "]"])

    texts = sorted({text() for _ in range(4000)})

    def model(text):
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(text)
                break
            except (ValueError, SyntaxError):
                continue
        else:
            return None
        is_messages = isinstance(value, (list, tuple)) and all(isinstance(e, dict) for e in value)
        return [[m.get("role"), m.get("content")] for m in value] if is_messages else None

    def field(name):
        return lambda m: F.try_variant_get(F.try_element_at(m, F.lit(name)), "$", "string")

    both = F.transform("m", lambda m: F.array(field("role")(m), field("content")(m)))
    rows = with_message_list(frame(spark, texts), "x", "m").select("i", both).collect()
    readable = 0
    for i, found in rows:
        expected = model(texts[i])
        if expected is None:
            # a list with other entries than objects, or an object alone, must not pass as messages
            assert not found or all(None in e for e in found) or found is None, repr(texts[i])
        else:
            assert found == expected, repr(texts[i])
            readable += 1
    assert readable > 100


def plain_model(text):
    """What a Python literal holds, as JSON values; the marker where it is none."""
    try:
        return json.loads(json.dumps(ast.literal_eval(text)))
    except (ValueError, SyntaxError, TypeError):
        return Ellipsis


def variant_lists(df, name):
    as_text = F.to_json(F.transform(name, lambda m: F.transform_values(m, lambda _, v: F.to_json(v))))
    rows = df.select("i", as_text).collect()
    return {i: None if t is None else [{k: json.loads(v) for k, v in m.items()} for m in json.loads(t)] for i, t in rows}


def test_plain_literals_are_read_without_python(spark):
    """Literals written by rule, so what they hold is known; all of them have to be read natively."""
    rng = random.Random(5)
    letters = ["a", "b c", "'", '"', "\\", "\n", "\t", "{", "},", "[", "é", "\U0001f600", ":", "(", "True", "\b", "\x7f"]

    def literal(value):
        """A string in one or more quoted pieces, none of them empty next to another."""
        cuts = sorted(rng.sample(range(1, len(value)), min(len(value) - 1, rng.choice([0, 0, 1, 2])))) if len(value) > 1 else []
        pieces = [value[a:b] for a, b in zip([0, *cuts], [*cuts, len(value)])]
        out = []
        for piece in pieces:
            quote = rng.choice("'\"")
            body = "".join(
                {"\\": "\\\\", "\n": "\\n", "\b": "\\u0008", quote: "\\" + quote}.get(c, c) for c in piece
            )
            out.append(quote + body + quote)
        return rng.choice([" ", "\n ", "\t"]).join(out)

    def scalar():
        kind = rng.randrange(6)
        if kind == 0:
            return rng.choice([("True", True), ("False", False), ("None", None), ("0", 0), ("-12", -12), ("123456789012345678", 123456789012345678)])
        value = "".join(rng.choices(letters, k=rng.randint(0, 6)))
        return literal(value), value

    def message():
        keys = rng.sample(["role", "content", "x", "it's"], rng.randint(0, 3))
        pairs = [(k, *scalar()) for k in keys]
        blank = rng.choice(["", " ", "\n"])
        body = f",{blank}".join(f"{literal(k)}:{blank}{written}" for k, written, _ in pairs)
        return "{" + body + ("," if pairs and rng.random() < 0.2 else "") + "}", {k: v for k, _, v in pairs}

    texts, held = [], []
    for _ in range(3000):
        some = [message() for _ in range(rng.randint(0, 4))]
        body = ", ".join(written for written, _ in some)
        if rng.random() < 0.5:
            text = "[" + body + ("," if some and rng.random() < 0.3 else "") + "]"
        else:
            text = "(" + body + ("," if len(some) == 1 or some and rng.random() < 0.3 else "") + ")"
        if "'''" in text or '"""' in text:
            continue
        texts.append(rng.choice(["", " "]) + text + rng.choice(["", " ", "\n"]))
        held.append([value for _, value in some])
    assert [plain_model(t) for t in texts] == held
    found = variant_lists(with_plain_literals(frame(spark, texts), "x", "m"), "m")
    for i, expected in enumerate(held):
        assert found[i] == expected, repr(texts[i])


@pytest.mark.filterwarnings("ignore:.*invalid escape sequence:SyntaxWarning")
def test_what_plain_literals_say_python_says(spark):
    """Texts of random pieces: what is read natively is what Python reads, the rest is left to it."""
    pieces = [
        "[", "]", "(", ")", "{", "}", ",", ":", " ", "\n", "\t", "'", '"', "'a'", '"b"', "'k':", "1", "0", "-", "007", "1.5", "True",
        "None", "true", "\\", "\\(", "\\é", "\\u00e9", "'\\x41'", "'\\''", "#", "r'c'", "{'k': 1}", "{'k': 'v',}", "{'k': 1, 'k': 2}", "{1: 2}", "{'k': {}}",
    ]
    bodies = random_texts(pieces, 6000, 3, seed=6)
    framed = [f"{a}{t}{b}" for t in bodies for a, b in (("[{'k': ", "}]"), ("({'k': 0,", "},)"), ("(", ",)"), ("[{'k': 'v", "'}]"))]
    texts = sorted({*random_texts(pieces, 8000, 6, seed=7), *framed})
    found = variant_lists(with_plain_literals(frame(spark, texts), "x", "m"), "m")
    read = 0
    for i, text in enumerate(texts):
        if found[i] is not None:
            assert found[i] == plain_model(text), repr(text)
            read += 1
    assert read > 300
