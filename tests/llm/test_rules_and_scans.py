"""Quality rules, personal data and secrets."""

import base64
import hashlib
import math
import random
import re
import string

import pytest
from compare import compare, duck
from hypothesis import HealthCheck, given, settings, strategies as st
from llm_helpers import DOCS, docs, odd_docs

from weftline.llm import pii, quality, queries, secrets
from weftline.llm.common import Span, clear_of, replaced

CARD = "4111 1111 1111 1111"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_personal(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group())):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def plain_secrets(text):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def as_tuples(spans):
    return [(s["start"], s["ord"], s["end"], s["kind"]) for s in spans]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


PARTS = [
    "ann@mail.example.com", "x@y", "a.b@c-d.e_f@g.hh", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4",
    CARD, "4111-1111-1111-1112", "123456789012", "1 2 3", "+1 (017) 555-7713", "+12", "+1234567890123456", " ", "\n",
    "\U0001f600", "é", "token = ", "API_KEY:'", "password", "0123456789abcdef0123456789abcdef", "AKIA", "ABCDEFGHIJKL12",
    "secret=abcdefgh", "\"", "word", "-", ".", "Zürich",
]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=40, max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(spark, texts):
    table = docs(spark, texts)
    for module, plain in ((pii, plain_personal), (secrets, plain_secrets)):
        found = pii.find(table) if module is pii else secrets.scan(table)
        for row in found.collect():
            assert as_tuples(row["base_spans"]) == plain(row["text"])


@pytest.mark.parametrize(
    ("name", "plain"), [("op3_personal_data", plain_personal), ("op5_secret_scan", plain_secrets)]
)
def test_scan_queries_over_whole_tables(spark, sf_dir, name, plain):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = plain(texts[row["doc_id"]])
        assert row["base_sha256"] == digest(base)
        listed = [s for s in row["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(listed)


def test_many_matches_in_one_text_keep_their_places(spark):
    text = "é a@b.cc " * 3000
    row = pii.find(docs(spark, [text])).first()
    assert as_tuples(row["base_spans"]) == plain_personal(text)


def test_long_runs_take_linear_time(spark):
    text = "a" * 300_000 + " " + "1." * 100_000 + " x@" + "a." * 50_000 + " " + "9" * 200_000
    spans = as_tuples(pii.find(docs(spark, [text])).first()["base_spans"])
    kinds = [s[3] for s in spans]
    start = text.index("x@")
    assert kinds.count("ip") == 25_000 and len(kinds) == 25_001
    assert spans[-1] == (start, 0, start + 2 + 99_999, "email")
    assert secrets.scan(docs(spark, ["f" * 300_000])).first()["spans"][0]["end"] == 300_000


def test_disclosing_terms_are_found_by_corpus_evidence(spark):
    near = [f"Call Quillfeather about matter {w} at ann@mail.example.com before noon" for w in ("red", "blue", "green", "grey")]
    other = [f"the matter {w} came up before noon and nobody minded at all" for w in ("oak", "elm", "ash", "fir", "yew")]
    copies = ["Ring Onlyonce at bob@mail.example.com now"] * 6
    table = docs(spark, near + other + copies + ["Quillfeather wrote about oak trees"])
    rows = {r["doc_id"]: r for r in pii.find(table).collect()}
    for i in range(4):
        kinds = {r["kind"] for r in rows[i]["spans"]}
        words = {near[i][s["start"] : s["end"]] for s in rows[i]["spans"]}
        assert "Quillfeather" in words and "email" in kinds
        assert "matter" not in words and "noon" not in words
    # copies are one context and prove nothing
    assert [s["kind"] for s in rows[9]["spans"]] == ["email"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(table).collect()}
    assert "Quillfeather" not in clean[15] and "oak trees" in clean[15]
    assert "ann@" not in clean[0] and "[email]" in clean[0]
    assert all(clean[4 + i] == other[i] for i in range(5))


def test_disclosing_terms_equal_a_plain_count(spark):
    """Shares of texts, counted by hand on a fixture."""
    texts = [f"So Alder meets Birch {w} near 10.0.0.1 today" for w in ("one", "two", "three", "four")]
    texts += [f"Birch alone again {chr(97 + i)}" for i in range(3)]
    terms, _ = pii.disclosing_terms(docs(spark, texts))
    found = {r["term"]: round(r["bits"], 6) for r in terms.collect()}
    # alder: 4 of 4 texts; birch: 4 of 7, 0.807355 bits
    assert found["alder"] == 0 and found["birch"] == 0.807355


def test_a_shared_contact_line_is_evidence_in_every_text(spark):
    fill = "please write to the office in good time and do not forget the number of the order which is here"
    line = f"{fill} Quillfeather ann@mail.example.com {fill}"
    texts = [f"text {chr(97 + i) * 3} about something else. {line} and so on {chr(97 + i) * 4}" for i in range(9)]
    texts += [f"the office in good time, order number {chr(97 + i) * 5}" for i in range(20)]
    terms, _ = pii.disclosing_terms(docs(spark, texts + texts[:3]))
    found = {r["term"]: (r["entity"], r["bits"]) for r in terms.collect()}
    assert found["quillfeather"] == ("email:ann@mail.example.com", 0)
    assert "office" not in found and "good" not in found


def test_markov_finds_random_strings_and_leaves_words(spark):
    texts = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" here' for i in range(60)]
    texts += [f"ordinary_identifier_name and another-long-identifier number{i} Understandable" for i in range(60)]
    weights = secrets.train(docs(spark, texts))
    probe = ["see q8Zr2Kx0vLw9Tn4Bh7Yd1Mc3 there", "see ordinary_identifier_number there", "4111111111111111"]
    rows = secrets.scan(docs(spark, probe), weights=weights).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["spans"]] for r in rows] == [["markov"], [], []]
    clean = secrets.redacted(docs(spark, probe), weights=weights).orderBy("doc_id").collect()
    assert clean[0]["text"] == "see [secret] there" and clean[1]["text"] == probe[1]


def test_overlapping_spans_are_replaced_once(spark):
    from pyspark.sql import functions as F

    spans = F.expr(
        "array(named_struct('start', 2, 'ord', 0, 'end', 6, 'kind', 'a'), "
        "named_struct('start', 4, 'ord', 1, 'end', 8, 'kind', 'b'))"
    )
    row = spark.sql("SELECT '0123456789' AS t").select(replaced(F.col("t"), spans, {"a": "[a]", "b": "[b]"}).alias("x"))
    assert row.first()["x"] == "01[a]89"


@pytest.mark.parametrize("operator", [pii.find, secrets.scan, quality.judge])
def test_odd_rows_and_names(spark, operator):
    table = odd_docs(spark)
    wide = table.selectExpr("*", "1 AS spans", "2 AS base_spans", "3 AS quality", "4 AS _text", "5 AS _row", "6 AS _words", "7 AS n_words")
    rows = operator(wide).collect()
    assert len(rows) == 7 and {"_text", "_row", "n_words"} <= set(operator(wide).columns)
    assert operator(table.limit(0)).count() == 0
    if operator is not quality.judge:
        assert all(r["spans"] == [] for r in rows)


@pytest.mark.parametrize("rewrite", [pii.sanitised, secrets.redacted])
def test_texts_without_findings_stay(spark, rewrite):
    table = odd_docs(spark)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, rewrite(table).collect())) == sorted(map(key, table.collect()))


def test_quality_query_against_sql(spark, sf_dir):
    problem, _, _ = compare(
        spark, duck(sf_dir), sf_dir, "op6_quality_rules", queries.QUERIES["op6_quality_rules"], queries.ORACLES["op6_quality_rules"]
    )
    assert not problem, problem


def plain_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for own in places.values() if len(own) > 1 for i in own for k in range(3)})


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd", "\n", "\t"]), max_size=120).map(" ".join), min_size=30, max_size=30))
def test_repeated_windows_equal_a_plain_count(spark, texts):
    texts = [*texts, " ".join(str(i % 40) for i in range(400)), "x " * 5000]
    for row in quality.judge(docs(spark, texts)).select("text", "quality.n_repeat_words").collect():
        assert row[1] == plain_repeats(row[0])


def test_rules_name_what_fails(spark):
    good = " ".join(f"the word{i} of" for i in range(60))
    rows = quality.judge(docs(spark, [good, "# " * 100, None])).orderBy("doc_id").collect()
    assert rows[0]["quality"]["kept"] and not rows[0]["quality"]["failed"]
    assert "symbols" in rows[1]["quality"]["failed"] and not rows[2]["quality"]["kept"]
    only = quality.judge(docs(spark, [good]), rules=(quality.Rule("short", "n_words", None, 10),))
    assert only.first()["quality"]["failed"] == ["short"]
    assert DOCS


def test_clear_spans_equal_a_plain_comparison(spark):
    from pyspark.sql import functions as F

    draw = random.Random(5)

    def some(n, width):
        found = [(a, 0, a + 1 + draw.randrange(width), "x") for a in (draw.randrange(900) for _ in range(n))]
        return sorted(found)

    rows = [(i, some(draw.choice([0, 3, 300]), 4), some(draw.choice([0, 1, 40, 600]), 9)) for i in range(12)]
    table = spark.createDataFrame(rows, f"id long, spans {Span}, others {Span}")
    for row in table.withColumn("clear", clear_of(F.col("spans"), F.col("others"))).collect():
        wanted = [s for s in row["spans"] if not any(o["start"] < s["end"] and s["start"] < o["end"] for o in row["others"])]
        assert sorted(row["clear"]) == sorted(wanted)


def plain_weights(texts):
    """The log ratios by the docstring of the module, in plain Python."""
    random_, ordinary = set(), set()
    for text in texts:
        for a, _, b, kind in plain_secrets(text):
            own = text[a:b]
            random_.add(re.fullmatch(secrets.ASSIGN, own).group(2) if kind == "assign" else own)
        ordinary |= {w for w in text.split(" ") if len(w) >= 8 and re.fullmatch(secrets.IDENTIFIER[1:-1], w)}
    made = (hashlib.sha256(str(i).encode()).digest() for i in range(secrets.DIGESTS))
    random_ |= {base64.b64encode(d).decode().rstrip("=") for d in made}
    size = len(secrets.ALPHABET) + 1
    chances = []
    for values in (random_, ordinary):
        table = [[0] * size for _ in range(size)]
        for value in values:
            at = [secrets.ALPHABET.find(c) + 1 for c in value]
            for a, b in zip(at, at[1:]):
                table[a][b] += 1
        whole = [sum(row[b] for row in table) + 0.5 for b in range(size)]
        lean = [secrets.BACKOFF * w / sum(whole) for w in whole]
        chances.append([[(row[b] + lean[b]) / (sum(row) + secrets.BACKOFF) for b in range(size)] for row in table])
    return lambda a, b: math.log(chances[0][a][b] / chances[1][a][b])


def plain_markov(text, weight):
    base, out = plain_secrets(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        own = m.group()
        if len(own) < 8 or not re.search("[A-Za-z]", own) or any(a < m.end() and m.start() < b for a, _, b, _ in base):
            continue
        at = [secrets.ALPHABET.find(c) + 1 for c in own]
        total = sum(weight(a, b) for a, b in zip(at, at[1:]))
        least, mean = (12, 0.5) if re.search("[0-9]|[a-z][A-Z]", own) else (18, 1.0)
        if total >= least and total >= mean * (len(own) - 1):
            out.append((m.start(), 3, m.end(), "markov"))
    return out


def test_markov_spans_equal_a_plain_scorer(spark, sf_dir):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    draw = random.Random(11)
    signs = [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits]
    for i in range(0, len(texts), 5):  # random strings of all lengths and alphabets, in the middle of real texts
        own = "".join(draw.choice(signs[i % 3]) for _ in range(draw.choice([8, 10, 12, 15, 24, 48])))
        texts[i] = f"{texts[i][:200]} {own} {texts[i][200:]}"
    weight = plain_weights(texts)
    lengths = set()
    for row in secrets.scan(docs(spark, texts)).collect():
        wanted = sorted([*plain_secrets(row["text"]), *plain_markov(row["text"], weight)])
        assert as_tuples(row["spans"]) == wanted
        lengths |= {row["text"][a:b].islower() for a, _, b, kind in wanted if kind == "markov"}
        lengths |= {b - a for a, _, b, kind in wanted if kind == "markov"}
    assert min(lengths - {True, False}) < 16 and True in lengths  # beyond the fixed forms, short and of letters alone
