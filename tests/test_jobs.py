"""Joins, write-backs, languages, skewed inputs, streaming and plan shapes."""

import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from weftline.operators import langs
from weftline.operators.exchange import attach, coalesce_update, pending, retry, teacher_map
from weftline.operators.turn_tables import check_turns, gather_turns
from weftline.plans import requests as ask
from weftline.plans.train_set import require_subsets, stack_subsets, with_provenance
from weftline.session import new_folder
from weftline.sources.batches import write_requests
from weftline.sources.jsonl import read_jsonl, read_prompt_files


def answers(spark, rows):
    return spark.createDataFrame(rows, "req_id string, reasoning string, response string")


def test_attach_takes_one_answer_and_prefers_a_text(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "req_id string")
    got = answers(spark, [("a", None, None), ("a", "r", "x"), ("a", "r", "x"), ("b", None, None), ("z", "r", "y")])
    rows = {r["req_id"]: r["response"] for r in attach(requests, got).collect()}
    assert rows == {"a": "x", "b": None, "c": None}
    assert [r["req_id"] for r in pending(requests, got).collect()] == ["c"]


def test_one_result_sent_very_often(spark):
    """A third of all rows are copies of one result; each request still has one row."""
    requests = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("req_id"))
    hot = spark.range(1000).select(F.md5(F.lit("7")).alias("req_id"))
    got = requests.unionByName(hot).withColumns({"reasoning": F.lit("r"), "response": F.lit("x")})
    joined = attach(requests, got)
    assert joined.count() == 2000 and joined.filter("response = 'x'").count() == 2000


def test_retry_gets_new_ids_and_ends(spark):
    requests = spark.createDataFrame([("a", "k", 0), ("b", "l", 0)], "req_id string, key string, attempt int")
    failed = retry(requests, answers(spark, [("a", None, "x")]).select("req_id"), "job", ["key"], 2)
    (row,) = failed.collect()
    assert row["key"] == "l" and row["attempt"] == 1 and row["req_id"] not in ("a", "b")
    assert retry(failed, answers(spark, []), "job", ["key"], 2).count() == 0


def test_write_back(spark):
    base = spark.createDataFrame(
        [(1, "old"), (2, "old"), (3, None), (4, None)], "id int, revised_prompt string"
    )
    updates = spark.createDataFrame([(1, None), (2, "new"), (3, "new")], "id int, revised_prompt string")
    rows = {r["id"]: r["revised_prompt"] for r in coalesce_update(base, updates, "id", ["revised_prompt"]).collect()}
    assert rows == {1: "old", 2: "new", 3: "new", 4: None}
    fresh = coalesce_update(base.select("id"), updates, "id", ["revised_prompt"])
    assert {r["id"]: r["revised_prompt"] for r in fresh.collect()} == {1: None, 2: "new", 3: "new", 4: None}


def test_failing_client_call_costs_one_row(spark):
    requests = spark.createDataFrame([("a", "s", "1"), ("b", "s", "x")], "req_id string, system_prompt string, prompt string")

    def client():
        return lambda system, prompt: {"reasoning": system, "response": str(int(prompt) + 1)}

    rows = {r["req_id"]: (r["reasoning"], r["response"]) for r in teacher_map(requests, client, 2).collect()}
    assert rows == {"a": ("s", "2"), "b": (None, None)}


def test_requests_are_written_once_unless_forced(spark):
    def requests(n):
        return spark.range(n).select(
            F.md5(F.col("id").cast("string")).alias("req_id"), F.lit("s").alias("system_prompt"), F.lit("p").alias("prompt")
        )

    path = new_folder(spark, "requests")
    write_requests(requests(3), path, model="m", run_name="-run")
    write_requests(requests(5), path, model="m", run_name="-run")
    assert spark.read.text(path).count() == 3
    write_requests(requests(5), path, model="m", force=True)
    assert spark.read.text(path).count() == 5


# --- Languages -----------------------------------------------------------------------

SCRIPTS = [
    (0, "ajp_Arab", "South Levantine Arabic"),
    (1, "als_Latn", "Albanian (Tosk)"),
    (2, "apc_Arab_sout3123", "South Levantine Arabic"),
]


def test_codes_by_name_in_table_order(spark):
    codes = langs.codes_by_name(spark.createDataFrame(SCRIPTS, "ord int, code string, name string").repartition(3))
    assert {r["name"]: r["codes"] for r in codes.collect()}["South Levantine Arabic"] == ["ajp_Arab", "apc_Arab_sout3123"]


def test_first_code_the_corpus_has(spark):
    codes = spark.createDataFrame(SCRIPTS, "ord int, code string, name string")
    corpus = spark.createDataFrame([("apc_Arab_sout3123", 1), ("als_Latn", 2), ("xxx", 3)], "code string, id int")
    rows = {r["id"]: r["lang_name"] for r in langs.corpus_of_languages(corpus, "code", codes).collect()}
    assert rows == {1: "South Levantine Arabic", 2: "Albanian (Tosk)"}


def test_short_codes(spark):
    two, three = langs.two_letter_codes(spark), langs.three_letter_codes(spark)
    assert (two.count(), three.count()) == (60, 98)
    names = spark.createDataFrame([("French",), ("Zulu",), ("Simplified Chinese",), ("Klingon",)], "lang_name string")
    rows = {r["lang_name"]: (r["three_letter_code"], r["short_code"]) for r in langs.shortest_code(names, "lang_name", two, three).collect()}
    assert rows == {
        "French": ("fra", "fr"), "Zulu": ("zul", "zul"), "Simplified Chinese": (None, None), "Klingon": (None, None),
    }
    many = spark.range(10**9).select(F.concat(F.lit("L"), "id").alias("lang_name"))
    plan = plan_of(langs.shortest_code(many, "lang_name", two, three))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    missing = langs.unknown_names(names, "lang_name", three)
    assert sorted(r[0] for r in missing.collect()) == ["Klingon", "Simplified Chinese"]
    last = two.filter("name = 'Simplified Chinese'").agg(F.max_by("code", "ord")).first()[0]
    assert last == "zh_cn"


# --- Conversations -------------------------------------------------------------------


def turns_of(spark, conversations):
    rows = [
        (conv, start + i, role, text)
        for conv, (start, turns) in conversations.items()
        for i, (role, text) in enumerate(turns)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_turn_checks_do_not_depend_on_where_counting_begins(spark):
    good, swapped = [("user", "a"), ("assistant", "b c")], [("assistant", "a"), ("user", "b")]
    turns = turns_of(
        spark, {1: (0, good), 2: (1, good), 3: (0, swapped), 4: (1, swapped), 5: (0, [("user", None)]), 6: (0, [("user", "a"), ("user", "b")])}
    )
    gap = turns_of(spark, {7: (0, [("user", "a")])}).unionByName(turns_of(spark, {7: (3, [("assistant", "a")])}))
    rows = {r["conv_id"]: r["valid"] for r in check_turns(turns.unionByName(gap)).collect()}
    assert rows == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}


def turn_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_turn_numbers_only_give_the_order(spark):
    turns = turn_rows(
        spark,
        [
            (1, 9000, "user", "a"), (1, 9001, "assistant", "b"),
            (2, 10, "user", "a"), (2, 20, "assistant", "b"),
            (3, 0, "user", "a"), (3, 0, "user", "b"), (3, 2, "user", "c"),
            (4, 0, "user", "a"), (4, 0, "user", "b"), (4, 3, "user", "c"), (4, 3, "assistant", "d"),
            (5, 1_700_000_000_000, "user", "a"), (5, -4, "assistant", "b"),
            (6, None, "user", "a"), (6, 1, "assistant", "b"), (None, 1, "user", "a"),
        ],
    )
    rows = {r["conv_id"]: (r["n_turns"], r["valid"]) for r in check_turns(turns).collect()}
    assert rows == {1: (2, True), 2: (2, True), 3: (3, False), 4: (4, False), 5: (2, False), 6: (2, False)}
    gathered = {r["conv_id"]: [t["value"] for t in r["conversations"]] for r in gather_turns(turns, 2048).collect()}
    assert gathered[1] == ["a", "b"] and gathered[5] == ["b", "a"] and len(gathered[4]) == 4
    wide = turn_rows(spark, [(1, t, "human" if i % 2 == 0 else "gpt", "w") for i, t in enumerate([0, 1, 5000, 5001])])
    assert len(gather_turns(wide, 2048).first()["conversations"]) == 4


def test_a_conversation_of_a_million_turns_is_not_gathered(spark):
    hot = spark.range(1_000_000).select(
        F.lit(1).cast("long").alias("conv_id"),
        (F.col("id") * 3 + 5).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.lit("").alias("text"),
    )
    small = turn_rows(spark, [(2, 4, "user", "a"), (2, 9, "assistant", "b")])
    both = hot.unionByName(small)
    rows = {r["conv_id"]: (r["n_turns"], r["valid"]) for r in check_turns(both).collect()}
    assert rows == {1: (1_000_000, True), 2: (2, True)}
    assert [r["conv_id"] for r in gather_turns(both, 2048).collect()] == [2]


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_stretches_of_turns_fit_together(spark, stretch):
    """Faults anywhere, also where two stretches meet; numbers crowded at one end; some texts many times."""
    draw = random.Random(4)
    convs, expected = {}, {}
    for c in range(60):
        n = draw.choice([1, 2, 3, 40, 150])
        roles = ["user" if i % 2 == 0 else "assistant" for i in range(n)]
        numbers = sorted(draw.sample(range(10**6), n)) if c % 2 else [2**i if i < 40 else 2**40 + i for i in range(n)]
        fault = draw.randrange(6)
        at = draw.randrange(n)
        if fault == 0:
            roles[at] = draw.choice(["system", None])
        elif fault == 1 and n > 1:
            numbers[at] = numbers[at - 1] if at else numbers[1]
        elif fault == 2:
            roles = roles[1:] + ["user"]
        elif fault == 3:
            numbers[at] = None
        order = sorted(range(n), key=lambda i: (numbers[i] is not None, numbers[i] or 0))
        sound = len(set(numbers)) == n and None not in numbers
        expected[c] = (n, sound and [roles[i] for i in order] == ["user" if i % 2 == 0 else "assistant" for i in range(n)])
        convs[c] = [(c, t, r, "w") for t, r in zip(numbers, roles)]
    rows = [row for own in convs.values() for row in own]
    draw.shuffle(rows)
    found = {r["conv_id"]: (r["n_turns"], r["valid"]) for r in check_turns(turn_rows(spark, rows), stretch=stretch).collect()}
    assert found == expected
    assert {v for _, v in expected.values()} == {True, False}


def test_turns_are_not_ordered_all_together(spark, sf_dir):
    plan = plan_of(check_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_gather_leaves_out_what_cannot_keep_the_limit(spark):
    long_one = [("human" if i % 2 == 0 else "gpt", "w") for i in range(500)]
    wordy = [("human", "w " * 60), ("gpt", "w")]
    turns = turns_of(spark, {1: (0, long_one), 2: (0, wordy), 3: (1, long_one[:40]), 4: (0, [("human", "hi")])})
    rows = {r["conv_id"]: r["conversations"] for r in gather_turns(turns, 50).collect()}
    assert sorted(rows) == [3, 4] and len(rows[3]) == 40
    assert [t["from"] for t in rows[3]] == ["human", "gpt"] * 20


# --- Assembly ------------------------------------------------------------------------


def test_provenance_order(spark):
    rows = [(1, "summarize", "s", "t"), (2, None, "s", "t"), (3, None, None, "t"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id int, prompt_type string, scenario string, topic string")
    got = {r["id"]: r["generation_method"] for r in with_provenance(df).collect()}
    assert got == {1: "context", 2: "scenario", 3: "topic", 4: "translated"}


def test_missing_subset_is_an_error_except_contextual(spark):
    require_subsets(spark.createDataFrame([("topic",), ("scenario",)], "subset string"))
    with pytest.raises(ValueError, match="scenario"):
        require_subsets(spark.createDataFrame([("topic",), ("contextual",)], "subset string"))


def test_stack_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, topic string"), spark.createDataFrame([(2,)], "id int")
    assert {r["id"]: r["topic"] for r in stack_subsets(a, b).collect()} == {1: "x", 2: None}


def test_dropped_rows_are_counted(spark):
    from pyspark.sql import Observation

    from weftline.plans.train_set import generated_rows

    rows = [("p", "a", "r"), ("p", None, "r"), (None, "a", "r"), ("p", "a", None), ("<image>", "a", "r")]
    df = spark.createDataFrame(rows, "final_prompt string, response string, reasoning string")
    seen = Observation("dropped")
    assert generated_rows(df, seen).count() == 1
    assert seen.get == {"rows": 5, "no_answer": 2, "no_reasoning": 1}


def test_prompt_files_named_by_subset(spark):
    root = new_folder(spark, "files")
    for subset in ("topic", "contextual"):
        row = spark.createDataFrame([("hello",)], "prompt string")
        row.write.json(f"{root}/Basque/{subset}_prompts.jsonl")
    rows = read_prompt_files(spark, root).select("lang", "subset", "has_context", "prompt").collect()
    assert sorted(map(tuple, rows)) == [
        ("Basque", "contextual", True, "hello"), ("Basque", "topic", False, "hello"),
    ]


def test_unreadable_lines_are_kept_apart(spark):
    path = new_folder(spark, "lines")
    spark.createDataFrame([('{"a": "x"}',), ("{broken",)], "value string").write.text(path)
    rows = read_jsonl(spark, path, "a STRING").collect()
    assert sorted((r["a"] or "", r["_corrupt_record"] or "") for r in rows) == [("", "{broken"), ("x", "")]


# --- Plans ---------------------------------------------------------------------------


def test_native_parts_have_no_python_and_no_single_partition_window(spark, sf_dir):
    from queries import catalog

    native = ["parse_answer", "split_reasoning", "token_count", "valid_conversations", "combine_responses",
              "reasoning_messages", "context_prompt_requests", "attach_responses", "task_round_robin"]
    for name in native:
        plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Exchange SinglePartition" not in plan, name


def test_sample_is_a_filter_on_the_scan(spark, documents):
    plan = plan_of(sample_plan(documents))
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def sample_plan(documents):
    from weftline.operators.sampling import sample_n

    return sample_n(documents, 20, ["doc_id"], 3)


def test_language_filter_reaches_the_scan(spark, sf_dir):
    from queries import catalog

    plan = plan_of(catalog.QUERIES["source_lang_filter"](spark, sf_dir))
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_request_texts_know_no_language_clause_for_general_topics(spark):
    df = spark.createDataFrame([("sea", "Basque", None), ("sea", "Basque", "Basque")], "topic string, lang_name string, target_lang string")
    general, target = [r["prompt"] for r in ask.topic_requests(df, 10).orderBy(F.col("target_lang").asc_nulls_first()).collect()]
    assert general.endswith("simple English.") and target.endswith("who speak Basque.")
    assert target.startswith(general)


def test_english_sample_then_languages(spark):
    from weftline.plans import translation

    rows = [(i, "en" if i % 2 else "fr", [("human", "hi"), ("gpt", "yo")]) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, langdetect string, conversations array<struct<`from`:string,value:string>>")
    sample = translation.english_sample(df, seed=3, n=15)
    assert sample.count() == 15 and sample.filter("langdetect <> 'en'").count() == 0
    asked = translation.translation_requests(
        translation.for_languages(translation.with_messages(sample), ["Basque", "Zulu"])
    )
    assert asked.count() == 30 and asked.select("req_id").distinct().count() == 30
    assert asked.first()["prompt"] == '[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]'
    with pytest.raises(Exception, match="21 rows wanted, 20 present"):
        translation.english_sample(df, seed=3, n=21)


def test_translation_head_asks_for_every_english_conversation(spark, tmp_path):
    from queries import catalog

    turns = [(i, t, ("user", "assistant")[t], f"text {i}") for i in range(90) for t in range(2)]
    turns += [(91, 0, "user", "word " * 3000), (92, 0, "system", "hi")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    got = catalog.QUERIES["translation_head"](spark, str(tmp_path)).collect()
    assert sorted(r["conv_id"] for r in got) == [i for i in range(90) if i % 3]
    assert {r["n_turns"] for r in got} == {2} and len({r["req_id"] for r in got}) == 60


def test_translation_head_without_english_conversations(spark, tmp_path):
    from queries import catalog

    turns = [(i, 0, "user", "hi") for i in (0, 3, 6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    assert catalog.QUERIES["translation_head"](spark, str(tmp_path)).count() == 0


def test_a_cut_off_write_does_not_freeze(spark):
    from weftline.sources.jsonl import freeze

    path = new_folder(spark, "frozen")
    spark.range(1).write.json(f"{path}/_temporary")
    assert freeze(spark.range(5), path).count() == 5
    assert freeze(spark.range(9), path).count() == 5


def test_unknown_roles_are_counted(spark):
    from pyspark.sql import Observation

    from weftline.plans import translation

    rows = [(1, [("human", "hi")]), (2, [("system", "x"), ("human", "hi")])]
    df = spark.createDataFrame(rows, "conv_id long, conversations array<struct<`from`:string,value:string>>")
    seen = Observation("roles")
    assert translation.with_messages(df, seen).count() == 1
    assert seen.get == {"rows": 2, "unknown_role": 1}


def test_bucketed_requests_are_not_moved_by_a_join(spark):
    from weftline.session import stored

    requests = spark.range(3000).select(
        F.md5(F.col("id").cast("string")).alias("req_id"), F.repeat(F.lit("long text "), 20).alias("prompt")
    )
    kept = stored(requests, "bucketed-requests", by="req_id")
    got = requests.select("req_id", F.lit("r").alias("reasoning"), F.lit("x").alias("response"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach(kept, got)
        plan = plan_of(joined)
        assert joined.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the only exchange is that of the answers
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_the_shared_folder_has_to_be_named(spark):
    from weftline import session

    class Unset:
        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Unset)


def test_stages_are_removed_on_demand(spark):
    from weftline import session

    kept = session.stored(spark.range(10).toDF("k"), "gone-later")
    assert kept.count() == 10
    assert session.remove_stages(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017
        kept.count()


def test_numbering_moves_wide_rows_once(spark, documents):
    from weftline.operators.sampling import with_hash_index

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(with_hash_index(documents, ["doc_id"], 3, by=["lang"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one scan reads the texts, and one exchange stands above it
    wide = [line for line in plan.splitlines() if "text#" in line and "Exchange" in line]
    scans = [line for line in plan.splitlines() if "FileScan" in line and "text" in line.split("ReadSchema")[-1]]
    assert len(scans) == 1 and len(wide) <= 1, plan


def test_stream_gives_what_attach_gives_for_every_order(spark):
    """A cut-off result, two different texts and a foreign line, in every order of two lots."""
    from itertools import permutations

    from weftline.operators.exchange import from_batch, one_answer
    from weftline.schemas import BATCH_RESULT
    from weftline.streaming.collect import collect_stream

    ids = [f"{i:032x}" for i in range(2)]
    requests = spark.createDataFrame([(i,) for i in ids], "req_id string")

    def line(own, reason, text):
        message = f'{{"reasoning": "r", "content": "{text}"}}'
        return (f'{{"custom_id": "{own}", "response": {{"body": {{"choices": [{{"finish_reason": "{reason}", "message": {message}}}]}}}}}}',)

    lots = [
        [line(f"r-{ids[0]}", "length", "cut"), line("someone-else", "stop", "x")],
        [line(f"r-{ids[0]}", "stop", "Beta"), line(f"r-{ids[1]}", "stop", "one")],
        [line(f"r-{ids[0]}", "stop", "Alpha")],
    ]
    for order in permutations(range(3)):
        folder = new_folder(spark, "orders")
        for n in order:
            spark.createDataFrame(lots[n], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
            collect_stream(spark, f"{folder}/in", requests, f"{folder}/out", f"{folder}/state", partitions=2).awaitTermination()
        streamed = {r["req_id"]: r["response"] for r in one_answer(spark.read.parquet(f"{folder}/out")).collect()}
        batch = from_batch(spark.read.schema(BATCH_RESULT).json(f"{folder}/in"))
        assert batch.filter("req_id IS NULL").count() == 1
        whole = {r["req_id"]: r["response"] for r in attach(requests, batch).collect()}
        assert streamed == whole == {ids[0]: "Alpha", ids[1]: "one"}


def test_stream_takes_each_result_once_however_often_it_is_sent(spark):
    from weftline.streaming.collect import collect_stream

    requests = spark.range(50).select(F.md5(F.col("id").cast("string")).alias("req_id"))
    folder = new_folder(spark, "stream")

    def send(ids):
        choice = F.struct(
            F.lit("stop").alias("finish_reason"),
            F.struct(F.lit("r").alias("reasoning"), F.lit("x").alias("content")).alias("message"),
        )
        body = F.struct(F.struct(F.array(choice).alias("choices")).alias("body"))
        lines = ids.select(F.concat(F.lit("r-"), "req_id").alias("custom_id"), body.alias("response"))
        lines.repartition(10).write.mode("append").json(f"{folder}/results")
        run = collect_stream(spark, f"{folder}/results", requests, f"{folder}/out", f"{folder}/state")
        run.awaitTermination()
        return sorted(r["req_id"] for r in spark.read.parquet(f"{folder}/out").collect())

    hot = spark.range(500).select(F.md5(F.lit("7")).alias("req_id"))
    unknown = spark.range(5).select(F.md5(F.lit("other")).alias("req_id"))
    all_ids = sorted(r["req_id"] for r in requests.collect())
    first = requests.filter("req_id < '8'")
    assert send(first.unionByName(hot).unionByName(unknown)) == sorted(
        {i for i in all_ids if i < "8"} | {r["req_id"] for r in hot.limit(1).collect()}
    )
    assert send(requests.unionByName(hot)) == all_ids
