"""Whole jobs with a played teacher that gives exactly what it is asked for."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline.operators.exchange import teacher_map
from weftline.plans import context_job, prompt_jobs, scenario_tree, topic_tree, train_set, translation
from weftline.session import new_folder, stored
from weftline.sources.jsonl import read_prompts, write_prompts


# the tasks cannot import this file, so its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def make_teacher():
    import hashlib

    def teacher(system, prompt):
        mark = hashlib.md5(prompt.encode()).hexdigest()[:12]
        if '"topics"' in system:
            key, n = "topics", re.match(r"Write (\d+)", prompt)[1]
        elif '"scenarios"' in system:
            key, n = "scenarios", re.match(r"Write (?:the )?(\d+)", prompt)[1]
        elif '"prompts"' in system:
            key, n = "prompts", re.match(r"Write (?:at least 1 and at most )?(\d+)", prompt)[1]
        elif '"improved_prompt"' in system:
            return {"reasoning": None, "response": json.dumps({"improved_prompt": f"better {mark}"})}
        else:
            return {"reasoning": f"thinking {mark}", "response": f"answer {mark}"}
        entries = [f"{mark} {i}" for i in range(int(n))]
        return {"reasoning": None, "response": f"```json\n{json.dumps({key: entries})}\n```"}

    return teacher


def ask(requests):
    return stored(teacher_map(requests, make_teacher, 8), "answers")


@pytest.fixture(scope="module")
def langs(spark):
    return spark.createDataFrame([("Basque",), ("Northern Sotho",)], "lang_name string")


@pytest.fixture(scope="module")
def topic_rows(spark, langs):
    levels = [topic_tree.seeds(langs)]
    for _ in range(2):
        requests = stored(topic_tree.topic_requests(levels[-1]), "requests")
        levels.append(stored(topic_tree.grow(requests, ask(requests)), "level"))
    topics = topic_tree.distinct_topics(*levels)
    requests = stored(topic_tree.prompt_requests(topics), "requests")
    return stored(topic_tree.topic_prompts(requests, ask(requests)), "prompts")


@pytest.fixture(scope="module")
def scenario_rows(spark, langs):
    broad_requests = stored(scenario_tree.scenario_requests(scenario_tree.roots(langs)), "requests")
    answers = ask(broad_requests)
    assert scenario_tree.retry_broad(broad_requests, answers, 3).count() == 0
    broad = stored(scenario_tree.grow(broad_requests, answers), "broad")
    requests = stored(scenario_tree.scenario_requests(broad), "requests")
    detailed = scenario_tree.grow(requests, ask(requests))
    scenarios = scenario_tree.all_scenarios(detailed, broad)
    requests = stored(scenario_tree.prompt_requests(scenarios), "requests")
    return stored(scenario_tree.scenario_prompts(requests, ask(requests)), "prompts")


@pytest.fixture(scope="module")
def context_rows(spark, documents):
    corpus = documents.select("doc_id", "text", F.lit("Basque").alias("lang_name"))
    requests = stored(context_job.context_requests(corpus, seed=1), "requests")
    return stored(context_job.context_prompts(requests, ask(requests), seed=1), "prompts")


def test_topic_counts_with_default_settings(topic_rows):
    # general topics do not name the language, so both languages get the same ones
    per_language = {r["lang_name"]: (r["t"], r["p"]) for r in topic_rows.groupBy("lang_name").agg(
        F.countDistinct("topic").alias("t"), F.count("prompt").alias("p")
    ).collect()}
    assert per_language == {"Basque": (3536, 10608), "Northern Sotho": (3536, 10608)}


def test_scenario_counts_with_default_settings(scenario_rows):
    counts = {r["lang_name"]: r["count"] for r in scenario_rows.groupBy("lang_name").count().collect()}
    assert counts == {"Basque": 9300, "Northern Sotho": 9300}


def test_small_corpus_keeps_all_prompts(context_rows, documents):
    assert context_rows.count() == 3 * documents.count()
    assert context_rows.filter("prompt is null").count() == 0


def test_prompts_to_training_table(spark, topic_rows, scenario_rows, context_rows):
    root = new_folder(spark, "prompts")
    write_prompts(train_set.stack_subsets(context_rows, scenario_rows, topic_rows), root)
    prompts = read_prompts(spark, root)
    train_set.require_subsets(prompts)
    total = prompts.count()
    assert total == topic_rows.count() + scenario_rows.count() + context_rows.count()
    assert sorted(r[0] for r in prompts.select("lang").distinct().collect()) == ["Basque", "NorthernSotho"]

    requests = stored(prompt_jobs.revision_requests(prompts, seed=1), "requests")
    sizes = prompts.groupBy("lang_name", "subset").count().collect()
    assert requests.count() == sum(round(r["count"] * 0.5) for r in sizes)
    revised = stored(prompt_jobs.combine_revisions(prompts, requests, ask(requests)), "revised")
    assert revised.count() == total
    assert revised.filter("revised_prompt like 'better %'").count() == requests.count()

    asked = stored(prompt_jobs.answer_requests(revised), "requests")
    answered = prompt_jobs.combine_responses(revised, ask(asked))
    generated = stored(train_set.generated_rows(answered), "generated")
    assert generated.count() == total

    turns = [[("human", "hello there"), ("gpt", "hi")], [("human", "a"), ("gpt", "b"), ("human", "c")]]
    source = spark.createDataFrame(
        list(enumerate(turns)), "conv_id long, conversations array<struct<`from`:string,value:string>>"
    )
    sent = translation.token_limit(translation.with_messages(source))
    sent = stored(translation.translation_requests(translation.for_languages(sent, ["Basque"])), "requests")
    same = sent.select("req_id", F.lit(None).cast("string").alias("reasoning"), F.col("prompt").alias("response"))
    translations = train_set.translated_rows(translation.translated(sent, same))
    full = train_set.train_set(generated, translations, ["prompt_id", "conv_id"], 1, train_set.TRAINING)
    rows = train_set.published(full)
    assert rows.columns == train_set.PUBLISHED
    methods = {r["generation_method"]: r["count"] for r in rows.groupBy("generation_method").count().collect()}
    assert methods == {
        "context": context_rows.count(),
        "scenario": scenario_rows.count(),
        "topic": topic_rows.count(),
        "translated": 2,
    }
    said = rows.filter("generation_method = 'topic'").first()["messages"]
    assert [m["role"] for m in said] == ["user", "assistant"]
    assert re.fullmatch(r"<think> thinking \w+ </think> answer \w+", said[1]["content"])
