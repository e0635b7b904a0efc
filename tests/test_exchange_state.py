"""Bounded stream state, resumed client calls, a user's tokenizer, whole chats."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import python_counter, python_cutter, truncate_tokens
from weftline.functions.turns import CHAT, ChatTemplate, chat_tokens, two_turns
from weftline.operators.exchange import FolderLedger, asked_in_parallel, one_answer, teacher_map
from weftline.plans import context_job
from weftline.session import new_folder
from weftline.streaming.collect import collect_stream, collected, reconcile

REQUESTS = "req_id string, system_prompt string, prompt string"


# --- stream state ---


def send(spark, folder, ids, age, text="x"):
    """A file of results, last modified ``age`` seconds ago."""
    choice = F.struct(
        F.lit("stop").alias("finish_reason"),
        F.struct(F.lit("r").alias("reasoning"), F.lit(text).alias("content")).alias("message"),
    )
    body = F.struct(F.struct(F.array(choice).alias("choices")).alias("body"))
    path = f"{folder}/in/{time.time_ns()}"
    lines = spark.createDataFrame([(i,) for i in ids], "req_id string")
    lines.select(F.concat(F.lit("r-"), "req_id").alias("custom_id"), body.alias("response")).coalesce(1).write.json(path)
    then = time.time() - age
    for name in os.listdir(path):
        os.utime(f"{path}/{name}", (then, then))


def run_stream(spark, folder, requests, within):
    run = collect_stream(spark, f"{folder}/in/*", requests, f"{folder}/out", f"{folder}/state", 2, within)
    run.awaitTermination()
    return max((sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in run.recentProgress[-1:]), default=0)


def lots(n, size=20):
    return [[f"{lot * size + i:032x}" for i in range(size)] for lot in range(n)]


def test_state_follows_the_interval_and_late_files_are_found(spark):
    parts = lots(8)
    requests = spark.createDataFrame([(i,) for part in parts for i in part], "req_id string")
    folders = {w: new_folder(spark, "state") for w in (None, "90 minutes")}
    state = {w: [] for w in folders}
    for within, folder in folders.items():
        for n, part in enumerate(parts):
            # an hour between lots; every lot is sent twice
            send(spark, folder, part * 2, 3600 * (len(parts) - n))
            state[within].append(run_stream(spark, folder, requests, within))
    assert state[None][-1] == 2 * len(parts) * 20
    # lots of the interval and the one just read, in two operators
    assert max(state["90 minutes"]) <= 2 * 3 * 20
    assert state["90 minutes"][-1] == state["90 minutes"][-2]

    folder = folders["90 minutes"]
    whole = Counter(r["req_id"] for r in spark.read.parquet(f"{folder}/out").collect())
    assert set(whole) == {i for part in parts for i in part} and set(whole.values()) == {1}
    # another answer to known requests and one of nobody, in a file of last week
    send(spark, folder, [*parts[0], "f" * 32], 7 * 86400, "a late text")
    run_stream(spark, folder, requests, "90 minutes")
    assert collected(spark, f"{folder}/out").filter("response = 'a late text'").count() == 0
    found = reconcile(spark, f"{folder}/in/*", requests, f"{folder}/out")
    assert found.filter("response = 'a late text'").count() == 20
    assert found.count() == 180
    # nothing new: nothing is added
    assert reconcile(spark, f"{folder}/in/*", requests, f"{folder}/out").count() == 180
    answers = {r["req_id"]: r["response"] for r in one_answer(collected(spark, f"{folder}/out")).collect()}
    assert answers[parts[0][0]] == "a late text" and answers[parts[1][0]] == "x"


def test_a_copy_after_the_interval_is_one_answer(spark):
    folder = new_folder(spark, "copies")
    ids = lots(1)[0]
    requests = spark.createDataFrame([(i,) for i in ids], "req_id string")
    for age in (10 * 3600, 5 * 3600, 4 * 3600 + 60):
        send(spark, folder, ids, age)
        run_stream(spark, folder, requests, "1 hour")
    assert one_answer(collected(spark, f"{folder}/out")).count() == len(ids)


# --- client calls ---


def test_calls_run_side_by_side_and_no_more_than_allowed():
    import threading

    lock, now, most = threading.Lock(), [0], [0]

    def make():
        def ask(system, prompt):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            return {"reasoning": system, "response": prompt}

        return ask

    rows = [(str(i), "s", f"p{i}") for i in range(100)]
    start = time.time()
    answers = list(asked_in_parallel(iter(rows), make, 10))
    assert sorted(answers) == sorted((i, s, p) for i, s, p in rows)
    assert 2 <= most[0] <= 10
    assert time.time() - start < 100 * 0.02


@pytest.mark.parametrize("parallel", [1, 4])
def test_a_killed_task_asks_only_for_the_rest(spark, tmp_path, parallel):
    """The worker is killed after thirty calls; what was answered before is not asked for again."""
    requests = spark.createDataFrame([(f"{i:032x}", "s", str(i)) for i in range(60)], REQUESTS)
    calls, ledger = tmp_path / "calls", f"file://{tmp_path}/ledger"
    calls.mkdir()

    def client(deadly):
        folder = str(calls)

        def make():
            def ask(system, prompt):
                if deadly and len(os.listdir(folder)) >= 30:
                    os._exit(1)
                open(f"{folder}/{prompt}-{time.time_ns()}", "w").close()
                return {"reasoning": "r", "response": f"answer {prompt}"}

            return ask

        return make

    with pytest.raises(Exception):
        teacher_map(requests, client(True), 1, parallel, ledger, keep_every=1)
    assert 30 <= len(os.listdir(calls)) < 60
    answers = teacher_map(requests, client(False), 1, parallel, ledger, keep_every=1)
    assert {r["req_id"]: r["response"] for r in answers.collect()} == {f"{i:032x}": f"answer {i}" for i in range(60)}
    times = Counter(name.split("-")[0] for name in os.listdir(calls))
    assert len(times) == 60
    # calls under way when the task was lost, and answers not yet written
    assert sum(times.values()) <= 60 + 2 * parallel
    # a third run asks nothing
    before = len(os.listdir(calls))
    assert teacher_map(requests, client(True), 1, parallel, ledger).count() == 60
    assert len(os.listdir(calls)) == before


def test_failed_calls_are_asked_again(spark, tmp_path):
    requests = spark.createDataFrame([("a", "s", "1"), ("b", "s", "x"), ("a", "s", "1")], REQUESTS)
    ledger = f"file://{tmp_path}/ledger"

    def strict():
        return lambda system, prompt: {"reasoning": system, "response": str(int(prompt) + 1)}

    def kind():
        return lambda system, prompt: {"reasoning": system, "response": "again"}

    first = {r["req_id"]: r["response"] for r in teacher_map(requests, strict, 3, ledger=ledger).collect()}
    second = {r["req_id"]: r["response"] for r in teacher_map(requests, kind, 3, ledger=ledger).collect()}
    assert first == {"a": "2", "b": None}
    assert second == {"a": "2", "b": "again"}
    assert teacher_map(requests.limit(0), kind, 3, ledger=ledger).count() == 0


def test_a_file_not_yet_whole_is_not_read(tmp_path):
    book = FolderLedger(f"file://{tmp_path}/book")
    assert book.known(3) == {}
    book.add(3, [("a", None, "x")])
    (tmp_path / "book" / "bucket=3" / "half.tmp").write_bytes(b"PAR1")
    assert book.known(3) == {"a": (None, "x")} and book.known(4) == {}


# --- a user's tokenizer ---


@pytest.fixture
def bpe():
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))

    def make_codec():
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: own.encode(text, add_special_tokens=False).ids, own.decode

    return make_codec


def test_texts_are_cut_by_the_tokens_of_a_real_tokenizer(spark, bpe):
    texts = ["The unbelievably long-winded sentence, again and again. " * 5, "ünï \U0001f600 cödé", "", None, "short"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    cut = truncate_tokens(F.col("text"), 7, python_cutter(bpe))
    found = [r["cut"] for r in table.select("doc_id", cut.alias("cut")).orderBy("doc_id").collect()]
    encode, decode = bpe()
    assert found == [None if t is None else decode(encode(t)[:7]) for t in texts]
    assert found[4] == "short" and len(found[0]) < len(texts[0])


def test_the_web_text_job_asks_about_texts_cut_by_it(spark, bpe):
    corpus = spark.createDataFrame([("Basque", i, f"word{i} " * 40) for i in range(6)], "lang_name string, doc_id int, text string")
    requests = context_job.context_requests(corpus, 3, num_contexts=4, first_n_tokens=9, cutter=python_cutter(bpe)).collect()
    encode, decode = bpe()
    assert len(requests) == 4
    for r in requests:
        head = decode(encode(f"word{r['doc_id']} " * 40)[:9])
        assert r["text"] == head and head in r["prompt"] and f"{head}w" not in r["prompt"]


# --- whole chats ---


def test_a_chat_is_counted_as_one_text(spark):
    table = spark.createDataFrame([(1, "hi there", "yes"), (2, "a", None)], "n int, q string, a string")
    chat = two_turns(F.col("q"), F.col("a"))
    other = ChatTemplate(turn="[{role}] {content} ", start="<s>", end="</s>", roles=(("assistant", "model"),))
    rows = table.select(
        "n",
        CHAT.text(chat).alias("text"),
        other.text(chat).alias("other"),
        chat_tokens(chat).alias("tokens"),
        chat_tokens(chat, other, python_counter(lambda: len)).alias("own"),
    )
    found = {r["n"]: r for r in rows.collect()}
    assert found[1]["text"] == "<|im_start|>user\nhi there<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert found[1]["other"] == "<s>[user] hi there [model] yes </s>"
    assert found[1]["own"] == len(found[1]["other"])
    # seven tokens begin a turn and seven end it, one is the role, and three are the contents
    assert found[1]["tokens"] == 2 * (7 + 1 + 7) + 3
    assert found[2]["text"] is None and found[2]["tokens"] is None
