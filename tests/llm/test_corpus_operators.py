"""Mixing, toxicity, joins, deduplication, neighbours and packing."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, duck
from conftest import plan_of
from llm_helpers import docs, near_classes, odd_docs
from pyspark.sql import functions as F

from weftline.llm import (
    block_knn,
    mixing,
    ngram_join,
    packing,
    queries,
    sentence_spans,
    suffix_dedup,
    toxicity,
)
from weftline.llm.common import n_words, tokenizer_path
from weftline.llm.components import components


def words(n, seed, pool=5000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(pool)}" for _ in range(n))


# --- mixing ---


def test_mixing_query_against_sql(spark, sf_dir):
    problem, _, _ = compare(spark, duck(sf_dir), sf_dir, "op1_mixing", queries.QUERIES["op1_mixing"], queries.ORACLES["op1_mixing"])
    assert not problem, problem


def test_mix_comes_near_its_targets(spark):
    sources = ["hot"] * 600 + ["mid"] * 90 + ["tiny"] * 10 + [None] * 50
    table = docs(spark, [words(5 + i % 40, i) for i in range(750)], sources)
    rows = mixing.with_copies(table, n_words("text")).collect()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert target["tiny"] == 3 * size["tiny"]
    for source in target:
        assert abs(taken[source] - target[source]) <= 45 + 1e-9
    again = mixing.with_copies(table.repartition(7), n_words("text")).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)
    emitted = mixing.mixed(table, n_words("text"))
    assert emitted.columns == table.columns
    assert Counter(r["doc_id"] for r in emitted.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mixing_odd_rows(spark):
    wide = odd_docs(spark).selectExpr("*", "1 AS size", "2 AS copies", "3 AS _row", "4 AS target")
    rows = mixing.with_copies(wide, n_words("text")).collect()
    assert len(rows) == 7
    assert mixing.with_copies(wide.limit(0), n_words("text")).count() == 0
    assert mixing.mixed(wide.filter("text IS NULL"), n_words("text")).count() == 0


# --- toxicity ---


def test_folding():
    assert toxicity.fold("Ѕtup1d, M0R0N!") == " stupid  moron  " or toxicity.fold("Ѕtup1d, M0R0N!").split() == ["stupid", "moron"]


def toxic_table(spark):
    bad, texts, labels = ["zorgle", "blarfed"], [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = words(30, i, 300) + (f" you {bad[i % 8 // 4]} there" if toxic else " plain ending")
        if i % 4 == 1:
            text += " the zorgle festival was nice"
        texts.append(text)
        labels.append((i, int(toxic)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_entries_and_exceptions(spark):
    table, labels = toxic_table(spark)
    model = toxicity.fit(table, labels)
    assert any("blarf" in e for e in model.entries)
    rows = {r["doc_id"]: r for r in toxicity.scored(table, model).collect()}
    right = sum(rows[i]["predicted"] == (i % 4 == 0) for i in range(400))
    assert right >= 396
    probe = docs(spark, ["what a bl4rfеd thing", "nothing here", None, "", "blarfed " + words(4000, 1, 300)])
    scores = [r["score"] for r in toxicity.scored(probe, model).orderBy("doc_id").collect()]
    assert scores[0] > 0.3 > scores[1] and scores[1] == scores[2] == scores[3] and scores[4] < scores[0]


def test_toxicity_never_reads_held_out_labels(spark):
    table, labels = toxic_table(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(table, labels) == toxicity.fit(table, turned)


def test_an_id_of_many_rows_is_one_training_row(spark):
    table, labels = toxic_table(spark)
    few = toxicity.training_rows(table, labels).collect()
    held = {r[0] for r in labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id").collect()}
    hot = min(held)
    more = table.filter(F.col("doc_id") == hot).selectExpr("doc_id", "explode(sequence(1, 500)) AS i", "text", "lang", "source", "n_chars")
    more = more.selectExpr("doc_id", "concat(text, ' ', i) AS text", "lang", "source", "n_chars")
    rows = toxicity.training_rows(table.unionByName(more), labels).collect()
    assert len(rows) == len(few) == len(held)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op2_toxicity(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.85 * len(rows)


def plain_weight(model, text):
    """Summed weight of a text by looking for every entry and phrase one by one."""
    folded, best = toxicity.fold(text), {}

    def spots(part):
        at = folded.find(part)
        while at >= 0:
            yield at, at + len(part)
            at = folded.find(part, at + 1)

    exempt = [spot for phrase in model.exceptions for spot in spots(phrase)]
    for entry, weight in model.entries.items():
        for a, b in spots(entry):
            if not any(c <= a and b <= d for c, d in exempt):
                best[a] = max(weight, best.get(a, 0))
    return sum(best.values())


def test_scores_equal_a_plain_scorer(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.entries:  # the small table need not have enough labels
        model = toxicity.Model({" the ": 1.5, " und": 2.0, " de": 0.5}, [" the end ", " of the "], (-2.0, 1.0, 0.5))
    for row in toxicity.scored(table, model).collect():
        text = row["text"] or ""
        weight, n = plain_weight(model, text), toxicity.fold(text).count(" ")
        z = float(np.dot(model.curve, [1, np.log1p(weight), np.log1p(100 * weight / (n + 20))]))
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
        assert row["predicted"] == (row["score"] >= 0.3)


def test_lexicon_has_no_limits_of_number_or_length():
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:05d}") for i in range(9000)]
    strong = [(f" {name} ", 1.0) for name in names] + [(" aa", 1.0), (" aaaabx ", 1.0), (f" {'y' * 90} ", 2.0)]
    kept = toxicity.without_kin(strong)
    assert len(kept) == 9001 and f" {'y' * 90} " in kept
    assert f" {'y' * 90} " in toxicity.features("so " + "y" * 90)
    model = toxicity.Model(kept, [" not aaaaf "])
    assert toxicity.weigh(model.automaton(), "not aaaaf aaaaf aiajj " + "Y" * 90)[0] == 4.0


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs(spark), labels)
    wide = odd_docs(spark).selectExpr("*", "1 AS score", "2 AS predicted")
    assert [r["score"] for r in toxicity.scored(wide, model).collect()] == [0.0] * 7
    assert toxicity.scored(wide.limit(0), model).count() == 0


# --- n-gram join ---


def near_texts():
    texts = {i: words(60, i) for i in range(12)}
    for i in range(40):  # near copies of 0, some of each other only
        own = texts[0].split()
        for k in range(i % 4):
            own[(i * 7 + k * 13) % 60] = f"x{i}"
        texts[100 + i] = " ".join(own)
    texts |= {200: texts[3].upper(), 201: "one two", 202: "one two", 203: "", 204: None, 205: " ", 206: "five " * 5}
    return texts


@pytest.mark.parametrize(("block", "shingles"), [(1024, 1 << 20), (8, 1 << 20), (1024, 300)])
def test_join_equals_all_pairs(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    texts = near_texts()
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.joined(table).collect()}
    assert got == near_classes(texts)


def test_join_over_whole_table(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op4_ngram_jaccard_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == near_classes(texts)
    assert sum(r["first"] for r in rows) == len({r["class_id"] for r in rows})


def test_join_odd_rows(spark):
    wide = odd_docs(spark).selectExpr("*", "1 AS class_id", "2 AS _set", "3 AS first", "4 AS root")
    rows = ngram_join.joined(wide).collect()
    assert len(rows) == 7 and sum(r["first"] for r in rows) == 6
    assert ngram_join.joined(wide.limit(0)).count() == 0


def test_lowest_similarity_by_trying_all():
    for n in range(1, 80):
        found = [i / (n + m - i) for m in range(1, 2 * n + 2) for i in range(min(n, m) + 1) if 5 * i >= 4 * (n + m - i) and i < n + m - i]
        assert ngram_join.lowest_similarity(n) == min(found, default=1.0)
        depth = ngram_join.set_depth(n)
        missed = lambda d: (1 - min(found) ** d) ** ngram_join.TREES
        assert (depth == 0) == (not found)
        if found:
            assert missed(depth) <= 1 - ngram_join.RECALL
            assert depth == ngram_join.DEPTH or missed(depth + 1) > 1 - ngram_join.RECALL
    assert ngram_join.set_depth(10**6) == ngram_join.SHORTEST


def test_prefixes_are_shortened_as_far_as_a_set_needs(spark):
    """The same paths, once of sets that need the whole path and once of sets that need less."""

    def edges(depths):
        paths = {1: "aabbccdd", 2: "aabbccdd", 3: "aabbccde", 4: "aabbccxx", 5: "aabbyyyy", 6: "zabbccdd"}
        rows = [(s, depths, b"\x00" + "".join(f"{c}{c}" for c in p).encode()) for s, p in paths.items()]
        found = ngram_join.forest_edges(spark.createDataFrame(rows, "_set long, depth int, path binary")).collect()
        hung = {s: {s} for s in paths}
        for r in found:
            both = hung[r["a"]] | hung[r["b"]]
            for s in both:
                hung[s] = both
        return {frozenset(s) for s in hung.values()}

    one = lambda *sets: {frozenset(s) for s in sets}
    assert edges(8) == one({1, 2}, {3}, {4}, {5}, {6})
    assert edges(7) == one({1, 2, 3}, {4}, {5}, {6})
    assert edges(6) == one({1, 2, 3, 4}, {5}, {6})


@pytest.mark.parametrize(("size", "depth"), [(7, 8), (6, 7), (10, 6)])
def test_candidates_at_the_lowest_similarity(spark, size, depth):
    """Pairs at the lowest similarity their sizes allow, in data that end at different depths, are candidates."""
    assert ngram_join.set_depth(size) == depth
    draw, texts, low = random.Random(size), [], ngram_join.lowest_similarity(size)
    for i in range(400):
        own = [f"t{i}w{draw.randrange(10**6)}" for _ in range(size + 4)]
        # the other text lacks or has one shingle, or two, at its end
        less = next(k for k in (1, 2) if abs((size - k) / size - low) < 1e-9)
        texts += [" ".join(own), " ".join(own[:-less])]
    rows = {r["doc_id"]: r for r in ngram_join.joined(docs(spark, texts)).collect()}
    met = sum(rows[2 * i]["class_id"] == rows[2 * i + 1]["class_id"] == 2 * i for i in range(400))
    assert met >= 0.99 * 400


def test_components_of_paths_stars_and_rings(spark):
    draw, edges = random.Random(5), []
    edges += [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(301, 300), (302, 301), (300, 302), (7, 7)]
    draw.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 200 for i in range(200, 240))
    assert {got[300], got[301], got[302]} == {300}


# --- sentence spans ---


def plain_spans(texts):
    """Sentences kept of every text, runs compared as texts."""
    import re

    cut = {k: re.findall(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+", t or "") for k, t in texts.items()}
    plain = {k: [re.sub(r"[\W_]+", " ", s.lower()).strip() for s in own] for k, own in cut.items()}
    seen, gone = {}, defaultdict(set)
    for k in sorted(texts):
        for i in range(len(plain[k]) - 1):
            run = f"{plain[k][i]} {plain[k][i + 1]}"
            if len(run) >= 40:
                if run in seen:
                    gone[k] |= {i, i + 1}
                else:
                    seen[run] = (k, i)
    return {k: "".join(s for i, s in enumerate(own) if i not in gone[k]) for k, own in cut.items()}


def plain_part_spans(texts):
    """What is kept of every text by the rule with parts, run by run, as it is stated: no hashes, no shortcuts."""
    import re

    cuts, runs = {}, {}
    for k, text in texts.items():
        text = text or ""
        sents = [m.span() for m in re.finditer(r"[^.!?\n]*[.!?\n]+[ \t\n\x0b\f\r]*|[^.!?\n]+", text)]
        begins = {a for a, _ in sents} | {0}
        for n, blank in enumerate(text):
            if blank in " \t\n\x0b\f\r":
                m = n + 1
                while m < len(text) and not (text[m].isalnum() or text[m] == "_" or text[m].isspace()):
                    m += 1
                if m < len(text) and (text[m].isupper() or text[m].istitle()):
                    begins.add(n + 1)
        begins = sorted(begins)
        parts = list(zip(begins, [*begins[1:], len(text)]))
        cuts[k] = parts

        def said(i, j):  # the words of parts i to j
            return " ".join(re.findall(r"[^\W_]+", text[parts[i][0] : parts[j][1]].lower()))

        at = {a: i for i, (a, _) in enumerate(parts)}
        first = [at[a] for a, _ in sents]
        last = [*(f - 1 for f in first[1:]), len(parts) - 1]
        own = {}
        for a, b in zip(first, last[1:]):
            if len(said(a, b)) >= 40:
                own[a, b] = False
        worded = [i for i in range(len(parts)) if said(i, i)]
        for n, i in enumerate(worded):
            on = next((j for j in worded[n:] if len(said(i, j)) >= 80), None)
            upto = next((j for j in reversed(worded[: n + 1]) if len(said(j, i)) >= 80), None)
            for run in ([(i, on)] if on is not None else []) + ([(upto, i)] if upto is not None else []):
                own.setdefault(run, True)
        if worded and len(said(worded[0], worded[-1])) >= 40:
            own.setdefault((worded[0], worded[-1]), True)
        runs[k] = {run: (said(*run), by_parts) for run, by_parts in own.items()}
    stands = {}
    for k in sorted(runs):
        for (a, b), (words_, _) in sorted(runs[k].items()):
            stands.setdefault(words_, (k, a, b))
    kept = {}
    for k, parts in cuts.items():
        gone = set()
        for (a, b), (words_, by_parts) in runs[k].items():
            own, at, end = stands[words_]
            if own != k or a > (end if by_parts else at):
                gone |= set(range(a, b + 1))
        kept[k] = "".join((texts[k] or "")[x:y] for i, (x, y) in enumerate(parts) if i not in gone)
    return kept


def test_spans_equal_a_plain_pass(spark, sf_dir):
    """Sentence runs alone, and with runs of parts, each against its rule, on made texts and on a whole table."""
    passage = f"{words(20, 1)}. {words(15, 2)}! {words(22, 3)}."
    texts = {i: f"{words(12, 50 + i)}. {passage} {words(9, 90 + i)}\n{words(14, 130 + i)}." for i in range(30)}
    texts |= {40: "", 41: "...\n!!", 42: "no end", 43: passage + passage, 44: passage.upper(), 45: "Ha " * 200}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    alone = {r["doc_id"]: r["text"] for r in sentence_spans.deduplicated(table, parts=False).collect()}
    assert alone == plain_spans(texts)
    got = {r["doc_id"]: r["text"] for r in sentence_spans.deduplicated(table).collect()}
    assert got == plain_part_spans(texts)
    for found in (alone, got):
        assert passage in found[0] and all(words(15, 2) not in found[i] for i in range(1, 30))
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r[0]: r[1] for r in docs_.collect()}
    alone = {r["doc_id"]: r["text"] for r in sentence_spans.deduplicated(docs_, parts=False).collect()}
    assert alone == plain_spans(whole)
    found = {r["doc_id"]: r["text"] for r in queries.QUERIES["op7_sentence_spans"](spark, sf_dir).collect()}
    assert found == plain_part_spans(whole)
    assert sum(map(len, found.values())) < sum(map(len, alone.values()))


def test_passages_in_the_middle_of_sentences(spark):
    short_long = f"Begin {words(5, 1)}. And {words(46, 2)}."
    lines = f"One {words(60, 3)}."
    texts = {i: f"{words(7, 20 + i)} {short_long} {words(8, 30 + i)}." for i in range(3)}
    texts |= {i: f"{words(7, 20 + i)} {lines} {words(8, 30 + i)}." for i in range(10, 13)}
    # whole texts of one sentence, a passage at the start of one text and inside another, a part behind a short one
    texts |= {20: words(12, 4), 21: words(12, 4), 22: words(12, 5), 23: f"Tail {words(40, 6)}. Oh. Yes"}
    texts |= {24: f"{words(4, 7)} Tail {words(40, 6)}. Oh. Yes", 25: f"{words(30, 8)}, {words(30, 9)}.", 26: "Ha " * 50}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sentence_spans.deduplicated(table).collect()}
    for i in (0, 10, 20, 22, 23, 25, 26):
        assert rows[i]["text"] == texts[i] and rows[i]["n_removed"] == 0
    for i in (1, 2, 11, 12):
        assert rows[i]["text"] == f"{words(7, 20 + i)} {words(8, 30 + i)}."
    assert [rows[i]["n_removed"] for i in (1, 11)] == [2, 1]
    assert rows[21]["text"] == "" and rows[24]["text"] == f"{words(4, 7)} "


def test_spans_odd_rows(spark):
    wide = odd_docs(spark).selectExpr("*", "1 AS n_removed", "2 AS _uid", "3 AS hash", "4 AS place")
    rows = sentence_spans.deduplicated(wide).collect()
    assert len(rows) == 7 and sum(r["text"] is None for r in rows) == 1
    assert sentence_spans.deduplicated(wide.limit(0)).count() == 0


# --- suffix dedup ---


def plain_suffixes(texts, length):
    counts = Counter()
    data = {k: (t or "").encode() for k, t in texts.items()}
    for own in data.values():
        counts.update(own[i : i + length] for i in range(len(own) - length + 1))
    out = {}
    for k, own in data.items():
        gone = bytearray(len(own))
        for i in range(len(own) - length + 1):
            if counts[own[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(own, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(own), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def digests(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


@pytest.mark.parametrize("block", [4096, 5])
def test_suffixes_equal_plain_windows(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    draw, texts = random.Random(9), {}
    passages = ["".join(draw.choice("abcé ") for _ in range(n)) for n in (12, 30, 45, 90)]
    for i in range(60):
        parts = [draw.choice(passages) if draw.random() < 0.4 else words(draw.randrange(8), i * 9 + k) for k in range(6)]
        texts[i] = draw.choice(["", " "]).join(parts)
    texts |= {100: "ab" * 200, 101: "aaaaa" * 30, 102: texts[3], 103: "", 104: None, 105: texts[4] + texts[4]}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = suffix_dedup.deduplicated(table, length=24, anchor=12).collect()
    assert digests(got) == plain_suffixes(texts, 24)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_query_over_whole_table(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert digests(queries.QUERIES["op8_suffix_dedup"](spark, sf_dir).collect()) == plain_suffixes(texts, 400)


def test_deep_shallow_order():
    draw = random.Random(3)
    strings = ["".join(draw.choice("ab") for _ in range(draw.randrange(60))).encode() for _ in range(300)]
    strings += [b"a" * n for n in range(40)] + [b"", b"", b"a" * 20]
    order = suffix_dedup.deep_shallow(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


def test_suffix_odd_rows(spark):
    wide = odd_docs(spark).selectExpr("*", "1 AS n_bytes", "2 AS doc", "3 AS own", "4 AS spans", "5 AS kept")
    rows = suffix_dedup.deduplicated(wide).collect()
    assert len(rows) == 7 and {r["n_removed"] for r in rows} == {0, 150_000}
    assert suffix_dedup.deduplicated(wide.limit(0)).count() == 0


# --- neighbours ---


def plain_nearest(ids, vectors, asked, k):
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for q in asked:
        i = ids.index(q)
        score = vectors @ vectors[i] / lengths / lengths[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [ids[j] for j in order]
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_neighbours_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(block_knn, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(block_knn, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(300, 24)).astype(np.float32)
    vectors[100:140] = vectors[7]  # ties
    vectors[140:150] *= 1e-12
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = block_knn.nearest(table, F.col("vec_id") % 10 == 0).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == plain_nearest(list(range(300)), vectors.astype(float), range(0, 300, 10), 5)


def test_neighbour_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, []), (None, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS q")
    got = [tuple(r)[:3] for r in block_knn.nearest(table, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 9), (0, 3, 9)]
    assert block_knn.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_huge_and_tiny_vectors_have_the_same_neighbours(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(60, 8))
    sizes = 2.0 ** np.resize([0, 900, -900], 60)

    def found(table):
        rows = [(i, v.tolist()) for i, v in enumerate(table)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        out = block_knn.nearest(frame, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()
        return [tuple(r) for r in out]

    plain = found(vectors)
    assert len(plain) == 60 and found(vectors * sizes[:, None]) == plain


def test_no_block_is_broadcast_or_repeated(spark, monkeypatch):
    """Query blocks below the broadcast threshold used to be multiplied by the places of candidates and sent to the driver whole."""
    monkeypatch.setattr(block_knn, "CANDIDATE_BLOCK", 8)
    monkeypatch.setattr(block_knn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(block_knn, "CANDIDATE_GROUPS", 4, raising=False)
    monkeypatch.setattr(block_knn, "GROUP_BLOCKS", 2, raising=False)
    draw = np.random.default_rng(5)
    long, short = draw.normal(size=(200, 12)).astype(np.float32), draw.normal(size=(100, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*long, *short])]
    out = block_knn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    wanted = plain_nearest(list(range(200)), long.astype(float), range(0, 200, 10), 5)
    wanted |= plain_nearest(list(range(200, 300)), short.astype(float), range(200, 300, 10), 5)
    assert dict(got) == wanted
    plan = plan_of(out)
    assert "Broadcast" not in plan and "explode" not in plan


def test_rounding_errors_stay_within_their_bound():
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=(40, 70)), draw.normal(size=(50, 70))
    q, c = block_knn.Rounded(a), block_knn.Rounded(b)
    near = block_knn.tile_product(q.int8, c.int8) * q.step * c.step.T
    slack = q.length[:, None] * c.error + q.error[:, None] * c.length + q.error[:, None] * c.error
    assert (np.abs(near - q.unit @ c.unit.T) <= slack + 1e-12).all()


def test_products_of_long_vectors_are_whole_numbers():
    draw = np.random.default_rng(4)
    a, b = (draw.integers(100, 128, size=(n, 2500)).astype(np.int8) for n in (5, 7))
    assert (block_knn.tile_product(a, b) == a.astype(int) @ b.astype(int).T).all()


# --- packing ---


ODD_TEXTS = [None, "", "Plain text, with words.", "ÉÈ é Å İstanbul ΣΣ", "a b c\x1cd\te\r\nf", "<|endoftext|>x <|startoftext|>",
             "it's we'll they'd 12 345", "中文字 \U0001f600\U0001f600", "x" * 5000, "long words " * 3000, " ́lead", "a‍b c﻿"]


def test_pieces_round_trip(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    table = docs(spark, ODD_TEXTS)
    found = defaultdict(list)
    for r in packing.pieces(table, with_ids=True).collect():
        found[r["doc_id"]].append(r)
    for i, text in enumerate(ODD_TEXTS):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(found[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in own)


def check_packing(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("group", [8192, 100])
def test_packing_is_tight_and_whole(spark, group):
    draw = random.Random(4)
    lengths = [draw.choice([draw.randrange(1, 300), draw.randrange(300, 2049), 2048]) for _ in range(1500)]
    cut = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.packed_pieces(cut, group=group).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1500))
    used, least = check_packing(rows), -(-sum(lengths) // 2048)
    assert used <= least * 1.02 + 2


def test_swaps_empty_bins_that_best_fit_leaves():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3, 2, 2, 2])
    worse = [[0, 7], [1, 3], [2, 4], [5, 6, 8], [9]]
    better = packing.swap_search(worse, lengths, 12)
    assert sorted(i for b in better for i in b) == list(range(10))
    assert len(better) < len(worse) and all(lengths[b].sum() <= 12 for b in better)
    # 4 goes in for 3, and 3 then fits elsewhere
    lengths = np.array([6, 3, 7, 4])
    better = packing.swap_search([[0, 1], [2], [3]], lengths, 10)
    assert sorted(int(lengths[b].sum()) for b in better) == [10, 10]


def test_swap_search_never_lowers_the_squared_fill():
    draw = np.random.default_rng(6)
    for _ in range(20):
        lengths = draw.integers(1, 100, size=60)
        bins = packing.best_fit(lengths, 100)
        better = packing.swap_search(bins, lengths, 100)
        squares = lambda found: sum(int(lengths[b].sum()) ** 2 for b in found)
        assert squares(better) >= squares(bins) and len(better) <= len(bins)


def test_packing_odd_rows(spark):
    wide = odd_docs(spark).selectExpr("*", "1 AS piece", "2 AS _uid", "3 AS length")
    rows = packing.packed(wide).collect()
    check_packing(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([1, None, 2, 3, 3, 4, 5])
    assert packing.packed(wide.limit(0)).count() == 0


# --- pipeline ---


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()}
    stages = dict(pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in whole.collect()}
    clean = stages["toxicity"](spark, whole, sf_dir)
    assert clean.columns == whole.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    harmless = [k for k in labels if labels[k] == 0]
    assert sum(k in kept for k in harmless) >= 0.95 * len(harmless)
    assert all(texts[k] == kept[k] for k in kept)

    single = stages["ngram_join"](spark, clean, sf_dir)
    expected = {c for c, _ in near_classes(kept).values()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(expected)

    private = stages["personal_data"](spark, single, sf_dir)
    assert private.columns == whole.columns and private.count() == len(expected)
    assert private.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0

    mix = stages["mixing"](spark, private, sf_dir)
    assert mix.columns == whole.columns
    packed = stages["packing"](spark, mix, sf_dir)
    assert packed.filter("piece = 0").count() == mix.count()
    check_packing(packed.collect())


def test_whole_pipeline_and_odd_documents(spark, sf_dir):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, sf_dir).count() > 0
    for docs_ in (odd_docs(spark), odd_docs(spark).limit(0), odd_docs(spark).selectExpr("*", "1 AS row", "2 AS first")):
        for _, stage in pipeline.STAGES:
            docs_ = spark.createDataFrame(stage(spark, docs_, sf_dir).collect(), stage(spark, docs_, sf_dir).schema)
