"""Importance resampling, conversation trie and SimHash against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import compare, duck
from llm_helpers import docs, odd_docs
from pyspark.sql import functions as F

from weftline.llm import conversation_trie, queries, resampling, simhash

TURNS = "conv_id long, turn long, role string, text string"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_conversation_trie"])
def test_query_against_sql(spark, sf_dir, name):
    problem, _, n = compare(spark, duck(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLES[name])
    assert not problem, problem
    assert n


# --- importance resampling ---


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_draw(rows, target):
    """``{doc_id: (n_features, weight, score, rank)}``; ids are distinct."""
    own = {i: plain_features(t) for i, t in rows}
    s = Counter(b for _, bs in own.values() for b in bs)
    t = Counter(b for text in target for b in plain_features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    scores = {}
    for i, (_, bs) in own.items():
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        scores[i] = (len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((i for i in own if own[i][0] >= 20), key=lambda i: (-scores[i][2], i))
    rank = {i: n for n, i in enumerate(able[: 25 * len(able) // 100], 1)}
    return {i: (*v, rank.get(i)) for i, v in scores.items()}


def drawn_by_id(found):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()}


def test_draw_equals_a_plain_draw(spark):
    pool = random.Random(1)
    texts = [" ".join(pool.choice("Alpha BETA gamma 12 ünï Ünï ß x_y a-b é".split()) for _ in range(n % 60)) for n in range(400)]
    target = ["alpha beta gamma", None, "12 12 ünï", ""]
    wide = docs(spark, texts).selectExpr("*", "1 AS _row", "2 AS rank", "3 AS weight")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = drawn_by_id(resampling.drawn(wide, goal))
    assert found == plain_draw(list(enumerate(texts)), target)
    assert sum(v[3] is not None for v in found.values()) > 60


@pytest.mark.parametrize("k", [1, 2, 37, 499, 500, 999, 1000])
def test_quickselect_finds_the_kth_key(spark, k):
    # one score holds half of the rows, one id a third, and some ids are null
    rows = [(i * 7 % 1000, 5 if i % 2 else i % 11, None if i % 10 == 0 else 3 if i % 3 == 0 else i) for i in range(1000)]
    table = spark.createDataFrame(rows, "_row long, score long, doc_id long")
    order = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert resampling.kth_key(table, k, n_pivots=5) == (order[k - 1][1], order[k - 1][2], order[k - 1][0])


def test_draw_odd_rows(spark):
    table = odd_docs(spark).withColumn("score", F.lit("x"))
    goal = table.select("text")
    found = resampling.drawn(table, goal).collect()
    assert Counter(r["doc_id"] for r in found) == Counter([1, None, 2, 3, 3, 4, 5])
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[1]["n_features"], by_id[1]["weight"], by_id[1]["rank"]) == (0, 0, None)
    assert by_id[4]["n_features"] == 59_999
    assert resampling.drawn(table.limit(0), goal).count() == 0
    assert resampling.drawn(table, goal.limit(0)).count() == 7
    # repeated rows are drawn each by itself, and ranks have no gaps
    same = table.filter("doc_id = 4")
    many = same.crossJoin(spark.range(40).select()).unionByName(odd_docs(spark).withColumn("score", F.lit("x")))
    ranks = sorted(r["rank"] for r in resampling.drawn(many, goal).collect() if r["rank"] is not None)
    assert ranks == list(range(1, 25 * 41 // 100 + 1))


# --- conversation trie ---


def plain_trie(convs):
    """Rows of the trie over ``{conv_id: [(role, text), ...]}``."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        rows.append(
            (min(own), len(path), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=repr)


def trie_rows(found):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)


def branching(seed, n=120):
    """Conversations that share beginnings, extend each other and repeat."""
    draw = random.Random(seed)
    convs = {}
    for c in range(n):
        old = list(convs.values())
        base = draw.choice(old) if old and draw.random() < 0.8 else []
        base = base[: draw.randrange(len(base) + 1)]
        more = [(draw.choice(["user", "assistant"]), "é" * draw.randrange(9)) for _ in range(draw.randrange(4))]
        convs[c if draw.random() < 0.9 else c - 1000] = base + more
    convs[500] = [("user", f"t{i}") for i in range(300)]
    convs[501] = convs[500][:250] + [("user", "other")]
    return convs


def lists_of(spark, convs):
    rows = [(c, n, role, text) for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    return conversation_trie.turn_lists(spark.createDataFrame(rows, TURNS))


@pytest.mark.parametrize("run_bytes", [1, 3000, 1 << 24])
def test_trie_equals_a_plain_trie(spark, run_bytes):
    """Every key its own stretch, a few keys a stretch, all in one: what two stretches share is added up."""
    convs = {c: t for c, t in branching(3).items() if t}
    found = conversation_trie.nodes(lists_of(spark, convs), run_bytes)
    assert trie_rows(found) == plain_trie(convs)


def test_trie_with_turnless_conversations(spark):
    convs = {7: [], 9: [], 8: [("user", "a")], 3: [("user", "a"), ("", "")]}
    lists = lists_of(spark, convs)
    none = spark.createDataFrame([(7,), (9,)], "conv_id long").withColumn("turns", F.slice(F.array(F.struct(F.lit("").alias("id"), F.lit(0).alias("size"))), 1, 0))
    for run_bytes in (1, 1 << 24):
        assert trie_rows(conversation_trie.nodes(lists.unionByName(none), run_bytes)) == plain_trie(convs)


def test_tree_nodes_grow():
    """All layouts: a node with 256 children, and keys found in byte order whatever the order they came in."""
    keys = [bytes([a, b]) * 8 for a in range(256) for b in range(0, 256, 60)]
    random.Random(2).shuffle(keys)
    root, kinds = conversation_trie.Node(b""), set()
    for i, key in enumerate(keys):
        conversation_trie.insert(root, key, i)
        conversation_trie.insert(root, key, i)
        kinds.add((type(root.kids).__name__, getattr(root.kids, "room", 0)))
    assert kinds == {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Full", 0)}
    found = []

    def walk(node, before):
        if node.entry >= 0:
            found.append((before + node.path, node.entry))
        for byte in range(256):
            kid = node.kids.get(byte) if node.kids is not None else None
            if kid is not None:
                walk(kid, before + node.path + bytes([byte]))

    walk(root, b"")
    assert found == sorted((k, i) for i, k in enumerate(keys))


def test_trie_hot_conversation(spark):
    """A third of all conversations are one and the same, another third shares the first turn."""
    hot = [("user", "hi"), ("assistant", "hello")]
    convs = {c: hot if c % 3 == 0 else [("user", "hi"), ("user", f"{c}")] if c % 3 == 1 else [("user", f"{c}")] for c in range(900)}
    found = trie_rows(conversation_trie.nodes(lists_of(spark, convs), 40_000))
    assert len(found) == 1 + 1 + 1 + 300 + 300
    ends = hashlib.sha256(",".join(str(c) for c in range(0, 900, 3)).encode()).hexdigest()
    assert (0, 2, 0, 300, 0, 1, 299 * 5, ends) in found
    assert (0, 1, 0, 600, 301, 301, 599 * 2 + 299 * 5, conversation_trie.NO_ENDS) in found


def test_trie_odd_rows(spark):
    rows = [
        (1, None, None, None),
        (1, 2, "user", "b"),
        (1, 2, "user", "b"),
        (None, 1, "user", "lost"),
        (2, None, "", ""),
        (2, 1, "user", "b"),
        (-5, 1, "user", "x" * 200_000),
    ]
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS key", "2 AS id", "3 AS size")
    lists = conversation_trie.turn_lists(table)
    empty, b = ("", ""), ("user", "b")
    convs = {1: [empty, b, b], 2: [empty, b], -5: [("user", "x" * 200_000)]}
    assert trie_rows(conversation_trie.nodes(lists)) == plain_trie(convs)
    assert conversation_trie.nodes(conversation_trie.turn_lists(table.limit(0))).count() == 0


def test_openings(spark):
    convs = {c: [("user", f"{c}-{n}") for n in range(1 + c % 8)] for c in range(95, 230) if c != 200}
    lists = conversation_trie.with_openings(lists_of(spark, convs))
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    assert any(not t for t in rebuilt.values())
    assert trie_rows(conversation_trie.nodes(lists, 5000)) == plain_trie(rebuilt)


# --- SimHash ---


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", small(text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id that can be reached, from ``{id: fingerprint}``, all pairs compared."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_equals_all_pairs(spark, documents):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents.collect()}
    expected = plain_components(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.linked(documents).collect()}
    assert found == {i: (f"{p:016x}", expected[i]) for i, p in prints.items()}
    assert any(expected[i] != i for i in prints)


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    """Fingerprints around few centres, most in one: all groups are large, and cut into blocks where a tile is small."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BLOCK", max(tile // 2, 1))
    monkeypatch.setattr(simhash, "FOLD", 50)
    draw = random.Random(9)
    centres = [draw.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    prints = set()
    for _ in range(600):
        own = centres[0] if draw.random() < 0.4 else draw.choice(centres)
        for _ in range(draw.randrange(9)):
            own ^= 1 << draw.randrange(64)
        prints.add(own)
    prints = dict(enumerate(sorted(prints)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints.values()]
    pairs = simhash.links(spark.createDataFrame(signed, "print long")).collect()
    parent = {p: p for p in prints.values()}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in pairs:
        a, b = (root(r[c] % (1 << 64)) for c in "ab")
        parent[max(a, b)] = min(a, b)
    expected = plain_components(prints)
    # sorted, so that the smallest id has the smallest fingerprint
    assert {i: root(p) for i, p in prints.items()} == {i: prints[c] for i, c in expected.items()}


def test_pivots_discard_all_but_near_pairs():
    """Coordinates bound the distance from both sides."""
    draw = np.random.default_rng(5)
    a = draw.integers(0, 1 << 63, size=500, dtype=np.uint64)
    b = a.copy()
    for i in range(500):
        for bit in draw.choice(64, size=i % 24, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    references = simhash.pivots()
    gap = np.abs(simhash.distance_table(a, references).astype(int) - simhash.distance_table(b, references)).max(axis=1)
    distance = np.bitwise_count(a ^ b)
    assert (gap <= distance).all()
    assert (distance[gap <= simhash.RADIUS] <= simhash.RADIUS**2).all()


def test_simhash_odd_rows(spark):
    table = odd_docs(spark, [(9, " \t", "en", "a", 2), (None, None, None, None, None)]).selectExpr("*", "1 AS print", "2 AS least")
    found = simhash.linked(table)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    rows = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect())
    zero = "0" * 16
    assert rows[(1, zero, 1)] == rows[(2, zero, 1)] == rows[(9, zero, 1)] == rows[(None, zero, 1)] == 1
    assert sum(n for (i, _, c), n in rows.items() if i == 3 and c == 3) == 2
    assert [c for (i, f, c) in rows if i is None and f != zero] == [None]
    assert sum(rows.values()) == table.count()
    assert simhash.linked(table.limit(0)).count() == 0
