"""Small tables and plain versions that the operators are held against."""

import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None, first_id=0):
    rows = [
        (first_id + i, t, "en", sources[i] if sources else "a", len(t or ""))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark, extra=()):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rows = [
        (1, None, None, None, None),
        (None, "a text without an id", "en", "a", 20),
        (2, "", "en", "a", 0),
        (3, "one two three four five six seven", "en", "b", 30),
        (3, "one two three four five six seven", "en", "b", 30),
        (4, "word " * 30_000, "en", None, 150_000),
        (5, "ünï cödé \U0001f600 text\twith\x0bodd\r\nblanks here", "de", "a", 1),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def shingle_sets(texts):
    out = {}
    for key, text in texts.items():
        words = WORD.findall((text or "").lower())
        if len(words) >= 5:
            out[key] = frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        else:
            out[key] = frozenset([tuple(words)]) if words else frozenset()
    return out


def near_classes(texts):
    """Class (smallest id) and number of similar other sets of every text, all pairs compared."""
    by_set = defaultdict(list)
    for key, own in shingle_sets(texts).items():
        by_set[own].append(key)
    sets = [s for s in by_set if s]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    lowest = defaultdict(lambda: 10**18)
    for i, s in enumerate(sets):
        lowest[root(i)] = min(lowest[root(i)], *by_set[s])
    found = {k: (k, 0) for k in by_set.get(frozenset(), [])}
    for i, s in enumerate(sets):
        for k in by_set[s]:
            found[k] = (lowest[root(i)], links[i])
    return found
