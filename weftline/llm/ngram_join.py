"""Near-duplicate join: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

An LSH forest: every distinct shingle set gets ``TREES`` paths of ``DEPTH`` MinHash values, and the sorted paths of a tree are
its prefix trie.  Two sets are candidates where their paths agree on a prefix.  It is first the whole path; for a set
whose recall would be too low with that, prefixes are shortened until a similar set shares one of them in some
tree with probability ``RECALL``.  How far that is depends on the set: a set of seven shingles has no partner between 0.8
and 6/7, so its whole path will do, while one of ten has partners at exactly 0.8 and needs shorter prefixes.

Equal paths are found by grouping, shorter common prefixes between neighbours in the order of a tree: what shares a prefix
stands together there, so neighbours are enough to hang it together.  Edges grow with the sets and not with pairs.  Sets that
hang together are then verified exactly against each other, all of them, in tiles of at most twice ``BLOCK`` sets: a tile is a matrix
product over their common shingles, and gives each set its number of links and its class.  Copies count once.

Joins are by shuffle at every size; of the texts only those that can be candidates by a bitmap of their rows
go through one.

Words are what stands between white space, in lower case.  A text of one to four words has them
as its only shingle.

Defined results: a null or empty text has no shingles, no links and a class of its own; a class is named by the
smallest id in it (null if it has no id); repeated rows are copies; an empty table gives an empty table; other
columns stay, and columns named as an added one are replaced.  Sets are known by a hash of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.llm.common import key_filter, may_match, packed, text_or_empty, unpacked
from weftline.llm.components import components
from weftline.session import stored

WORDS = 5
#: similarity as a ratio of whole numbers, so that the test is exact
SIMILAR = (4, 5)
TREES = 24
DEPTH = 8
RECALL = 0.999
#: sets of more shingles than this are taken to have partners at the threshold itself
EXACT_SIZES = 512
#: sets in a block, and shingles in it, about; a tile holds two blocks
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: shingles multiplied at a time
STRIP = 4096


def needed_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity still meets in some tree often enough."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


#: the depth for partners at the threshold itself
SHORTEST = needed_depth(SIMILAR[0] / SIMILAR[1])


def words_of(text: Column) -> Column:
    """What stands between ASCII white space, in lower case."""
    spaced = F.lower(text)
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """Distinct hashes of the runs of ``n`` words, sorted."""
    runs = F.transform(
        words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)])
    )
    whole = F.array(F.xxhash64(words))
    none = F.array().cast("array<bigint>")
    return (
        F.when(F.size(words) >= n, F.sort_array(F.array_distinct(F.slice(runs, F.lit(1), F.size(words) - (n - 1)))))
        .when(F.size(words) > 0, whole)
        .otherwise(none)
    )


def with_shingles(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add ``_shingles`` and ``_set``, the hash of the set (null without shingles)."""
    df = df.withColumn("_w", words_of(F.col(text)))
    df = df.withColumn("_shingles", shingle_hashes(F.col("_w"))).drop("_w")
    return df.withColumn(
        "_set", F.when(F.size("_shingles") > 0, F.xxhash64("_shingles"))
    )


@cache
def lowest_similarity(n: int) -> float:
    """The lowest similarity, at or above the threshold, that a set of ``n`` can have to a set that differs from it; 1 if there is none."""
    least, whole = SIMILAR
    found = 1.0
    for m in range(-(-least * n // whole), whole * n // least + 1):
        common = -(-least * (n + m) // (least + whole))  # the fewest that reach the threshold
        if common <= min(n, m) and n + m - common > common:
            found = min(found, common / (n + m - common))
    return found


@cache
def set_depth(n: int) -> int:
    """How many values of a path a set of ``n`` shingles has to agree on; 0 where no other set is similar to it."""
    lowest = lowest_similarity(min(n, EXACT_SIZES))
    return needed_depth(lowest) if lowest < 1 else 0


def tree_paths(trees: int = TREES, depth: int = DEPTH):
    """Column function of shingles: the depth a set needs, and its path in each tree.

    A path is the tree's number and ``depth`` values of two bytes, big end first, so that order of bytes is order in the trie.
    """
    draw = np.random.default_rng(4)
    odd = draw.integers(0, 1 << 63, size=trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, size=trees * depth, dtype=np.uint64)

    @F.pandas_udf("depth int, paths array<binary>")
    def paths(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            depths, out = [], []
            for own in batch:
                needed = set_depth(len(own)) if own is not None else 0
                depths.append(needed)
                if not needed:
                    out.append(None)
                    continue
                x = np.asarray(own).astype(np.int64).view(np.uint64)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
                least = np.full(trees * depth, np.uint64(2**64 - 1))
                for at in range(0, len(x), 512):  # a strip stays in the cache
                    h = x[None, at : at + 512] * odd[:, None] + add[:, None]
                    np.minimum(least, (h >> np.uint64(8)).min(axis=1), out=least)
                values = (least ^ (least >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
                code = (values >> np.uint64(48)).astype(">u2").tobytes()
                out.append([bytes([t]) + code[2 * depth * t : 2 * depth * (t + 1)] for t in range(trees)])
            yield pd.DataFrame({"depth": pd.Series(depths, dtype="int32"), "paths": pd.Series(out, dtype=object)})

    return paths


def forest_edges(paths: DataFrame) -> DataFrame:
    """``(a, b)`` that hang candidates together, from ``(_set, depth, path)``: one row for each set and tree."""
    ends = paths.groupBy("path").agg(
        F.min("_set").alias("a"), F.max("_set").alias("z"), F.min("depth").alias("depth")
    )
    ends = stored(ends, "trie-paths")
    shared = ends.filter(F.col("a") < F.col("z")).select("path", "a")
    whole = paths.select("path", F.col("_set").alias("b")).join(shared.hint("merge"), "path").select("a", "b")
    # below the shortest prefix that any set needs nothing is compared
    trunk = F.substring("path", 1, 1 + 2 * SHORTEST)
    order = W.partitionBy(trunk).orderBy("path")
    beside = ends.select(
        F.col("a").alias("b"),
        F.lag("a").over(order).alias("a"),
        F.col("path").alias("own"),
        F.lag("path").over(order).alias("other"),
        F.least("depth", F.lag("depth").over(order)).alias("depth"),
    )
    agree = F.expr("substring(own, 1, 1 + 2 * depth)") == F.expr("substring(other, 1, 1 + 2 * depth)")
    return whole.unionByName(beside.filter(F.col("a").isNotNull() & agree).select("a", "b"))


def tile_links(sets: list[np.ndarray], left: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact links among sets: of the first ``left`` with the others, or of all where ``left`` is 0.

    Gives the number of links of each set in this tile, and the smallest place among those it hangs together with.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = seen[column] > 1  # a shingle of one set adds nothing to any intersection
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, STRIP):
        a, b = np.searchsorted(column, (at, at + STRIP))
        strip = np.zeros((n, min(STRIP, width - at)), dtype=np.float32)
        strip[owner[a:b], column[a:b] - at] = 1
        both += strip @ strip.T
    # common / (both sizes - common) at or above the threshold, without a fraction
    inter = both.astype(np.int32)
    del both
    inter *= sum(SIMILAR)
    weight = (SIMILAR[0] * sizes).astype(np.int32)
    linked = inter >= weight[:, None] + weight[None, :]
    np.fill_diagonal(linked, False)
    if left:
        linked[:left, :left] = False
        linked[left:, left:] = False
    root = np.arange(n)
    for i in range(n):  # breadth first, each set once
        if root[i] < i or not linked[i].any():
            continue
        front = np.array([i])
        while len(front):
            reached = np.flatnonzero(linked[front].any(axis=0))
            front = reached[root[reached] > i]
            root[front] = i
    return linked.sum(axis=1), root


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles, one after another, out of rows sorted by tile: ``(_set, links, root)`` of each set."""

    def answer(tile: tuple, rows: list) -> pd.DataFrame:
        rows = list({r[0]: r for r in rows}.values())
        rows.sort(key=lambda r: (r[1] != tile[1], r[0]))
        left = sum(r[1] == tile[1] for r in rows) if tile[1] != tile[2] else 0
        names = np.array([r[0] for r in rows], dtype=np.int64)
        links, root = tile_links([np.asarray(r[2], dtype=np.int64) for r in rows], left)
        return pd.DataFrame({"_set": names, "links": links.astype("int64"), "root": names[root]})

    now, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            tile = (row.root, row.low, row.high)
            if tile != now:
                if rows:
                    yield answer(now, rows)
                now, rows = tile, []
            rows.append((row.set_id, row.block, row.shingles))
    if rows:
        yield answer(now, rows)


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(rows, sets)``: the stored rows ``(_row, _uid, _set)`` with their ``_text``, and ``(_set, root, links)`` of all linked sets."""
    rows = with_shingles(packed(df, text)).withColumn("_uid", F.monotonically_increasing_id())
    rows = rows.withColumn("_tree", tree_paths()(F.col("_shingles")))
    rows = rows.withColumn("_size", F.size("_shingles")).drop("_shingles", "_text")
    # a text is stored once, in its row
    rows = stored(rows, "shingle-sets").withColumn("_text", text_or_empty(F.col("_row")[text]))
    forest = rows.select("_set", F.col("_tree")["depth"].alias("depth"), F.explode("_tree.paths").alias("path"))
    edges = forest_edges(forest)
    hanging = components(edges, "candidates").select(F.col("node").alias("_set"), "root")
    # one row for each candidate set carries its shingles on
    one = (
        rows.select("_set", "_uid", "_size")
        .join(hanging.hint("merge"), "_set")
        .groupBy("_set", "root")
        .agg(F.min("_uid").alias("_uid"), F.max("_size").alias("_size"))
    )
    one = stored(one, "candidate-sets")
    sizes = one.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("volume"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    placed = one.join(sizes, "root").withColumns(
        {"blocks": blocks, "block": F.pmod(F.xxhash64("_set", F.lit(1)), blocks).cast("int")}
    )
    texts = may_match(rows.select("_uid", "_text"), "_uid", key_filter(one, "_uid"))
    texts = texts.filter("_may").drop("_may")
    members = with_shingles(texts.join(placed.hint("merge"), "_uid"))
    tiles = members.select(
        "root",
        "block",
        F.col("_set").alias("set_id"),
        F.col("_shingles").alias("shingles"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )
    keys = ["root", "low", "high"]
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys).drop("other")
    dealt = dealt.select(*keys, "block", "set_id", "shingles")
    found = stored(dealt.mapInPandas(verified, "_set long, links long, root long"), "links")
    together = components(found.select(F.col("_set").alias("a"), F.col("root").alias("b")), "classes")
    links = found.groupBy("_set").agg(F.sum("links").alias("links")).filter(F.col("links") > 0)
    return rows, links.join(together.select(F.col("node").alias("_set"), "root"), "_set")


def joined(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with ``class_id``, ``n_links`` (other texts that are similar) and ``first`` (the row that stands for its class)."""
    rows, sets = classes(df, text, doc_id)
    own = F.col("_row")[doc_id]
    narrow = rows.select("_uid", own.alias("_id"), "_set").join(sets, "_set", "left")
    narrow = narrow.withColumns(
        {
            "_links": F.coalesce("links", F.lit(0)),
            # rows without shingles are classes of their own
            "_kind": F.when(F.col("_set").isNull(), 1).otherwise(0),
            "_class": F.coalesce("root", "_set", "_uid"),
        }
    ).select("_uid", "_id", "_links", "_kind", "_class")
    narrow = stored(narrow, "class-members")
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_uid")))
    heads = narrow.groupBy("_kind", "_class").agg(first.alias("_head"))
    heads = heads.select(
        "_kind", "_class", F.col("_head._id").alias("_head_id"), F.col("_head._uid").alias("_head_uid")
    )
    named = narrow.join(heads, ["_kind", "_class"]).select("_uid", "_links", "_head_id", "_head_uid")
    out = rows.select("_row", "_uid").join(named, "_uid")
    return unpacked(
        out,
        df.columns,
        class_id=F.col("_head_id"),
        n_links=F.col("_links").cast("long"),
        first=F.col("_uid") == F.col("_head_uid"),
    )
