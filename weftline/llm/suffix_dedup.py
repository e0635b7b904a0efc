"""Removal of repeated byte strings by sorted suffixes.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else goes.

Only suffixes at anchors are sorted.  The anchors of a text are the places where a hash of the next ``ANCHOR`` bytes is the smallest of
those inside some window of ``LENGTH`` bytes; equal windows have their anchor at the same place, so two equal strings
always meet under one anchor, with what is left and right of it.  Occurrences with equal surroundings are counted as
one; where the surroundings of an anchor differ, its suffixes (to the right) and the reversed prefixes (to the left) are sorted
deep-shallow: multikey quicksort down to ``SHALLOW`` bytes, blind tries for the groups that are
still equal there.  Common prefixes of neighbours then say which windows around the anchor occur twice.

An anchor with many different surroundings is sorted in tiles of at most twice ``BLOCK`` of them, every block with every other.

Texts are known by 64-bit hashes, as are anchors.  Defined results: a null text is empty; texts shorter than ``LENGTH`` lose
nothing; repeated rows are occurrences of each other; matches never cross texts; an empty table gives an empty table; other
columns stay, and columns named as an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import key_filter, may_match, packed, unpacked
from weftline.session import stored

LENGTH = 400
ANCHOR = 200
SHALLOW = 16
BLOCK = 4096
#: bytes of a text that are hashed at a time
STRETCH = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        own = []
        for base in (_BASE, inverse):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            own.append(np.multiply.accumulate(steps))
        _POWERS[size] = (own[0], own[1])
    return _POWERS[size]


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum over windows of ``width``, by windows of doubled width."""
    done, out = 1, values
    while 2 * done <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = best(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Places of the anchors of a text."""
    found = [
        start + stretch_anchors(data[start : start + STRETCH + length - 1], length, anchor)
        for start in range(0, max(len(data) - length + 1, 0), STRETCH)
    ]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def stretch_anchors(data: bytes, length: int, anchor: int) -> np.ndarray:
    n = len(data)
    if n < length:
        return np.zeros(0, dtype=np.int64)
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)  # 0 stands for no window below
    width = length - anchor + 1
    least = sliding(h, width, np.minimum)
    room = np.zeros(width - 1, dtype=np.uint64)
    highest = sliding(np.concatenate([room, least, room]), width, np.maximum)
    return np.flatnonzero(highest == h)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """A trie that keeps, for each branch, only the depth at which strings differ and the next byte."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [first]  # a leaf: places of equal strings

    @staticmethod
    def at(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def insert(self, own: int) -> None:
        text, node = self.strings[own], self.root
        while isinstance(node, tuple):  # down without comparing what lies between branches
            depth, children = node
            char = self.at(text, depth)
            node = children[char] if char in children else next(iter(children.values()))
        near = self.strings[node[0]]
        if near == text:
            node.append(own)
            return
        differ = common(text, near)
        above, edge, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < differ:
            above, edge = node, self.at(text, node[0])
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == differ:
            node[1][self.at(text, differ)] = [own]
            return
        branch = (differ, {self.at(near, differ): node, self.at(text, differ): [own]})
        if above is None:
            self.root = branch
        else:
            above[1][edge] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Order of strings: multikey quicksort to ``shallow`` bytes, blind tries below."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings, group[0])
            for own in group[1:]:
                trie.insert(own)
            out += trie.order()
        else:
            at = BlindTrie.at
            pivot = at(strings[group[len(group) // 2]], depth)
            parts: tuple[list, list, list] = ([], [], [])
            for i in group:
                char = at(strings[i], depth)
                parts[0 if char < pivot else 1 if char == pivot else 2].append(i)
            stack.append((parts[2], depth))
            # strings that end here are equal
            if pivot < 0:
                stack += [(p, shallow) for p in parts[1:2]]
            else:
                stack.append((parts[1], depth + 1))
            stack.append((parts[0], depth))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed ranges of whole numbers."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def twice_ranges(
    lefts: list[bytes], rights: list[bytes], side: int
) -> list[list[tuple[int, int]]]:
    """For each surrounding the distances before the anchor at which windows start that another one has too.

    ``lefts`` are reversed; a window at distance o needs o bytes of the left and ``side`` - o of the right.    """
    n = len(lefts)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                low, high = side - common(rights[i], rights[j]), common(lefts[i], lefts[j])
                if low <= high:
                    ranges[i].append((low, high))
                    ranges[j].append((low, high))
        return [merged(r) for r in ranges]
    order_l, order_r = deep_shallow(lefts), deep_shallow(rights)
    lcp_l = np.array([common(lefts[a], lefts[b]) for a, b in zip(order_l, order_l[1:], strict=False)])
    lcp_r = np.array([common(rights[a], rights[b]) for a, b in zip(order_r, order_r[1:], strict=False)])
    len_l = np.array([len(x) for x in lefts])
    len_r = np.array([len(x) for x in rights])
    # between two of these distances nothing changes
    points = np.unique(
        np.concatenate([[0], lcp_l + 1, len_l + 1, side - lcp_r, side - len_r])
    )
    points = points[(points >= 0) & (points <= side)]
    ends = np.append(points[1:] - 1, side)
    class_l, class_r = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for start, end in zip(points.tolist(), ends.tolist(), strict=True):
        valid = (len_l >= start) & (len_r >= side - start)
        if valid.sum() < 2:
            continue
        class_l[order_l] = np.concatenate([[0], np.cumsum(lcp_l < start)])
        class_r[order_r] = np.concatenate([[0], np.cumsum(lcp_r < side - start)])
        own = np.flatnonzero(valid)
        _, code, counts = np.unique(class_l[own] * n + class_r[own], return_inverse=True, return_counts=True)
        for i in own[counts[code] > 1].tolist():
            if ranges[i] and ranges[i][-1][1] == start - 1:
                ranges[i][-1] = (ranges[i][-1][0], end)
            else:
                ranges[i].append((start, end))
    return ranges


ANCHORS = "anchor long, around long, doc long, pos long, fit long"
#: bytes before and after an anchor are kept in one number
FIT = 1 << 32


def anchor_rows(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row per anchor: its hash, the hash of its surroundings, and where it is."""
    side = length - anchor

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        names = ["anchor", "around", "doc", "pos", "fit"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                part = batch.iloc[at : at + 256]
                for doc, text in zip(part["doc"], part["_text"], strict=True):
                    data = text.encode()
                    for p in anchors(data, length, anchor).tolist():
                        before, after = min(side, p), min(side, len(data) - p - anchor)
                        out.append(
                            (
                                xxhash.xxh64_intdigest(data[p : p + anchor]) - (1 << 63),
                                xxhash.xxh64_intdigest(data[p - before : p + anchor + after], before) - (1 << 63),
                                doc, p, before * FIT + after,
                            )
                        )
                yield pd.DataFrame(out, columns=names)

    return rows.select("doc", "_text").mapInPandas(find, ANCHORS)


def surroundings(rows: DataFrame, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes around the anchors in ``wanted(doc, own, places)``, left ones reversed."""
    schema = "anchor long, around long, blocks int, lefts binary, rights binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                out = []
                for text, places in zip(part["_text"], part["places"], strict=True):
                    data = text.encode()
                    for r in places:
                        p, (before, after) = r["pos"], divmod(r["fit"], FIT)
                        left = data[p - before : p][::-1]
                        right = data[p + anchor : p + anchor + after]
                        out.append((r["anchor"], r["around"], r["blocks"], left, right))
                yield pd.DataFrame(out, columns=["anchor", "around", "blocks", "lefts", "rights"])

    same = (F.col("w.doc") == F.col("r.doc")) & F.col("w.own").eqNullSafe(F.col("r.own"))
    chosen = rows.alias("r").join(wanted.alias("w"), same).select("r._text", "w.places")
    return chosen.mapInPandas(cut, schema)


def solved(batches: Iterator[pd.DataFrame], side: int) -> Iterator[pd.DataFrame]:
    """Tiles, one after another, out of rows sorted by tile."""

    def answers(rows: list) -> Iterator[tuple]:
        own = list({r[1]: r for r in rows}.values())
        if len(own) < 2:
            return
        found = twice_ranges([r[2] for r in own], [r[3] for r in own], side)
        for r, ranges in zip(own, found, strict=True):
            if ranges:
                yield (r[0], r[1], [{"low": a, "high": b} for a, b in ranges])

    columns = ["anchor", "around", "ranges"]
    now, rows, out = None, [], []
    for batch in batches:
        for t in batch.itertuples(index=False):
            tile = (t.anchor, t.low, t.high)
            if tile != now:
                out += answers(rows)
                now, rows = tile, []
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            rows.append((t.anchor, t.around, t.lefts, t.rights))
    out += answers(rows)
    yield pd.DataFrame(out, columns=columns)


RANGES = "array<struct<low:bigint,high:bigint>>"


def repeated_ranges(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc, spans)``: for each text the byte spans to remove, not yet merged."""
    side = length - anchor
    found = stored(anchor_rows(rows, length, anchor), "anchors")
    place = F.struct("doc", "pos", "fit")
    around = found.groupBy("anchor", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("at")
    )
    twice = around.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    around = stored(around.join(twice.filter("total > 1"), "anchor"), "surroundings")
    # equal surroundings: all windows that fit
    fits = F.array(
        F.struct(
            (F.lit(side) - F.col("at.fit") % FIT).alias("low"), F.floor(F.col("at.fit") / FIT).alias("high")
        )
    ).cast(RANGES)
    whole = around.filter("n > 1").select("anchor", "around", fits.alias("ranges"))
    # different ones: sorted, one of each
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    wanted = (
        around.filter("k > 1")
        .select(
            F.col("at.doc").alias("doc"),
            F.struct(
                "anchor",
                "around",
                F.col("at.pos").alias("pos"),
                F.col("at.fit").alias("fit"),
                blocks.alias("blocks"),
            ).alias("p"),
        )
        .groupBy("doc")
        .agg(F.collect_list("p").alias("places"))  # at most the anchors of one text
    )
    # of equal texts one row is read
    one_row = rows.groupBy("doc").agg(F.min("own").alias("own"))
    wanted = stored(wanted.join(one_row, "doc"), "wanted-surroundings")
    rows = may_match(rows, "doc", key_filter(wanted, "doc")).filter("_may").drop("_may")
    mixed = surroundings(rows, wanted, length, anchor)
    block = F.pmod(F.xxhash64("around"), F.col("blocks")).cast("int")
    tiles = (
        mixed.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .select("anchor", "low", "high", "around", "lefts", "rights")
    )
    keys = ["anchor", "low", "high"]
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys)
    partly = dealt.mapInPandas(
        lambda batches: solved(batches, side), f"anchor long, around long, ranges {RANGES}"
    )
    ranges = whole.unionByName(partly).groupBy("anchor", "around")
    ranges = ranges.agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    spans = F.transform(
        F.filter("ranges", lambda r: r["low"] <= r["high"]),
        lambda r: F.struct(
            (F.col("pos") - r["high"]).alias("start"), (F.col("pos") - r["low"] + length).alias("end")
        ),
    )
    # a stored side, so that Spark can split a join key that many occurrences share
    ranges = stored(ranges, "repeated-ranges")
    hit = may_match(found.select("anchor", "around", "doc", "pos"), "around", key_filter(ranges, "around"))
    hit = hit.filter("_may").drop("_may").join(ranges, ["anchor", "around"])
    hit = hit.groupBy("doc", "pos").agg(F.first(spans).alias("spans"))
    return hit.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


KEPT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>"


def deduplicated(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    with_kept: bool = True,
) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the bytes ``kept``."""
    rows = packed(df, text).withColumns(
        {"doc": F.xxhash64("_text"), "own": F.col("_row")[doc_id]}
    )

    @F.pandas_udf(KEPT)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text_, own in zip(texts, spans, strict=True):
            data = text_.encode()
            gone = merged([(s["start"], s["end"] - 1) for s in own]) if own is not None else []
            kept, at = [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b + 1
            kept = b"".join([*kept, data[at:]])
            out.append(
                (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(),
                 kept if with_kept else None)
            )
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    removed = repeated_ranges(rows.select("doc", "own", "_text"), length, anchor)
    removed = stored(removed, "removed-spans")
    # texts that lose nothing are not moved
    rows = may_match(rows, "doc", key_filter(removed, "doc"))
    hit = rows.filter("_may").join(removed, "doc", "left")
    none = F.lit(None).cast(removed.schema["spans"].dataType)
    joined = hit.unionByName(rows.filter("NOT _may").withColumn("spans", none))
    joined = joined.withColumn("_cut", cut("_text", "spans"))
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    return unpacked(joined, df.columns, **{c: F.col("_cut")[c] for c in added})
