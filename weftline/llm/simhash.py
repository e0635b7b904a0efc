"""SimHash near-duplicates: texts whose 64-bit fingerprints hang together by links of at most ``RADIUS`` differing bits.

A fingerprint bit is set where more than half of the hashes of a text's shingles have it.  Equal fingerprints are one
fingerprint from then on, so copies cost nothing.

Links are found by pivot distance tables.  Every fingerprint has a row of Hamming distances to ``PIVOTS`` reference
fingerprints.  By the triangle inequality two fingerprints within ``RADIUS`` differ by at most ``RADIUS`` in every
coordinate of their rows, so pairs with a larger difference in any coordinate are discarded; survivors
are verified by their own bits.  The references are the rows of a Hadamard matrix: squared differences of two rows then
sum to 64 times the distance, so no pair more than ``RADIUS``\\ :sup:`2` bits apart survives.

Not every pair is looked at.  Of five blocks of bits, ``RADIUS`` = 3 differing bits leave two untouched, so fingerprints meet
in ten groups, one for each choice of two blocks and their content.  Inside a group they are sorted by
their first coordinate, and a pair is looked at while that differs by at most ``RADIUS``.  A group of more
than ``TILE`` fingerprints is cut into blocks, and each pair of blocks is a task's work of its own.  A tile gives the
fingerprints' smallest relative in it, not its pairs; links are then closed over all tiles by
:func:`weftline.llm.components.components`.

Defined results: a null text is an empty one, whose fingerprint is zero and linked like any other; a null id counts
for nothing when a component is named, and a component without ids has none; repeated rows are copies; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import text_or_empty
from weftline.llm.components import components
from weftline.session import stored

WORDS = 3
SEED = 42
RADIUS = 3
#: bits of the blocks a fingerprint is cut into, two of which are equal in all pairs within ``RADIUS``
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = 64
#: fingerprints of a group that one tile takes by itself, and of a block of a larger group
TILE = 4096
BLOCK = 2048
#: pairs looked at before they are folded into their components
FOLD = 1 << 20


def shingles(text: str, n: int = WORDS) -> list[bytes]:
    """Runs of ``n`` words, A to Z in lower case, repeats included; all words where there are fewer."""
    words = text.encode().lower().split()  # bytes: only ASCII has cases and blanks
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned hashes: each bit that more than half of them have."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(seed: int = SEED, n: int = WORDS):
    """Column function: the fingerprint of a text, as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(len(batch), dtype=np.uint64)
            for i, text in enumerate(batch):
                hashes = np.array([xxh64_intdigest(s, seed) for s in shingles(text, n)], dtype=np.uint64)
                out[i] = majority(hashes)
            yield pd.Series(out.view(np.int64))

    return of


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of the Hadamard matrix of order 64."""
    places = np.arange(64)
    rows = [sum(int((r & c).bit_count() & 1) << int(c) for c in places) for r in range(n)]
    return np.array(rows, dtype=np.uint64)


def distance_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def folded(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after links between places ``a`` and ``b``; a label is the smallest place of its component."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
        if (label == before).all():
            return label


def linked_places(prints: np.ndarray, tile: np.ndarray, references: np.ndarray) -> np.ndarray:
    """For each fingerprint the place of its smallest relative in its tile.

    Rows are sorted by tile and by distance to the first reference.  The pairs at one offset in that order are
    looked at together, over all tiles of the batch; a row drops out at its first partner that is too far.
    """
    table = distance_table(prints, references)
    first = table[:, 0].astype(np.int64)
    label = np.arange(len(prints))
    left, right, n_kept = [], [], 0
    near, offset = np.arange(len(prints) - 1), 1
    while len(near):
        near = near[near + offset < len(prints)]
        other = near + offset
        near = near[(tile[near] == tile[other]) & (first[other] - first[near] <= RADIUS)]
        a = near
        for part in (slice(1, 9), slice(9, None)):  # most pairs are discarded by a few coordinates
            gap = np.abs(table[a, part] - table[a + offset, part])
            if gap.shape[1]:
                a = a[gap.max(axis=1) <= RADIUS]
        a = a[np.bitwise_count(prints[a] ^ prints[a + offset]) <= RADIUS]
        left.append(a)
        right.append(a + offset)
        n_kept += len(a)
        if n_kept > FOLD:
            label = folded(label, np.concatenate(left), np.concatenate(right))
            left, right, n_kept = [], [], 0
        offset += 1
    if n_kept:
        label = folded(label, np.concatenate(left), np.concatenate(right))
    return label


def group_keys(own: Column) -> Column:
    """One key for each choice of two blocks: which two, and their content."""
    starts = np.concatenate([[0], np.cumsum(BLOCKS)[:-1]]).tolist()
    parts = [
        F.shiftrightunsigned(own, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        for at, bits in zip(starts, BLOCKS, strict=True)
    ]
    two = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    widest = max(BLOCKS)
    return F.array(
        *[
            F.shiftleft(F.shiftleft(F.lit(n).cast("long"), widest).bitwiseOR(parts[i]), widest).bitwiseOR(parts[j])
            for n, (i, j) in enumerate(two)
        ]
    )


def tiles(prints: DataFrame) -> DataFrame:
    """``(group, low, high, print)``: the fingerprints of each tile.

    Groups up to ``TILE`` are one tile.  A larger one is cut into blocks, and a tile holds two of them.
    """
    met = prints.select("print", F.explode(group_keys(F.col("print"))).alias("group"))
    large = met.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    large = stored(large.select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-groups")
    placed = met.join(large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))
    dealt = placed.withColumn("block", block).select("group", "print", "block", F.explode(others).alias("other"))
    return dealt.select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "print"
    )


def relatives(references: np.ndarray):
    """Function over tiles sorted by tile and first coordinate: ``(a, b)`` of every fingerprint with a smaller relative."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["print"].to_numpy(dtype=np.int64)
        keys = rows[["group", "low", "high"]].to_numpy(dtype=np.int64)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        label = linked_places(prints.view(np.uint64), np.cumsum(new), references)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": prints[moved], "b": prints[label[moved]]})

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["group", "low", "high"]].to_numpy(dtype=np.int64)
            # the last tile may go on in the next batch
            differs = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            rest = rows.iloc[cut:]
            if cut:
                yield links(rows.iloc[:cut])
        if rest is not None:
            yield links(rest)

    return over


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links that join all distinct fingerprints ``print`` within ``RADIUS`` of each other, closed by tile."""
    references = pivots()
    first = F.bit_count(F.col("print").bitwiseXOR(F.lit(int(references[0].view(np.int64))).cast("long")))
    tile = ["group", "low", "high"]
    dealt = tiles(prints).withColumn("first", first).repartition(*tile).sortWithinPartitions(*tile, "first", "print")
    found = dealt.select(*tile, "print").mapInPandas(relatives(references), "a long, b long")
    return found.distinct()


def printed(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, print)``, stored: the texts are read once and not moved."""
    own = df.select(F.col(doc_id).alias("doc_id"), fingerprints()(text_or_empty(text)).alias("print"))
    return stored(own, "fingerprints")


def linked(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``df``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id that can be reached by links.
    """
    rows = printed(df, text, doc_id)
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    together = components(stored(links(prints.select("print")), "fingerprint-links"), "fingerprint-components")
    of_root = prints.join(together.withColumnRenamed("node", "print"), "print", "left")
    of_root = stored(of_root.select("print", "least", F.coalesce("root", "print").alias("root")), "roots")
    named = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = of_root.select("print", "root").join(named, "root").select("print", "component_id")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    return rows.join(by_print, "print").select("doc_id", shown.alias("fingerprint"), "component_id")
