"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences (ends: ``. ! ?`` and line breaks), and these into parts: a part also begins where a word
behind white space has a capital, so that a passage put into the middle of another sentence has parts of its own.
Hashed, without regard to case, white space and punctuation, are

* every run of ``RUN`` consecutive sentences with at least ``RUN_CHARS`` letters and digits,
* from each part on and up to each part the shortest run of parts with at least ``LONG_CHARS`` of them,
* the whole text, if it has at least ``RUN_CHARS``.

Where a run of parts begins and ends depends on the run alone, not on what stands around it.  Runs are joined over the whole table by
hash; the first occurrence (smallest id, then place) stays, and the parts inside any other occurrence are removed.  A run
of parts that overlaps its own first occurrence, as in one word repeated, is no other occurrence.

A frequent run is no single group: its first occurrence is an aggregate that is combined before the shuffle, and the runs are joined
to it, a join whose large partitions Spark splits.

Defined results: a null text stays null and an empty one empty; a text whose sentences all go becomes empty, its row
stays; a repeated row counts as another document, so the second of two loses its text; null ids come last in order; an
empty table gives an empty table; other columns stay, and columns named as an added one are replaced; ``n_removed``
counts sentences that are removed, in part or as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.llm.common import key_filter, may_match, packed, unpacked
from weftline.session import stored

RUN = 2
RUN_CHARS = 40
LONG_CHARS = 80
BLANK = r"[ \t\n\x0b\f\r]"
SENTENCE = rf"[^.!?\n]*+[.!?\n]++{BLANK}*+|[^.!?\n]++"
#: texts whose runs are sent on together
STEP = 256


def sentences(text: Column) -> Column:
    """Sentences with what ends them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(0))


@cache
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """A sentence, a blank with the beginning of a capitalised word and what opens it, a plain word."""
    capitals = "".join(c for c in map(chr, range(0x110000)) if c.isupper() or c.istitle())
    opened = re.compile(rf"{BLANK}[^\w\s]*+[{capitals}]")
    return re.compile(SENTENCE), opened, re.compile(r"[^\W_]+")


def cut(text: str) -> tuple[list[int], list[int]]:
    """Where the parts of a text begin, with its end; and the first part of each sentence, with their number."""
    sentence, opened, _ = patterns()
    ends = [m.end() for m in sentence.finditer(text)]
    at = sorted({0, *ends, *(m.start() + 1 for m in opened.finditer(text))})
    place = {x: i for i, x in enumerate(at)}
    return at, [0, *(place[x] for x in ends)]


def runs_of(text: str, run: int = RUN, parts: bool = True) -> dict[tuple[int, int], tuple[str, bool]]:
    """``(first part, number of parts)`` of all runs of a text, with their plain text and whether they are runs of parts.

    Without ``parts`` these are the runs of sentences alone.
    """
    at, first = cut(text)
    word = patterns()[2]
    plain = [" ".join(word.findall(text[a:b].lower())) for a, b in zip(at, at[1:])]
    whole = [" ".join(p for p in plain[a:b] if p) for a, b in zip(first, first[1:])]
    found = {}
    for i in range(len(whole) - run + 1):
        own = " ".join(whole[i : i + run])
        if len(own) >= RUN_CHARS:
            found[first[i], first[i + run] - first[i]] = own, False
    if not parts:
        return found
    worded = [i for i, p in enumerate(plain) if p]
    flat = " ".join(plain[i] for i in worded)
    begin = [0]  # of each part with words in ``flat``
    for i in worded:
        begin.append(begin[-1] + len(plain[i]) + 1)
    long = {(0, len(worded) - 1)} if len(flat) >= RUN_CHARS else set()
    for i in range(len(worded)):
        behind = bisect_left(begin, begin[i] + LONG_CHARS + 1)
        if behind < len(begin):
            long.add((i, behind - 1))
        before = bisect_right(begin, begin[i + 1] - 1 - LONG_CHARS) - 1
        if before >= 0:
            long.add((before, i))
    for i, j in long:
        found.setdefault((worded[i], worded[j] - worded[i] + 1), (flat[begin[i] : begin[j + 1] - 1], True))
    return found


def run_rows(run: int, parts: bool):
    """Function of record batches: ``(_uid, _id, place, size, of_parts, hash)`` of all runs of ``(_uid, _id, _text)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                some = batch.slice(start, STEP)
                own, place, size, of_parts, hashes = [], [], [], [], []
                for i, text in enumerate(some.column("_text").to_pylist()):
                    for (at, n), (plain, by_parts) in runs_of(text, run, parts).items():
                        own.append(i)
                        place.append(at)
                        size.append(n)
                        of_parts.append(by_parts)
                        digest = blake2b(plain.encode(), digest_size=8).digest()
                        hashes.append(int.from_bytes(digest, "little", signed=True))
                own = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("_uid").take(own),
                        some.column("_id").take(own),
                        pa.array(place, pa.int32()),
                        pa.array(size, pa.int32()),
                        pa.array(of_parts, pa.bool_()),
                        pa.array(hashes, pa.int64()),
                    ],
                    names=["_uid", "_id", "place", "size", "of_parts", "hash"],
                )

    return rows


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def without(texts: pd.Series, places: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    """Texts without the runs at these places, and the number of sentences that lose something."""
    out = []
    for text, starts, counts in zip(texts, places, sizes):
        if starts is None:
            out.append((text, 0))
            continue
        at, first = cut(text)
        gone = bytearray(len(at))
        for a, n in zip(starts, counts):
            gone[a : a + n] = b"\1" * int(n)
        kept = "".join(text[a:b] for a, b, g in zip(at, at[1:], gone) if not g)
        out.append((kept, sum(any(gone[a:b]) for a, b in zip(first, first[1:]))))
    return pd.DataFrame(out, columns=["text", "n"])


def deduplicated(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN, parts: bool = True
) -> DataFrame:
    """``df`` with repeated parts of sentences removed from ``text``, and ``n_sentences``, ``n_removed``.

    Without ``parts`` only runs of whole sentences count, and whole sentences go.
    """
    rows = packed(df, text).withColumn("_uid", F.monotonically_increasing_id())
    rows = stored(rows, "sentence-rows")
    cut_rows = rows.select("_uid", F.col("_row")[doc_id].alias("_id"), "_text")
    added = {"place": T.IntegerType(), "size": T.IntegerType(), "of_parts": T.BooleanType(), "hash": T.LongType()}
    schema = T.StructType([*cut_rows.schema.fields[:2], *(T.StructField(n, t) for n, t in added.items())])
    runs = cut_rows.mapInArrow(run_rows(run, parts), schema)
    runs = stored(runs, "sentence-runs")
    occurrence = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_uid"), F.col("place"), F.col("size"))
    # only runs that may stand twice are moved with what they carry
    twice = runs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    runs = may_match(runs, "hash", key_filter(twice, "hash")).filter("_may").drop("_may")
    runs = stored(runs, "runs-that-may-repeat")
    repeated = (
        runs.groupBy("hash")
        .agg(F.min(occurrence).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("hash", F.col("first._uid").alias("_first"), F.col("first.place").alias("_at"), F.col("first.size").alias("_n"))
    )
    later = (
        runs.join(repeated, "hash")
        .filter((F.col("_uid") != F.col("_first")) | (F.col("place") > F.col("_at") + F.when(F.col("of_parts"), F.col("_n") - 1).otherwise(0)))
        .groupBy("_uid")
        .agg(F.collect_list(F.struct("place", "size")).alias("_runs"))
    )
    # texts that lose nothing are not moved
    later = stored(later, "repeated-sentences")
    rows = may_match(rows, "_uid", key_filter(later, "_uid"))
    none = F.lit(None).cast("struct<text:string,n:int>")
    untouched = rows.filter("NOT _may").withColumn("_new", none)
    touched = rows.filter("_may").join(later, "_uid", "left")
    new = without("_text", F.col("_runs")["place"], F.col("_runs")["size"])
    joined = touched.withColumn("_new", new).drop("_runs").unionByName(untouched)
    own = F.col("_row")[text]
    return unpacked(
        joined,
        df.columns,
        **{
            text: F.when(own.isNotNull(), F.coalesce(F.col("_new")["text"], F.col("_text"))),
            "n_sentences": F.size(sentences(F.col("_text"))).cast("long"),
            "n_removed": F.coalesce(F.col("_new")["n"], F.lit(0)).cast("long"),
        },
    )
