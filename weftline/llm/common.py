"""Column expressions that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.session import stored

#: a word: code points other than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

Span = "array<struct<start:int,ord:int,end:int,kind:string>>"

#: bytes of an Arrow batch, which a task holds several times over on both sides
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"

#: prefix sums are taken in blocks of so many elements, so that none is quadratic in the text
BLOCK = 256


def own_shared_dir(spark: SparkSession) -> None:
    """Name a folder for stage tables where the session names none (tests, a local trial)."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` where the session sets no size: of long texts ten thousand rows are very large."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the work on it starts from a folder for stage tables."""
    own_shared_dir(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame | Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(f"({WORD})")).cast("long")


def running_sums(values: Column) -> Column:
    """Sums up to and with each element of an int array."""
    return running(values, lambda total, v: total + v)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes of 0 and the elements up to and with each one of an int array, in two levels of blocks."""

    def block(state: Column, index: Column) -> Column:
        part = F.slice(values, index * BLOCK + 1, F.lit(BLOCK))
        inner = F.aggregate(
            part,
            F.struct(F.array().cast("array<int>").alias("sums"), state["total"].alias("total")),
            lambda s, v: F.struct(
                F.concat(s["sums"], F.array(step(s["total"], v))).alias("sums"),
                step(s["total"], v).alias("total"),
            ),
        )
        return F.struct(
            F.concat(state["blocks"], F.array(inner["sums"])).alias("blocks"),
            inner["total"].alias("total"),
        )

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    start = F.struct(
        F.array().cast("array<array<int>>").alias("blocks"), F.lit(0).alias("total")
    )
    summed = F.flatten(F.aggregate(blocks, start, block, lambda s: s["blocks"]))
    return F.when(F.size(values) > 0, summed).otherwise(F.array().cast("array<int>"))


def matched(
    df: DataFrame, text: str, patterns: Sequence[tuple[str, str]], needs: dict[str, Column]
) -> DataFrame:
    """Leftmost non-overlapping matches of each kind, with code-point places.

    Adds one column ``_found_<kind>`` per pattern: an array of ``(start, end, value)``.  ``needs`` may name, per
    kind, a cheap condition without which a text has no match.  A text is cut at the
    matches, so the lengths of pieces and matches add up to places.  A match is found twice
    (once as value, once as cut), each in one pass of the expression.
    """
    for kind, pattern in patterns:
        can = needs.get(kind, F.lit(True))
        values = F.when(can, F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(0)))
        df = df.withColumn(f"_v_{kind}", F.coalesce(values, F.array().cast("array<string>")))
    for kind, pattern in patterns:
        values = F.col(f"_v_{kind}")
        pieces = F.split(F.col(text), pattern, -1)
        df = df.withColumn(
            f"_l_{kind}",
            F.when(
                F.size(values) > 0,
                F.zip_with(
                    F.slice(F.transform(pieces, F.length), F.lit(1), F.size(values)),
                    F.transform(values, F.length),
                    lambda gap, own: gap + own,
                ),
            ).otherwise(F.array().cast("array<int>")),
        )
    for kind, _ in patterns:
        df = df.withColumn(f"_e_{kind}", running_sums(F.col(f"_l_{kind}")))
    for kind, _ in patterns:
        found = F.zip_with(
            F.col(f"_v_{kind}"),
            F.col(f"_e_{kind}"),
            lambda value, end: F.struct(
                (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")
            ),
        )
        df = df.withColumn(f"_found_{kind}", found)
    return df.drop(*[f"_{c}_{kind}" for kind, _ in patterns for c in "vle"])


def as_spans(found: Column, kind: str, order: int) -> Column:
    """Matches as ``(start, ord, end, kind)``, the order in which spans are listed."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(order).alias("ord"),
            m["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def n_of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(
                s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def literal_pattern(words: Sequence[str]) -> str:
    """An alternation of fixed words."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def tokenizer_path(name: str) -> str:
    """A vocabulary file: from the folder ``PUBLIC_TOKENIZERS`` names, else the installed one."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packed(df: DataFrame, text: str) -> DataFrame:
    """All columns as one struct ``_row`` beside ``_text`` (null: empty), so that no name can clash."""
    return df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"), text_or_empty(text).alias("_text")
    )


def unpacked(df: DataFrame, columns: Sequence[str], **added: Column) -> DataFrame:
    """The columns of ``_row`` again, with ``added`` ones in place of those of the same name."""
    taken = {name.lower() for name in added}
    kept = [F.col("_row")[c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in added.items()])


def replaced(text: Column, spans: Column, put: dict[str, str]) -> Column:
    """``text`` with sorted spans cut out and the text for their kind put in; overlapping ones count as one."""
    names = F.create_map(*[F.lit(x) for pair in put.items() for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        grown = F.struct(
            s["end"].alias("at"),
            F.concat(state["out"], F.array(gap, F.coalesce(names[s["kind"]], F.lit("")))).alias("out"),
        )
        longer = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], grown).otherwise(longer)

    done = F.aggregate(
        spans,
        start,
        step,
        lambda state: F.concat(
            F.array_join(state["out"], ""),
            F.substring(text, state["at"] + 1, F.length(text)),
        ),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def clear_of(spans: Column, others: Column, kind: str = Span) -> Column:
    """Spans, an array of type ``kind``, that overlap none of ``others``, in order of their ends.

    Ends of spans and starts of others stand in one sorted array.  A span is clear if the furthest end among the others that
    begin before its own end is not behind its start.
    """
    none = F.lit(None).cast(kind.removeprefix("array<").removesuffix(">"))
    ends = F.transform(
        spans,
        lambda s: F.struct(
            s["end"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("reach"), s["start"].alias("start"), s.alias("span")
        ),
    )
    starts = F.transform(
        others,
        lambda o: F.struct(
            o["start"].alias("at"), F.lit(1).alias("turn"), o["end"].alias("reach"), F.lit(0).alias("start"), none.alias("span")
        ),
    )
    events = F.array_sort(F.concat(ends, starts))
    reach = running(F.transform(events, lambda e: e["reach"]), lambda furthest, end: F.greatest(furthest, end))
    clear = F.zip_with(
        events, reach, lambda e, r: F.when((e["turn"] == 0) & (r <= e["start"]), e["span"])
    )
    return F.when(F.size(others) > 0, F.filter(clear, lambda s: s.isNotNull())).otherwise(spans)


#: bits of a key filter: sixteen for a key, between one megabyte and 64
LEAST_BITS = 1 << 23
MOST_BITS = 1 << 29
_CHUNK = 1 << 15


class KeyFilter(NamedTuple):
    """A bitmap of hashes of keys: rows ``(_chunk, _bits)`` of 4 KB each, and how many bits there are in all."""

    table: DataFrame
    bits: int


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(bits))


def key_filter(keys: DataFrame, key: str) -> KeyFilter:
    """A bitmap that tells most other keys from ``keys`` (a stored table), sized by their number."""
    n, bits = keys.count(), LEAST_BITS
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2
    place = _place(key, bits)
    hashed = keys.select(F.floor(place / _CHUNK).cast("int").alias("_chunk"), (place % _CHUNK).alias("_at"))
    chunks = hashed.groupBy("_chunk").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    return KeyFilter(stored(chunks, "key-filter"), bits)


def may_match(df: DataFrame, key: str, bitmap: KeyFilter) -> DataFrame:
    """``df`` with ``_may``: false only where ``key`` is none of the filter's keys.

    Rows that cannot match need not be shuffled for a join.  The bitmap has at most ``MOST_BITS``, so it is broadcast; beyond
    some thirty million keys it lets more and more rows through, and the join decides as before.
    """
    place = _place(key, bitmap.bits)
    own = df.withColumn("_chunk", F.floor(place / _CHUNK).cast("int"))
    joined = own.join(F.broadcast(bitmap.table), "_chunk", "left")
    at = place % _CHUNK
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1
    return joined.withColumn("_may", F.coalesce(bit, F.lit(False))).drop("_chunk", "_bits")
