"""Importance resampling towards a target: documents whose words resemble the target are drawn more often.

Features are runs of one and two words, hashed to ``BUCKETS`` buckets.  The gain of a bucket is the log ratio of its smoothed share in
the target and in the corpus; a document's weight is the mean gain of its features, looked up in one array.  The score is
the weight plus Gumbel noise that follows from the id, so the highest scores are a draw without
replacement with probabilities that grow with exp(weight), and reruns agree.

The highest scores are found by distributed quickselect.  Keys (score, id, row) are compared with a few random
keys of the rows still in question; one pass counts exactly how many are above, equal to and below each; the
interval that holds the k-th key is what is still in question, until a pivot is that key.  Every round leaves
about one part in ``PIVOTS`` of the rows, so few rounds are needed at any size, and the rows still in question are
stored anew each time.  Only the winners are sorted and ranked, by ranges, not in one task.

Defined results: a null text has no features and weight 0; of equal scores smaller ids come first, then null ids, then
rows in the order they are stored in; a null id has the noise of an empty one; repeated rows are drawn each by itself; an empty table
gives an empty table; an empty target makes all gains depend on the corpus alone; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import text_or_empty
from weftline.operators.sampling import with_row_index
from weftline.session import stored

BUCKETS = 10_000
SEED = 7
PERCENT = 25
MIN_WORDS = 20
PIVOTS = 32

#: digits, small letters and all bytes of other scripts stay, capitals become small, the rest are blanks
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def feature_buckets(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of one and two words.

    The hash of two words goes on from that of the first.
    """
    crc = zlib.crc32
    words = text.encode().translate(_TABLE).split()
    single = [crc(w) for w in words]
    double = [crc(w, crc(b" ", c)) for c, w in zip(single, words[1:])]
    return len(words), np.array(single + double, dtype=np.int64) % buckets


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket.  A task counts into one array before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for own in batch["text"]:
                total += np.bincount(feature_buckets(own, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int64), "n": total[at]})

    counted = df.select(text_or_empty(text).alias("text")).mapInPandas(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from ``(bucket, n)`` of both sides: ``buckets`` whole numbers, a size that data do not change."""
    counts = (
        corpus.withColumnRenamed("n", "s")
        .join(target.withColumnRenamed("n", "t"), "bucket", "full")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
        .toPandas()
    )
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[counts["bucket"]], t[counts["bucket"]] = counts["s"], counts["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(gain: np.ndarray):
    """Column function: ``(n_words, n_features, weight)`` of a text."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), 3), dtype=np.int64)
            for i, text in enumerate(batch):
                n_words, own = feature_buckets(text, len(gain))
                if n_words:
                    out[i] = n_words, len(own), int(gain[own].sum()) // len(own)
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return of


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(df: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``(_row, doc_id, n_words, n_features, weight, score)`` of every row, stored; ``_row`` tells rows apart."""
    buckets, seed = options.get("buckets", BUCKETS), options.get("seed", SEED)
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, text, buckets), buckets)
    own = df.select(F.col(doc_id).alias("doc_id"), weights(gain)(text_or_empty(text)).alias("w"))
    score = (F.col("w.weight") + noise(F.col("doc_id"), seed)).alias("score")
    row = F.monotonically_increasing_id().alias("_row")
    return stored(own.select(row, "doc_id", "w.n_words", "w.n_features", "w.weight", score), "scores")


def before(key: tuple) -> Column:
    """Whether a row's key comes before ``key`` = (score, id, row) in the order of the draw."""
    score, own, row = key
    tie = F.col("_row") < F.lit(row)
    if own is None:
        by_id = F.col("doc_id").isNotNull() | tie
    else:
        same = F.col("doc_id") == F.lit(own)
        by_id = F.coalesce((F.col("doc_id") < F.lit(own)) | (same & tie), F.lit(False))
    return (F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & by_id)


def kth_key(rows: DataFrame, k: int, n_pivots: int = PIVOTS) -> tuple:
    """The key (score, doc_id, row) of the ``k``-th of ``rows``, counted from 1, by rounds of random pivots."""
    keys = rows.select("score", "doc_id", "_row")
    level = 0
    while True:
        pivots = keys.orderBy(F.xxhash64("_row", F.lit(level))).limit(n_pivots).collect()
        pivots = [(p["score"], p["doc_id"], p["_row"]) for p in pivots]
        counts = keys.agg(
            *[F.count_if(before(p)).alias(f"b{i}") for i, p in enumerate(pivots)],
            *[F.count_if(F.col("_row") == p[2]).alias(f"e{i}") for i, p in enumerate(pivots)],
        ).first()
        low, high, n_low = None, None, 0
        for i, pivot in enumerate(pivots):
            above, equal = counts[f"b{i}"], counts[f"e{i}"]
            if above < k <= above + equal:
                return pivot
            if above + equal < k:
                if low is None or above + equal > n_low:
                    low, n_low = pivot, above + equal
            elif high is None or above < counts[f"b{high}"]:
                high = i
        inside = F.lit(True)
        if low is not None:
            inside = ~before(low) & (F.col("_row") != F.lit(low[2]))
        if high is not None:
            inside = inside & before(pivots[high])
        keys, k, level = stored(keys.filter(inside), "keys"), k - n_low, level + 1


def drawn(
    df: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    **options,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``; ``rank`` is null where a row is not drawn.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    rows = scored(df, target, text, doc_id, **options)
    able = F.col("n_words") >= min_words
    k = percent * rows.filter(able).count() // 100
    none = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, none)
    last = kth_key(rows.filter(able), k)
    wins = able & (before(last) | (F.col("_row") == F.lit(last[2])))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ranked = with_row_index(rows.filter(wins), order, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.select(*columns, "rank").unionByName(rows.filter(~wins).select(*columns, none))
