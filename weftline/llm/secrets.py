"""Secret scan: fixed forms, and a character Markov model against ordinary identifiers.

Two first-order Markov models over :data:`ALPHABET` give every token a log-likelihood ratio.  They are trained from
labelled samples of the corpus itself: strings inside the fixed forms (and ``DIGESTS`` base64 texts of
digests, so that random strings are not only hexadecimal) are the random ones, words
that read as identifiers the ordinary ones, each distinct string once.  What
comes to the driver are the transition counts, at most 2 x 68 x 68 rows.

Everything runs as Spark expressions.  Defined results: a null or empty text has no
spans; without any sample of a class its model is uniform; an empty table gives an empty table;
repeated rows are scanned each by itself; other columns stay, and columns
named as an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import (
    Span,
    as_spans,
    clear_of,
    listed,
    matched,
    n_of_kind,
    packed,
    replaced,
    unpacked,
)

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: 32 or more, from the start of a run: a shorter run fails as a whole
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: fewer characters than the shortest assigned secret cannot be told from a word
LEAST_TOKEN = 8
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}+"

MATCHES = "array<struct<start:int,end:int,value:string>>"

BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))

#: random strings made besides those found in the corpus
DIGESTS = 2048
#: weight of a character's overall share in its share after another one
BACKOFF = 10.0

#: a token is taken as random at this mean log ratio per transition and this sum, in nats
MEAN_RATIO = 0.5
SUM_RATIO = 12.0
#: the same for letters in one or no change of case, which long or foreign words also are
WORD_MEAN_RATIO = 1.0
WORD_SUM_RATIO = 18.0

IDENTIFIER = r"^[A-Za-z]+(?:[_/-][A-Za-z]+)*[0-9]{0,4}$"


def base_spans(df: DataFrame) -> DataFrame:
    """Add ``_found_<kind>`` of the fixed forms for ``_text``, failing matches dropped."""
    text = F.col("_text")
    needs = {
        "assign": text.contains("=") | text.contains(":"),
        "access": text.contains("AKIA"),
    }
    df = matched(df, "_text", BASE, needs)
    return df.withColumns(
        {
            "_found_assign": F.filter(
                "_found_assign",
                lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8,
            ),
            "_found_access": F.filter("_found_access", lambda m: F.length(m["value"]) >= 16),
        }
    )


def samples(df: DataFrame) -> DataFrame:
    """Distinct labelled strings ``(random, value)`` out of rows with ``_text``."""
    found = base_spans(df.select("_text"))
    inside = F.concat(
        F.transform("_found_assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 2)),
        F.transform("_found_access", lambda m: m["value"]),
        F.transform("_found_hex", lambda m: m["value"]),
    )
    known = found.select(F.explode(inside).alias("value")).distinct()
    digests_ = df.sparkSession.range(DIGESTS).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    made = digests_.select(F.translate(F.base64(F.unhex("d")), "=", "").alias("value"))
    random = known.unionByName(made)
    words = df.select(F.explode(F.split("_text", " ", -1)).alias("value"))
    ordinary = words.filter(
        (F.length("value") >= 8) & F.col("value").rlike(IDENTIFIER)
    ).distinct()
    return random.withColumn("random", F.lit(True)).unionByName(
        ordinary.withColumn("random", F.lit(False))
    )


def train(df: DataFrame, text: str = "text") -> list[float]:
    """Log ratio of each transition, row by row of the alphabet (other characters: class 0)."""
    labelled = samples(packed(df, text))
    pairs = steps(F.col("value"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = (
        labelled.filter(F.length("value") >= 2)
        .select("random", F.explode(pairs).alias("s"))
        .groupBy("random", "s.a", "s.b")
        .count()
        .toArrow()  # at most 2 rows for each pair of characters
        .to_pylist()
    )
    size = len(ALPHABET) + 1
    tables = {kind: [[0.0] * size for _ in range(size)] for kind in (True, False)}
    for row in counts:
        tables[row["random"]][row["a"]][row["b"]] += row["count"]
    chances = {kind: chances_of(table) for kind, table in tables.items()}
    return [
        math.log(chances[True][a][b]) - math.log(chances[False][a][b])
        for a in range(size)
        for b in range(size)
    ]


def chances_of(table: list[list[float]]) -> list[list[float]]:
    """Chance of each character after each other, leaning on its overall chance where little is known."""
    size = len(table)
    overall = [sum(row[b] for row in table) + 0.5 for b in range(size)]
    whole = sum(overall)
    return [
        [(row[b] + BACKOFF * overall[b] / whole) / (sum(row) + BACKOFF) for b in range(size)]
        for row in table
    ]


def places(value: Column) -> Column:
    """Places of a string's characters in the alphabet, from 1; 0 for any other."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def steps(value: Column, make) -> Column:
    """``make`` of each character's place and the next one's."""
    own = places(value)
    n = F.greatest(F.length(value) - 1, F.lit(0))
    return F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, F.lit(2), n), make)


def ratio(value: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio of a string, summed over its transitions."""
    size = len(ALPHABET) + 1
    table = F.array(*[F.lit(w) for w in weights])
    each = steps(value, lambda a, b: F.get(table, a * size + b))
    return F.aggregate(each, F.lit(0.0), lambda total, w: total + w)


def scan(df: DataFrame, text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of start, ord, end, kind; code points, end exclusive).

    Without ``weights`` the models are trained on ``df`` first.
    """
    if weights is None:
        weights = train(df, text)
    found = base_spans(packed(df, text))
    base = F.array_sort(
        F.concat(*[as_spans(F.col(f"_found_{k}"), k, i) for i, (k, _) in enumerate(BASE)])
    )
    found = found.withColumn("_base", base).drop(*[f"_found_{k}" for k, _ in BASE])
    found = matched(found, "_text", (("markov", TOKEN),), {})
    # plain numbers are no random strings
    lettered = F.filter("_found_markov", lambda m: m["value"].rlike("[A-Za-z]"))
    free = clear_of(lettered, F.col("_base"), MATCHES)
    scored = F.filter(
        F.transform(
            free,
            lambda m: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                ratio(m["value"], weights).alias("ratio"),
                (~m["value"].rlike("[0-9]|[a-z][A-Z]")).alias("word"),
            ),
        ),
        lambda m: (m["ratio"] >= F.when(m["word"], WORD_SUM_RATIO).otherwise(SUM_RATIO))
        & (m["ratio"] >= F.when(m["word"], WORD_MEAN_RATIO).otherwise(MEAN_RATIO) * (m["end"] - m["start"] - 1)),
    )
    found = found.withColumn("_scored", scored).drop("_found_markov")
    added = as_spans(F.col("_scored"), "markov", len(BASE))
    found = found.withColumn("_all", F.array_sort(F.concat("_base", added)))
    return unpacked(
        found,
        df.columns,
        base_spans=F.col("_base").cast(Span),
        spans=F.col("_all").cast(Span),
    )


def redacted(df: DataFrame, text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``[secret]``."""
    found = scan(df, text, weights)
    kinds = [k for k, _ in BASE] + ["markov"]
    new = replaced(F.col(text), F.col("spans"), {k: "[secret]" for k in kinds})
    return found.withColumn(text, F.when(F.col(text).isNotNull(), new)).select(*df.columns)


def digests(found: DataFrame) -> dict[str, Column]:
    """The digest columns of a scan: counts by kind, hash of base spans, list of all spans."""
    counts = {
        f"n_{k}": n_of_kind(F.col("base_spans"), k)
        for k, _ in BASE
    }
    return counts | {
        "base_sha256": F.sha2(listed(F.col("base_spans")), 256),
        "spans": listed(F.col("spans")),
    }
