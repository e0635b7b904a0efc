"""Quality rules: a table of thresholds compiled into one Spark projection.

Every rule is a row ``(name, measure, lowest, highest)``; :func:`verdict` turns the table
into one boolean column.  The measures are Spark expressions, no user function runs.

Defined results: a null text has no words and fails ``n_words``; an empty table gives an empty
table; repeated rows are each judged by themselves; columns of the input with the
names of a measure are kept under their own name only where :func:`judge` is told another prefix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import WORD, text_or_empty

SYMBOLS = r"[#*$%&|<>]"

#: frequent function words of the languages the rules are meant for
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are as with he be by at this from or",
    "de": "und der die das in zu den mit von ist ein eine sich auf für im dem des",
    "fr": "les le la de et un une des en du que qui dans par pour est au avec sur pas",
    "es": "el los las y un una que se con por para al es del no su lo como",
}


@dataclass(frozen=True)
class Rule:
    """A measure has to lie between two bounds, both allowed; None leaves a side open."""

    name: str
    measure: str
    lowest: float | None = None
    highest: float | None = None

    def passes(self) -> Column:
        value = F.col(self.measure)
        low = F.lit(True) if self.lowest is None else value >= F.lit(self.lowest)
        high = F.lit(True) if self.highest is None else value <= F.lit(self.highest)
        return F.coalesce(low & high, F.lit(False))


#: what :func:`judge` applies by default
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("repeated_windows", "repeat_ratio", None, 0.5),
    Rule("word_length", "mean_word_chars", 3.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamations", "exclamation_ratio", None, 0.2),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
)

#: the two that the base verdict asks for
BASE = RULES[:2]


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that rules refer to; ``text`` may be null."""
    whole = text_or_empty(text)
    spaced = whole
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    small = {w for ws in STOP_WORDS.values() for w in ws.split()}
    stops = sorted(small | {w.capitalize() for w in small})
    df = df.withColumns(
        {
            "_words": F.array_remove(F.split(spaced, " ", -1), ""),
            "_lines": lines,
            "n_symbols": F.regexp_count(whole, F.lit(f"({SYMBOLS})")).cast("long"),
            "_exclamations": F.octet_length(whole)
            - F.octet_length(F.replace(whole, F.lit("!"), F.lit(""))),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_stops": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    df = with_repeats(df)
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / per_word,
            "symbol_ratio": F.col("n_symbols") / per_word,
            "exclamation_ratio": F.col("_exclamations") / per_word,
            "stop_ratio": F.col("_stops") / per_word,
            "repeat_ratio": F.col("n_repeat_words") / per_word,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    ).drop("_words", "_lines", "_exclamations", "_stops")


#: up to so many repeated windows are looked up one by one; with more, places are sorted
FEW = 16


def with_repeats(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``_words``: words in windows of three found at least twice.

    Only a text with two equal windows goes beyond hashing them.  Its hashes are sorted,
    so equal ones are neighbours, which gives the repeated ones; their places, in order, each add
    the words that the place before has not covered.  Where many windows repeat, windows are
    sorted with their places instead of looked up.  Both give the same; work is n log n.
    """
    words, n = F.col("_words"), F.size("_words")
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn(
        "_windows",
        F.when(n >= 3, F.slice(hashes, F.lit(1), n - 2)).otherwise(F.array().cast("array<bigint>")),
    )
    h = F.col("_windows")
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col("_sorted")
    df = df.withColumn(
        "_twice", F.array_distinct(F.filter(s, lambda w, k: F.when(k > 0, F.get(s, k - 1) == w)))
    )
    twice = F.col("_twice")
    looked_up = F.filter(
        F.transform(h, lambda w, i: F.when(F.array_contains(twice, w), i)), lambda i: i.isNotNull()
    )
    placed = F.sort_array(F.transform(h, lambda w, i: F.struct(w.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.size(twice) > FEW, placed))
    p = F.col("_placed")
    again = F.filter(
        p,
        lambda w, k: F.coalesce(F.when(k > 0, F.get(p, k - 1)["h"] == w["h"]), F.lit(False))
        | F.coalesce(F.get(p, k + 1)["h"] == w["h"], F.lit(False)),
    )
    df = df.withColumn(
        "_places",
        F.when(F.size(twice) > FEW, F.sort_array(F.transform(again, lambda w: w["i"]))).when(
            F.size(twice) > 0, looked_up
        ),
    )
    q = F.col("_places")
    new = F.transform(
        q, lambda i, k: F.when(k > 0, F.least(F.lit(3), i - F.get(q, k - 1))).otherwise(F.lit(3))
    )
    total = F.aggregate(new, F.lit(0), lambda a, v: a + v)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(
        "_windows", "_sorted", "_twice", "_placed", "_places"
    )


def verdict(rules: Sequence[Rule]) -> Column:
    """The table as one boolean: true if every rule passes."""
    passed = F.lit(True)
    for rule in rules:
        passed = passed & rule.passes()
    return passed


def failed_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules a row fails, in table order."""
    return F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with a struct ``quality`` of all measures, failed rules and the verdict ``kept``.

    All columns stay as they were; a column named ``quality`` is replaced.
    """
    rest = F.struct(*[F.col(c) for c in df.columns]) if df.columns else F.struct(F.lit(0))
    inner = df.select(rest.alias("_row"), F.col(text).alias("_text"))
    scored = measured(inner, "_text")
    measures = [c for c in scored.columns if c not in ("_row", "_text")]
    quality = F.struct(
        *measures, failed_rules(rules).alias("failed"), verdict(rules).alias("kept")
    )
    return scored.select("_row", quality.alias("quality")).select(
        *[F.col("_row")[c].alias(c) for c in df.columns if c.lower() != "quality"], "quality"
    )
