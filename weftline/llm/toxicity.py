"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters and digits inside words back to plain ones, everything
that is no letter to a blank.  One Aho-Corasick automaton finds all lexicon entries (whole words and
word stems) in one pass.  Entries that stand in an exception phrase do not count.  The summed weight, and the same normalised by
length, go through a logistic curve to a score between 0 and 1.

Entries, weights, exception phrases and the curve are learned from labelled rows: at most
``TRAIN_ROWS`` of them, those with the smallest hash of their id.  Only
texts and labels go in.  Every word, stem and phrase that meets the thresholds is kept, of any length; that the rows
are bounded bounds the model.

Defined results: a null text scores as an empty one; without labels of both
classes every score is 0; an empty table gives an empty table; repeated rows score alike; other
columns stay, and columns named as an added one are replaced.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.session import stored

#: labelled rows the model is fitted on, at most
TRAIN_ROWS = 20_000
STEMS = range(4, 11)
MIN_TEXTS = 6
MIN_WEIGHT = 1.5
MIN_Z = 5.0
#: features counted in a task before they are handed on
FLUSH = 100_000
THRESHOLD = 0.3

#: Letters that look alike, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l",
}
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
}


class Folding(dict):
    """Character table of the folding, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char).lower()
        if unicodedata.category(char) in ("Mn", "Cf"):
            plain = "" if unicodedata.category(char) == "Cf" else char
        elif not plain.isalpha():
            plain = SUBSTITUTES.get(char, " ")
        else:
            plain = HOMOGLYPHS.get(plain, plain)
        self[code] = plain
        return plain


_FOLDING = Folding()


def fold(text: str) -> str:
    """Folded text with a blank at each end; words are what stands between blanks.

    A substitute only counts inside or before a word: "!" at the end of a word is no letter.
    """
    text = unicodedata.normalize("NFC", text)
    if "!" in text:
        text = text.replace("! ", "  ").replace("!\n", "  ").replace("!!", "  ").rstrip("!")
    return f" {text.translate(_FOLDING)} "


@dataclass
class Model:
    """A fitted lexicon: folded entries (" word " or " stem"), phrases that cancel, and the curve."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-math.inf, 0.0, 0.0)

    def automaton(self):
        """The automaton over entries and exceptions; None for an empty lexicon."""
        import ahocorasick

        if not self.entries:
            return None
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def covered(hit: tuple, starts: list[int], reach: list[int]) -> bool:
    """Whether one of the phrases holds the whole hit."""
    before = bisect_right(starts, hit[0])
    return before > 0 and hit[1] <= reach[before - 1]


def weigh(automaton, text: str) -> tuple[float, int]:
    """Summed weight of the entries outside exception phrases, and the number of words."""
    folded = fold(text)
    if automaton is None:
        return 0.0, folded.count(" ")
    hits, exempt = [], []
    for end, (length, weight) in automaton.iter(folded):
        if weight is None:
            exempt.append((end - length + 1, end))
        else:
            hits.append((end - length + 1, end, weight))
    if exempt:
        # the furthest end of all phrases that begin at or before a place
        exempt.sort()
        starts = [a for a, _ in exempt]
        reach = list(accumulate((b for _, b in exempt), max))
        hits = [h for h in hits if not covered(h, starts, reach)]
    # a word counts once, by its heaviest entry
    best: dict[int, float] = {}
    for start, _, weight in hits:
        best[start] = max(weight, best.get(start, 0.0))
    return sum(best.values()), folded.count(" ")


def measures(weights: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of the curve: one, log of the weight, log of the weight for 100 words."""
    return np.column_stack(
        [np.ones(len(weights)), np.log1p(weights), np.log1p(100 * weights / (words + 20))]
    )


def features(text: str) -> set[str]:
    """Words and stems of a text, in their folded forms."""
    found = set()
    for word in set(fold(text).split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEMS if n <= len(word))
    return found


def counted(batches: Iterable[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
    """Texts with each feature by label, summed inside the task as far as memory allows."""

    def out(label: int, counts: Counter) -> pd.DataFrame:
        own = np.fromiter(counts.values(), np.int64, len(counts))
        none = np.zeros(len(counts), np.int64)
        pos, neg = (own, none) if label else (none, own)
        return pd.DataFrame({"feature": pd.Series(list(counts), dtype=object), "pos": pos, "neg": neg})

    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            own = counts[int(toxic == 1)]
            own.update(of(text))
            if len(own) > FLUSH:
                yield out(int(toxic == 1), own)
                own.clear()
    for label, own in counts.items():
        yield out(label, own)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """Labelled texts that may be learned from, one of each id: never those whose crc32(doc_id) mod 4 is 2."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(
        F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    )
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(limit)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most ``limit`` ids and labels, so their size is bounded; so are the rows, as an id that many rows carry gives one text
    held = texts.join(F.broadcast(chosen), "doc_id")
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return held.groupBy("doc_id", "toxic").agg(least).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Learn lexicon, exceptions and curve from labelled rows."""
    rows = stored(training_rows(docs, labels, limit), "training-texts")
    schema = "feature string, pos long, neg long"
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model()

    def summed(of) -> DataFrame:
        parts = rows.mapInPandas(lambda batches: counted(batches, of), schema)
        return parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    share = n_pos / (n_pos + n_neg)
    seen = F.col("pos") + F.col("neg")
    z = (F.col("pos") - seen * share) / F.sqrt(seen * share * (1 - share))
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    strong = (
        summed(features)
        .withColumns({"z": z, "weight": weight})
        .filter(
            (F.col("pos") >= MIN_TEXTS) & (F.col("weight") >= MIN_WEIGHT) & (F.col("z") >= MIN_Z)
        )
        # the strongest; among equals whole words and longer stems
        .orderBy(F.desc("z"), F.desc(F.length("feature")), "feature")
        .select("feature", "weight")
        .collect()
    )
    model = Model(without_kin((row["feature"], float(row["weight"])) for row in strong))
    model.exceptions = learned_exceptions(summed, model, share)
    model.curve = fitted_curve(rows, model)
    return model


def without_kin(strong: Iterable[tuple[str, float]]) -> dict[str, float]:
    """Entries in the given order, without those that begin, or begin with, an earlier one.

    What is kept is sorted and free of prefixes, so a prefix of a word can only stand right before it.
    """
    entries: dict[str, float] = {}
    kept: list[str] = []
    for feature, weight in strong:
        bare = feature.strip()
        at = bisect_left(kept, bare)
        kin = at < len(kept) and kept[at].startswith(bare) or at > 0 and bare.startswith(kept[at - 1])
        if not kin:
            kept.insert(at, bare)
            entries[feature] = weight
    return entries


def learned_exceptions(summed, model: Model, share: float) -> list[str]:
    """Two-word phrases with an entry in them that stand in harmless texts."""
    automaton = model.automaton()
    if automaton is None:
        return []
    entries = set(model.entries)

    def phrases(text: str) -> set[str]:
        folded, found = fold(text), set()
        own = Model({e: 1.0 for e in entries}).automaton() if phrases.own is None else phrases.own
        phrases.own = own
        for end, (length, _) in own.iter(folded):
            start = end - length + 1
            stop = folded.find(" ", start + 1)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", stop + 1)
            if before >= 0 and start - before > 1:
                found.add(folded[before : stop + 1])
            if after > stop + 1:
                found.add(folded[start : after + 1])
        return found

    phrases.own = None
    harmless = (
        summed(phrases)
        .filter((F.col("neg") >= 4) & (F.col("pos") <= share * F.col("neg") * 0.5))
        .orderBy("feature")
        .select("feature")
        .collect()
    )
    return [r["feature"] for r in harmless]


def fitted_curve(rows: DataFrame, model: Model) -> tuple[float, float, float]:
    """Logistic regression of the label on the two measures, by Newton steps; a row per training text."""

    def weighed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            pairs = [weigh(automaton, t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "weight": [p[0] for p in pairs],
                    "words": [p[1] for p in pairs],
                    "toxic": batch["toxic"].astype("int64"),
                }
            )

    data = rows.mapInPandas(weighed, "weight double, words long, toxic long").toPandas()
    x = measures(data["weight"].to_numpy(), data["words"].to_numpy(dtype=float))
    y = data["toxic"].to_numpy(dtype=float)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * beta
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(curvature, slope)
        beta += np.clip(step, -2, 2)
    return tuple(float(b) for b in beta)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from :data:`THRESHOLD` on)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        beta = np.array(model.curve)
        for batch in batches:
            pairs = [weigh(automaton, t or "") for t in batch]
            if not pairs or not np.isfinite(beta).all():
                yield pd.Series(np.zeros(len(pairs)))
                continue
            w = np.array(pairs, dtype=float)
            z = np.clip(measures(w[:, 0], w[:, 1]) @ beta, -30, 30)
            yield pd.Series(1 / (1 + np.exp(-z)))

    scores = df.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))
    return scores.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
