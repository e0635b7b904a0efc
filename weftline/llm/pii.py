"""Personal data: fixed forms, and terms that give protected entities away.

Information-theoretic sanitisation: an entity is a personal value (an address, a number) found by the fixed forms.  Corpus co-occurrence
tells how much a term reveals of it: with p(e|t), the share of texts with term t in which
entity e stands close by, what stays uncertain about the entity is -log2 p(e|t) bits, the
information content of e less its pointwise mutual information with t.  A term that leaves at
most ``GENERALISED_BITS`` is generalised, one that leaves at most ``REMOVED_BITS`` is removed, wherever it occurs.
Evidence is counted in distinct texts on both sides of the share, so copies prove nothing, and less than ``SUPPORT`` texts prove nothing.

Everything runs as Spark expressions and joins.  Defined results: a null or empty text has
no spans and stays as it is; an empty table gives an empty table; repeated rows are treated
alike; other columns stay, and columns named as an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import (
    Span,
    as_spans,
    clear_of,
    key_filter,
    listed,
    matched,
    may_match,
    n_of_kind,
    packed,
    replaced,
    unpacked,
)
from weftline.session import stored

#: Each pattern starts where a run starts and keeps what it has taken, so that none goes over a
#: long run twice; the matches are those of the plain forms.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){11,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_])"
AT_MOST_255 = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

#: code points on each side of an entity that count as its context
CONTEXT = 80
#: distinct texts an entity, and an entity with a term, need
SUPPORT = 3
GENERALISED_BITS = 1.0
REMOVED_BITS = 0.2

PUT = {k: f"[{k}]" for k, _ in BASE} | {"term": "[term]", "removed": ""}


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    backwards = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(backwards, lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, v: a + v,
    )
    return total % 10 == 0


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a form is a value of its kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(AT_MOST_255))
    if kind == "card":
        digits = only_digits(value)
        return (F.length(digits) <= 19) & luhn(digits)
    if kind == "phone":
        return F.length(only_digits(value)).between(9, 15)
    return F.lit(True)


def can_hold(text: Column) -> dict[str, Column]:
    """Cheap conditions without which a text has no match of a kind."""
    return {"email": text.contains("@"), "phone": text.contains("+")}


def kept_matches(kind: str) -> Column:
    return F.filter(f"_found_{kind}", lambda m: holds(kind, m["value"]))


def base_found(df: DataFrame) -> DataFrame:
    """Add ``_found_<kind>`` of the fixed forms for ``_text``, failing matches dropped."""
    df = matched(df, "_text", BASE, can_hold(F.col("_text")))
    return df.withColumns({f"_found_{kind}": kept_matches(kind) for kind, _ in BASE[1:]})


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(0)), F.lower)
    )


def entity_contexts(df: DataFrame) -> DataFrame:
    """``(entity, terms, text_hash)``: what stands around each occurrence of a personal value, and in which text.

    A text is cut at the matches of a form; the pieces before and behind a match give its context, so no text is
    gone through once for each match.
    """
    found = df.select("_text")
    needs = can_hold(F.col("_text"))
    none = F.array().cast("array<string>")
    for kind, pattern in BASE:
        values = F.regexp_extract_all(F.col("_text"), F.lit(f"({pattern})"), F.lit(0))
        values = F.when(needs.get(kind, F.lit(True)), values)
        found = found.withColumn(f"_v_{kind}", F.coalesce(values, none))
    for kind, pattern in BASE:
        cut = F.when(F.size(f"_v_{kind}") > 0, F.split(F.col("_text"), pattern, -1)).otherwise(none)
        found = found.withColumn(f"_p_{kind}", cut)

    def entities(kind: str) -> Column:
        same = F.lower if kind in ("email", "ip") else only_digits
        values, pieces = F.col(f"_v_{kind}"), F.col(f"_p_{kind}")

        def one(value: Column, i: Column) -> Column:
            # words that the window cuts in two are left out
            before, behind = F.get(pieces, i), F.get(pieces, i + 1)
            left = F.when(
                F.length(before) > CONTEXT,
                F.regexp_replace(F.substring(before, -CONTEXT, CONTEXT), r"^\S*+", ""),
            ).otherwise(before)
            right = F.when(
                F.length(behind) > CONTEXT,
                F.regexp_replace(F.substring(behind, 1, CONTEXT), r"\S*+$", ""),
            ).otherwise(behind)
            return F.when(
                holds(kind, value),
                F.struct(
                    F.concat(F.lit(f"{kind}:"), same(value)).alias("entity"),
                    F.concat(left, F.lit(" "), right).alias("context"),
                ),
            )

        return F.array_compact(F.transform(values, one))

    every = F.concat(*[entities(kind) for kind, _ in BASE])
    near = found.select(F.xxhash64("_text").alias("text_hash"), F.explode(every).alias("e"))
    terms = F.array_sort(terms_of(F.col("e.context"))).alias("terms")
    return near.select(F.col("e.entity").alias("entity"), terms, "text_hash")


def disclosing_terms(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Terms over the thresholds, and the texts that hold them.

    Returns ``(term, entity, bits, action)``, one row for each term by the entity it gives away most,
    and ``(text_hash, term)``.  Both start from stored tables.
    """
    rows = packed(df, text)
    contexts = stored(entity_contexts(rows), "entity-contexts")
    enough = contexts.groupBy("entity").agg(F.count_distinct("text_hash").alias("n_entity"))
    enough = enough.filter(F.col("n_entity") >= SUPPORT)
    pairs = (
        contexts.join(enough, "entity", "left_semi")
        .select("entity", "text_hash", F.explode("terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count_distinct("text_hash").alias("n_both"))
        .filter(F.col("n_both") >= SUPPORT)
    )
    # texts with the term near some entity are part of all texts with it: what already fails
    # against their number cannot pass against all
    near = (
        contexts.select("text_hash", F.explode("terms").alias("term"))
        .distinct()
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_near"))
    )
    can_pass = F.col("n_both") >= F.col("n_near") * F.lit(2.0**-GENERALISED_BITS)
    pairs = stored(pairs.join(near, "term").filter(can_pass).drop("n_near"), "entity-terms")
    candidates = pairs.select("term").distinct()
    held = (
        rows.select(F.xxhash64("_text").alias("text_hash"), F.explode(terms_of(F.col("_text"))).alias("term"))
        .join(candidates, "term")
        .distinct()
    )
    held = stored(held, "term-texts")
    texts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    share = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    best = (
        pairs.join(texts, "term")
        .withColumn("bits", -F.log2(share))
        .filter(F.col("bits") <= GENERALISED_BITS)
        .groupBy("term")
        .agg(F.min(F.struct("bits", "entity")).alias("best"))
        .select(
            "term",
            "best.entity",
            "best.bits",
            F.when(F.col("best.bits") <= REMOVED_BITS, "removed").otherwise("term").alias("action"),
        )
    )
    best = stored(best, "disclosing-terms")
    return best, held


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of start, ord, end, kind; code points, end exclusive).

    Kinds of the method's own spans: ``term`` (to generalise) and ``removed``.
    """
    terms, held = disclosing_terms(df, text)
    by_text = (
        held.join(terms.select("term", "action"), "term")
        .groupBy("text_hash")
        .agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("_terms"))
    )
    # texts without such a term are not moved; the filter lets some of them through
    by_text = stored(by_text, "marked-texts")
    rows = packed(df, text).withColumn("text_hash", F.xxhash64("_text"))
    rows = may_match(rows, "text_hash", key_filter(by_text, "text_hash"))
    marked = rows.filter("_may").join(by_text, "text_hash", "left")
    clear = rows.filter("NOT _may").withColumn("_terms", F.lit(None).cast("map<string,string>"))
    joined = marked.unionByName(clear).drop("text_hash", "_may")
    found = base_found(joined)
    base = F.array_sort(
        F.concat(*[as_spans(F.col(f"_found_{k}"), k, i) for i, (k, _) in enumerate(BASE)])
    )
    found = found.withColumn("_base", base).drop(*[f"_found_{k}" for k, _ in BASE])
    found = matched(found, "_text", (("term", TERM),), {"term": F.col("_terms").isNotNull()})
    marked = F.filter(
        F.transform(
            "_found_term",
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(len(BASE)).alias("ord"),
                m["end"].alias("end"),
                F.col("_terms")[F.lower(m["value"])].alias("kind"),
            ),
        ),
        lambda s: s["kind"].isNotNull(),
    )
    found = found.withColumn("_marked", F.coalesce(marked, F.array().cast(Span)))
    added = clear_of(F.col("_marked"), F.col("_base"))
    found = found.withColumn("_all", F.array_sort(F.concat("_base", added)))
    return unpacked(
        found, df.columns, base_spans=F.col("_base").cast(Span), spans=F.col("_all").cast(Span)
    )


def sanitised(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal values replaced by their kind, disclosing terms generalised or removed."""
    found = find(df, text)
    new = replaced(F.col(text), F.col("spans"), PUT)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), new)).select(*df.columns)


def digests(found: DataFrame) -> dict[str, Column]:
    """The digest columns: counts by kind, hash of base spans, list of all spans."""
    counts = {
        f"n_{k}": n_of_kind(F.col("base_spans"), k)
        for k, _ in BASE
    }
    return counts | {
        "base_sha256": F.sha2(listed(F.col("base_spans")), 256),
        "spans": listed(F.col("spans")),
    }
