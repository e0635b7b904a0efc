"""The registered queries of the package: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import (
    block_knn,
    conversation_trie,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    resampling,
    secrets,
    sentence_spans,
    simhash,
    suffix_dedup,
    toxicity,
)
from weftline.llm.common import n_words, table
from weftline.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of its result where there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# --- 6: quality rules ------------------------------------------------------------------

STOPS_SQL = ", ".join(
    f"'{form}'"
    for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()})
    for form in (w, w.capitalize())
)

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, ws[i:i+2] AS g FROM d, unnest(range(1, len(ws) - 1)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
         len(list_filter(ws, lambda w: w IN ({STOPS_SQL}))) AS n_stops
  FROM d LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND n_repeat_words / n_words <= 0.5
       AND word_chars / n_words BETWEEN 3.0 AND 12.0 AND n_symbols / n_words <= 0.1
       AND n_exclamations / n_words <= 0.2 AND n_stops / n_words >= 0.06
       AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AS kept
FROM m
"""


@query(OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    scored = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return scored.select(
        "doc_id",
        *[q[c].alias(c) for c in counts],
        failed.alias("base_failed"),
        (q["kept"] & ~failed).alias("kept"),
    )


# --- 3: personal data ------------------------------------------------------------------


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal values and disclosing terms of all documents."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = pii.digests(found)
    return found.select("doc_id", *[c.alias(n) for n, c in columns.items()])


# --- 5: secrets ------------------------------------------------------------------------


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by fixed forms and the Markov models."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = secrets.digests(found)
    return found.select("doc_id", *[c.alias(n) for n, c in columns.items()])


# --- 1: mixing -------------------------------------------------------------------------

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), p AS (
  SELECT *, sum(total) OVER () AS all_sizes, sum(w) OVER () AS all_w,
         coalesce(sum(3 * total) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS cap_w
  FROM s WINDOW o AS (ORDER BY total / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 3 * total < w::DOUBLE * (all_sizes - caps)::DOUBLE / (all_w - cap_w)::DOUBLE AS capped FROM p
), r AS (
  SELECT all_sizes - coalesce(sum(3 * total) FILTER (capped) OVER (), 0) AS rest,
         all_w - coalesce(sum(w) FILTER (capped) OVER (), 0) AS free, *
  FROM c
), t AS (
  SELECT source, total AS source_size,
         CASE WHEN capped THEN (3 * total)::DOUBLE
              ELSE w::DOUBLE * rest::DOUBLE / free::DOUBLE END AS target,
         ('0x' || substr(md5('{mixing.SEED}|' || coalesce(source, '')), 1, 5))::BIGINT::DOUBLE / 1048576::DOUBLE AS u
  FROM r
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, k) - 1 AS i FROM d
), e AS (
  SELECT n.doc_id, n.size, t.source_size, t.target, n.i, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0::DOUBLE END AS x
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (floor((i + 1) * x + u) - floor(i * x + u))::BIGINT AS taken
FROM e
"""


@query(OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    narrow = stored(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    taken = mixing.with_copies(narrow, F.col("size"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


# --- 2: toxicity -----------------------------------------------------------------------


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


# --- 9: nearest neighbours -------------------------------------------------------------


@query()
def op9_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    return block_knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# --- 10: packing -----------------------------------------------------------------------


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents")).drop("ids")


# --- 7: sentence spans -----------------------------------------------------------------


@query()
def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences that stand in an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.deduplicated(docs)


# --- 4: n-gram join --------------------------------------------------------------------


@query()
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; copies of one text share their links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.joined(docs).select("doc_id", "class_id", "n_links", "first")


# --- 8: repeated byte strings ----------------------------------------------------------


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicated(docs, with_kept=False).drop("text")


# --- 11: importance resampling ---------------------------------------------------------

#: CRC-32 by a table of 256 steps, from the reversed polynomial
CRC_SQL = r"""
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS steps
)
"""


def crc_sql(numbers: str) -> str:
    """SQL of the CRC-32 of a list of bytes."""
    step = "xor(a >> 8, crc.steps[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce({numbers}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"


FEATURES_SQL = r"""
  SELECT {key} AS id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]))) AS f
  FROM (
    SELECT {key}, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM {table}
  )
"""

OP11_SQL = rf"""
WITH {CRC_SQL}, d AS ({FEATURES_SQL.format(key="doc_id", table="documents")}
), b AS ({FEATURES_SQL.format(key="item_id", table="benchmark")}
), names AS (
  SELECT f, {crc_sql("list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)")} % {resampling.BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM b)), crc
), s AS (
  SELECT bucket, count(*) AS s FROM d JOIN names USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN names USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {resampling.BUCKETS})::DOUBLE
           / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (
  SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM d JOIN names USING (f) JOIN gains USING (bucket) GROUP BY id
), a AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
         coalesce(n_features, 0) + 1 >= 2 * {resampling.MIN_WORDS} AS able
  FROM documents LEFT JOIN w ON documents.doc_id = w.id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place,
         {resampling.PERCENT} * count(*) OVER (PARTITION BY able) // 100 AS k
  FROM a
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND place <= k THEN place END AS rank FROM r
"""


@query(OP11_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn towards the words of ``benchmark``, among all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.drawn(docs, table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# --- 12: conversation trie -------------------------------------------------------------

OP12_SQL = rf"""
WITH {CRC_SQL}, t AS (
  SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS n
  FROM (
    SELECT conv_id, turn, length(coalesce(text, '')) AS size,
           substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id
    FROM conversations WHERE conv_id IS NOT NULL
  )
), c AS (
  SELECT conv_id, {crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), turns AS (
  SELECT c.conv_id, 0 AS part, t.n, id, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.n <= c.h
  UNION ALL SELECT c.conv_id, 1, t.n, id, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h
), placed AS (
  SELECT conv_id, size, row_number() OVER o AS d, string_agg(id, '') OVER o AS path
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY part, n)
), steps AS (
  SELECT conv_id, size, d, path FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM c
), whole AS (
  SELECT conv_id, max(d) AS last FROM steps GROUP BY conv_id
), nodes AS (
  SELECT path, d, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last) AS ends
  FROM steps JOIN whole USING (conv_id) GROUP BY path, d
), up AS (
  SELECT n.*, p.path AS parent, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.path = left(n.path, 32 * (n.d - 1)::BIGINT) AND p.d = n.d - 1
), kids AS (
  SELECT parent AS path, count(*) AS n_children FROM up WHERE d > 0 GROUP BY parent
), below AS (
  SELECT DISTINCT a.path AS path, b.path AS own FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT below.path, sum((n.n_convs - 1) * n.size)::BIGINT AS saved, count(*) FILTER (k.path IS NULL) AS n_leaves
  FROM below JOIN nodes n ON n.path = below.own LEFT JOIN kids k ON k.path = below.own GROUP BY below.path
)
SELECT up.conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM up JOIN sums USING (path) LEFT JOIN kids USING (path)
"""


@query(OP12_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie over all conversations, rebuilt with shared openings."""
    lists = conversation_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return conversation_trie.nodes(conversation_trie.with_openings(lists))


# --- 13: SimHash -----------------------------------------------------------------------


@query()
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.linked(table(spark, sf_dir, "documents"))
