"""A training corpus from ``documents``: five stages, each one operator on all that the one before has kept.

Toxic documents go; one document of each group of near duplicates stays; personal data is replaced; sources are mixed to
target weights (a document may then occur several times, or not at all); what is left is packed into sequences.
Between stages everything is a table, so a lost executor repeats one stage at most.  What a stage wrote for itself is
deleted once its result is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import mixing, ngram_join, packing, pii, toxicity
from weftline.llm.common import free_name, n_words, own_shared_dir, small_batches
from weftline.session import remove_stages, stage_tables, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, fitted on the labelled ones among them, does not reject."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return toxicity.scored(keyed, model).filter(F.col("predicted") == 0).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates."""
    small_batches(spark)
    taken = [c for c in docs.columns if c.lower() in ("class_id", "n_links", "first")]
    own = {c: free_name(docs, f"_{c}") for c in taken}
    kept = ngram_join.joined(docs.withColumnsRenamed(own)).filter("first")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values and disclosing terms replaced."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    clean = pii.sanitised(keyed)
    columns = [
        F.col("text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns
    ]
    return clean.select(*columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, n_words("text"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    small_batches(spark)
    return packing.packed(docs).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: no SQL: a lexicon, a forest and a local search; tests compare with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    own_shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with stage_tables() as made:
            result = stage(spark, docs, sf_dir)
        docs = stored(result, name)
        remove_stages(spark, made)
    return STAGES[-1][1](spark, docs, sf_dir)
