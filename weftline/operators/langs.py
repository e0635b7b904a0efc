"""Language codes: dimensions, look-ups by name, the code a corpus offers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline import fixed_values as fixed
from weftline.schemas import CODES
from weftline.session import stored


def _listed(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    columns = {
        "ord": pa.array(range(len(entries)), pa.int32()),
        "code": [code for code, _ in entries],
        "name": [name for _, name in entries],
    }
    # from Arrow, so that the planner knows the size and broadcasts by itself
    return spark.createDataFrame(pa.table(columns))


def two_letter_codes(spark: SparkSession) -> DataFrame:
    return _listed(spark, fixed.TWO_LETTER_CODES)


def three_letter_codes(spark: SparkSession) -> DataFrame:
    return _listed(spark, fixed.THREE_LETTER_CODES)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A code table kept as CSV with header ``ord,code,name`` (the script codes, say)."""
    return spark.read.schema(CODES).option("header", True).csv(path)


def codes_by_name(codes: DataFrame) -> DataFrame:
    """Per name the array of its codes in table order; ``codes`` lists each code once."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "code")))
    return codes.groupBy("name").agg(F.transform(ordered, lambda e: e["code"]).alias("codes"))


def _last_code(codes: DataFrame, name: str) -> DataFrame:
    return codes.groupBy("name").agg(F.max_by("code", "ord").alias(name))


def shortest_code(
    df: DataFrame, name_col: str, two_letter: DataFrame, three_letter: DataFrame
) -> DataFrame:
    """Add ``three_letter_code`` and ``short_code``; both null for an unsupported name.

    The short code is the two-letter one where there is one.  Of repeated
    names the last entry counts.
    """
    two = _last_code(two_letter, "_two").withColumnRenamed("name", name_col)
    three = _last_code(three_letter, "three_letter_code").withColumnRenamed("name", name_col)
    joined = df.join(three, name_col, "left").join(two, name_col, "left")
    short = F.when(
        F.col("three_letter_code").isNotNull(), F.coalesce("_two", "three_letter_code")
    )
    return joined.withColumn("short_code", short).drop("_two")


def unknown_names(df: DataFrame, name_col: str, codes: DataFrame) -> DataFrame:
    """Names without an entry in a code table."""
    known = codes.select(F.col("name").alias(name_col)).distinct()
    return df.select(name_col).distinct().join(known, name_col, "left_anti")


def first_corpus_code(corpus: DataFrame, code_col: str, codes: DataFrame) -> DataFrame:
    """Per language name the first of its codes, in table order, that the corpus has."""
    present = corpus.select(F.col(code_col).alias("code")).distinct()
    offered = codes.join(present, "code", "left_semi")
    return offered.groupBy("name").agg(F.min_by("code", "ord").alias("code"))


def corpus_of_languages(
    corpus: DataFrame, code_col: str, codes: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Corpus rows of the chosen code of each language, with ``lang_name``.

    The choice (a row per language) is stored first, so that its size is known and the
    texts are joined where they are.
    """
    chosen = first_corpus_code(corpus, code_col, codes)
    if names is not None:
        chosen = chosen.join(names.select(F.col("lang_name").alias("name")).distinct(), "name", "left_semi")
    chosen = chosen.select(F.col("code").alias(code_col), F.col("name").alias("lang_name"))
    return corpus.join(stored(chosen, "chosen-codes"), code_col)
