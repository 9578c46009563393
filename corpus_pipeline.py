"""A training-data pipeline over `documents`: language, near duplicates, benchmark passages, secrets, packing.

Each stage works on all rows that the one before kept, and is written as Parquet and
read again before the next.  Rows go if their language is unknown or unsure, if an earlier document is a near duplicate, or if
they hold a benchmark item; secrets are masked in the texts; what is left is packed.

Defined results: null or empty texts go at the first stage (they have no language); rows
are judged by their texts, so rows with one doc_id or with none are kept or dropped
each for itself; of repeated rows one stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanna.llm.common import forget, shared_dir, table, written
from lanna.llm.decontamination import clean
from lanna.llm.language import accepted, fit
from lanna.llm.minhash import near_duplicates
from lanna.llm.packing import pieces_digest
from lanna.llm.secrets import redacted

#: A text is rejected if its language is less likely than this.
LEAST_SCORE = 0.5
#: Texts are near duplicates if they share so many percent of their shingles.
NEAR_PERCENT = 80
#: The column of row numbers; no column of the documents has this name.
NUMBER = "_row_number_of_the_pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text has a language that is likely enough; null texts and texts without letters go, null doc_ids stay."""
    return accepted(docs, fit(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the smallest doc_id.

    If doc_ids repeat or are null, rows are told apart by numbers of their own, so one row of each group stays whatever its doc_id.
    """
    own = F.col("doc_id").cast("long")
    if docs.groupBy(own.alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        numbered = written(docs.withColumn(NUMBER, F.monotonically_increasing_id()))
        gone = near_duplicates(numbered.select(F.col(NUMBER).alias("doc_id"), "text"), NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias(NUMBER))
        return numbered.join(gone, NUMBER, "left_anti").select(*[numbered[x] for x in docs.columns])
    gone = near_duplicates(docs, NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias(NUMBER))
    return docs.join(gone, own == gone[NUMBER], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, and n_chars follows the text; all rows stay, null and empty texts as they are."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; null or empty texts are documents of the end id alone, repeated rows are packed each."""
    return pieces_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Language models, signatures and tokenizers can't be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        forget(spark, path)
        docs = spark.read.parquet(path)
    return docs
