"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its
result is written as Parquet and read again. All stages but the last return the columns of
documents, whichever they are (doc_id, text and source are needed). Null texts have no
language and go in the first stage; documents without doc_id pass the second, which cannot
tell them apart, and count as documents of their own in the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import decontaminate, jaccard, language, mixing, secrets
from keelson.llm.common import stored, tune

#: A document whose best language scores less is rejected, like one without letters.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    tune(spark)
    found = language.predicted(language.learn(docs))(F.col("text").cast("string"))
    name = "_".join(["language", *docs.columns])  # a name that no column has
    return docs.withColumn(name, found).where((F.col(f"`{name}`.lang_pred") != "und") & (F.col(f"`{name}`.score") >= LEAST_SCORE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; rows that repeat an id are one document and stay or go together."""
    return docs.join(jaccard.similar(docs).select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    tune(spark)
    docs = docs.withColumn("text", secrets.redact(F.col("text")))
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]
#: Language ID is a learnt model: SQL cannot express it. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
