"""A corpus from documents: each stage works on what its predecessor kept.

A stage's result is written before the next one is called, which therefore begins by deleting what the
stage before it stored on its way.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import byte_bpe, language_id, mixing, ngram_join, pii
from barlake.llm.common import delete, forget_shuffles, recorded, remainder, stored
from barlake.session import settings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents whose best language is less likely than this are rejected, as are those without any. It is
# low, so that short but readable texts stay, which several languages may share.
LEAST_LANGUAGE_SCORE = 0.3
# Spark keeps the text of a thousand plans in the driver, anew after every step of theirs, and those of a
# stage are long; this many characters of each tell them apart.
PLAN_TEXT = {"spark.sql.maxPlanStringLength": "2000"}


# What the latest stage over a folder has stored on its way.
_left: dict[str, list[str]] = {}


def tidy(stage):
    """Delete what the stage before stored on its way, and note what this one does. The driver keeps little
    of its plans."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for place in _left.pop(sf_dir, []):
            delete(spark, place)
        forget_shuffles(spark)
        with recorded() as places, settings(spark, PLAN_TEXT):
            result = stage(spark, docs, sf_dir)
        _left[sf_dir] = places
        return result

    return run_stage


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; learns as op5 does, from two thirds of them."""
    predicted = language_id.identify(docs.select(*COLUMNS), remainder(F.col("doc_id"), 3) != 1)
    return predicted.filter((F.col("lang_pred") != language_id.UNDETERMINED)
                            & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


@tidy
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.near_duplicates(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


@tidy
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts what is left."""
    clean = pii.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


@tidy
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents, decoded again as a check."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                     public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("distinct", distinct),
    ("redacted", redacted),
    ("mixed", mixed),
    ("encoded", encoded),
]

# Most stages go beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
