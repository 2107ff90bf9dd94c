"""Cleaning a corpus for training: each stage works on all documents that the one before it kept.

Every stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and returns the same columns,
the last one the packed pieces. run() writes each stage's rows before the next one reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import langid, packing, pii, quality, similar
from gridspark.llm.common import limit_batches, load
from gridspark.llm.tokens import tokenizer_path
from gridspark.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Probability from which a predicted language is accepted.
LANGUAGE_FROM = 0.5
# Words whose ids a worker keeps: it holds them while it works on other stages, whose memory they take.
CACHED_WORDS = 50_000
# Whole texts handed to Python at a time. What a stage's batches take in an executor, the later stages find taken.
BATCH_ROWS = 200

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def only_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores as bad."""
    return quality.kept(only_columns(docs))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or uncertain; `lang` becomes the predicted one where it was null."""
    return langid.kept(only_columns(docs), LANGUAGE_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 0.8 or more of five-word shingles: the one with the smallest doc_id."""
    return similar.representatives(only_columns(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; n_chars follows the new text."""
    return pii.mask_texts(only_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack(only_columns(docs), path, cache_entries=CACHED_WORDS).drop("ids")


def in_small_batches(stage: Stage) -> Stage:
    """The stage with BATCH_ROWS rows at a time. Its rows are made when they are written, so the setting stays with the session;
    it changes no row."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        limit_batches(spark, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, in_small_batches(stage)) for name, stage in (
    ("quality classifier", keep_good),
    ("language ID", keep_known_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("packing", pack),
)]

# The stages' models and tokenizer have no SQL form; the tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
