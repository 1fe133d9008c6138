"""The corpus pipeline: documents in, packed training sequences out.

Each stage applies one training-data operator to all that the stage before it kept; what an
operator decides takes effect. All stages but the last return the columns of ``documents``.

Defined results: rows without a doc_id pass the near-duplicate stage (they cannot be named as
another's copy); null texts go at the first stage, as they have no language; an empty table
passes through; further columns pass through to the last stage. Repeated rows (equal doc_id and text) are one
document to the near-duplicate and passage stages: all pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import language_id, packing, quality, simhash, substring_dedup
from wattloom.llm.common import Scratch, load

#: Documents whose language scores less are rejected, besides those without a letter.
LEAST_LANGUAGE_SCORE = 0.25


def _rows(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside their text, so that no column can clash with an operator's."""
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or with no language to tell."""
    model = language_id.fit_on_learnable(docs)
    found = language_id.predict(_rows(docs), model)
    known = (F.col("language.lang_pred") != language_id.UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the base rule or a learned rule names."""
    scratch = Scratch(spark, "quality")
    stats = quality.with_statistics(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "quality.*")
    rules = quality.fit(scratch.save(stats, "statistics"), load(spark, sf_dir, "labels"))
    judged = quality.with_statistics(_rows(docs)).select("row", "quality.*")
    return judged.where(quality.verdict(rules)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group that five-word shingles link at a similarity of 0.8 or more."""
    found = simhash.similar(docs, words=5, similarity=0.8)
    gone = Scratch(spark, "copies").save(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone.withColumnRenamed("doc_id", "gone_"), F.col("doc_id") == F.col("gone_"), "left_anti")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every repeated 100-byte string out of the texts but where it stands first."""
    return substring_dedup.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned stages nor suffix sorting or packing. Tests hold the near-duplicate and passage stages
#: against brute force, the other stages against what their operators' tests check: statistics, labels, ids and coverage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
