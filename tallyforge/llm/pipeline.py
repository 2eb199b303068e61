"""A corpus pipeline of five stages over ``documents``: each takes what its predecessor kept, whole.

Language identification drops texts without a language, line dedup takes later lines out of the texts, SimHash keeps one
document of each group of near copies, decontamination drops documents that hold a benchmark window, and mixing gives
each remaining document its place in the training order. All stages but the last return the columns of documents.

Rows that share an id: different texts under one id are different documents in every stage, told apart by the hash of the
text; of several equal rows SimHash keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, langid, linededup, mixing, simhash
from tallyforge.plans.registry import table
from tallyforge.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told: null texts and texts without a letter."""
    model = langid.LanguageModel(langid.training_sample(docs))
    found = langid.identify(docs, model, keep_text=True, prefix="_lid_")
    return found.where(F.col("_lid_lang_pred") != "und").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that repeat an earlier line out of text; n_chars follows. Documents stay, even without a line."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]

#: SQL cannot express the language model or XXH64 fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is cut by a checkpoint before the next stage reads it."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
