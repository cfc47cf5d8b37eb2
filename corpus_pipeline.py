"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept; all but the last return the columns of `documents`, so any
prefix of the pipeline is a corpus of its own. run() writes each stage's rows to
the shared folder, reads them again for the next, and deletes what no stage reads any more.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodplain.llm import decontam, langid, linededup, mixing, neardup
from floodplain.llm.queries import WEIGHTS
from floodplain.llm.state import dropped, fresh, settled, table

#: Documents with a language score under this are rejected, like those without a letter.
MIN_SCORE = 0.3
SIMILAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; a missing lang is filled with the predicted one."""
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs, model)
    predicted, score = out.columns[-2:]
    kept = out.where((F.col(predicted) != "und") & (F.col(score) >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", predicted)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, frequent lines only in the largest doc_id; n_chars follows the text."""
    out = linededup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    key, kept = fresh(docs, "_doc", "_kept")
    chosen = neardup.near_duplicates(docs, SIMILAR_PERCENT).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[key])).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, epoch, n_tokens of what the mix takes; a document of two epochs comes twice."""
    taken = mixing.mix(docs, mixing.two_domains(), WEIGHTS).select("doc_id", "epoch", "n_tokens").dropDuplicates(["doc_id", "epoch"])
    return docs.select("doc_id", "text", "lang", "source").join(taken, "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can't express the learned and the iterative stages; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "written_to"):
            dropped(before)
    return docs
