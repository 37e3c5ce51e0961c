"""From documents to packed training bins, in five stages.

Each stage takes what its predecessor kept, as a table, and does one operator's work on all of it.
All but the last return the columns of documents; a text that a stage shortens gets its new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import anchors, common, lines, packing, toxicity, weighted_minhash


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on the labelled ones, does not reject."""
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of three-line windows that stand earlier."""
    return _sized(lines.dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return weighted_minhash.keep(docs)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without word runs that a smaller doc_id has."""
    return _sized(anchors.dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces go: doc_id, piece, bin, bin_start, length."""
    return packing.pack(packing.sized(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("substring_dedup", dedup_substrings),
    ("best_fit_packing", pack),
]

#: No stage but the line windows can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again; no documents, no rows, and without labels the fixed words alone tell toxic texts."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
