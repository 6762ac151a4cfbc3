"""A training-data pipeline: quality, line deduplication, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of documents. run() writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import bpe_chunks, decontaminate, jaccard_join, kneser_ney, line_dedup
from voxframe.llm.common import removed, staged, table, tuned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier does not reject."""
    return kneser_ney.keep_good(docs, table(tuned(spark), sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a smaller doc_id holds; n_chars is counted anew."""
    columns = docs.columns
    apart = docs.toDF(*[c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(columns)])  # names that the operator adds may be taken
    kept = line_dedup.dedup_lines(apart).select(*apart.columns).toDF(*columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents, the smallest doc_id."""
    return jaccard_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(tuned(spark), sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids of every document."""
    return bpe_chunks.round_trip(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: Training, hashing of whole texts and a public vocabulary are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(tuned(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # its rows are written anew
            removed(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
