"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. Each works on all that its predecessor kept, and all but the last return the columns of documents.
Empty tables pass through every stage; nulls, repeated rows and columns of any name are handled as the operators'
modules say: rows without doc_id are judged, keep their lines, are near duplicates of nothing, and are redacted and
packed like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberlode.llm import bpe, line_dedup, near_dedup, packing, quality, secret_scan
from amberlode.llm.common import durable, table
from amberlode.sources.shared import remove, settled


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that was changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and texts lose their boilerplate lines."""
    return _resized(quality.passing(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their crowded lines."""
    return _resized(line_dedup.cleaned(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicated(docs, near_dedup.Params())


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    return _resized(secret_scan.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens get places in training sequences."""
    counted = bpe.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(durable(counted.select("doc_id", "n_tokens"), "counts"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: The order in which best fit meets equally long pieces, and components of links, can't be put as one SQL statement;
#: a test compares every stage and `run` with a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again; a stage's input and the
    tables it needed on the way are deleted once its result stands."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settled(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if last is not None:
            remove(spark, last)
        last = docs
    return docs
