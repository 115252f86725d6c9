"""Training-corpus pipeline over the documents table: five stages, each written and reread.

quality -> near_duplicates -> substring -> pii -> packing.  Every stage works on
all rows that its predecessor kept; all but the last return the columns of
documents.  Null and empty texts, null and repeated ids, empty tables and extra
columns are handled as the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ngram_join, packing, pii, quality, substring
from quire.llm.queries import tokenizer
from quire.session import written
from quire.sources.tables import table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now (null for null texts)."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, once.

    Rows without a doc_id belong to no group and stay.
    """
    first = ngram_join.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    kept = kept.dropDuplicates(["doc_id", "_text"]).select(*docs.columns)      # repeated rows
    return kept.union(docs.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    return _counted(substring.remove_repeats(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind."""
    return _counted(docs.withColumn("text", pii.redact(F.col("text"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts with their places in sequences of 2048."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
