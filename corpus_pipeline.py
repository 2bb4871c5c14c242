"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
stages but the last return the columns of documents. Nulls count as empty texts, an empty table passes through, and
repeated ids are documents of their own; see the operators for ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from lotloom.llm.common import OWN, written
from lotloom.llm.queries import END_ID, LENGTH, QUALITY_THRESHOLD, tokenizer_path

#: No SQL can fit the classifier, so tests hold run() against a version in plain Python.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"{OWN}score"
    return quality.with_score(docs, model, name=score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, rounded up: 0, 1 or 2 times."""
    return mixing.repeat_by_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return packing.pack(docs, tokenizer_path(), END_ID, LENGTH)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
