"""A training corpus from documents: language ID, near-duplicates, benchmark passages, mixing, shards.

Every stage takes (spark, docs, sf_dir) and returns rows of documents; the last adds the shard. What a stage returns is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import decontamination, language, mixing, sharding, simhash
from samewise.sources.shared import written

LEAST_SCORE = 0.5  # posterior of the language
SHINGLE_WORDS = 5
SIMILARITY = 0.8
MIX_BUDGET = 0.9  # of the tokens


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language: texts without letters and undecided ones go."""
    found = language.identify(docs, language.train(docs), out="__language")
    return found.where((F.col("__language.lang") != language.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)).drop("__language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id: five-word shingles similar to 0.8 or more."""
    return simhash.deduplicated(docs, words=SHINGLE_WORDS, least=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="__hits")
    return found.where(F.col("__hits.n_hit") == 0).drop("__hits")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by tempered weights of source, language and topic."""
    return mixing.sampled(docs, budget=MIX_BUDGET)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.assign(docs, "doc_id", [1.0] * sharding.SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", shards),
]

ORACLE_SQL = None  # naive Bayes and components are beyond SQL; tests/llm/test_pipeline.py compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
