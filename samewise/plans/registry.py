"""Queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.plans import graphs, stores, streams, texts, vectors

QUERIES = {**texts.QUERIES, **vectors.QUERIES, **stores.QUERIES, **graphs.QUERIES, **streams.QUERIES}
ORACLE = {**texts.ORACLE, **vectors.ORACLE, **stores.ORACLE, **graphs.ORACLE, **streams.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["match_decision"](spark, sf_dir)
