"""Exact matching of records by the set of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clusters(keyed: DataFrame, rid: str = "rid", key: str = "token_key") -> DataFrame:
    """One row per key held by more than one record: its smallest record and its size. Counts combine before the shuffle."""
    return (
        keyed.groupBy(key)
        .agg(F.min(rid).alias("survivor"), F.count(F.lit(1)).alias("n_members"))
        .where(F.col("n_members") > 1)
        .select("survivor", "n_members", key)
    )


def membership(keyed: DataFrame, rid: str = "rid", key: str = "token_key") -> DataFrame:
    """Every record of a cluster with the cluster's survivor."""
    return keyed.join(clusters(keyed, rid, key), key).select(F.col(rid), "survivor", "n_members")


def pairs(keyed: DataFrame, rid: str = "rid", key: str = "token_key") -> DataFrame:
    """All pairs (a, b), a < b, of records with equal keys, as wanted by callers that take pairs; clusters() says the same in linear size."""
    left, right = keyed.alias("l"), keyed.alias("r")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"l.{rid}") < F.col(f"r.{rid}"))
    return left.join(right, on).select(F.col(f"l.{rid}").alias("a"), F.col(f"r.{rid}").alias("b"))


def survivors(keyed: DataFrame, rid: str = "rid", key: str = "token_key") -> DataFrame:
    """The records that stay when each cluster keeps its smallest record."""
    gone = membership(keyed, rid, key).where(F.col(rid) != F.col("survivor")).select(rid)
    return keyed.join(gone, rid, "left_anti")


def incremental(window: DataFrame, store: DataFrame, rid: str = "rid", key: str = "token_key") -> DataFrame:
    """For each window record with an equal token set in the store, the smallest such store record."""
    first = store.groupBy(key).agg(F.min(rid).alias("match"))
    return window.join(first, key).select(F.col(rid), "match")


def with_key(df: DataFrame, rid: Column, key: Column) -> DataFrame:
    return df.select(rid.alias("rid"), key.alias("token_key"))
