"""The versions of every pair decision, append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("rid_i", "rid_j")


def versions(changes: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Number the changes of each pair and fill what a change leaves open from the one before.

    changes has rid_i, rid_j, ts, score, stage and decision. The first version has stage PM and decision tentative unless it says else,
    later ones CM unless they say else. Pairs are ordered: i::j is another one than j::i.
    """
    by = Window.partitionBy(*PAIR).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(by)
    stage = F.coalesce("stage", F.when(number == 1, "PM").otherwise("CM"))
    return changes.select(
        F.concat_ws("::", *PAIR).alias("pair_key"),
        *PAIR,
        number.alias("version"),
        *order,
        F.last("score", ignorenulls=True).over(upto).alias("score"),
        stage.alias("stage"),
        F.coalesce(F.last("decision", ignorenulls=True).over(upto), F.lit("tentative")).alias("decision"),
        F.lit("pending").alias("transaction"),
        F.lit(True).alias("active"),
    )


def latest(state: DataFrame) -> DataFrame:
    """The highest version of each pair; an aggregation, so a pair of very many versions is combined before the shuffle."""
    rest = [c for c in state.columns if c not in ("pair_key", "version")]
    top = F.max_by(F.struct("version", *rest), "version").alias("s")
    return state.groupBy("pair_key").agg(top).select("pair_key", "s.*")


def history(state: DataFrame, pair_key: str) -> DataFrame:
    return state.where(F.col("pair_key") == pair_key).orderBy("version")


def appended(state: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of the pairs, after those that state has."""
    last = latest(state).select(*PAIR, F.col("version").alias("before"), F.col("score").alias("old_score"), F.col("decision").alias("old_decision"))
    fresh = versions(changes).join(last, list(PAIR), "left")
    known = F.col("before").isNotNull()
    return fresh.select(
        "pair_key",
        *PAIR,
        (F.col("version") + F.coalesce("before", F.lit(0))).cast("int").alias("version"),
        "ts",
        F.coalesce("score", "old_score").alias("score"),
        F.when(known & (F.col("stage") == "PM"), "CM").otherwise(F.col("stage")).alias("stage"),
        F.when(known & (F.col("decision") == "tentative"), F.col("old_decision")).otherwise(F.col("decision")).alias("decision"),
        "transaction",
        "active",
    )
