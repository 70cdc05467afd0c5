"""Which nearest neighbours are accepted as matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators import knn

EPS = 1e-12


def gaps(neighbours: DataFrame) -> DataFrame:
    """(row, col, s1, s2) of each row's first two; s2 is NULL where there is one only."""
    first = lambda rank, name: F.max(F.when(F.col("rank") == rank, F.col(name)))
    return neighbours.where("rank <= 2").groupBy("row").agg(first(1, "col").alias("col"), first(1, "sim").alias("s1"), first(2, "sim").alias("s2"))


def decided(neighbours: DataFrame, ratio: float | None = None, delta: float | None = 0.1, enforce_rnn: bool = True, single_threshold: float = 0.95, max_degree: int = 5) -> DataFrame:
    """(row, col, score) of the accepted edges, one per row at most.

    A row is forced if its best score reaches the threshold and neither end is a hub. The others must pass the tests given. Then an edge
    stays if its row scores its column best over all lists, unless every row was forced. The hub test binds forced rows only.
    """
    hub = knn.hubs(neighbours, max_degree).select("node", F.lit(True).alias("hub"))
    pairs = gaps(neighbours)
    pairs = pairs.join(hub.select(F.col("node").alias("row"), F.col("hub").alias("row_hub")), "row", "left")
    pairs = pairs.join(hub.select(F.col("node").alias("col"), F.col("hub").alias("col_hub")), "col", "left")
    forced = (F.col("s1") >= single_threshold) & F.col("row_hub").isNull() & F.col("col_hub").isNull()
    tests = F.col("s2").isNotNull()
    if ratio is not None:
        tests &= F.col("s1") / (F.col("s2") + EPS) >= ratio
    if delta is not None:
        tests &= F.col("s1") - F.col("s2") >= delta
    judged = pairs.withColumn("forced", forced).withColumn("passes", F.col("forced") | tests)
    accepted = judged.where("passes").select("row", "col", F.col("s1").alias("score"))
    if not enforce_rnn:
        return accepted
    all_forced = judged.agg(F.coalesce(F.every("forced"), F.lit(True)).alias("all_forced"))
    best = knn.best_rows(neighbours).select(F.col("col"), F.col("row").alias("best"))
    both = accepted.join(best, "col").crossJoin(F.broadcast(all_forced))  # one row
    return both.where(F.col("all_forced") | (F.col("best") == F.col("row"))).select("row", "col", "score")
