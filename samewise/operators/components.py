"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.sources.shared import written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each node that has an edge, with the smallest node of its component, as (node, component).

    Large and small stars alternate until nothing moves, which takes few rounds even for long chains. A node's smallest
    neighbour comes from an aggregation that combines before the shuffle, is written, and is joined back, so that a node of very many edges
    is a skewed join, which adaptive execution splits, and never one group in one task. The joins are merges, as broadcasts of one side in
every round would gather on the driver. Every round is written to the shared folder.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    stars = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    while True:
        both = stars.union(stars.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least.hint("merge"), "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    hubs = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)
