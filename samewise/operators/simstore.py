"""Bounded similarity lists, match groups, and how they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.operators.components import components
from samewise.sources.listfiles import FORMATS, write_db
from samewise.sources.shared import remove


def heaps(scores: DataFrame, n: int) -> DataFrame:
    """(key, word, score) of each key's n best words, by score, then word. Of a word that came before, the first score (by pos) counts."""
    first = scores.groupBy("key", "word").agg(F.min_by("score", "pos").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("word"))
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def lists(heap: DataFrame) -> DataFrame:
    """(key, similarity), similarity being the JSON text of [score, word] pairs, best first."""
    pair = F.struct(F.col("rank"), F.array(F.col("score").cast("string"), F.col("word").cast("string")).alias("p"))
    return heap.groupBy("key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["p"])).alias("similarity"))


def edge_cap(edges: DataFrame, n: int) -> DataFrame:
    """The edges (a, b, weight) that are among the n heaviest at both ends."""
    ends = edges.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("end"))
    order = Window.partitionBy("end").orderBy(F.desc("weight"), F.asc("a"), F.asc("b"))
    kept = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return kept.groupBy("a", "b", "weight").count().where("count = 2").select("a", "b", "weight")


def groups(records: DataFrame, equal: DataFrame) -> DataFrame:
    """(rid, group) for all records: records joined by equal pairs (a, b) share the smallest rid."""
    found = components(equal, "a", "b").withColumnRenamed("node", "rid")
    return records.join(found, "rid", "left").select("rid", F.coalesce("component", "rid").alias("group"))


def contracted(edges: DataFrame, grouped: DataFrame) -> DataFrame:
    """(a, b, weight) between groups, the heaviest of each pair; edges inside a group vanish."""
    side = lambda x: grouped.select(F.col("rid").alias(x), F.col("group").alias(f"g{x}"))
    both = edges.join(side("a"), "a").join(side("b"), "b").where("ga <> gb")
    return both.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.max("weight").alias("weight"))


def members(grouped: DataFrame) -> DataFrame:
    """(group, n_members, members): members joined by commas in order."""
    return grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.array_sort(F.collect_set("rid")), ",").alias("members"))


def sharing(heap: DataFrame) -> DataFrame:
    """(a, b, n_common): keys, a < b, that have equal (score, word) entries."""
    a, b = heap.alias("x"), heap.alias("y")
    met = a.join(b, (F.col("x.word") == F.col("y.word")) & (F.col("x.score") == F.col("y.score")) & (F.col("x.key") < F.col("y.key")))
    return met.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.count(F.lit(1)).alias("n_common"))


def propagated(scores: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh pairs (a, b) of score 1, and what they imply over pairs (key, other, score) that have score 1 already."""
    exact = scores.where("score = 1.0").select(F.col("key").alias("b"), F.col("other").alias("c"))
    both = exact.union(exact.select("c", "b"))
    implied = fresh.join(both, "b").select("a", F.col("c").alias("b")).where("a <> b")
    return fresh.select("a", "b").union(implied).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def upsert(spark: SparkSession, path: str, fresh: DataFrame, key: str = "key") -> None:
    """Put rows into a parquet table by key; rows of equal keys are replaced, and of fresh rows with equal keys one stays. The new table is
    written beside the old one, which is set aside, not deleted, before the new one takes its place; a run that finds no table but one
    set aside goes on from that."""
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside, following = f"{path}.before", f"{path}.next"
    if not fs.exists(at(path)) and fs.exists(at(aside)):
        fs.rename(at(aside), at(path))
    fresh = fresh.dropDuplicates([key])
    rows = fresh
    if fs.exists(at(path)):
        old = spark.read.schema(fresh.schema).parquet(path)
        rows = old.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    rows.write.mode("overwrite").parquet(following)
    if fs.exists(at(path)):
        remove(spark, aside)
        fs.rename(at(path), at(aside))
    fs.rename(at(following), at(path))
    remove(spark, aside)


def write_lists(heap: DataFrame, path: str, fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {', '.join(FORMATS)}")
    if fmt == "db":
        write_db(lists(heap), path)
        return
    lists(heap).write.mode("overwrite").format(fmt).save(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines of source, target and weight."""
    edges.select("a", "b", "weight").write.mode("overwrite").option("sep", " ").csv(path)


def append_changes(neighbours: DataFrame, path: str, round_: int) -> None:
    """The similarities of a round, in a partition of its own; a repeated round replaces its partition."""
    rows = neighbours.select(F.col("row").alias("target_id"), F.col("rank").alias("neighbor_rank"), F.col("col").alias("neighbor_id"), F.col("sim").alias("similarity"))
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/round={round_}")
