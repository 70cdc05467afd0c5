"""Match quality against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.sources.listfiles import read_lists

MAX_GRID = 10_000


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def truth(pairs: DataFrame, source_a: int = 0) -> DataFrame:
    """Distinct (a, b), a < b; with source_a, only those with an id below it."""
    out = pairs.select(*ordered(F.col("a"), F.col("b"))).distinct()
    return out.where(F.col("a") < source_a) if source_a else out


def read_truth(spark: SparkSession, path: str, source_a: int = 0) -> DataFrame:
    """A text file with lines like ``idx_3,idx_751``; blanks around are cut, blank lines skipped."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    number = lambda i: F.regexp_extract(parts[i], r"_+([0-9]+)$", 1).try_cast("long")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return truth(lines.select(number(0).alias("a"), number(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"), source_a)


def read_similarities(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(key, other, score) from lists in parquet, json or a database."""
    pair = F.from_json("similarity", "array<array<string>>")
    rows = read_lists(spark, path, fmt)
    return rows.select("key", F.explode(pair).alias("p")).select("key", F.col("p")[1].alias("other"), F.col("p")[0].cast("double").alias("score"))


def cut(scores: DataFrame, n: int | None, digits: int) -> DataFrame:
    """Rows of (key, other, score), rounded, of the n highest distinct scores of each key; all if n is no positive number."""
    rounded = scores.withColumn("score", F.bround("score", digits))
    if not n or n < 1:
        return rounded
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score")))
    return rounded.withColumn("cut", rank).where(F.col("cut") <= n).drop("cut")


def predicted(scores: DataFrame, n: int | None, digits: int, threshold: float) -> DataFrame:
    """Distinct pairs from the threshold on."""
    kept = cut(scores, n, digits).where((F.col("score") >= threshold) & (F.col("key") != F.col("other")))
    return kept.select(*ordered(F.col("key"), F.col("other"))).distinct()


def share(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(0.0)


def metrics(correct: Column, found: Column, wanted: Column, suffix: str = "") -> list[Column]:
    p, r = share(correct, found), share(correct, wanted)
    return [p.alias(f"precision{suffix}"), r.alias("recall") if not suffix else r.alias(f"recall{suffix}"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias(f"f1{suffix}")]


def sweep(scores: DataFrame, wanted: DataFrame, thresholds: list[float], most: int, digits: int) -> DataFrame:
    """One row per threshold and k = 1..most: predicted, predicted_bis, correct, wanted and the metrics.

    A pair is predicted from some cuts on at some scores: a corner per side that lists it, less where two corners overlap. So a pair adds a
    few corners, which are counted by cut and step of the thresholds, and the grid takes its sums from these counts. bis counts only
    predictions that touch a node of the truth. The grid has MAX_GRID cells at most.
    """
    if len(thresholds) * most > MAX_GRID:
        raise ValueError("the grid is too large")
    spark = scores.sparkSession
    steps = sorted(set(thresholds), reverse=True)
    ranked = scores.withColumn("score", F.bround("score", digits)).where("key <> other").withColumn("cut", F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score")))).where(F.col("cut") <= most)
    nodes = wanted.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sides = ranked.select(*ordered(F.col("key"), F.col("other")), "score", "cut").groupBy("a", "b", "cut").agg(F.max("score").alias("score"))
    known = sides.join(wanted.withColumn("true", F.lit(True)), ["a", "b"], "left")
    for end in ("a", "b"):
        known = known.join(nodes.select(F.col("node").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    before = F.max("score").over(Window.partitionBy("a", "b").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
    corners = known.withColumn("before", before).where("before IS NULL OR score > before")
    step = lambda x: F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t > x))
    signed = F.explode(F.array(F.struct(F.lit(1).alias("sign"), step(F.col("score")).alias("step")), F.struct(F.when(F.col("before").isNotNull(), -1).otherwise(0).alias("sign"), step(F.coalesce("before", "score")).alias("step"))))
    points = corners.select("cut", F.coalesce("true", F.lit(False)).cast("int").alias("true"), F.coalesce("has_a", "has_b", F.lit(False)).cast("int").alias("bis"), signed.alias("x"))
    sign = F.col("x.sign")
    counted = points.groupBy("cut", F.col("x.step").alias("step")).agg(F.sum(sign).alias("p"), F.sum(sign * F.col("bis")).alias("q"), F.sum(sign * F.col("true")).alias("c"))
    grid = spark.createDataFrame([(t, k, steps.index(t)) for t in thresholds for k in range(1, most + 1)], "threshold double, k int, at int")
    cells = grid.join(F.broadcast(counted), (F.col("cut") <= F.col("k")) & (F.col("step") <= F.col("at")))  # both at most as large as the grid
    sums = cells.groupBy("threshold", "k").agg(F.sum("p").alias("predicted"), F.sum("q").alias("predicted_bis"), F.sum("c").alias("correct"))
    grid = grid.drop("at")
    total = wanted.agg(F.count(F.lit(1)).alias("wanted"))
    every = grid.join(sums, ["threshold", "k"], "left").fillna(0).crossJoin(F.broadcast(total))  # one row
    c, w = F.col("correct"), F.col("wanted")
    return every.select("threshold", "k", "predicted", "predicted_bis", "correct", "wanted", *metrics(c, F.col("predicted"), w), *metrics(c, F.col("predicted_bis"), w, "_bis"))


def best(grid: DataFrame, measure: str = "f1", ascending: bool = False) -> DataFrame:
    """The cell of the highest measure; among equals the highest threshold (or lowest, ascending), then the smallest k."""
    order = F.asc("threshold") if ascending else F.desc("threshold")
    return grid.where(F.col(measure) > 0).orderBy(F.desc(measure), order, F.asc("k")).limit(1)


def scatter(scores: DataFrame, wanted: DataFrame, n: int, digits: int) -> DataFrame:
    """(low, high, similarity, is_match) of each key's cut."""
    low, high = ordered(F.col("key"), F.col("other"))
    rows = cut(scores, n, digits).select("key", "other", low, high, F.col("score").alias("similarity"))
    return rows.join(wanted.withColumn("is_match", F.lit(True)), ["a", "b"], "left").select("key", "other", "a", "similarity", F.coalesce("is_match", F.lit(False)).alias("is_match"))


def classification(rows: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """accuracy, and precision, recall and F1 weighted by the labels' counts; one row. weight: a column with how often a row counts."""
    cells = rows.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count"))
    every = cells.select("l").union(cells.select("p")).distinct().withColumnRenamed("l", "c")
    hit = cells.where("l = p").select(F.col("l").alias("c"), F.col("count").alias("hit"))
    real = cells.groupBy(F.col("l").alias("c")).agg(F.sum("count").alias("real"))
    said = cells.groupBy(F.col("p").alias("c")).agg(F.sum("count").alias("said"))
    by = every.join(hit, "c", "left").join(real, "c", "left").join(said, "c", "left").fillna(0)
    p, r = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("real"))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    total = F.sum("real")
    return by.agg((F.sum("hit") / total).alias("accuracy"), *[(F.sum(x * F.col("real")) / total).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))])
