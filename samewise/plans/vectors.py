"""Queries on nearest neighbours, decisions and evaluation, over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import decide, evaluate, index, knn
from samewise.plans.tables import table
from samewise.sources.shared import written

K = 5
SOURCE_A = 249
THRESHOLDS = [i / 100 for i in range(95, 0, -5)]
DIGITS = 4
DECISION = {"ratio": None, "delta": 0.02, "single_threshold": 0.45, "max_degree": 5}


def neighbours(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return knn.topk(table(spark, sf_dir, "embeddings"), k)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbours(spark, sf_dir))


def knn_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return _rounded(knn.topk(vectors, 10, queries=vectors.where("vec_id % 50 = 0")))


def knn_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten times n best over all words, then those that are records (even ids), then the first n; fewer may be left."""
    vectors = table(spark, sf_dir, "embeddings")
    found = knn.topk(vectors, 3 * 10, queries=vectors.where("vec_id % 50 = 0")).where(F.col("col") % 2 == 0)
    return _rounded(knn.ranked(found.select("row", "col", "sim"), 3))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of even ids, for every query row."""
    vectors = table(spark, sf_dir, "embeddings")
    return _rounded(knn.topk(vectors, 10, queries=vectors.where("vec_id % 50 = 0"), among=F.col("vec_id") % 2 == 0))


def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows by the clustered index, for every query row."""
    vectors = table(spark, sf_dir, "embeddings")
    centres = index.centres(vectors)
    rows = written(index.placed(vectors, centres), "index")
    return _rounded(index.search(rows, vectors.where("vec_id % 50 = 0"), centres, 10, index.probes_for(vectors, centres, 10)))


def knn_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours the index finds; one row."""
    return index.recall(knn_index(spark, sf_dir), knn_one(spark, sf_dir))


def knn_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.cross_source(neighbours(spark, sf_dir, 2 * K), SOURCE_A, K))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression form, between vectors of neighbouring ids."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(knn.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.mutual(neighbours(spark, sf_dir, 1)))


def hub_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.hubs(neighbours(spark, sf_dir), 5)


def best_row_for_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.best_rows(neighbours(spark, sf_dir)))


def gap_ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = decide.gaps(neighbours(spark, sf_dir))
    return g.select("row", "col", F.round(F.col("s1") - F.col("s2"), 6).alias("gap"), F.round(F.col("s1") / (F.col("s2") + decide.EPS), 6).alias("ratio"), ((F.col("s1") - F.col("s2")) >= 0.02).alias("passes"))


def match_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(neighbours(spark, sf_dir, 10), "neighbours")
    return _rounded(decide.decided(found, **DECISION))


def decision_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours, the decision over all records, and only then the test for different sources."""
    edges = match_decision(spark, sf_dir)
    return edges.withColumn("cross", (F.col("row") <= SOURCE_A) != (F.col("col") <= SOURCE_A)).where("cross").drop("cross")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 10).select(F.col("row").alias("key"), F.col("col").alias("other"), F.col("sim").alias("score"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with equal labels and numbers at most 40 apart."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.array(*map(F.lit, range(2)))).alias("s")).withColumn("cell", (F.col("vec_id") / 40).cast("int") + F.col("s"))
    a, b = v.alias("a"), v.where("s = 0").alias("b")
    on = (F.col("a.label") == F.col("b.label")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.vec_id") < F.col("b.vec_id")) & (F.col("b.vec_id") - F.col("a.vec_id") <= 40)
    return a.join(b, on).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"))


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.truth(_truth(spark, sf_dir), SOURCE_A)


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.predicted(_scores(spark, sf_dir), 3, 2, 0.4)


def f1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = written(evaluate.truth(_truth(spark, sf_dir), SOURCE_A), "truth")
    return _rounded(evaluate.sweep(written(_scores(spark, sf_dir), "scores"), wanted, THRESHOLDS, 10, DIGITS))


def _cell(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    one = f1_sweep(spark, sf_dir).where("threshold = 0.3 AND k = 3")
    return one.select("threshold", "k", "correct", f"predicted{suffix}", f"precision{suffix}", f"recall{suffix}", f"f1{suffix}")


def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell(spark, sf_dir, "")


def prf_bis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell(spark, sf_dir, "_bis")


def f1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best(f1_sweep(spark, sf_dir))


def f1_best_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best(f1_sweep(spark, sf_dir), ascending=True)


def similarity_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scatter(_scores(spark, sf_dir), evaluate.truth(_truth(spark, sf_dir), SOURCE_A), 2, DIGITS)


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.classification(table(spark, sf_dir, "labels"), "quality", "toxic"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_one, knn_basic, knn_filtered, knn_index, knn_index_recall, knn_cross_source, cosine_pairs, mutual_nn, hub_degree, best_row_for_col, gap_ratio_test, match_decision, decision_pipeline, truth_pairs, similar_pairs, f1_sweep, prf, prf_bis, f1_best, f1_best_ascending, similarity_scatter, pair_metrics)}

_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def knn_sql(k: int, where: str = "") -> str:
    """The CTE nn(row, rank, col, sim)."""
    return f"""s AS (SELECT a.vec_id AS row, b.vec_id AS col, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {where}),
        nn AS (SELECT row, rank, col, sim FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY sim DESC, col)::INTEGER AS rank FROM s) WHERE rank <= {k})"""


_RANK = "row_number() OVER (PARTITION BY row ORDER BY sim DESC, col)::INTEGER AS rank"
_BEST = "best AS (SELECT col, arg_min(row, (-sim, row)) AS row, max(sim) AS sim FROM nn GROUP BY col)"
_GAPS = "g AS (SELECT row, max(CASE WHEN rank = 1 THEN col END) AS col, max(CASE WHEN rank = 1 THEN sim END) AS s1, max(CASE WHEN rank = 2 THEN sim END) AS s2 FROM nn GROUP BY row)"
_TRUE = "t AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 40 WHERE a.vec_id < {})".format(SOURCE_A)
_DECIDED = f"""{knn_sql(10)}, {_GAPS}, {_BEST},
    hub AS (SELECT col AS node FROM nn GROUP BY col HAVING count(*) > {DECISION["max_degree"]}),
    j AS (SELECT *, s1 >= {DECISION["single_threshold"]} AND row NOT IN (SELECT node FROM hub) AND col NOT IN (SELECT node FROM hub) AS forced FROM g),
    p AS (SELECT row, col, s1 FROM j WHERE forced OR s1 - s2 >= {DECISION["delta"]}),
    decided AS (SELECT p.row, p.col, round(s1, 6) AS score FROM p JOIN best ON p.col = best.col WHERE best.row = p.row OR (SELECT bool_and(forced) FROM j))"""
_SWEEP = f"""{knn_sql(10)}, {_TRUE}, n AS (SELECT DISTINCT unnest([a, b]) AS node FROM t),
    r AS (SELECT row, col, score, dense_rank() OVER (PARTITION BY row ORDER BY score DESC) AS cut FROM (SELECT row, col, round_even(sim, {DIGITS}) AS score FROM nn)),
    grid AS (SELECT threshold, k FROM (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in THRESHOLDS)}]) AS threshold), (SELECT unnest(range(1, 11))::INTEGER AS k)),
    c AS (SELECT DISTINCT threshold, k, least(row, col) AS a, greatest(row, col) AS b FROM grid JOIN r ON cut <= k AND score >= threshold),
    m AS (SELECT threshold, k, count(*) AS predicted, count(*) FILTER (WHERE c.a IN (SELECT node FROM n) OR c.b IN (SELECT node FROM n)) AS predicted_bis, count(t.a) AS correct FROM c LEFT JOIN t ON c.a = t.a AND c.b = t.b GROUP BY threshold, k),
    x AS (SELECT threshold, k, coalesce(predicted, 0) AS predicted, coalesce(predicted_bis, 0) AS predicted_bis, coalesce(correct, 0) AS correct, (SELECT count(*) FROM t) AS wanted FROM grid LEFT JOIN m USING (threshold, k)),
    y AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0 END::DOUBLE AS p, CASE WHEN predicted_bis > 0 THEN correct / predicted_bis ELSE 0.0 END::DOUBLE AS q, CASE WHEN wanted > 0 THEN correct / wanted ELSE 0.0 END::DOUBLE AS z FROM x),
    sweep AS (SELECT threshold, k, predicted, predicted_bis, correct, wanted, round(p, 6) AS precision, round(z, 6) AS recall, round(CASE WHEN p + z > 0 THEN 2 * p * z / (p + z) ELSE 0.0 END, 6) AS f1,
      round(q, 6) AS precision_bis, round(z, 6) AS recall_bis, round(CASE WHEN q + z > 0 THEN 2 * q * z / (q + z) ELSE 0.0 END, 6) AS f1_bis FROM y)"""
ORACLE = {
    "knn_topk": f"WITH {knn_sql(K)} SELECT row, rank, col, round(sim, 6) AS sim FROM nn",
    "knn_one": f"WITH {knn_sql(10, 'WHERE a.vec_id % 50 = 0')} SELECT row, rank, col, round(sim, 6) AS sim FROM nn",
    "knn_basic": f"WITH {knn_sql(30, 'WHERE a.vec_id % 50 = 0')} SELECT * FROM (SELECT row, {_RANK}, col, round(sim, 6) AS sim FROM nn WHERE col % 2 = 0) WHERE rank <= 3",
    "knn_filtered": f"WITH {knn_sql(10, 'WHERE a.vec_id % 50 = 0 AND b.vec_id % 2 = 0')} SELECT row, rank, col, round(sim, 6) AS sim FROM nn",
    "knn_cross_source": f"WITH {knn_sql(2 * K)} SELECT * FROM (SELECT row, {_RANK}, col, round(sim, 6) AS sim FROM nn WHERE (row <= {SOURCE_A}) <> (col <= {SOURCE_A})) WHERE rank <= {K}",
    "cosine_pairs": f"SELECT a.vec_id, round({_SIM}, 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "mutual_nn": f"WITH {knn_sql(1)} SELECT x.row, x.col, round(x.sim, 6) AS sim FROM nn x JOIN nn y ON x.col = y.row AND x.row = y.col WHERE x.row < x.col",
    "hub_degree": f"WITH {knn_sql(K)} SELECT col AS node, count(*) AS degree FROM nn GROUP BY col HAVING count(*) > 5",
    "best_row_for_col": f"WITH {knn_sql(K)}, {_BEST} SELECT col, row, round(sim, 6) AS sim FROM best",
    "gap_ratio_test": f"WITH {knn_sql(K)}, {_GAPS} SELECT row, col, round(s1 - s2, 6) AS gap, round(s1 / (s2 + 1e-12), 6) AS ratio, s1 - s2 >= 0.02 AS passes FROM g",
    "match_decision": f"WITH {_DECIDED} SELECT row, col, score FROM decided",
    "decision_pipeline": f"WITH {_DECIDED} SELECT row, col, score FROM decided WHERE (row <= {SOURCE_A}) <> (col <= {SOURCE_A})",
    "truth_pairs": f"WITH {_TRUE} SELECT a, b FROM t",
    "similar_pairs": f"""WITH {knn_sql(10)}, r AS (SELECT row, col, score, dense_rank() OVER (PARTITION BY row ORDER BY score DESC) AS cut FROM (SELECT row, col, round_even(sim, 2) AS score FROM nn))
        SELECT DISTINCT least(row, col) AS a, greatest(row, col) AS b FROM r WHERE cut <= 3 AND score >= 0.4""",
    "f1_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "prf": f"WITH {_SWEEP} SELECT threshold, k, correct, predicted, precision, recall, f1 FROM sweep WHERE threshold = 0.3 AND k = 3",
    "prf_bis": f"WITH {_SWEEP} SELECT threshold, k, correct, predicted_bis, precision_bis, recall_bis, f1_bis FROM sweep WHERE threshold = 0.3 AND k = 3",
    "f1_best": f"WITH {_SWEEP} SELECT * FROM sweep WHERE f1 > 0 ORDER BY f1 DESC, threshold DESC, k LIMIT 1",
    "f1_best_ascending": f"WITH {_SWEEP} SELECT * FROM sweep WHERE f1 > 0 ORDER BY f1 DESC, threshold, k LIMIT 1",
    "similarity_scatter": f"""WITH {knn_sql(10)}, {_TRUE}, r AS (SELECT row, col, score, dense_rank() OVER (PARTITION BY row ORDER BY score DESC) AS cut FROM (SELECT row, col, round_even(sim, {DIGITS}) AS score FROM nn))
        SELECT row AS key, col AS other, least(row, col) AS a, score AS similarity, t.a IS NOT NULL AS is_match FROM r LEFT JOIN t ON t.a = least(row, col) AND t.b = greatest(row, col) WHERE cut <= 2""",
    "pair_metrics": """WITH c AS (SELECT DISTINCT unnest([quality, toxic]) AS c FROM labels),
        b AS (SELECT c, (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS hit, (SELECT count(*) FROM labels WHERE quality = c) AS real, (SELECT count(*) FROM labels WHERE toxic = c) AS said FROM c),
        m AS (SELECT hit, real, CASE WHEN said > 0 THEN hit / said ELSE 0.0 END::DOUBLE AS p, CASE WHEN real > 0 THEN hit / real ELSE 0.0 END::DOUBLE AS r FROM b)
        SELECT round(sum(hit) / sum(real), 6) AS accuracy, round(sum(p * real) / sum(real), 6) AS precision, round(sum(r * real) / sum(real), 6) AS recall,
          round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * real) / sum(real), 6) AS f1 FROM m""",
}
