"""Queries on similarity lists, groups and match states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import simstore, state
from samewise.plans.tables import table
from samewise.plans.vectors import knn_sql, neighbours
from samewise.sources.shared import written

EQUAL = 0.42  # at and above it, two vectors count as equal here


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a similarity of user and type, in the order of time; the score is the value to two places."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("word"), F.round("value", 2).alias("score"), F.struct("ts", "event_id").alias("pos"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours(spark, sf_dir, 5)
    return n.groupBy(F.least("row", "col").alias("a"), F.greatest("row", "col").alias("b")).agg(F.max(F.round("sim", 6)).alias("weight"))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = written(_edges(spark, sf_dir), "edges")
    records = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"))
    return edges, written(simstore.groups(records, edges.where(F.col("weight") >= EQUAL).select("a", "b")), "groups")


def sim_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simstore.heaps(_scores(spark, sf_dir), 3)


def similar_words_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simstore.sharing(simstore.heaps(_scores(spark, sf_dir), 3))


def edge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simstore.edge_cap(_edges(spark, sf_dir), 3)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simstore.members(_groups(spark, sf_dir)[1])


def contracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, grouped = _groups(spark, sf_dir)
    return simstore.contracted(edges.where(F.col("weight") < EQUAL), grouped)


def exact_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(_edges(spark, sf_dir), "edges")
    old = edges.where((F.col("weight") >= 0.4) & ((F.col("a") + F.col("b")) % 2 == 0)).select(F.col("a").alias("key"), F.col("b").alias("other"), F.lit(1.0).alias("score"))
    return simstore.propagated(old, edges.where((F.col("weight") >= 0.4) & ((F.col("a") + F.col("b")) % 2 == 1)).select("a", "b"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    decision = F.when(F.col("value") > 80, "accepted").when(F.col("value") < 5, "rejected")
    score = F.when(F.col("event_id") % 3 != 1, F.round("value", 2))
    return e.select(F.col("user_id").cast("string").alias("rid_i"), F.col("event_type").alias("rid_j"), "ts", "event_id", score.alias("score"), F.lit(None).cast("string").alias("stage"), decision.alias("decision"))


def match_state_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.versions(_changes(spark, sf_dir), ("ts", "event_id")).select("pair_key", "version", "event_id", "score", "stage", "decision", "transaction", "active")


def match_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(match_state_versions(spark, sf_dir))


def match_state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(match_state_versions(spark, sf_dir), "1::click")


QUERIES = {f.__name__: f for f in (sim_heap, similar_words_validate, edge_cap, groups, members, contracted_edges, exact_propagation, match_state_versions, match_state_latest, match_state_history)}

_HEAP = """h AS (SELECT key, word, score, rank FROM (SELECT key, word, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, word DESC)::INTEGER AS rank
    FROM (SELECT user_id AS key, event_type AS word, round(arg_min(value, (ts, event_id)), 2) AS score FROM events GROUP BY ALL)) WHERE rank <= 3)"""
_EDGES = f"{knn_sql(5)}, e AS (SELECT least(row, col) AS a, greatest(row, col) AS b, max(round(sim, 6)) AS weight FROM nn GROUP BY ALL)"
_GROUPS = f"""{_EDGES}, q AS (SELECT a, b FROM e WHERE weight >= {EQUAL} UNION SELECT b, a FROM e WHERE weight >= {EQUAL}),
    reach AS (SELECT vec_id AS rid, vec_id AS other FROM embeddings UNION SELECT reach.rid, q.b FROM reach JOIN q ON reach.other = q.a),
    gr AS (SELECT rid, min(other) AS "group" FROM reach GROUP BY rid)"""
_EXACT = f"{_EDGES}, o AS (SELECT a, b FROM e WHERE weight >= 0.4 AND (a + b) % 2 = 0), f AS (SELECT a, b FROM e WHERE weight >= 0.4 AND (a + b) % 2 = 1), oo AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o)"
_STATE = """v AS (SELECT user_id::VARCHAR || '::' || event_type AS pair_key, row_number() OVER w ::INTEGER AS version, event_id,
    last_value(CASE WHEN event_id % 3 <> 1 THEN round(value, 2) END IGNORE NULLS) OVER u AS score, CASE WHEN row_number() OVER w = 1 THEN 'PM' ELSE 'CM' END AS stage,
    coalesce(last_value(CASE WHEN value > 80 THEN 'accepted' WHEN value < 5 THEN 'rejected' END IGNORE NULLS) OVER u, 'tentative') AS decision, 'pending' AS transaction, true AS active
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id), u AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
ORACLE = {
    "sim_heap": f"WITH {_HEAP} SELECT * FROM h",
    "similar_words_validate": f"WITH {_HEAP} SELECT x.key AS a, y.key AS b, count(*) AS n_common FROM h x JOIN h y ON x.word = y.word AND x.score = y.score AND x.key < y.key GROUP BY ALL",
    "edge_cap": f"""WITH {_EDGES}, d AS (SELECT *, unnest([a, b]) AS node FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, a, b) AS rank FROM d)
        SELECT a, b, weight FROM r WHERE rank <= 3 GROUP BY ALL HAVING count(*) = 2""",
    "groups": f'WITH RECURSIVE {_GROUPS} SELECT rid, "group" FROM gr',
    "members": f"""WITH RECURSIVE {_GROUPS} SELECT "group", count(*) AS n_members, string_agg(rid::VARCHAR, ',' ORDER BY rid) AS members FROM gr GROUP BY "group\"""",
    "contracted_edges": f"""WITH RECURSIVE {_GROUPS}, z AS (SELECT x."group" AS ga, y."group" AS gb, weight FROM e JOIN gr x ON e.a = x.rid JOIN gr y ON e.b = y.rid WHERE weight < {EQUAL})
        SELECT least(ga, gb) AS a, greatest(ga, gb) AS b, max(weight) AS weight FROM z WHERE ga <> gb GROUP BY ALL""",
    "exact_propagation": f"WITH {_EXACT}, i AS (SELECT f.a, oo.b FROM f JOIN oo ON f.b = oo.a WHERE f.a <> oo.b) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, b FROM f UNION ALL SELECT a, b FROM i)",
    "match_state_versions": f"WITH {_STATE} SELECT * FROM v",
    "match_state_latest": f"WITH {_STATE} SELECT * FROM v QUALIFY version = max(version) OVER (PARTITION BY pair_key)",
    "match_state_history": f"WITH {_STATE} SELECT * FROM v WHERE pair_key = '1::click'",
}
