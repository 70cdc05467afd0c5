"""Queries on windows, streams, labelled pairs and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.text import token_key
from samewise.operators import classify, embed, graph, walks
from samewise.operators.pairs import compared
from samewise.plans import graphs
from samewise.plans.tables import table
from samewise.plans.texts import PART_KEY
from samewise.sources.records import pair_texts, set_of
from samewise.sources.shared import fresh_path, written
from samewise.streaming import job, matcher, windows

COUNT, STRIDE = 130, 50


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.in_order(table(spark, sf_dir, "events"), "ts", "event_id")


def _summary(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.round(F.sum("value"), 4).alias("total"))


def count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_numbered(spark, sf_dir).withColumn("window_id", windows.tumbling(F.col("n"), COUNT)), "window_id")


def sliding_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that fill up; the residual rows are a flush's."""
    return _summary(windows.sliding(_numbered(spark, sf_dir), "n", COUNT, STRIDE), "window_id").where(F.col("n") == COUNT)


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(windows.by_time(table(spark, sf_dir, "events"), "ts", "6 hours", "2 hours"), "window_start")


def window_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir).select(windows.tumbling(F.col("n"), COUNT).alias("window_id"), "event_id", token_key([F.col("event_type"), F.col("props")]).alias("token_key"))
    return rows.groupBy("window_id", "token_key").agg(F.min("event_id").alias("survivor"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")


def stream_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream through the matcher: windows, exact matches within and across them, and the last flush."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = matcher.Matcher(spark, fresh_path(spark, "stream"), ("event_type", "props"), ("event_id",), COUNT)
    matcher.run(stream, found, fresh_path(spark, "stream-checkpoint"))
    return found.matches()


JOB = {
    "graph": {"flatten": ["tt"], "node_types": ["7#__tn", "7$__tt", "5$__st", "3$__idx", "1$__cid"], "smoothing_method": "no"},
    "walks": {"walk_length": 4, "walks_number": 1, "backtrack": False},
    "embeddings": {"learning_method": "skipgram", "window_size": 2, "negative": 2, "epochs": 1, "inc_epochs": 1, "n_dimensions": 8, "training_algorithm": "word2vec"},
    "similarity_list": {"top_k": 3, "simlist_n": 3, "output_format": "parquet"},
}


def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a file stream through the window job: the versions of the pairs that are equal records."""
    schema = table(spark, sf_dir, "part").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir)
    found = matcher.Matcher(spark, fresh_path(spark, "job"), ("p_name", "p_brand", "p_type"), ("p_partkey",), COUNT)
    done = job.Job(found, JOB, fresh_path(spark, "job-out"))
    matcher.run(stream, done, fresh_path(spark, "job-checkpoint"))
    equal = found.matches().where("survivor <> rid OR match IS NOT NULL").select(F.concat(F.lit("idx__"), "rid").alias("rid_i"), F.concat(F.lit("idx__"), F.coalesce("match", "survivor")).alias("rid_j"))
    return done.versions().join(equal, ["rid_i", "rid_j"]).select("pair_key", "rid_i", "rid_j", "version", "score", "stage", "decision", "active")


def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey)
    named = rows.select(F.col("s_suppkey").alias("left1.id"), F.col("s_name").alias("left1.name"), F.col("s_nationkey").alias("left1.nation"), F.col("n_nationkey").alias("right2.id"), F.col("n_name").alias("right2.name"), F.col("n_regionkey").alias("right2.region"), (F.col("s_suppkey") % 2).alias("label"))
    return pair_texts(named)


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"), "event_type")
    text = F.to_json(F.array(F.col("event_type"), F.col("p.k").cast("string")))
    back = F.from_json(text, "array<string>")
    return e.select("event_id", F.col("p.k").alias("k"), text.alias("text"), back[0].alias("event_type"))


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = graphs._starts(spark, sf_dir)
    return written(walks.walk(starts, graph.indexed(graphs._edges(spark, sf_dir)), 7, seed=graphs.SEED), "walks")


def w2v_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed.word2vec(_walked(spark, sf_dir), size=16, epochs=1)
    return found.select("word", F.size("vec").alias("dimensions"))


def sgns_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first training on half of the walks, and a second one on the rest that goes on from it."""
    lines = _walked(spark, sf_dir)
    odd = F.col("walk_id") % 2 == 1
    first = written(embed.trained(lines.where(~odd), size=16, epochs=1), "embeddings")
    return embed.trained(lines.where(odd), first, size=16, epochs=1).select("word", F.size("vec").alias("dimensions"), "n")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts that share a brand and a size, those with equal texts and set as one row with their number; the label is whether
    their types are equal."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_type")
    found = lambda a, b: [F.col(f"{a}.text").alias("text1"), F.col(f"{b}.text").alias("text2"), (F.col(f"{a}.p_type") == F.col(f"{b}.p_type")).cast("int").alias("labels")]
    pairs = compared(p, "p_partkey", ("p_brand", "p_size"), ("text", "p_type"), found)
    return pairs.groupBy(set_of(F.concat_ws("-", "a", "b")).alias("set"), "text1", "text2", "labels").agg(F.count(F.lit(1)).alias("n"))


def pair_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = written(_labelled(spark, sf_dir), "pairs")
    model = classify.fitted(pairs.where("set = 'train'"), weight="n")
    return classify.tested(model, pairs.where("set = 'test'"), weight="n")


QUERIES = {f.__name__: f for f in (count_window, sliding_count_window, time_window, window_exact, stream_e2e, stream_match, pair_text, json_roundtrip, w2v_train, sgns_incremental, pair_classifier)}

_KEY = "array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(event_type || '_' || props), '[^a-z0-9]+', '_', 'g'), '_'), '_'), lambda x: x <> '' AND x <> 'nan'))), ' ')"
_N = "r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events)"
_SUM = "count(*) AS n, min(event_id) AS low, max(event_id) AS high, round(sum(value), 4) AS total"
ORACLE = {
    "count_window": f"WITH {_N} SELECT n // {COUNT} AS window_id, {_SUM} FROM r GROUP BY 1",
    "sliding_count_window": f"WITH {_N}, w AS (SELECT unnest(range((SELECT max(n) FROM r) // {STRIDE} + 1)) AS window_id) SELECT window_id, {_SUM} FROM w JOIN r ON r.n >= window_id * {STRIDE} AND r.n < window_id * {STRIDE} + {COUNT} GROUP BY window_id HAVING count(*) = {COUNT}",
    "time_window": f"SELECT window_start, {_SUM} FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 1 HOURS * i FOR i IN [0, 2, 4]]) AS window_start FROM events) GROUP BY 1",
    "window_exact": f"WITH {_N} SELECT n // {COUNT} AS window_id, {_KEY} AS token_key, min(event_id) AS survivor, count(*) AS n_members FROM r GROUP BY ALL HAVING count(*) > 1",
    "stream_e2e": f"""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS rid, {_KEY} AS k FROM events), w AS (SELECT rid, rid // {COUNT} AS window_id, k FROM r),
        f AS (SELECT *, min(rid) OVER (PARTITION BY k) AS first, min(window_id) OVER (PARTITION BY k) AS fw, min(rid) OVER (PARTITION BY k, window_id) AS survivor FROM w)
        SELECT rid, window_id, survivor, CASE WHEN fw < window_id THEN first END AS match FROM f""",
    "stream_match": f"""WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rid, {PART_KEY} AS k FROM part), w AS (SELECT rid, rid // {COUNT} AS window_id, k FROM r),
        f AS (SELECT *, min(rid) OVER (PARTITION BY k) AS first, min(window_id) OVER (PARTITION BY k) AS fw, min(rid) OVER (PARTITION BY k, window_id) AS survivor FROM w),
        m AS (SELECT 'idx__' || rid AS rid_i, 'idx__' || CASE WHEN fw < window_id THEN first ELSE survivor END AS rid_j FROM f WHERE fw < window_id OR survivor <> rid)
        SELECT rid_i || '::' || rid_j AS pair_key, rid_i, rid_j, 1 AS version, 1.0::DOUBLE AS score, 'PM' AS stage, 'match' AS decision, true AS active FROM m""",
    "pair_text": "SELECT 'name' || s_name || 'nation' || s_nationkey AS text1, 'name' || n_name || 'region' || n_regionkey AS text2, (s_suppkey % 2)::INTEGER AS labels FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "json_roundtrip": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '[\"' || event_type || '\",\"' || json_extract_string(props, '$.k') || '\"]' AS text, event_type FROM events",
}
