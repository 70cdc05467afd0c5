"""Queries on the record graph and its walks, over customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import graph, walks
from samewise.plans.tables import table
from samewise.sources.shared import written

COLUMNS = ("c_name", "c_nationkey", "c_mktsegment")
SEED, HOPS = 7, 4
PATHS = (("customer", "nation", "region"), ("segment", "nation"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cells(table(spark, sf_dir, "customer"), "c_custkey", COLUMNS)


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touches(_cells(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(graph.edges(_touches(spark, sf_dir)), "graph-edges")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_cells(spark, sf_dir), _touches(spark, sf_dir))


def graph_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("name", "type", "numeric", "isfirst", "isroot", "isappear")


def graph_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("name", "frequency_in_graph")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_touches(spark, sf_dir))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph_edges(spark, sf_dir))


def graph_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = graph.cells(table(spark, sf_dir, "part"), "p_partkey", ("p_name", "p_type"))
    return graph.touches(part, grams=(2, 3)).where("kind = 2").select("rid", "col", "name").distinct()


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph_edges(spark, sf_dir)).select("name", F.array_join("neighbours", ",").alias("neighbours"))


def neighbour_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.indexed(_edges(spark, sf_dir))


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all customers, from that of the even ones and the nodes that the odd ones change."""
    cells = _cells(spark, sf_dir)
    touched = [graph.touches(cells.where(F.col("rid_num") % 2 == i)) for i in (0, 1)]
    old, new = (written(graph.edges(x), "graph-edges") for x in touched)
    changed = new.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return graph.refreshed(written(graph.indexed(old), "index"), old.union(new).distinct(), changed)


def record_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every tenth customer, read back from the graph."""
    names = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.concat(F.lit("idx__"), "c_custkey").alias("name"))
    return graph.neighbours(_nodes(spark, sf_dir), _edges(spark, sf_dir), names)


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def graph_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.concat(F.lit("idx__"), "c_custkey").alias("name"))
    return graph.removed(_nodes(spark, sf_dir), _edges(spark, sf_dir), gone)[1]


def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequencies after a second window: the customers with odd keys come after the others."""
    cells = _cells(spark, sf_dir)
    halves = [cells.where(F.col("rid_num") % 2 == i) for i in (0, 1)]
    old, new = (graph.nodes(h, graph.touches(h)) for h in halves)
    return graph.merged(old, new).select("name", "frequency_in_graph")


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.concat(F.lit("idx__"), "c_custkey").alias("name"))
    return graph.affected(_edges(spark, sf_dir), touched)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = written(_nodes(spark, sf_dir), "graph-nodes"), _edges(spark, sf_dir)
    totals = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("frequency_in_graph").alias("words"))
    return nodes.join(graph.degrees(edges), "name", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(totals))  # one row


def smooth_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in ("n_nodes", "words", "frequency_in_graph", "degree")]
    return _weights(spark, sf_dir).select("name", *[F.round(graph.smooth_weight(k, *cols), 6).alias(k.lower()) for k in ("ICF", "IDF", "log", "no")])


def rare_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, d, one = F.col("frequency_in_graph"), F.col("degree"), F.lit(1.0)
    return _weights(spark, sf_dir).select("name", *[F.round(graph.rare_weight(k, f, d, 0.7, one), 6).alias(k or "none") for k in ("idf", "degree", None)])


def sample_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = graph.rare_weight("idf", F.col("frequency_in_graph"), F.col("degree"), 0.7, F.lit(1.0))
    return _weights(spark, sf_dir).select("name", F.round(graph.sampling_weight(F.lit(1.0), rare), 6).alias("weight"))


def meta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.col("c_name").alias("customer"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))
    return graph.meta_edges(graph.cells(rows, "c_custkey", ("customer", "nation", "region", "segment")), PATHS)


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "customer").select(F.concat(F.lit("idx__"), "c_custkey").alias("name"), F.col("c_custkey").alias("number"))
    return walks.rooted(roots, 2)


def _path(df: DataFrame) -> DataFrame:
    return df.select("walk_id", "root", F.array_join("path", ">").alias("path"))


def uniform_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(walks.walk(_starts(spark, sf_dir), graph.indexed(_edges(spark, sf_dir)), HOPS + 1, seed=SEED))


def hidden_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hops that go through columns without naming them and never name a node twice running."""
    nodes = _nodes(spark, sf_dir).select("name", "isfirst", (F.col("type") != "cid").alias("isappear"))
    return _path(walks.walk(_starts(spark, sf_dir), graph.indexed(_edges(spark, sf_dir)), HOPS + 1, nodes=nodes, backtrack=False, max_hops=HOPS, seed=SEED))


def first_node_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of two nodes from records, which may not come first and are put after a value."""
    edges = _edges(spark, sf_dir)
    nodes = _nodes(spark, sf_dir).select("name", "isfirst", F.lit(True).alias("isappear"))
    both = graph.both_ways(edges).join(nodes.where("isfirst").select(F.col("name").alias("dst")), "dst").select("src", "dst")
    return _path(walks.walk(_starts(spark, sf_dir), graph.indexed(edges), 2, nodes=nodes, first_index=graph.numbered(both), seed=SEED))


def metapath_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).select("name", "type")
    return _path(walks.metapath(_starts(spark, sf_dir), _edges(spark, sf_dir), nodes, ("idx", "tt", "idx", "tn"), HOPS + 1, SEED))


def row_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjacent = graph.adjacency(_edges(spark, sf_dir)).where(F.col("name").startswith("idx__")).withColumn("number", F.expr("cast(substr(name, 6) as bigint)"))
    return walks.row_walk(adjacent, 6, SEED).select("root", F.array_join("path", ">").alias("path"))


def weighted_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks that prefer rare nodes."""
    found = _weights(spark, sf_dir)
    rare = graph.rare_weight("idf", F.col("frequency_in_graph"), F.col("degree"), 0.7, F.lit(1.0))
    weights = found.select("name", graph.sampling_weight(F.lit(1.0), rare).alias("weight"))
    return _path(walks.walk(_starts(spark, sf_dir), graph.weighted(graph.both_ways(_edges(spark, sf_dir)), weights), HOPS + 1, seed=SEED))


def multiscale_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.multiscale(_starts(spark, sf_dir), graph.indexed(_edges(spark, sf_dir)), ((3, 2), (4, 1)), SEED).select("scale", "walk_id", F.array_join("path", ">").alias("path"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(walks.visits(walks.walk(_starts(spark, sf_dir), graph.indexed(_edges(spark, sf_dir)), HOPS + 1, seed=SEED)), "visits")


def walk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = walks.statistics(_nodes(spark, sf_dir), _seen(spark, sf_dir))
    return found.withColumn("mean_visits", F.round("mean_visits", 6))


def visit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = walks.histogram(_seen(spark, sf_dir))
    return found.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("density", "mean", "std")])


QUERIES = {f.__name__: f for f in (graph_cells, graph_nodes, graph_freq, graph_edges, graph_degree, graph_ngrams, adjacency, neighbour_index, index_refresh, record_neighbours, graph_summary, graph_delete, graph_merge, affected, smooth_weight, rare_weight, sample_weight, meta_edges, uniform_walk, hidden_walk, first_node_walk, metapath_walk, row_walk, weighted_walk, multiscale_walk, walk_stats, visit_histogram)}

_CLEAN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
_CELLS = """cells AS (SELECT 'idx__' || c_custkey AS rid, c_custkey AS rid_num, 0 AS col_pos, 'c_name' AS col, c_name AS value FROM customer
    UNION ALL SELECT 'idx__' || c_custkey, c_custkey, 1, 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'idx__' || c_custkey, c_custkey, 2, 'c_mktsegment', c_mktsegment FROM customer)"""
_TOUCH = f"""{_CELLS}, base AS (SELECT *, CASE WHEN col = 'c_nationkey' THEN value ELSE {_CLEAN.format("value")} END AS token, CASE WHEN col = 'c_nationkey' THEN 'tn' ELSE 'tt' END AS type FROM cells),
    touch AS (SELECT rid, rid_num, col, col_pos, 0 AS kind, 'tt__' || token AS name, type, type = 'tn' AS numeric FROM base
      UNION ALL SELECT rid, rid_num, col, col_pos, 1, 'tt__' || p, 'st', false FROM (SELECT *, unnest(string_split(token, '_')) AS p FROM base WHERE type = 'tt') WHERE p <> '')"""
_NODE = f"""{_TOUCH}, every AS (SELECT name, type, numeric, rid_num, col_pos, kind FROM touch UNION ALL SELECT DISTINCT rid, 'idx', false, rid_num, -1, 0 FROM cells UNION ALL SELECT 'cid__' || col, 'cid', false, rid_num, col_pos, -1 FROM cells),
    node AS (SELECT name, arg_min(type, (rid_num, col_pos, kind, type)) AS type, arg_min(numeric, (rid_num, col_pos, kind, type)) AS numeric, count(*) AS frequency_in_graph FROM every GROUP BY name)"""
_EDGE = "edge AS (SELECT DISTINCT least(name, other) AS src, greatest(name, other) AS dst FROM (SELECT name, unnest([rid, 'cid__' || col]) AS other FROM touch) WHERE name <> other)"
_BOTH = "arcs AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge)"
_INDEX = "idx AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 3), dst) - 1 AS at, dst, count(*) OVER (PARTITION BY src) AS n FROM arcs)"
_GRAPH = f"{_NODE}, {_EDGE}, {_BOTH}"
_WALKED = "start AS (SELECT c_custkey * 2 + i AS walk_id, 'idx__' || c_custkey AS root FROM customer, (SELECT unnest([0, 1]) AS i))"


def _draw(step: int, seed: int = SEED) -> str:
    return f"('0x' || substr(md5(walk_id || ':{step}:{seed}'), 1, 13))::BIGINT"


def _hops(n: int, seed: int = SEED, start: str = "start", name: str = "w") -> str:
    """CTEs name0..name<n> of walks whose path is named at every hop."""
    out = [f"{name}0 AS (SELECT walk_id, root, root AS node, [root] AS path FROM {start})"]
    for i in range(1, n + 1):
        out.append(f"{name}{i} AS (SELECT walk_id, root, idx.dst AS node, list_append(path, idx.dst) AS path FROM {name}{i - 1} w JOIN idx ON w.node = idx.src AND idx.at = {_draw(i, seed)} % idx.n)")
    return ", ".join(out)


def _weighted_hops() -> str:
    out = ["w0 AS (SELECT walk_id, root, root AS node, [root] AS path FROM start)"]
    for i in range(1, HOPS + 1):
        out.append(f"w{i} AS (SELECT walk_id, root, line.dst AS node, list_append(path, line.dst) AS path FROM w{i - 1} w JOIN line ON w.node = line.src AND {_draw(i)} % line.total >= line.hi - line.w AND {_draw(i)} % line.total < line.hi)")
    return ", ".join(out)


def _hidden() -> str:
    out = ["w0 AS (SELECT walk_id, root, root AS node, [root] AS path FROM start)"]
    for i in range(1, HOPS + 1):
        out.append(f"w{i} AS (SELECT walk_id, root, idx.dst AS node, CASE WHEN idx.dst NOT LIKE 'cid\\_\\_%' ESCAPE '\\' AND idx.dst <> path[-1] THEN list_append(path, idx.dst) ELSE path END AS path FROM w{i - 1} w JOIN idx ON w.node = idx.src AND idx.at = {_draw(i)} % idx.n)")
    return ", ".join(out)


def _meta() -> str:
    types = ("idx", "tt", "idx", "tn")
    out = ["typed AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src, type ORDER BY substr(md5(dst), 1, 3), dst) - 1 AS at, count(*) OVER (PARTITION BY src, type) AS n FROM arcs JOIN node ON node.name = arcs.dst)", "w0 AS (SELECT walk_id, root, root AS node, [root] AS path FROM start)"]
    for i in range(1, HOPS + 1):
        out.append(f"w{i} AS (SELECT walk_id, root, t.dst AS node, CASE WHEN t.dst IS NULL THEN path ELSE list_append(path, t.dst) END AS path FROM w{i - 1} w LEFT JOIN typed t ON w.node = t.src AND t.type = '{types[i % 4]}' AND t.at = {_draw(i)} % t.n)")
    return ", ".join(out)


_WEIGHT = f"{_GRAPH}, deg AS (SELECT src AS name, count(*) AS degree FROM arcs GROUP BY src), wt AS (SELECT node.name, frequency_in_graph AS f, coalesce(degree, 0) AS d, (SELECT count(*) FROM node) AS n, (SELECT sum(frequency_in_graph) FROM node) AS words FROM node LEFT JOIN deg USING (name))"
_VISITS = f"{_GRAPH}, {_INDEX}, {_WALKED}, {_hops(HOPS)}, seen AS (SELECT name, count(*) AS visits FROM (SELECT unnest(path) AS name FROM w{HOPS}) GROUP BY name)"
_META_ROWS = "SELECT 'customer__' || {0} AS customer, 'nation__' || {1} AS nation, 'region__' || {2} AS region, 'segment__' || {3} AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey".format(*[_CLEAN.format(c) for c in ("c_name", "n_name", "r_name", "c_mktsegment")])
ORACLE = {
    "graph_cells": f"WITH {_CELLS} SELECT rid, rid_num, col, col_pos, value FROM cells",
    "graph_nodes": f"WITH {_NODE}, c AS (SELECT *, CASE type WHEN 'tn' THEN 7 WHEN 'tt' THEN 7 WHEN 'st' THEN 5 WHEN 'idx' THEN 3 ELSE 1 END AS digit FROM node) SELECT name, type, numeric, digit & 4 <> 0 AS isfirst, digit & 2 <> 0 AS isroot, digit & 1 <> 0 AS isappear FROM c",
    "graph_freq": f"WITH {_NODE} SELECT name, frequency_in_graph FROM node",
    "graph_edges": f"WITH {_TOUCH}, {_EDGE} SELECT src, dst FROM edge",
    "graph_degree": f"WITH {_TOUCH}, {_EDGE}, {_BOTH} SELECT src AS name, count(*) AS degree FROM arcs GROUP BY src",
    "graph_ngrams": f"""WITH v AS (SELECT p_partkey, 'p_name' AS col, string_split({_CLEAN.format("p_name")}, '_') AS t FROM part UNION ALL SELECT p_partkey, 'p_type', string_split({_CLEAN.format("p_type")}, '_') FROM part)
        SELECT DISTINCT 'idx__' || p_partkey AS rid, col, 'ng::' || n || '::' || array_to_string(t[i:i + n - 1], '{graph.SEPARATOR}') AS name FROM (SELECT p_partkey, col, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM v, (SELECT unnest([2, 3]) AS n))""",
    "adjacency": f"WITH {_TOUCH}, {_EDGE}, {_BOTH} SELECT src AS name, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM arcs GROUP BY src",
    "neighbour_index": f"WITH {_TOUCH}, {_EDGE}, {_BOTH}, {_INDEX} SELECT src, idx.at AS \"at\", dst FROM idx",
    "index_refresh": f"WITH {_TOUCH}, {_EDGE}, {_BOTH}, {_INDEX} SELECT src, idx.at AS \"at\", dst FROM idx",
    "record_neighbours": f"WITH {_GRAPH} SELECT src AS name, dst AS neighbour, type FROM arcs JOIN node ON node.name = dst WHERE src LIKE 'idx%' AND substr(src, 6)::BIGINT % 10 = 3",
    "graph_summary": f"WITH {_GRAPH}, deg AS (SELECT src AS name, count(*) AS degree FROM arcs GROUP BY src) SELECT type, count(*) AS n_nodes, sum(frequency_in_graph)::BIGINT AS frequency, sum(coalesce(degree, 0))::BIGINT AS degree, max(coalesce(degree, 0)) AS most FROM node LEFT JOIN deg USING (name) GROUP BY type",
    "graph_delete": f"WITH {_TOUCH}, {_EDGE}, gone AS (SELECT 'idx__' || c_custkey AS name FROM customer WHERE c_custkey % 10 = 3) SELECT src, dst FROM edge WHERE src NOT IN (SELECT name FROM gone) AND dst NOT IN (SELECT name FROM gone)",
    "graph_merge": f"WITH {_NODE} SELECT name, frequency_in_graph FROM node",
    "affected": f"WITH {_TOUCH}, {_EDGE}, {_BOTH}, n AS (SELECT 'idx__' || c_custkey AS name FROM customer WHERE c_custkey % 10 = 3) SELECT name FROM n UNION SELECT dst FROM arcs WHERE src IN (SELECT name FROM n)",
    "smooth_weight": f"WITH {_WEIGHT} SELECT name, round(ln(n / (d + 1.0::DOUBLE)), 6) AS icf, round(ln(words / (f + 1.0::DOUBLE)), 6) AS idf, round(1.0::DOUBLE / (ln(greatest(d, 1) + 1.0::DOUBLE) + 1.0::DOUBLE), 6) AS log, 1.0::DOUBLE AS no FROM wt",
    "rare_weight": f"WITH {_WEIGHT} SELECT name, round(pow(1.0::DOUBLE / (f + 1), 0.7), 6) AS idf, round(pow(1.0::DOUBLE / (d + 1), 0.7), 6) AS degree, 1.0::DOUBLE AS none FROM wt",
    "sample_weight": f"WITH {_WEIGHT} SELECT name, round(greatest(1e-12, pow(1.0::DOUBLE / (f + 1), 0.7)), 6) AS weight FROM wt",
    "meta_edges": f"WITH r AS ({_META_ROWS}) SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM (SELECT customer AS x, nation AS y FROM r UNION ALL SELECT nation, region FROM r UNION ALL SELECT nation, segment FROM r)",
    "uniform_walk": f"WITH {_GRAPH}, {_INDEX}, {_WALKED}, {_hops(HOPS)} SELECT walk_id, root, array_to_string(path, '>') AS path FROM w{HOPS}",
    "hidden_walk": f"WITH {_GRAPH}, {_INDEX}, {_WALKED}, {_hidden()} SELECT walk_id, root, array_to_string(path, '>') AS path FROM w{HOPS}",
    "first_node_walk": f"""WITH {_GRAPH}, {_WALKED}, f AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 3), dst) - 1 AS at, count(*) OVER (PARTITION BY src) AS n FROM arcs JOIN node ON node.name = arcs.dst WHERE type IN ('tn', 'tt', 'st'))
        SELECT walk_id, root, f.dst || '>' || root AS path FROM start JOIN f ON f.src = root AND f.at = {_draw(0)} % f.n""",
    "metapath_walk": f"WITH {_GRAPH}, {_WALKED}, {_meta()} SELECT walk_id, root, array_to_string(path, '>') AS path FROM w{HOPS}",
    "row_walk": f"""WITH {_TOUCH}, {_EDGE}, {_BOTH}, a AS (SELECT src, list(dst ORDER BY dst) AS l FROM arcs WHERE src LIKE 'idx%' GROUP BY src), p AS (SELECT src AS root, substr(src, 6)::BIGINT AS number, l, unnest([1, 2, 3]) AS i FROM a)
        SELECT root, string_agg(root || '>' || l[('0x' || substr(md5(number || ':' || i || ':{SEED}'), 1, 13))::BIGINT % len(l) + 1], '>' ORDER BY i) AS path FROM p GROUP BY root""",
    "weighted_walk": f"""WITH {_WEIGHT}, line AS (SELECT src, dst, w, sum(w) OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 3), dst) AS hi, sum(w) OVER (PARTITION BY src) AS total
          FROM (SELECT src, dst, greatest(1, round(greatest(1e-12, pow(1.0::DOUBLE / (f + 1), 0.7)) * 1000000))::BIGINT AS w FROM arcs JOIN wt ON wt.name = arcs.dst)), {_WALKED}, {_weighted_hops()}
        SELECT walk_id, root, array_to_string(path, '>') AS path FROM w{HOPS}""",
    "multiscale_walk": f"""WITH {_GRAPH}, {_INDEX}, {_WALKED}, two AS (SELECT walk_id * 2 + i AS walk_id, root FROM start, (SELECT unnest([0, 1]) AS i)),
        {_hops(2, SEED, "two", "x")}, {_hops(3, SEED + 1, "start", "y")} SELECT 3 AS scale, walk_id, array_to_string(path, '>') AS path FROM x2 UNION ALL SELECT 4, walk_id, array_to_string(path, '>') FROM y3""",
    "walk_stats": f"""WITH {_VISITS} SELECT type, count(*) AS n_nodes, round(avg(coalesce(visits, 0)), 6) AS mean_visits, count(*) FILTER (WHERE visits IS NULL) AS never_visited, max(coalesce(visits, 0)) AS most_visits,
        arg_min(name, (-coalesce(visits, 0), name)) AS most_visited FROM node LEFT JOIN seen USING (name) GROUP BY type""",
    "visit_histogram": f"""WITH {_VISITS}, z AS (SELECT min(visits) AS lo, max(visits) AS hi, avg(visits) AS mean, stddev_pop(visits) AS std, count(*) AS total FROM seen),
        b AS (SELECT least(floor((visits - lo) / ((hi - lo) / 30.0::DOUBLE)), 29)::INTEGER AS bin, (hi - lo) / 30.0::DOUBLE AS width, mean, std, total FROM seen, z)
        SELECT bin, count(*) AS n, round(count(*) / (total * width), 6) AS density, round(mean, 6) AS mean, round(std, 6) AS std FROM b GROUP BY bin, width, mean, std, total""",
}
