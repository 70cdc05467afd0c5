"""The window job: every micro-batch goes from exact matches to graph, walks, embeddings, neighbours and decisions.

The records that a batch's windows judge and that equal no earlier one join the graph. Walks start at them, over the whole graph so far; the
embeddings go on from the state before; the new records look for their nearest neighbours among all; the decision says which
are matches. What is kept: nodes and edges, the state of the embeddings, the similarities by round, the change log, and the versions of the
pairs. All of it is parquet under the matcher's folder, a subfolder per batch that a repeated batch replaces, so a batch may run twice. The
graph and the embeddings are whole tables, of which the last two are kept; similarities and versions are added to.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import decide, embed, graph, knn, simstore, state, walks
from samewise.sources.shared import remove, written
from samewise.streaming.matcher import Matcher

NODES = "name string, type string, numeric boolean, frequency_in_graph long, isfirst boolean, isroot boolean, isappear boolean"
EDGES = "src string, dst string"
SCORES = "key string, word string, score double, pos long"
VERSIONS = "pair_key string, rid_i string, rid_j string, version int, ts timestamp, score double, stage string, decision string, transaction string, active boolean"


class Job:
    def __init__(self, matcher: Matcher, config: dict[str, Any], out: str) -> None:
        """config has the sections graph, walks, embeddings and similarity_list; out names the similarity lists and the change log."""
        self.matcher, self.config, self.out = matcher, config, out
        self.spark: SparkSession = matcher.spark

    def process(self, records: DataFrame, batch: int) -> None:
        """The function for foreachBatch."""
        self.matcher.process(records, batch)
        self._round(batch)

    def flush(self, batch: int) -> None:
        self.matcher.flush(batch)
        self._round(batch + 1)

    def latest(self) -> int:
        return self.matcher.latest()

    def _old(self, name: str, schema: str, batch: int, only: bool = True) -> DataFrame:
        return self.matcher._read(name, schema, batch - 1, only)

    def _keep(self, name: str, batch: int, rows: DataFrame, schema: str, whole: bool = True) -> DataFrame:
        self.matcher._write(name, batch, rows)
        if whole and batch >= 2:
            remove(self.spark, f"{self.matcher.base}/{name}/batch={batch - 2}")
        return self.matcher._read(name, schema, batch, True)

    def _round(self, batch: int) -> None:
        m, g, e, lists = self.matcher, self.config["graph"], self.config["embeddings"], self.config["similarity_list"]
        judged = m.matches(batch, only=True)
        alike = (F.col("survivor") != F.col("rid")) | F.col("match").isNotNull()
        equal = written(judged.where(alike).select(F.col("rid").alias("a"), F.coalesce("match", "survivor").alias("b")), "equal")
        fresh = written(m.records(batch).join(judged.where(~alike).select("rid"), "rid"), "fresh")

        cells = graph.cells(fresh, "rid", m.columns)
        touched = written(graph.touches(cells, g["flatten"], g.get("ngrams", ())), "graph-touches")
        nodes = graph.merged(self._old("nodes", NODES, batch), graph.nodes(cells, touched, graph.parse_types(g["node_types"])).select(*[c.split()[0] for c in NODES.split(", ")]))
        nodes = self._keep("nodes", batch, nodes, NODES)
        edges = self._keep("edges", batch, self._old("edges", EDGES, batch).union(graph.edges(touched)).distinct(), EDGES)

        before = self._old("embeddings", embed.STATE, batch)
        started = before.limit(1).count() > 0
        lines = written(self._walks(fresh, nodes, edges), "walks")
        corpus = embed.with_subwords(lines) if e["training_algorithm"] == "fasttext" else lines
        trained = embed.trained(corpus, before if started else None, size=e["n_dimensions"], window=e["window_size"], negative=e["negative"], epochs=e["inc_epochs"] if started else e["epochs"], cbow=e["learning_method"] == "CBOW")
        vectors = written(embed.records_only(self._keep("embeddings", batch, trained, embed.STATE)), "vectors")

        near = written(knn.topk(vectors, lists["top_k"], queries=vectors.join(fresh.select(F.col("rid").alias("vec_id")), "vec_id", "left_semi")), "neighbours")
        found = written(decide.decided(near), "decided")
        self._similarities(batch, near, equal)
        simstore.append_changes(near, f"{self.out}-changes", batch)
        pair = lambda a, b, score: [F.concat(F.lit("idx__"), a).alias("rid_i"), F.concat(F.lit("idx__"), b).alias("rid_j"), F.current_timestamp().alias("ts"), score.cast("double").alias("score"), F.lit(None).cast("string").alias("stage"), F.lit("match").alias("decision")]
        changes = equal.select(*pair("a", "b", F.lit(1.0))).union(found.select(*pair("row", "col", F.col("score"))))
        self._keep("versions", batch, state.appended(self.versions(batch - 1), changes), VERSIONS, whole=False)

    def _walks(self, fresh: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        w = self.config["walks"]
        starts = walks.rooted(fresh.select(F.concat(F.lit("idx__"), "rid").alias("name"), F.col("rid").alias("number")), w["walks_number"])
        seen = nodes.select("name", "isfirst", "isappear")
        arcs = graph.both_ways(edges)
        first = arcs.join(nodes.where("isfirst").select(F.col("name").alias("dst")), "dst").select("src", "dst")
        index = walks.index_of(nodes, edges, self.config["graph"]["smoothing_method"])
        return walks.walk(starts, index, w["walk_length"], nodes=seen, first_index=graph.numbered(first), backtrack=w["backtrack"])

    def _similarities(self, batch: int, near: DataFrame, equal: DataFrame) -> None:
        """The lists by record, from the neighbours of all rounds, equal records, and what these imply."""
        name = lambda c: F.concat(F.lit("idx__"), c)
        old = self._old("scores", SCORES, batch, only=False)
        ones = old.where("score = 1.0").select(F.expr("cast(substr(key, 6) as bigint)").alias("key"), F.expr("cast(substr(word, 6) as bigint)").alias("other"), "score")
        both = simstore.propagated(ones, equal)
        exact = both.select("a", "b").union(both.select("b", "a")).select(name("a").alias("key"), name("b").alias("word"), F.lit(1.0).alias("score"))
        found = near.select(name("row").alias("key"), name("col").alias("word"), F.col("sim").alias("score"))
        back = found.select(F.col("word").alias("key"), F.col("key").alias("word"), "score")
        rows = exact.union(found).union(back).groupBy("key", "word").agg(F.max("score").alias("score")).withColumn("pos", F.lit(batch).cast("long"))
        self._keep("scores", batch, rows, SCORES, whole=False)
        latest = self.matcher._read("scores", SCORES, batch, False).withColumn("pos", -F.col("pos"))  # of a pair, the last round's counts
        self.write(simstore.heaps(latest, self.config["similarity_list"]["simlist_n"]))

    def rebuild(self, batch: int) -> None:
        """The lists anew, with every record up to this batch as a query, and the equal ones; what the rounds kept stays."""
        vectors = written(embed.records_only(self._old("embeddings", embed.STATE, batch + 1)), "vectors")
        near = written(knn.topk(vectors, self.config["similarity_list"]["top_k"]), "neighbours")
        name = lambda c: F.concat(F.lit("idx__"), c)
        found = near.select(name("row").alias("key"), name("col").alias("word"), F.col("sim").alias("score"))
        ones = self._old("scores", SCORES, batch + 1, only=False).where("score = 1.0").select("key", "word", "score")
        both = found.union(found.select(F.col("word").alias("key"), F.col("key").alias("word"), "score")).union(ones)
        rows = both.groupBy("key", "word").agg(F.max("score").alias("score")).withColumn("pos", F.lit(0).cast("long"))
        self.write(simstore.heaps(rows, self.config["similarity_list"]["simlist_n"]))

    def write(self, heap: DataFrame) -> None:
        """The lists in the format asked for; with graphml they are parquet, and get the table of edges beside them, for graph_files.graphml()."""
        fmt = self.config["similarity_list"]["output_format"]
        heap = written(heap, "heap")
        own = "parquet" if fmt == "graphml" else fmt
        simstore.write_lists(heap, f"{self.out}-similarities.{own}", own)
        if fmt == "graphml":
            simstore.write_edges(heap.where("key < word").select(F.col("key").alias("a"), F.col("word").alias("b"), F.col("score").alias("weight")), f"{self.out}-edges")

    def versions(self, batch: int = 1 << 60) -> DataFrame:
        return self.matcher._read("versions", VERSIONS, batch, False)
