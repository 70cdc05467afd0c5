"""Tasks from the command line: ``python -m samewise.app -f config.yaml`` or ``-d folder``."""

from __future__ import annotations

import argparse
import logging
import time
from logging.handlers import RotatingFileHandler
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from samewise import config as conf
from samewise.operators import classify, decide, embed, evaluate, graph, knn, simstore, walks
from samewise.session import session
from samewise.sources import graphs as graph_files
from samewise.sources.records import kafka_stream, pair_texts, read_csv
from samewise.sources.shared import written
from samewise.streaming import matcher
from samewise.streaming.job import Job

log = logging.getLogger("samewise")
LOG_BYTES, LOG_FILES = 5_000_000, 10


class Progress(StreamingQueryListener):
    """Rows taken, batches, seconds of the last one and how far the source is ahead, kept by stream in ``gauges`` and logged."""

    def __init__(self) -> None:
        self.gauges: dict[str, dict[str, Any]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.gauges[str(event.id)] = {"consumed": 0, "batches": 0, "window_seconds": 0.0, "lag": 0}
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        g = self.gauges[str(p.id)]
        g["consumed"] += p.numInputRows
        g["batches"] += 1
        g["window_seconds"] = p.durationMs.get("triggerExecution", 0) / 1000
        g["lag"] = sum(int(float(s.metrics.get("maxOffsetsBehindLatest", 0))) for s in p.sources)  # Kafka's only
        log.info("batch %s: %s rows, %s rows in all, %.3f s, %s behind", p.batchId, p.numInputRows, g["consumed"], g["window_seconds"], g["lag"])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        log.info("stream %s ended", event.id)


def graph_of(records: DataFrame, config: dict[str, Any], key: str = "rid_num") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of records; in meta-path mode, the columns of the paths only."""
    g = config["graph"]
    paths = g["meta_path"] and (g["meta_path"] if isinstance(g["meta_path"][0], list) else [g["meta_path"]])
    columns = [c for c in records.columns if c not in (key, "rid")]
    if paths:
        used = {c for p in paths for c in p}
        cells = graph.cells(records, key, [c for c in columns if c in used])
        edges = graph.meta_edges(cells, paths)
        names = edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("frequency_in_graph"))
        return names.withColumn("type", F.when(F.col("name").startswith("idx__"), "rid").otherwise(F.substring_index("name", "__", 1))).withColumn("isroot", F.col("type") == paths[0][0]), edges
    cells = graph.cells(records, key, columns)
    touched = written(graph.touches(cells, g["flatten"], g.get("ngrams", ())), "graph-touches")
    return graph.nodes(cells, touched, graph.parse_types(g["node_types"])), graph.edges(touched)


def walks_of(nodes: DataFrame, edges: DataFrame, config: dict[str, Any]) -> DataFrame:
    w, g = config["walks"], config["graph"]
    roots = nodes.where("isroot").select("name", F.abs(F.xxhash64("name") % 1_000_000_007).alias("number"))
    starts = walks.rooted(roots, w["walks_number"])
    if g["meta_path"]:
        paths = g["meta_path"] if isinstance(g["meta_path"][0], list) else [g["meta_path"]]
        out = None
        for path in paths:
            mine = walks.rooted(nodes.where(F.col("type") == path[0]).select("name", F.abs(F.xxhash64("name") % 1_000_000_007).alias("number")), w["walks_number"])
            part = walks.metapath(mine, edges, nodes.select("name", "type"), path, w["walk_length"])
            out = part if out is None else out.unionByName(part)
        return out
    seen = nodes.select("name", "isfirst", "isappear")
    first = graph.both_ways(edges).join(nodes.where("isfirst").select(F.col("name").alias("dst")), "dst").select("src", "dst")
    return walks.walk(starts, walks.index_of(nodes, edges, g["smoothing_method"]), w["walk_length"], nodes=seen, first_index=graph.numbered(first), backtrack=w["backtrack"])


def train_batch(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Records into graph, walks and embeddings, all saved; the embeddings."""
    out, e = config["output_file_name"], config["embeddings"]
    nodes, edges = (written(x, "graph") for x in graph_of(read_csv(spark, config["dataset_file"]), config))
    lines = written(walks_of(nodes, edges, config), "walks")
    if config["walks"]["write_walks"]:
        lines.select(F.array_join("path", " ").alias("value")).write.mode("overwrite").text(f"{out}-walks")
    corpus = embed.with_subwords(lines) if e["training_algorithm"] == "fasttext" else lines
    state = spark.read.parquet(config["embeddings_file"]) if config.get("embeddings_file") else None  # of an earlier run, to go on from
    made = embed.trained(corpus, state, size=e["n_dimensions"], window=e["window_size"], negative=e["negative"], epochs=e["epochs"], cbow=e["learning_method"] == "CBOW")
    made.write.mode("overwrite").parquet(f"{out}-embeddings")
    graph_files.save(nodes, edges, f"{out}-graph")
    similarities(spark.read.parquet(f"{out}-embeddings"), config)
    return spark.read.parquet(f"{out}-embeddings")


def similarities(state: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The neighbours of all records, saved as lists that the evaluation reads, and the decided pairs, saved beside them."""
    lists, out = config.get("similarity_list", {}), config["output_file_name"]
    found = written(knn.topk(embed.records_only(state), lists.get("top_k", 10)), "neighbours")
    heap = found.select(F.concat(F.lit("idx__"), "row").alias("key"), F.concat(F.lit("idx__"), "col").alias("word"), F.col("sim").alias("score"), "rank")
    simstore.write_lists(heap, f"{out}-similarities.parquet", "parquet")
    edges = decide.decided(found)
    if config.get("source_a"):
        edges = edges.where((F.col("row") < config["source_a"]) != (F.col("col") < config["source_a"]))
    edges.write.mode("overwrite").parquet(f"{out}-matches")
    return edges


def match_stream(spark: SparkSession, config: dict[str, Any]) -> int:
    """A Kafka topic, or a folder of JSON lines named stream_folder, through the window job, or with exact_only through the matcher alone.

    A window strategy of time makes each micro-batch a window: with window_time seconds, one each; the run then
    goes on until nothing has come for idle_seconds, or, with none, until it is stopped.
    """
    k = config["kafka"]
    columns = config["columns"]
    schema = ", ".join(f"`{c}` string" for c in columns)
    if config.get("stream_folder"):
        raw = spark.readStream.option("maxFilesPerTrigger", config.get("files_per_trigger", 16)).text(config["stream_folder"])
    else:
        raw = kafka_stream(spark, f"{k['bootstrap_servers']}:{k['port']}", k["topicid"])
    rows = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    out = config["output_file_name"]
    by_time = k["window_strategy"] == "time"
    found = matcher.Matcher(spark, f"{out}-state", columns, columns, k.get("window_count", 0), 0 if by_time else k["update_frequency"], by_time)
    live = by_time and not config.get("drain")
    trigger = {"processingTime": f"{k['window_time']} seconds"} if live else {}
    watch = Progress()
    spark.streams.addListener(watch)
    try:
        return matcher.run(rows, found if config.get("exact_only") else Job(found, config, out), f"{out}-checkpoint", idle=k["idle_seconds"] if live else None, **trigger)
    finally:
        spark.streams.removeListener(watch)


def evaluated(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    if not config["source_a"]:
        log.warning("source_a is 0: the truth is not restricted to pairs with a record of source A")
    if config["output_format"] == "graphml":
        scores = graph_files.read_graphml(spark, spark.read.text(config["similarity_file"], wholetext=True).first()[0])
    else:
        scores = evaluate.read_similarities(spark, config["similarity_file"], config["output_format"])
    number = lambda c: F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("long").alias(c)
    wanted = evaluate.read_truth(spark, config["match_file"], config["source_a"])
    grid = evaluate.sweep(scores.select(number("key"), number("other"), "score"), wanted, [i / 100 for i in range(95, 0, -5)], 10, config["eva"]["approximate"])
    return evaluate.best(written(grid, "sweep"))


def train_pairs(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    read = lambda name: pair_texts(spark.read.option("header", True).csv(config[name]))
    model = classify.fitted(read("train_file"))
    model.write().overwrite().save(f"{config.get('output_file_name', 'pairs')}-model")
    return classify.tested(model, read("test_file"))


def run(spark: SparkSession, given: dict[str, Any]) -> Any:
    config = conf.checked(given)
    tasks = {"batch": train_batch, "smatch": match_stream, "evaluation": evaluated, "llm-train": train_pairs, "llm-test": lambda *_: None}
    began = time.monotonic()
    out = tasks[config["task"]](spark, config)
    log.info("%s took %.1f s", config["task"], time.monotonic() - began)
    return out


def log_to(path: str | None) -> None:
    """The log of the driver, also to files that rotate, if a path is given; the path of the run before is left."""
    for old in [h for h in log.handlers if isinstance(h, RotatingFileHandler)]:
        log.removeHandler(old)
        old.close()
    if path:
        where = Path(f"{path}.log")
        where.parent.mkdir(parents=True, exist_ok=True)
        handler = RotatingFileHandler(where, maxBytes=LOG_BYTES, backupCount=LOG_FILES, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    which = parser.add_mutually_exclusive_group(required=True)
    which.add_argument("-f", "--file", help="one configuration")
    which.add_argument("-d", "--dir", help="a folder of configurations, run in order")
    parser.add_argument("--unblocking", action="store_true", help="go on with the next configuration when one fails, and fail at the end")
    parser.add_argument("--no_info", action="store_true", help="log warnings and errors only")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    log.setLevel(logging.WARNING if args.no_info else logging.INFO)
    failed = []
    for path in [args.file] if args.file else conf.files(args.dir):
        try:
            given = conf.read(path)
            log_to((given.get("log") or {}).get("path"))
            out = run(session(), given)
            if isinstance(out, DataFrame):
                out.show(20, truncate=False)
        except Exception:
            if not args.unblocking:
                raise
            log.exception("%s failed", path)
            failed.append(path)
        finally:
            log_to(None)
    if failed:
        raise SystemExit(f"failed: {', '.join(failed)}")


if __name__ == "__main__":
    main()
