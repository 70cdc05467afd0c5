"""Random walks over the record graph, step by step for all walks at once.

A step is two equi-joins: one on the node, for how many neighbours it has, and one on node and drawn number, for the neighbour itself. The
second spreads a hub's walks over its neighbours; nothing holds a hub's whole list. Draws are taken from the MD5 of walk, step and seed, so
they are independent from step to step, and a walk is the same in every run. Over a weighted index (graph.weighted) a step draws a point
on the node's line of weights, and the cell of the line that holds it. Every few steps the walks are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.operators.graph import both_ways, cell_of, degrees, indexed, numbered, smooth_weight, weighted
from samewise.sources.shared import written

EVERY = 5  # steps between writes


def draw(walk: Column, step: int | Column, seed: int, n: Column) -> Column:
    """A number from 0 to n - 1: the first 52 bits of the MD5 of walk, step and seed, modulo n."""
    step = F.lit(step) if isinstance(step, int) else step
    mark = F.md5(F.concat_ws(":", walk.cast("string"), step.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(mark, 1, 13), 16, 10).cast("long") % n


def rooted(nodes: DataFrame, per_root: int) -> DataFrame:
    """(walk_id, root): per_root walks from each root node (name, number)."""
    return nodes.select(F.explode(F.sequence(F.lit(0), F.lit(per_root - 1))).alias("i"), "name", "number").select((F.col("number") * per_root + F.col("i")).alias("walk_id"), F.col("name").alias("root"))


def _stepped(walks: DataFrame, index: DataFrame, sizes: DataFrame, step: int, seed: int) -> DataFrame:
    """Add next, NULL where the node has no neighbour."""
    counted = walks.join(sizes, walks["node"] == sizes["src"], "left").drop("src")
    if "total" in sizes.columns:
        drawn = counted.withColumn("point", F.when(F.col("total") > 0, draw(F.col("walk_id"), step, seed, F.col("total"))))
        drawn = drawn.withColumn("cell", cell_of(F.col("point"), F.col("n"), F.col("total"))).drop("n", "total")
        names = index.select(F.col("src").alias("of"), F.col("cell").alias("of_cell"), "lo", "hi", F.col("dst").alias("next"))
        on = (drawn["node"] == names["of"]) & (drawn["cell"] == names["of_cell"]) & (drawn["point"] >= names["lo"]) & (drawn["point"] < names["hi"])
        return drawn.join(names, on, "left").drop("of", "of_cell", "lo", "hi", "point", "cell")
    drawn = counted.withColumn("at", F.when(F.col("n") > 0, draw(F.col("walk_id"), step, seed, F.col("n"))))
    names = index.select(F.col("src").alias("node"), "at", F.col("dst").alias("next"))
    return drawn.join(names, ["node", "at"], "left").drop("n", "at")


def index_of(nodes: DataFrame, edges: DataFrame, smoothing: str = "no") -> DataFrame:
    """The index that walks step over: neighbours alike, or weighted by a smoothing method (log, IDF or ICF) of the neighbour."""
    if smoothing == "no":
        return indexed(edges)
    totals = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("frequency_in_graph").alias("words"))
    known = nodes.select("name", "frequency_in_graph").join(degrees(edges), "name", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(totals))  # one row
    weight = smooth_weight(smoothing, *[F.col(c) for c in ("n_nodes", "words", "frequency_in_graph", "degree")])
    return weighted(both_ways(edges), known.select("name", weight.alias("weight")))


def _sizes(index: DataFrame) -> DataFrame:
    if "total" in index.columns:
        return index.groupBy("src").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    return index.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def walk(starts: DataFrame, index: DataFrame, length: int, nodes: DataFrame | None = None, first_index: DataFrame | None = None, backtrack: bool = True, max_hops: int | None = None, seed: int = 7) -> DataFrame:
    """(walk_id, root, path): walks of ``length`` visible nodes.

    nodes (name, isfirst, isappear) says what is visible: walks go through invisible nodes without naming them. Without backtrack a node
    equal to the last visible one is not named, but the walk goes on from it. A root that may not come first is put after one of its
    neighbours in first_index; without such a neighbour there is no walk. Hops are bounded: the reference semantics may go on for ever.
    """
    walks = starts.withColumn("node", F.col("root")).withColumn("path", F.array("root"))
    if nodes is not None and first_index is not None:
        kinds = nodes.select(F.col("name").alias("root"), "isfirst")
        ahead = _stepped(walks.join(kinds, "root"), first_index, _sizes(first_index), 0, seed)
        walks = ahead.where("isfirst OR next IS NOT NULL").withColumn("path", F.when(F.col("isfirst"), F.col("path")).otherwise(F.array("next", "root"))).drop("isfirst", "next")
    index = written(index, "walk-index")
    sizes = written(_sizes(index), "walk-sizes")
    hidden = nodes.where(~F.col("isappear")).select(F.col("name").alias("next"), F.lit(True).alias("hidden")) if nodes is not None else None
    hops = max_hops or (length - 1 if backtrack and hidden is None else 4 * length)
    for hop in range(1, hops + 1):
        walks = _stepped(walks, index, sizes, hop, seed)
        named = F.col("next").isNotNull() & (F.size("path") < length)
        if hidden is not None:
            walks = walks.join(hidden, "next", "left")
            named &= F.col("hidden").isNull()
        if not backtrack:
            named &= F.col("next") != F.element_at("path", -1)
        walks = walks.select("walk_id", "root", F.coalesce("next", "node").alias("node"), F.when(named, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"))
        if hop % EVERY == 0 and hop < hops:
            walks = written(walks, "walks")
            if hops > length and walks.where(F.size("path") < length).limit(1).count() == 0:
                break
    return walks.select("walk_id", "root", "path")


def metapath(starts: DataFrame, edge: DataFrame, nodes: DataFrame, path: Sequence[str], length: int, seed: int = 7) -> DataFrame:
    """Walks whose i-th node has the type path[i mod len]; a walk ends early where no neighbour has the type wanted. nodes has name and type."""
    typed = both_ways(edge).join(nodes.select(F.col("name").alias("dst"), "type"), "dst")
    by_type = {t: written(numbered(typed.where(F.col("type") == t)), "walk-index") for t in sorted(set(path))}
    walks = starts.withColumn("node", F.col("root")).withColumn("path", F.array("root"))
    for step in range(1, length):
        index = by_type[path[step % len(path)]]
        walks = _stepped(walks, index, _sizes(index), step, seed)
        walks = walks.select("walk_id", "root", F.col("next").alias("node"), F.when(F.col("next").isNotNull(), F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"))
        if step % EVERY == 0:
            walks = written(walks, "walks")
    return walks.select("walk_id", "root", "path")


def row_walk(adjacent: DataFrame, length: int, seed: int = 7) -> DataFrame:
    """(root, path): the root in turn with neighbours drawn for it. adjacent has name, number and neighbours."""
    n = F.size("neighbours")
    picks = F.transform(F.sequence(F.lit(1), F.lit(length // 2)), lambda i: F.get(F.col("neighbours"), draw(F.col("number"), i, seed, n).cast("int")))
    return adjacent.where(n > 0).select(F.col("name").alias("root"), F.slice(F.flatten(F.transform(picks, lambda x: F.array(F.col("name"), x))), 1, length).alias("path"))


def multiscale(starts: DataFrame, index: DataFrame, scales: Sequence[tuple[int, int]] = ((15, 2), (30, 2), (60, 1)), seed: int = 7) -> DataFrame:
    """Walks of several lengths; each scale is a length and how many times each start is walked."""
    out = None
    for i, (length, times) in enumerate(scales):
        more = starts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col("walk_id") * times + F.col("i")).alias("walk_id"), "root")
        part = walk(more, index, length, seed=seed + i).withColumn("scale", F.lit(length))
        out = part if out is None else out.union(part)
    return out


def visits(walks: DataFrame) -> DataFrame:
    """(name, visits) over all paths."""
    return walks.select(F.explode("path").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("visits"))


def statistics(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """By type: nodes, mean visits, never visited, the most visits and the first name that has them."""
    both = nodes.select("name", "type").join(seen, "name", "left").fillna(0, ["visits"])
    least = F.min(F.struct((-F.col("visits")).alias("v"), F.col("name").alias("name")))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("visits").alias("mean_visits"), F.count_if(F.col("visits") == 0).alias("never_visited"), F.max("visits").alias("most_visits"), least["name"].alias("most_visited"))


def histogram(seen: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, n, density) over the range of visits, with mean and population deviation, on which a normal curve is drawn."""
    span = seen.agg(F.min("visits").alias("lo"), F.max("visits").alias("hi"), F.avg("visits").alias("mean"), F.stddev_pop("visits").alias("std"), F.count(F.lit(1)).alias("total"))
    both = seen.crossJoin(F.broadcast(span))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    at = F.least(F.floor((F.col("visits") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return both.groupBy(at.alias("bin"), "mean", "std", "total", width.alias("width")).agg(F.count(F.lit(1)).alias("n")).select("bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"), "mean", "std")
