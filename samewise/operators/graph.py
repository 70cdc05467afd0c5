"""The graph of records, columns, values, tokens and n-grams, as two tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions import text as T

SEPARATOR = "␟"
# What the three bits of a node class's digit mean, and the digits by node type.
CLASSES = {"tn": 7, "tt": 7, "st": 5, "idx": 3, "cid": 1}


def node_class(digit: Column) -> list[Column]:
    """isfirst, isroot and isappear."""
    return [(digit.bitwiseAND(F.lit(bit)) != 0).alias(name) for bit, name in ((4, "isfirst"), (2, "isroot"), (1, "isappear"))]


def parse_types(specs: Sequence[str]) -> dict[str, int]:
    """``7#__tn`` as {tn: 7}."""
    out = {}
    for spec in specs:
        digit, _, name = spec.partition("__")
        if not name or len(digit) != 2 or digit[1] not in "#$" or digit[0] not in "01234567":
            raise ValueError(f"unknown node type {spec!r}")
        out[name] = int(digit[0])
    return out


def cells(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(rid, rid_num, col, col_pos, value): a row per cell that is not NULL or empty."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])).alias("c")
    rows = records.select(F.concat(F.lit("idx__"), key).alias("rid"), F.col(key).cast("long").alias("rid_num"), each)
    return rows.select("rid", "rid_num", "c.*").where("value IS NOT NULL AND value <> ''")


def touches(cell: DataFrame, flatten: Sequence[str] = ("tt",), grams: Sequence[int] = ()) -> DataFrame:
    """Each time that a record touches a node: (rid, rid_num, col, col_pos, kind, name, type, numeric); kind is 0 for values, 1 for tokens, 2 for n-grams."""
    values = cell.withColumn("v", T.token_value(F.col("value"))).where("v IS NOT NULL")
    kind = F.when(F.col("v.is_numeric"), "tn").otherwise("tt")
    base = values.select("rid", "rid_num", "col", "col_pos", F.explode("v.tokens").alias("token"), kind.alias("type"), F.col("v.is_numeric").alias("numeric")).where("token <> ''")
    parts = F.when(F.col("type").isin(*flatten), T.tokens(F.col("token"))).otherwise(F.array().cast("array<string>")) if flatten else F.array().cast("array<string>")
    node = lambda kind, name, type_, numeric: F.struct(F.lit(kind).alias("kind"), name.alias("name"), type_.alias("type"), numeric.alias("numeric"))
    found = [
        F.array(node(0, F.concat(F.lit("tt__"), "token"), F.col("type"), F.col("numeric"))),
        F.transform(parts, lambda t: node(1, F.concat(F.lit("tt__"), t), F.lit("st"), F.lit(False))),
    ]
    for n in grams:
        runs = T.ngrams(T.tokens(F.col("token")), n)
        found.append(_grams(runs, n, node))
    return base.select("rid", "rid_num", "col", "col_pos", F.explode(F.concat(*found)).alias("x")).select("rid", "rid_num", "col", "col_pos", "x.*")


def _grams(runs: Column, n: int, node) -> Column:
    return F.transform(runs, lambda g: node(2, F.concat(F.lit(f"ng::{n}::"), F.array_join(g, SEPARATOR)), F.lit("st"), F.lit(False)))


def nodes(cell: DataFrame, touched: DataFrame, types: dict[str, int] | None = None) -> DataFrame:
    """One row per node: its type is that of the first touch (record, column, kind), its frequency the number of touches."""
    rank = ("rid_num", "col_pos", "kind")
    value = touched.select("name", "type", "numeric", *rank)
    rids = cell.select("rid", "rid_num").distinct().select(F.col("rid").alias("name"), F.lit("idx").alias("type"), F.lit(False).alias("numeric"), "rid_num", F.lit(-1).alias("col_pos"), F.lit(0).alias("kind"))
    cids = cell.select(F.concat(F.lit("cid__"), "col").alias("name"), F.lit("cid").alias("type"), F.lit(False).alias("numeric"), "rid_num", "col_pos", F.lit(-1).alias("kind"))
    first = F.min(F.struct(*rank, "type", "numeric")).alias("f")
    found = value.union(rids).union(cids).groupBy("name").agg(first, F.count(F.lit(1)).alias("frequency_in_graph"))
    digit = F.coalesce(*[F.when(F.col("type") == t, F.lit(d)) for t, d in (types or CLASSES).items()], F.lit(0))
    return found.select("name", "f.type", "f.numeric", "frequency_in_graph").select("*", *node_class(digit))


def edges(touched: DataFrame) -> DataFrame:
    """Undirected edges (src < dst): each value, token and n-gram with its record and its column."""
    ends = F.explode(F.array(F.col("rid"), F.concat(F.lit("cid__"), "col"))).alias("other")
    return touched.select("name", ends).select(F.least("name", "other").alias("src"), F.greatest("name", "other").alias("dst")).where("src <> dst").distinct()


def meta_links(paths: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """The distinct sorted neighbours on the paths."""
    return sorted({tuple(sorted(pair)) for path in paths for pair in pairwise(path)})


def meta_edges(cell: DataFrame, paths: Sequence[Sequence[str]], rid: str = "rid") -> DataFrame:
    """Edges between the values of linked columns in one record; the column ``rid`` stands for the record itself, under its own name."""
    value = cell.select("rid", "col", F.concat("col", F.lit("__"), T.clean_str(F.col("value"))).alias("name"))
    every = value.union(cell.select("rid", F.lit(rid).alias("col"), F.col("rid").alias("name")).distinct())
    out = None
    for a, b in meta_links(paths):
        left, right = every.where(F.col("col") == a).select("rid", F.col("name").alias("x")), every.where(F.col("col") == b).select("rid", F.col("name").alias("y"))
        pairs = left.join(right, "rid").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
        out = pairs if out is None else out.union(pairs)
    if out is None:
        raise ValueError("a path needs two columns or more")
    return out.where("src <> dst").distinct()


def both_ways(edge: DataFrame) -> DataFrame:
    return edge.select("src", "dst").union(edge.select("dst", "src"))


def degrees(edge: DataFrame) -> DataFrame:
    return both_ways(edge).groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency(edge: DataFrame) -> DataFrame:
    """(name, neighbours): sorted names. A hub's list grows with the data; walks use indexed() instead."""
    return both_ways(edge).groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def indexed(edge: DataFrame) -> DataFrame:
    return numbered(both_ways(edge))


def numbered(arcs: DataFrame) -> DataFrame:
    """(src, at, dst): the neighbours of each node numbered from 0, by the first three digits of the name's MD5, then the name.

    The digits cut each node's neighbours into up to 4096 blocks, which are numbered by themselves and start where the blocks before
    them end; so no window holds all neighbours of a hub.
    """
    rows = arcs.select("src", "dst").withColumn("block", F.substring(F.md5(F.col("dst").cast("binary")), 1, 3))
    sizes = rows.groupBy("src", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("src", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("src", "block").orderBy("dst"))
    return rows.withColumn("nth", within).join(starts, ["src", "block"]).select("src", (F.col("start") + F.col("nth") - 1).alias("at"), "dst")


def cell_of(point: Column, n: Column, total: Column) -> Column:
    """Which of n equal cells of the line from 0 to total a point is in; it never falls as the point grows."""
    return F.least(F.floor(point.cast("double") * n / total).cast("long"), n - 1)


def weighted(arcs: DataFrame, weights: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(src, cell, lo, hi, total, n, dst): each node's neighbours as stretches lo:hi of a line, as long as the neighbour's weight.

    weights has name and weight. Weights become whole numbers, at least 1, so sums are exact. The line of a node of n neighbours is cut
    into n cells, and a neighbour has a row for each cell that it touches: 2 n at most, and less than two on average in a cell that a random
    point falls in, however the weights differ. As in numbered(), no window holds all neighbours of a hub.
    """
    named = weights.select(F.col("name").alias("dst"), F.greatest(F.lit(1), F.round(F.col("weight") * scale)).cast("long").alias("w"))
    rows = arcs.select("src", "dst").join(named, "dst").withColumn("block", F.substring(F.md5(F.col("dst").cast("binary")), 1, 3))
    sizes = rows.groupBy("src", "block").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("s"))
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("src")
    starts = sizes.select("src", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"), F.sum("k").over(whole).alias("n"), F.sum("s").over(whole).alias("total"))
    upto = F.sum("w").over(Window.partitionBy("src", "block").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(starts, ["src", "block"]).withColumn("hi", F.col("start") + F.col("upto")).withColumn("lo", F.col("hi") - F.col("w"))
    cells = F.sequence(cell_of(F.col("lo"), F.col("n"), F.col("total")), cell_of(F.col("hi") - 1, F.col("n"), F.col("total")))
    return placed.select("src", F.explode(cells).alias("cell"), "lo", "hi", "total", "n", "dst")


def rare_weight(kind: str | None, frequency: Column, degree: Column, alpha: float, smooth: Column) -> Column:
    if kind is None:
        return smooth
    base = {"idf": frequency, "degree": degree}.get(kind)
    return F.lit(1.0) if base is None else F.pow(1.0 / (base + 1.0), F.lit(alpha))


def smooth_weight(kind: str, n_nodes: Column, words: Column, frequency: Column, degree: Column) -> Column:
    if kind == "ICF":
        return F.ln(F.greatest(n_nodes, F.lit(1)) / (degree + 1.0))
    if kind == "IDF":
        return F.ln(F.greatest(words, F.lit(1)) / (frequency + 1.0))
    if kind == "log":
        return 1.0 / (F.ln(F.greatest(degree, F.lit(1)) + 1.0) + 1.0)
    return F.lit(1.0)


def sampling_weight(base: Column, rare: Column) -> Column:
    return F.greatest(F.lit(1e-12), base * rare)


def removed(node: DataFrame, edge: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the names in gone."""
    names = gone.select("name").distinct()
    left = edge.join(names, F.col("src") == F.col("name"), "left_anti").join(names, F.col("dst") == F.col("name"), "left_anti")
    return node.join(names, "name", "left_anti"), left


def merged(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Nodes after another window: frequencies add up, and the type of the older table wins."""
    both = old_nodes.withColumn("__at", F.lit(0)).unionByName(new_nodes.withColumn("__at", F.lit(1)))
    rest = [c for c in old_nodes.columns if c not in ("name", "frequency_in_graph")]
    return both.groupBy("name").agg(F.sum("frequency_in_graph").alias("frequency_in_graph"), F.min_by(F.struct(*rest), "__at").alias("r")).select("name", "frequency_in_graph", "r.*").select(old_nodes.columns)


def refreshed(index: DataFrame, edge: DataFrame, changed: DataFrame) -> DataFrame:
    """The index of all edges, made from an older one: only the nodes named in changed are numbered anew, those of affected() after new records."""
    names = changed.select(F.col("name").alias("src")).distinct()
    return index.join(names, "src", "left_anti").unionByName(numbered(both_ways(edge).join(names, "src", "left_semi")))


def neighbours(node: DataFrame, edge: DataFrame, names: DataFrame) -> DataFrame:
    """(name, neighbour, type) of the nodes in names; a record's neighbours are the record itself, read back."""
    near = both_ways(edge).join(names.select(F.col("name").alias("src")).distinct(), "src", "left_semi")
    return near.join(node.select(F.col("name").alias("dst"), "type"), "dst").select(F.col("src").alias("name"), F.col("dst").alias("neighbour"), "type")


def summary(node: DataFrame, edge: DataFrame) -> DataFrame:
    """By type: nodes, how often they were touched, and the sum and the largest of their degrees."""
    both = node.select("name", "type", "frequency_in_graph").join(degrees(edge), "name", "left").fillna(0, ["degree"])
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("frequency_in_graph").alias("frequency"), F.sum("degree").alias("degree"), F.max("degree").alias("most"))


def affected(edge: DataFrame, touched_names: DataFrame) -> DataFrame:
    """Names touched and their neighbours: those whose samplers change."""
    names = touched_names.select("name").distinct()
    near = both_ways(edge).join(names, F.col("src") == F.col("name"), "left_semi").select(F.col("dst").alias("name"))
    return names.union(near).distinct()
