"""Graph tables on disk, and GraphML for exchange of small graphs."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GRAPHML = 200_000  # rows that a GraphML text may gather


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graphml(members: DataFrame, edges: DataFrame) -> str:
    """The GraphML text of groups (group, members) and weighted edges (a, b, weight). Refuses more than MAX_GRAPHML rows; use save()."""
    for df in (members, edges):
        if df.limit(MAX_GRAPHML + 1).count() > MAX_GRAPHML:
            raise ValueError("too large for GraphML")
    nodes = [f"<node id={quoteattr(str(r[0]))}><data key=\"members\">{escape(r[1])}</data></node>" for r in members.select("group", "members").orderBy("group").collect()]
    arcs = [f"<edge source={quoteattr(str(r[0]))} target={quoteattr(str(r[1]))}><data key=\"weight\">{r[2]!r}</data></edge>" for r in edges.select("a", "b", "weight").orderBy("a", "b").collect()]
    keys = '<key id="members" for="node" attr.name="members" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/>'
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">{"".join(nodes)}{"".join(arcs)}</graph></graphml>'


def read_graphml(spark: SparkSession, text: str) -> DataFrame:
    """(key, other, score) of a GraphML text: members of one group are similar at 1, members of linked groups at the edge's weight."""
    import xml.etree.ElementTree as tree

    space = {"g": "http://graphml.graphdrawing.org/xmlns"}
    root = tree.fromstring(text)
    groups = {n.get("id"): (n.findtext("g:data", "", space) or n.get("id")).split(",") for n in root.iterfind(".//g:node", space)}
    arcs = [(e.get("source"), e.get("target"), float(e.findtext("g:data", "nan", space))) for e in root.iterfind(".//g:edge", space)]
    member = spark.createDataFrame([(g, m) for g, ms in groups.items() for m in ms], "g string, m string")
    inside = member.alias("x").join(member.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.m") != F.col("y.m"))).select(F.col("x.m").alias("key"), F.col("y.m").alias("other"), F.lit(1.0).alias("score"))
    link = spark.createDataFrame(arcs + [(b, a, w) for a, b, w in arcs], "ga string, gb string, score double")
    across = link.join(member.select(F.col("g").alias("ga"), F.col("m").alias("key")), "ga").join(member.select(F.col("g").alias("gb"), F.col("m").alias("other")), "gb").select("key", "other", "score")
    return inside.unionByName(across)
