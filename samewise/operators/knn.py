"""Exact nearest neighbours by cosine, and what is read from their ranking.

All pairs have to be looked at, which is work in the square of the rows, whatever the plan. Rows are packed into blocks of bounded size,
each block meets each other block once in an equi-join on block numbers, matrix products give the similarities of the two blocks, and
only the best k of each row leave the kernel. No matrix is broadcast, so memory is that of two blocks at any number of rows. A block goes to
all others, so the shuffle holds the vectors as often as there are blocks; operators/index.py has the way around that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 22  # of the vectors of a block
STRIP = 512  # rows of a block that are compared at once
EPS = 1e-12
PAIRS = "row long, col long, sim double"
_PAIRS = pa.schema([("row", pa.int64()), ("col", pa.int64()), ("sim", pa.float64())])


def normalized(v: Column) -> Column:
    """The vector over its length."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(d, lambda x: x / (n + EPS)))[0]


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(normalized(a), normalized(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list column over their lengths, as a matrix."""
    sizes = pc.unique(pc.fill_null(pc.list_value_length(vectors), 0))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes.to_pylist())}")
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS)


def best_of(sims: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) places of the k best of each row, ties by column id."""
    n = min(k, sims.shape[1])
    cut = -np.partition(-sims, n - 1, axis=1)[:, n - 1]
    row, col = np.nonzero((sims >= cut[:, None]) & np.isfinite(sims))
    order = np.lexsort((cols[col], -sims[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < n], col[rank < n]


def kernel(k: int):
    """For mapInArrow: rows of two blocks (ids, vs, ids2, vs2) to PAIRS."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, cols = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (0, 2))
                left, right = (unit(batch.column(j)[i].values) for j in (1, 3))
                if left.shape[1] != right.shape[1]:
                    raise ValueError(f"vectors of different lengths: {sorted((left.shape[1], right.shape[1]))}")
                for a in range(0, len(ids), STRIP):
                    rows = ids[a : a + STRIP]
                    sims = left[a : a + STRIP] @ right.T
                    sims[rows[:, None] == cols[None, :]] = -np.inf
                    r, c = best_of(sims, cols, k)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[r], pa.int64()), pa.array(cols[c], pa.int64()), pa.array(sims[r, c])], schema=_PAIRS)

    return compared


def rows_of_block(rows: DataFrame, vector: str) -> int:
    """How many of the vectors make a block of BLOCK_BYTES."""
    return max(1, BLOCK_BYTES // (4 * max(1, rows.agg(F.max(F.size(vector))).first()[0] or 1)))


def topk(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None, block: int | None = None, among: Column | None = None) -> DataFrame:
    """(row, rank, col, sim): the k nearest other rows of each row, or of each query row; by similarity, then id. Fewer rows give fewer.

    Only rows for which the condition ``among`` holds are found, of which there are k if there can be.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())

    busy = math.isqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism) + 1  # blocks whose pairs keep all cores at work

    def packed(df: DataFrame) -> tuple[DataFrame, int]:
        count = df.count()
        n = max(-(-count // (block or rows_of_block(df, vector))), 0 if block else min(-(-count // STRIP), busy), 1)
        at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        pack = F.collect_list(F.struct(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<float>").alias("v")))
        return df.groupBy(at.alias("block")).agg(pack.alias("p")).select("block", F.col("p.i").alias("ids"), F.col("p.v").alias("vs")), n

    right, n = packed(rows if among is None else rows.where(among))
    left = (packed(queries)[0] if queries is not None else right if among is None else packed(rows)[0]).select("ids", "vs", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    met = left.join(right.withColumnRenamed("ids", "ids2").withColumnRenamed("vs", "vs2"), "block").select("ids", "vs", "ids2", "vs2")
    return ranked(met.mapInArrow(kernel(k), PAIRS), k)


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Number the columns of each row by similarity, then id, from 1; keep k."""
    order = Window.partitionBy("row").orderBy(F.desc("sim"), F.asc("col"))
    out = pairs.withColumn("rank", F.row_number().over(order)).select("row", "rank", "col", "sim")
    return out if k is None else out.where(F.col("rank") <= k)


def cross_source(neighbours: DataFrame, source_a: int, k: int) -> DataFrame:
    """Neighbours from the other source, the best k left. Fetch 2k first: the filter comes after that cut."""
    other = neighbours.where((F.col("row") <= source_a) != (F.col("col") <= source_a))
    return ranked(other.select("row", "col", "sim"), k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """Pairs (row < col) that are each other's nearest."""
    first = neighbours.where("rank = 1").select("row", "col", "sim")
    back = first.select(F.col("row").alias("col"), F.col("col").alias("row"))
    return first.join(back, ["row", "col"]).where("row < col")


def hubs(neighbours: DataFrame, max_degree: int) -> DataFrame:
    """(node, degree) of nodes in more than max_degree lists."""
    return neighbours.groupBy(F.col("col").alias("node")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > max_degree)


def best_rows(neighbours: DataFrame) -> DataFrame:
    """(col, row, sim): the row that scores each column best over all lists, the smallest of equal ones."""
    return neighbours.groupBy("col").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("row").alias("row"))).alias("b")).select("col", "b.row", (-F.col("b.s")).alias("sim"))
