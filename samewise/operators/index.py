"""Approximate nearest neighbours by cosine: a clustered index.

Centres come from spherical k-means over a bounded sample: the SAMPLE rows with the least hashes of their ids. Every row is put into the cell
of its nearest centre, so an index holds all rows, and fresh rows are added without moving others. A query looks into the cells of
its ``probes`` nearest centres, where probes_for() finds how many the wanted recall takes. Cells are cut into blocks of bounded size, so that neither a large cell nor many queries of one meet in one
task, and the blocks of a query's cells are compared as knn.topk compares blocks. The similarities found are exact; neighbours in other cells
are missed. recall() measures how many, against brute force.

Rows without id or vector are left out; an empty table gives an empty index, which finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import knn
from samewise.sources.shared import written

SAMPLE = 20_000  # rows on which centres are fitted, on the driver
ROUNDS = 12
PER_CENTRE = 8  # sampled rows a centre needs
JUDGED = 1_000  # sampled rows whose neighbours among the sample tell how many cells to look into
PLACED = "id long, vec array<float>, cell int"
_PLACED = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("cell", pa.int32())])


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))


def _sample(vectors: DataFrame, key: str, vector: str, sample: int) -> np.ndarray:
    """The vectors of the rows with the least hashes of their ids, over their lengths."""
    taken = _rows(vectors, key, vector).orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column(0)
    return knn.unit(pa.concat_arrays(taken.chunks)) if len(taken) else np.zeros((0, 0))


def centres(vectors: DataFrame, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors, one a cell. By default there are as many as the root of the number of rows; PER_CENTRE sampled rows are needed for each."""
    x = _sample(vectors, key, vector, sample)
    if not len(x):
        return np.zeros((0, 0))
    wanted = cells or math.isqrt(_rows(vectors, key, vector).count())
    n = max(1, min(wanted, len(x) // PER_CENTRE))
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=n) == 0
        total[empty] = c[empty]
        c = total / (np.linalg.norm(total, axis=1, keepdims=True) + knn.EPS)
    return c


def nearest(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of each row's nearest centres."""
    out = np.empty((len(x), min(probes, len(c))), np.int32)
    for a in range(0, len(x), knn.STRIP):
        sims = x[a : a + knn.STRIP] @ c.T
        out[a : a + knn.STRIP] = np.argsort(-sims, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def probes_for(vectors: DataFrame, c: np.ndarray, k: int, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> int:
    """How many cells a query must look into, to find the share ``least`` of the k nearest: as many as it takes for JUDGED rows of the sample
    and their neighbours among the sample, which lie no nearer than those among all rows."""
    x = _sample(vectors, key, vector, sample)
    if len(x) < 2:
        return 1
    order = nearest(x[:JUDGED], c, len(c))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c), dtype=np.int32)[None, :], axis=1)
    cell, number = nearest(x, c, 1)[:, 0], np.arange(len(x))
    ranks = []
    for a in range(0, len(order), knn.STRIP):
        some = number[a : min(a + knn.STRIP, len(order))]
        sims = x[some] @ x.T
        sims[some[:, None] == number[None, :]] = -np.inf
        row, col = knn.best_of(sims, number, k)
        ranks.append(rank[some[row], cell[col]])
    return int(np.quantile(np.concatenate(ranks), least, method="higher")) + 1


def placed(vectors: DataFrame, c: np.ndarray, probes: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, cell): a row for each of the ``probes`` nearest cells; one makes an index, more make queries."""
    held = vectors.sparkSession.sparkContext.broadcast(c)  # SAMPLE / PER_CENTRE vectors at most

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not len(held.value):
                continue
            cells = nearest(knn.unit(batch.column(1)), held.value, probes)
            for p in range(cells.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), pa.array(cells[:, p])], schema=_PLACED)

    return _rows(vectors, key, vector).mapInArrow(kernel, PLACED)


def appended(index: DataFrame, fresh: DataFrame, c: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index with fresh rows, which replace those of equal ids."""
    added = placed(fresh, c, 1, key, vector)
    return index.join(added.select("id"), "id", "left_anti").select(*index.columns).unionByName(added)


def save(index: DataFrame, c: np.ndarray, path: str) -> None:
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # SAMPLE / PER_CENTRE at most
    return spark.read.schema(PLACED).parquet(f"{path}/rows"), np.array([r.centre for r in found])


def _blocks(rows: DataFrame, block: int | None) -> DataFrame:
    """(cell, ids, vs), a row per block of a cell."""
    per = block or knn.rows_of_block(rows, "vec")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # a row per cell
    at = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / per)).alias("part")
    packed = rows.join(F.broadcast(sizes), "cell").groupBy("cell", at).agg(F.collect_list(F.struct("id", "vec")).alias("p"))
    return packed.select("cell", F.col("p.id").alias("ids"), F.col("p.vec").alias("vs"))


def search(index: DataFrame, queries: DataFrame, c: np.ndarray, k: int, probes: int, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(row, rank, col, sim) as knn.topk gives them, of the rows in the ``probes`` nearest cells of each query."""
    left = _blocks(written(placed(queries, c, probes, key, vector), "index-queries"), block)
    right = _blocks(index, block).withColumnRenamed("ids", "ids2").withColumnRenamed("vs", "vs2")
    met = left.join(right, "cell").select("ids", "vs", "ids2", "vs2")
    return knn.ranked(met.mapInArrow(knn.kernel(k), knn.PAIRS), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall): how many of the exact neighbours were found; one row. A recall of none is 1."""
    both = exact.select("row", "col").join(found.select("row", "col", F.lit(1).alias("hit")), ["row", "col"], "left")
    n, hits = F.count(F.lit(1)), F.count("hit")
    return both.agg(n.alias("n_exact"), hits.alias("n_found"), F.when(n > 0, hits / n).otherwise(1.0).alias("recall"))
