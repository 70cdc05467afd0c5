"""The clustered index: exact where all cells are looked into, recall where not, rows added, stored and odd ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.operators import index, knn
from samewise.plans import vectors as plans
from samewise.sources.shared import fresh_path
from samewise.streaming import windows

SCHEMA = "vec_id long, embedding array<float>"


def some(spark, n, seed, first=0, dim=12, spread=0.25):
    r = np.random.default_rng(seed)
    points = np.random.default_rng(5).normal(size=(10, dim))
    return spark.createDataFrame([(first + i, [float(x) for x in points[i % 10] + spread * r.normal(size=dim)]) for i in range(n)], SCHEMA)


def pairs(df):
    return {(r.row, r["rank"], r.col) for r in df.collect()}


def test_all_cells_are_the_exact_answer(spark):
    v = some(spark, 400, 1)
    c = index.centres(v, 7)
    queries = v.where("vec_id % 9 = 0")
    exact = pairs(knn.topk(v, 4, queries=queries))
    for block in (None, 30):  # cells cut into blocks change nothing
        assert pairs(index.search(index.placed(v, c), queries, c, 4, len(c), block=block)) == exact


def test_recall_with_few_cells(spark):
    v = some(spark, 600, 2)
    c = index.centres(v)
    probes = index.probes_for(v, c, 5)
    assert len(c) == 24 and probes < len(c)
    queries = v.where("vec_id % 10 = 0")
    got = index.recall(index.search(index.placed(v, c), queries, c, 5, probes), knn.topk(v, 5, queries=queries)).first()
    assert got.n_exact == 300 and got.recall >= 0.9


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_on_the_tables(spark, sf):
    got = plans.knn_index_recall(spark, f"/root/testdata/sf{sf}").first()
    print("index recall", sf, got.recall)
    assert got.recall >= 0.9


def test_rows_are_added_and_stored(spark):
    old, fresh = some(spark, 200, 3), some(spark, 60, 4, first=190)
    c = index.centres(old, 5)
    path = fresh_path(spark, "index")
    index.save(index.placed(old, c), c, path)
    rows, again = index.load(spark, path)
    assert np.array_equal(c, again)
    both = index.appended(rows, fresh, again)
    now = old.where("vec_id < 190").unionByName(fresh)
    assert both.count() == now.count() == 250
    assert pairs(index.search(both, fresh, c, 3, 5)) == pairs(knn.topk(now, 3, queries=fresh))


def test_odd_rows(spark):
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1])], SCHEMA)
    c = index.centres(odd, 3)
    assert len(c) == 1  # too few rows for more
    assert pairs(index.search(index.placed(odd, c), odd, c, 1, 1)) == pairs(knn.topk(odd, 1))
    empty = odd.where("false")
    none = index.centres(empty)
    assert index.probes_for(empty, none, 3) == 1 and index.search(index.placed(empty, none), empty, none, 3, 1).count() == 0
    with pytest.raises(ValueError, match="different lengths"):
        index.centres(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_numbers_go_by_time_also_where_all_is_in_one_hour(spark):
    rows = [(i, None if i % 50 == 0 else f"2024-01-01 00:00:{i % 7:02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("ts", F.col("t").cast("timestamp")).repartition(5)
    got = {r.id: r.n for r in windows.in_order(df, "ts", "id").collect()}
    wanted = sorted(rows, key=lambda r: (r[1] or "", r[0]))
    assert got == {r[0]: i for i, r in enumerate(wanted)}
