"""Draws of walks: even per step, independent between steps, by weight where the index is weighted."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from samewise.operators import graph, walks

N = 6000


def far(counts, shares, n):
    """The chi-square statistic of counts against shares."""
    return sum((counts.get(k, 0) - n * p) ** 2 / (n * p) for k, p in shares.items())


@pytest.fixture(scope="module")
def drawn(spark):
    cols = [walks.draw(F.col("id"), step, 7, F.lit(n)).alias(f"d{step}_{n}") for step in (1, 2, 3, 4) for n in (2, 3, 5, 10, 16)]
    return spark.range(N).select(*cols).collect()


@pytest.mark.parametrize("n", [2, 3, 5, 10, 16])
def test_draws_are_even_and_independent(drawn, n):
    for step in (1, 2, 3, 4):
        assert far(Counter(r[f"d{step}_{n}"] for r in drawn), {i: 1 / n for i in range(n)}, N) < n + 5 * (2 * n) ** 0.5 + 4
        for later in range(step + 1, 5):
            pairs = Counter((r[f"d{step}_{n}"], r[f"d{later}_{n}"]) for r in drawn)
            cells = n * n
            assert far(pairs, {(i, j): 1 / cells for i in range(n) for j in range(n)}, N) < cells + 5 * (2 * cells) ** 0.5 + 4


def test_row_walks_pick_independently(spark):
    rows = spark.range(N).select(F.concat(F.lit("r"), "id").alias("name"), F.col("id").alias("number"), F.array(*[F.lit(str(i)) for i in range(5)]).alias("neighbours"))
    paths = [r.path for r in walks.row_walk(rows, 6).collect()]
    assert far(Counter((p[1], p[5]) for p in paths), {(str(i), str(j)): 1 / 25 for i in range(5) for j in range(5)}, N) < 25 + 5 * 50**0.5 + 4


def test_weighted_steps_follow_the_weights(spark):
    weight = {"a": 1.0, "b": 3.0, "c": 0.5, "d": 5.5}
    arcs = spark.createDataFrame([("hub", x) for x in weight] + [(x, "hub") for x in weight], "src string, dst string")
    weights = spark.createDataFrame([*weight.items(), ("hub", 1.0)], "name string, weight double")
    starts = spark.range(N).select(F.col("id").alias("walk_id"), F.lit("hub").alias("root"))
    paths = [r.path for r in walks.walk(starts, graph.weighted(arcs, weights), 4).collect()]
    assert len(paths) == N and all(p[0] == p[2] == "hub" for p in paths)
    for step in (1, 3):
        assert far(Counter(p[step] for p in paths), {x: w / 10 for x, w in weight.items()}, N) < 20
    assert far(Counter((p[1], p[3]) for p in paths), {(x, y): v * w / 100 for x, v in weight.items() for y, w in weight.items()}, N) < 45


def test_the_line_of_weights_is_whole(spark):
    arcs = spark.createDataFrame([("s", f"n{i}") for i in range(200)] + [("t", "n1")], "src string, dst string")
    weights = spark.createDataFrame([(f"n{i}", 1e-12 if i % 2 else float(i)) for i in range(200)], "name string, weight double")
    rows = graph.weighted(arcs, weights).collect()
    stretches = sorted({(r.lo, r.hi, r.dst) for r in rows if r.src == "s"})
    total = next(r.total for r in rows if r.src == "s")
    assert len(stretches) == 200 and stretches[0][0] == 0 and stretches[-1][1] == total
    assert all(a[1] == b[0] for a, b in zip(stretches, stretches[1:], strict=False)) and len(rows) <= 402
    assert walks.index_of(spark.createDataFrame([("s", 3), ("n1", 1)], "name string, frequency_in_graph long"), arcs.where("src = 's' AND dst = 'n1'"), "log").count() >= 2
