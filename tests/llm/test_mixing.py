import random

import numpy as np
from pyspark.sql import functions as F

from samewise.llm import mixing


def brute(cells, budget, targets, sweeps=mixing.SWEEPS):
    """cells: {(source, lang, topic): tokens}."""
    keys, n = list(cells), np.array(list(cells.values()), float)
    w = n * budget
    for _ in range(sweeps):
        for d in range(3):
            levels = {k[d] for k in keys}
            raw = {x: sum(n[i] for i, k in enumerate(keys) if k[d] == x) ** mixing.TEMPER if targets[d] is None else targets[d].get(x, 0.0) for x in levels}
            for x in levels:
                own = [i for i, k in enumerate(keys) if k[d] == x]
                s = w[own].sum()
                goal = budget * n.sum() * raw[x] / sum(raw.values()) if sum(raw.values()) else 0
                w[own] = np.minimum(n[own], w[own] * (goal / s if s else 0))
    return dict(zip(keys, w, strict=True))


def test_weights(spark, monkeypatch):
    rng = random.Random(3)
    cells = {(s, x, t): float(rng.choice([0, 5, 70, 900])) for s in ("a", "b", "c", "d") for x in ("en", "de") for t in ("x", "y", "z") if rng.random() < 0.8}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, n double")
    for budget, targets in ((0.7, None), (0.3, {"lang": {"en": 1, "de": 1}, "source": {"a": 3, "b": 1}})):
        want = brute(cells, budget, [(targets or {}).get(d) for d in mixing.DIMENSIONS])
        for most in (mixing.MAX_CELLS, 1):
            monkeypatch.setattr(mixing, "MAX_CELLS", most)
            found = {(r.source, r.lang, r.topic): r.w for r in mixing.raked(frame, budget, targets).collect()}
            assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)
            assert all(w <= cells[k] for k, w in found.items())
        monkeypatch.undo()


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "s", "en"), (1, "a b", "s", "en"), (2, "a b c", None, "en"), *[(i, "some words here", f"s{i % 2}", "de") for i in range(3, 400)]]
    docs = mixing.described(spark.createDataFrame([(*r, True, 0.1) for r in rows], "doc_id long, text string, source string, lang string, selected boolean, probability double"))
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.probability <= 1 for r in found)
    assert sum(r.tokens for r in found) == sum(len((r[1] or "").split()) for r in rows)
    kept = sum(r.tokens for r in found if r.selected)
    assert 0.6 < kept / sum(r.tokens for r in found) < 0.8
    assert {r.source for r in found} == {"(none)", "s", "s0", "s1"}
    assert mixing.mixed(docs.where("false")).collect() == []


def test_marginals_are_met(spark):
    docs = mixing.described(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("text").cache()
    found = mixing.mixed(docs, targets={"lang": {"en": 1, "de": 1, "fr": 1, "es": 1}}, budget=0.2)
    shares = found.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("x")).collect()
    total = sum(r.x for r in shares)
    assert all(abs(r.x / total - 0.25) < 0.03 for r in shares)


def test_sweeps_end_when_nothing_moves(spark):
    frame = spark.createDataFrame([("a", "en", "x", 50.0), ("a", "de", "x", 50.0), ("b", "en", "x", 100.0), ("b", "de", "x", 100.0)], "source string, lang string, topic string, n double")
    for r in mixing.residuals(mixing.raked(frame, 0.5, sweeps=10_000), 0.5).collect():
        assert abs(r.target - r.reached) < 1e-6


def test_clashing_and_dotted_columns(spark):
    rows = [(i, "some words", "s", "en", 1, 2, 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, `a.b` int, tokens int, probability int")
    found = mixing.sampled(docs)
    assert found.columns == docs.columns and 0 < found.count() < 40 and mixing.sampled(docs.where("false")).count() == 0
