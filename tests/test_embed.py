import numpy as np

from samewise.operators import embed


def test_cbow_predicts_from_the_mean_of_the_context():
    rng = np.random.default_rng(1)
    line = ["a", "b", "c", "d", "e"]
    known = {w: (rng.normal(size=4), rng.normal(size=4)) for w in line}
    got = embed.train_shard([line], known, 4, 2, 0, 1, 7, True)
    vec, ctx = ({w: known[w][i].copy() for w in line} for i in (0, 1))
    for i, w in enumerate(line):
        around = [line[j] for j in range(max(0, i - 2), min(5, i + 3)) if j != i]
        mean = np.mean([known[x][0] for x in around], axis=0)
        error = 0.025 * (1 - 1 / (1 + np.exp(-known[w][1] @ mean)))
        ctx[w] += error * mean
        for x in around:
            vec[x] += error * known[w][1] / len(around)
    for w in line:
        assert np.allclose(got[w][0], vec[w]) and np.allclose(got[w][1], ctx[w])


def test_a_first_training_keeps_no_vocabulary_on_the_driver(spark):
    walks = spark.createDataFrame([([f"x{i}", "hub", f"y{i % 7}"],) for i in range(70)], "path array<string>")
    found = embed.word2vec(walks, size=8, epochs=1)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.word: len(r.vec) for r in found.collect()} == dict.fromkeys([*(f"x{i}" for i in range(70)), *(f"y{i}" for i in range(7)), "hub"], 8)
    assert {r.word for r in embed.word2vec(walks, size=8, epochs=1, min_count=10).collect()} == {*(f"y{i}" for i in range(7)), "hub"}
