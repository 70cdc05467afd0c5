import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.functions.text import token_key
from samewise.operators import components, decide, embed, evaluate, exact, graph, knn, simstore, state, walks
from samewise.sources.shared import fresh_path


def test_exact_cases(spark):
    rows = [(1, "france", "Amie", "1999-03-03", "50"), (2, "France", None, "2025", "40"), (3, "", "Amie France", "03/03/1999", "50"), (4, "france", None, "2025", "40")]
    df = spark.createDataFrame(rows, "rid long, country string, name string, date string, num string")
    keyed = df.select("rid", token_key([F.col(c) for c in ("country", "name", "date", "num")]).alias("token_key"))
    assert sorted((r.survivor, r.n_members) for r in exact.clusters(keyed).collect()) == [(1, 2), (2, 2)]
    assert sorted(r.rid for r in exact.survivors(keyed).collect()) == [1, 2]
    assert sorted((r.rid, r.match) for r in exact.incremental(keyed.where("rid > 2"), keyed.where("rid <= 2")).collect()) == [(3, 1), (4, 2)]
    assert keyed.where("rid = 1").first().token_key == "03 1999 50 amie france"


def test_heap(spark):
    rows = [("banana", 0.8), ("cherry", 0.9), ("grape", 0.85), ("orange", 0.7), ("pear", 0.95), ("watermelon", 0.92), ("pear", 0.1)]
    df = spark.createDataFrame([("apple", w, s, i) for i, (w, s) in enumerate(rows)], "key string, word string, score double, pos int")
    assert [r.word for r in simstore.heaps(df, 3).orderBy("rank").collect()] == ["pear", "watermelon", "cherry"]
    path = fresh_path(spark, "lists")
    simstore.write_lists(simstore.heaps(df, 3), path, "json")
    back = evaluate.read_similarities(spark, path, "json")
    assert sorted((r.key, r.other, r.score) for r in back.collect()) == [("apple", "cherry", 0.9), ("apple", "pear", 0.95), ("apple", "watermelon", 0.92)]


def test_upsert_and_changes(spark):
    path = fresh_path(spark, "table")
    make = lambda rows: spark.createDataFrame(rows, "key string, similarity string")
    simstore.upsert(spark, path, make([("a", "1"), ("b", "2")]))
    simstore.upsert(spark, path, make([("b", "3"), ("c", "4")]))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    top = spark.createDataFrame([(1, 1, 2, 0.5)], "row long, rank int, col long, sim double")
    for round_ in (1, 2, 2):
        simstore.append_changes(top, f"{path}-changes", round_)
    assert spark.read.option("header", True).csv(f"{path}-changes").count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, 300 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {a for a, b in edges if a == b}
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked} and loops - linked == loops - set(found)


@pytest.mark.parametrize(("n", "k", "block"), [(50, 4, 7), (3, 5, 2048), (1, 2, 4), (40, 39, 16)])
def test_topk(spark, n, k, block):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, 6)).astype(np.float32)
    m[: n // 3] = m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = (unit @ unit.T).round(9)
    found = {(r.row, r["rank"]): r for r in knn.topk(df, k, block=block).collect()}
    assert len(found) == n * min(k, n - 1)
    for i in range(n):
        want = sorted((-sims[i, j], j) for j in range(n) if j != i)[:k]
        got = [(-round(found[i, r + 1].sim, 9), found[i, r + 1].col) for r in range(len(want))]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-8)


def brute_decision(top, ratio, delta, rnn, threshold, max_degree):
    """top: {row: [(sim, col), ...]}."""
    degree, best = {}, {}
    for r in sorted(top):
        for s, c in top[r]:
            degree[c] = degree.get(c, 0) + 1
            if s > best.get(c, (-9, None))[0]:
                best[c] = (s, r)
    bad = {c for c, d in degree.items() if d > max_degree}
    forced = {r for r in top if top[r][0][0] >= threshold and r not in bad and top[r][0][1] not in bad}
    out = {(r, top[r][0][1]) for r in forced}
    if forced == set(top):
        return out
    for r in set(top) - forced:
        if len(top[r]) > 1:
            s1, s2 = top[r][0][0], top[r][1][0]
            if (ratio is None or s1 / (s2 + 1e-12) >= ratio) and (delta is None or s1 - s2 >= delta):
                out.add((r, top[r][0][1]))
    return {(r, c) for r, c in out if best[c][1] == r} if rnn else out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("ratio", "delta", "rnn", "threshold", "degree"), [(None, 0.1, True, 0.95, 5), (1.2, None, True, 0.6, 2), (None, None, False, 0.5, 1), (1.1, 0.05, True, 0.0, 99)])
def test_decision(spark, seed, ratio, delta, rnn, threshold, degree):
    rng = random.Random(seed)
    top = {r: sorted(((round(rng.random(), 2), c) for c in rng.sample([x for x in range(9) if x != r], 3)), key=lambda x: (-x[0], x[1])) for r in range(9)}
    rows = [(r, i + 1, c, s) for r, found in top.items() for i, (s, c) in enumerate(found)]
    df = spark.createDataFrame(rows, "row long, rank int, col long, sim double")
    got = decide.decided(df, ratio, delta, rnn, threshold, degree).collect()
    assert {(r.row, r.col) for r in got} == brute_decision(top, ratio, delta, rnn, threshold, degree)


def test_edge_cap_groups_contraction(spark):
    edges = [("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("d", "e", 0.6), ("b", "c", 0.5)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    assert {(r.a, r.b) for r in simstore.edge_cap(df, 2).collect()} == {("a", "b"), ("a", "c"), ("d", "e"), ("b", "c")}
    records = spark.createDataFrame([(x,) for x in "abcdef"], "rid string")
    grouped = simstore.groups(records, df.where("weight >= 0.85").select("a", "b"))
    assert {r.rid: r.group for r in grouped.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f"}
    assert {(r.a, r.b): r.weight for r in simstore.contracted(df, grouped).collect()} == {("a", "c"): 0.8, ("a", "d"): 0.7, ("d", "e"): 0.6}


def test_state(spark):
    ts = lambda i: f"2024-01-0{i} 00:00:00"
    make = lambda rows: spark.createDataFrame(rows, "rid_i string, rid_j string, ts string, score double, stage string, decision string").withColumn("ts", F.to_timestamp("ts"))
    first = state.versions(make([("1", "2", ts(1), 0.5, None, None), ("1", "2", ts(2), None, None, "accepted"), ("2", "1", ts(1), 0.1, "XX", None)]))
    rows = {(r.pair_key, r.version): (r.score, r.stage, r.decision) for r in first.collect()}
    assert rows == {("1::2", 1): (0.5, "PM", "tentative"), ("1::2", 2): (0.5, "CM", "accepted"), ("2::1", 1): (0.1, "XX", "tentative")}
    more = state.appended(first, make([("1", "2", ts(3), None, None, None), ("9", "9", ts(3), 1.0, None, None)]))
    assert {(r.pair_key, r.version): (r.score, r.stage, r.decision) for r in more.collect()} == {("1::2", 3): (0.5, "CM", "accepted"), ("9::9", 1): (1.0, "PM", "tentative")}
    assert state.latest(first).where("pair_key = '1::2'").first().version == 2


def test_truth_and_sweep(spark, tmp_path):
    path = tmp_path / "truth.txt"
    path.write_text("idx_0,idx_5\nidx_1,idx_6 \n\nidx_7,idx_6\n")
    assert sorted(map(tuple, evaluate.read_truth(spark, f"file://{path}", 5).collect())) == [(0, 5), (1, 6)]
    assert evaluate.read_truth(spark, f"file://{path}").count() == 3
    rng = random.Random(2)
    sims = {(a, b): rng.choice([0.9, 0.8, 0.55, 0.3]) for a in range(12) for b in rng.sample(range(12), 4)}
    scores = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "key long, other long, score double")
    wanted = {(0, 5), (1, 6), (2, 3), (4, 9)}
    grid = evaluate.sweep(scores, spark.createDataFrame(sorted(wanted), "a long, b long"), [0.8, 0.5], 3, 2)
    nodes = {x for p in wanted for x in p}
    best = None
    for r in grid.orderBy(F.desc("threshold"), "k").collect():
        found = set()
        for a in range(12):
            mine = [(s, b) for (x, b), s in sims.items() if x == a]
            kept = sorted({s for s, b in mine if a != b}, reverse=True)[: r.k]
            found |= {tuple(sorted((a, b))) for s, b in mine if s in kept and s >= r.threshold and a != b}
        assert (r.predicted, r.correct, r.wanted) == (len(found), len(found & wanted), 4)
        assert r.predicted_bis == sum(a in nodes or b in nodes for a, b in found)
        p, q = len(found & wanted) / len(found) if found else 0, len(found & wanted) / 4
        assert r.f1 == pytest.approx(2 * p * q / (p + q) if p + q else 0) and 0 <= r.f1 <= 1
        best = max(best or (0,), (r.f1, r.threshold, -r.k))
    top = evaluate.best(grid).first()
    assert (top.f1, top.threshold, -top.k) == best


def test_record_graph(spark):
    rows = [(1, "Honey Basil Amber", "A"), (2, "Rude Hippo Honey Basil Amber", "A"), (3, "Mint Lemon", None)]
    cells = graph.cells(spark.createDataFrame(rows, "rid long, name string, cat string"), "rid", ("name", "cat"))
    touched = graph.touches(cells, grams=(2, 3))
    edges = {(r.src, r.dst) for r in graph.edges(touched).collect()}
    gram = f"ng::3::honey{graph.SEPARATOR}basil{graph.SEPARATOR}amber"
    assert {("idx__1", gram), ("idx__2", gram), ("cid__name", gram)} <= edges and not any("Honey" in x for e in edges for x in e)
    nodes = {r.name: r for r in graph.nodes(cells, touched).collect()}
    assert nodes["cid__cat"].frequency_in_graph == 2 and nodes["tt__a"].type == "tt" and nodes[gram].type == "st" and nodes["idx__3"].isroot
    with pytest.raises(ValueError, match="node type"):
        graph.parse_types(["7tt"])
    assert graph.parse_types(["7#__tn", "1$__cid"]) == {"tn": 7, "cid": 1}


def test_walks_stay_on_edges(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("lone", "lone2")]
    edges = spark.createDataFrame(arcs, "src string, dst string")
    linked = {frozenset(e) for e in arcs}
    index = graph.indexed(edges)
    starts = walks.rooted(spark.createDataFrame([("a", 1), ("e", 2), ("zz", 3)], "name string, number long"), 5)
    found = walks.walk(starts, index, 8, seed=3).collect()
    assert found == walks.walk(starts, index, 8, seed=3).collect() and len(found) == 15
    for r in found:
        assert len(r.path) == (8 if r.root != "zz" else 1) and all(frozenset(p) in linked for p in itertools.pairwise(r.path))
    kinds = spark.createDataFrame([(x, x != "c", True) for x in "abcde"], "name string, isappear boolean, isfirst boolean")
    for r in walks.walk(starts.where("root <> 'zz'"), index, 4, nodes=kinds, backtrack=False).collect():
        assert "c" not in r.path[1:] and all(x != y for x, y in itertools.pairwise(r.path)) and len(r.path) <= 4


def test_embeddings_bring_neighbours_together(spark):
    rng = random.Random(1)
    lines = [(i, [rng.choice(["x1", "x2", "x3"] if i % 2 else ["y1", "y2", "y3"]) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(lines, "walk_id long, path array<string>")
    first = embed.trained(df, size=8, epochs=6, shard_rows=100)
    state_ = {r.word: np.array(r.vec) for r in first.collect()}
    cos = lambda a, b: state_[a] @ state_[b] / np.linalg.norm(state_[a]) / np.linalg.norm(state_[b])
    assert cos("x1", "x2") > cos("x1", "y1") and cos("y2", "y3") > cos("y2", "x3")
    again = embed.trained(spark.createDataFrame([(1, ["x1", "new"])], "walk_id long, path array<string>"), first, size=8, epochs=1)
    rows = {r.word: r for r in again.collect()}
    assert set(rows) == {*state_, "new"} and rows["y1"].vec == pytest.approx(state_["y1"].tolist()) and rows["new"].n == 1
    assert embed.with_subwords(df, 64).count() == 306
