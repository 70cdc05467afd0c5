import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from samewise import app, config
from samewise.plans import streams
from samewise.sources import graphs, records
from samewise.sources.shared import fresh_path
from samewise.streaming import matcher, windows


@pytest.mark.parametrize(("size", "stride"), [(7, 0), (6, 4), (100, 0)])
def test_count_windows_over_files(spark, tmp_path, size, stride):
    rng = random.Random(size)
    values = [rng.randrange(12) for _ in range(40)]
    for f in range(4):
        (tmp_path / f"{f}.json").write_text("".join(json.dumps({"n": f"{f * 10 + i:03d}", "v": f"v {values[f * 10 + i]}"}) + "\n" for i in range(10)))
        os.utime(tmp_path / f"{f}.json", (1_700_000_000 + f, 1_700_000_000 + f))
    stream = records.json_stream(spark, f"file://{tmp_path}", records.T.StructType.fromDDL("n string, v string"))
    m = matcher.Matcher(spark, fresh_path(spark, "m"), ("v",), ("n",), size, stride)
    matcher.run(stream, m, fresh_path(spark, "c"))
    rows = {r.rid: r for r in m.matches().collect()}
    step = stride or size
    assert sorted(rows) == list(range(40))
    for rid, r in rows.items():
        own = max(0, (rid - size) // step + 1)
        assert r.window_id == own, rid
        same = [i for i in range(40) if values[i] == values[rid] and i <= rid]
        before = [i for i in same if rows[i].window_id < own]
        assert r.match == (min(before) if before else None)
        assert r.survivor == min(i for i in same if rows[i].window_id == own)


def test_a_batch_may_run_twice(spark):
    m = matcher.Matcher(spark, fresh_path(spark, "m"), ("v",), ("n",), 3)
    make = lambda rows: spark.createDataFrame(rows, "n string, v string")
    for batch, rows in ((0, [("1", "a"), ("2", "b")]), (0, [("1", "a"), ("2", "b")]), (1, [("3", "a"), ("4", "b")]), (1, [("3", "a"), ("4", "b")])):
        m.process(make(rows), batch)
    m.flush(1)
    assert [(r.rid, r.window_id, r.survivor, r.match) for r in m.matches().orderBy("rid").collect()] == [(0, 0, 0, None), (1, 0, 1, None), (2, 0, 0, None), (3, 1, 3, 1)]


def test_windows(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=17 * i)) for i in range(50)]
    df = windows.in_order(spark.createDataFrame(rows, "event_id long, ts timestamp").repartition(5), "ts", "event_id")
    assert sorted((r.event_id, r.n) for r in df.collect()) == [(i, i) for i in range(50)]
    slid = {(r.n, r.window_id) for r in windows.sliding(df, "n", 10, 4).collect()}
    assert slid == {(n, w) for n in range(50) for w in range(13) if 4 * w <= n < 4 * w + 10}


def test_records_and_pairs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,\n')
    rows = records.read_csv(spark, f"file://{tmp_path}/a.csv").orderBy("rid_num").collect()
    assert [(r.rid, r.name) for r in rows] == [("idx__0", 'x, "y"'), ("idx__1", None)]
    df = spark.createDataFrame([("1", "a", "2", None, 1)], "`l1.id` string, `l1.name` string, `r2.id` string, `r2.name` string, label int")
    assert tuple(records.pair_texts(df).first()) == ("namea", "namenan", 1)
    sets = records.split_sets(spark.range(1000), "id")
    assert sum(s.count() for s in sets.values()) == 1000 and 500 < sets["train"].count() < 700


def test_graphml(spark):
    members = spark.createDataFrame([("a", "a,b"), ("c", "c")], '`group` string, members string')
    edges = spark.createDataFrame([("a", "c", 0.25)], "a string, b string, weight double")
    found = {(r.key, r.other): r.score for r in graphs.read_graphml(spark, graphs.graphml(members, edges)).collect()}
    assert found == {("a", "b"): 1.0, ("b", "a"): 1.0, ("a", "c"): 0.25, ("b", "c"): 0.25, ("c", "a"): 0.25, ("c", "b"): 0.25}


def test_config(tmp_path):
    text = "task: batch # now\ngraph:\n  smoothing_method: \"log\"\n  meta_path: [['rid','title'],[\"title\", 'venue']]\n  node_types:\n    - \"7#__tn\"\n    - '1$__cid'\ndataset_file: FILE\nx: 1.5\n"
    data = tmp_path / "d.csv"
    data.write_text("id\n")
    got = config.checked(config.parsed(text.replace("FILE", str(data))))
    assert got["graph"]["meta_path"] == [["rid", "title"], ["title", "venue"]] and got["graph"]["node_types"] == ["7#__tn", "1$__cid"] and got["x"] == 1.5
    assert got["walks"]["walk_length"] == 60 and got["graph"]["flatten"] == ["tt"]
    for bad in ({"task": "x"}, {"task": "batch"}, {"task": "batch", "dataset_file": "/none"}, {"task": "smatch", "kafka": {"window_strategy": "time"}}, {"task": "smatch", "graph": {"smoothing_method": "x"}}, {"task": "smatch", "graph": {"flatten": "zz"}}):
        with pytest.raises((ValueError, FileNotFoundError)):
            config.checked(bad)
    for name in ("b.yaml", "a.yaml", "default-batch.yaml"):
        (tmp_path / name).write_text("task: batch\n")
    assert [p[-6:] for p in config.files(str(tmp_path))] == ["a.yaml", "b.yaml"]


def test_batch_task(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,city\n" + "".join(f"shop {i % 4},town {i % 3}\n" for i in range(12)))
    given = {"task": "batch", "dataset_file": str(tmp_path / "r.csv"), "output_file_name": str(tmp_path / "out"), "walks": {"walk_length": 4, "walks_number": 2}, "embeddings": {"n_dimensions": 8, "epochs": 1}}
    found = app.run(spark, given)
    assert found.where(F.col("word").startswith("idx__")).count() == 12
    nodes, edges = graphs.load(spark, str(tmp_path / "out-graph"))
    assert nodes.where("type = 'idx'").count() == 12 and edges.count() > 20
    given["graph"] = {"meta_path": [["rid", "name", "city", "name"]]}
    assert app.run(spark, given).where(F.col("word").startswith("idx__")).count() == 12


def test_evaluation_task(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("idx_0,idx_3\nidx_1,idx_4\n")
    path = str(tmp_path / "sims.parquet")
    rows = [("idx__0", '[["0.9","idx__3"],["0.2","idx__4"]]'), ("idx__1", '[["0.8","idx__4"]]')]
    spark.createDataFrame(rows, "key string, similarity string").write.parquet(path)
    best = app.run(spark, {"task": "evaluation", "similarity_file": path, "match_file": str(tmp_path / "truth.txt"), "source_a": 3}).first()
    assert (best.f1, best.threshold, best.k) == (1.0, 0.8, 1)


def test_training_walks_start_at_every_customer(spark):
    sf = "/root/testdata/sf0.01"
    customers = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert customers > 1000 and streams._walked(spark, sf).select("root").distinct().count() == customers
