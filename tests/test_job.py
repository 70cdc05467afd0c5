"""The window job: what it keeps, that a repeated batch changes nothing, and that the evaluation reads its lists."""

import json
import os

import pytest
from pyspark.sql import functions as F

from samewise import app
from samewise.operators import knn, simstore
from samewise.plans.streams import JOB
from samewise.sources import listfiles
from samewise.sources.shared import fresh_path
from samewise.streaming import job, matcher

ROWS = [(i, f"shop {i % 7} of town {i % 5}", f"street {i % 11}") for i in range(40)]


def batches(spark):
    frame = spark.createDataFrame([(i, a, b, None) for i, a, b in ROWS], "n int, name string, street string, extra string")
    return [frame.where(F.col("n") % 2 == i) for i in (0, 1)]


def contents(done, out, spark):
    keep = lambda df, *cs: sorted(map(str, df.select(*cs).collect()))
    return [
        keep(done.matcher.matches(), "rid", "window_id", "survivor", "match"),
        keep(done.versions(), "pair_key", "version", "score", "stage", "decision"),
        keep(spark.read.parquet(f"{out}-similarities.parquet"), "key", "similarity"),
        keep(spark.read.option("header", True).csv(f"{out}-changes"), "round", "target_id", "neighbor_rank", "neighbor_id"),
    ]


@pytest.mark.parametrize("by_time", [False, True])
def test_a_repeated_batch_changes_nothing(spark, by_time):
    out = fresh_path(spark, "out")
    done = job.Job(matcher.Matcher(spark, fresh_path(spark, "job"), ("name", "street", "extra"), ("n",), 8, by_time=by_time), JOB, out)
    first, second = batches(spark)
    done.process(first, 0)
    done.process(second, 1)
    if not by_time:
        done.flush(1)
    before = contents(done, out, spark)
    if by_time:
        done.process(second, 1)
        assert {r.window_id for r in done.matcher.matches().collect()} == {0, 1}
    else:
        done.flush(1)
    assert contents(done, out, spark) == before
    judged = done.matcher.matches().collect()
    assert sorted(r.rid for r in judged) == list(range(40))
    assert done.versions().where("version = 1").count() > 0


def test_first_records_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(matcher, "COMPACT", 2)
    found = matcher.Matcher(spark, fresh_path(spark, "m"), ("name",), ("n",), 1, by_time=True)
    for batch in range(5):
        found.process(spark.createDataFrame([(0, f"name {batch % 2}"), (1, f"own {batch}")], "n int, name string"), batch)
    matches = {r.rid: r.match for r in found.matches().collect()}
    assert [matches[2 * b] for b in range(5)] == [None, None, 0, 2, 0] and all(matches[2 * b + 1] is None for b in range(5))


@pytest.mark.parametrize(("strategy", "fmt"), [("count", "parquet"), ("time", "db")])
def test_stream_task_and_evaluation_of_its_lists(spark, tmp_path, strategy, fmt):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("".join(json.dumps({"name": a, "street": b}) + "\n" for _, a, b in ROWS[:30]))
    given = {"task": "smatch", "columns": ["name", "street"], "stream_folder": str(folder), "output_file_name": str(tmp_path / "o"), "drain": True, **{k: JOB[k] for k in ("walks", "embeddings")}}
    given["graph"] = {"smoothing_method": "log"}
    given["kafka"] = {"window_strategy": strategy, "window_time": 1, "window_count": 10}
    given["similarity_list"] = JOB["similarity_list"] | {"output_format": fmt}
    app.run(spark, given)
    lists = f"{tmp_path}/o-similarities.{fmt}"
    assert listfiles.read_lists(spark, lists, fmt).count() > 10 and os.path.isdir(f"{tmp_path}/o-changes")
    (tmp_path / "truth.txt").write_text("idx_0,idx_1\n")
    best = app.run(spark, {"task": "evaluation", "similarity_file": lists, "match_file": str(tmp_path / "truth.txt"), "source_a": 40})
    assert best.columns[:2] == ["threshold", "k"]


def test_evaluation_reads_graphml(spark, tmp_path):
    from samewise.sources import graphs

    members = spark.createDataFrame([("idx__0", "idx__0,idx__3"), ("idx__1", "idx__1")], "`group` string, members string")
    edges = spark.createDataFrame([("idx__0", "idx__1", 0.25)], "a string, b string, weight double")
    (tmp_path / "s.graphml").write_text(graphs.graphml(members, edges))
    (tmp_path / "truth.txt").write_text("idx_0,idx_3\n")
    best = app.run(spark, {"task": "evaluation", "similarity_file": str(tmp_path / "s.graphml"), "match_file": str(tmp_path / "truth.txt"), "source_a": 3}).first()
    assert (best.f1, best.correct) == (1.0, 1)


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, v int")
    simstore.upsert(spark, path, rows(("a", 1), ("b", 2), ("b", 2)))
    simstore.upsert(spark, path, rows(("b", 3), ("c", 4)))
    assert {(r.key, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    os.rename(path, f"{path}.before")  # a run that ended between the two renames
    simstore.upsert(spark, path, rows(("d", 5)))
    assert {r.key for r in spark.read.parquet(path).collect()} == {"a", "b", "c", "d"}


def test_vectors_of_different_lengths_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        knn.topk(vectors, 1).collect()


def made(spark, folder, **more):
    given = {"task": "smatch", "columns": ["name", "street"], "stream_folder": str(folder / "in"), "output_file_name": str(folder / "o"), **{k: JOB[k] for k in ("walks", "embeddings", "similarity_list")}}
    return given | more


def lines(rows):
    return "".join(json.dumps({"name": a, "street": b}) + "\n" for _, a, b in rows)


def test_a_run_that_finds_nothing_new_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(lines(ROWS[:12]))
    given = made(spark, tmp_path, drain=True, files_per_trigger=1, kafka={"window_strategy": "count", "window_count": 5})
    assert app.run(spark, given) == 0
    (tmp_path / "in/b.json").write_text(lines(ROWS[12:25]))
    assert app.run(spark, given) == 1
    read = lambda: sorted(map(str, spark.read.parquet(f"{tmp_path}/o-similarities.parquet").collect()))
    before = read()
    assert app.run(spark, given) == 1 and read() == before


def test_a_live_stream_stops_when_idle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(lines(ROWS[:6]))
    given = made(spark, tmp_path, exact_only=True, kafka={"window_strategy": "time", "window_time": 1, "idle_seconds": 3})
    assert app.run(spark, given) == 0
    assert matcher.Matcher(spark, f"{tmp_path}/o-state", ("name", "street"), ("name",), 0, by_time=True).matches().count() == 6


def test_rebuild(spark):
    out = fresh_path(spark, "out")
    done = job.Job(matcher.Matcher(spark, fresh_path(spark, "job"), ("name", "street", "extra"), ("n",), 8, by_time=True), JOB, out)
    for batch, rows in enumerate(batches(spark)):
        done.process(rows, batch)
    done.rebuild(1)
    n = JOB["similarity_list"]["simlist_n"]
    found = {r.key: json.loads(r.similarity) for r in spark.read.parquet(f"{out}-similarities.parquet").collect()}
    judged = done.matcher.matches().collect()
    fresh = {f"idx__{r.rid}" for r in judged if r.match is None and r.survivor == r.rid}
    assert fresh <= set(found) and all(0 < len(x) <= n for x in found.values())
    assert all(key not in [w for _, w in x] for key, x in found.items())


def test_gauges():
    class Event:
        def __init__(self, **kw):
            self.__dict__.update(kw)

    watch = app.Progress()
    watch.onQueryStarted(Event(id="s"))
    for n in (3, 4):
        watch.onQueryProgress(Event(progress=Event(id="s", batchId=n, numInputRows=n, durationMs={"triggerExecution": 1500}, sources=[Event(metrics={"maxOffsetsBehindLatest": "9"})])))
    assert watch.gauges["s"] == {"consumed": 7, "batches": 2, "window_seconds": 1.5, "lag": 9}


def test_command_line_goes_on_and_logs_to_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(app, "LOG_BYTES", 400)
    monkeypatch.setattr(app, "session", lambda: spark)
    for i, body in enumerate(("task: nothing", "task: llm-test", "task: llm-test")):
        (tmp_path / f"{i}.yaml").write_text(f"{body}\nlog:\n  path: {tmp_path}/logs/run{i}\n")
    with pytest.raises(ValueError, match="nothing"):
        app.main(["-d", str(tmp_path)])
    with pytest.raises(SystemExit, match="0.yaml"):
        app.main(["-d", str(tmp_path), "--unblocking"])
    assert "failed" in (tmp_path / "logs/run0.log").read_text() and "took" in (tmp_path / "logs/run2.log").read_text()
    with pytest.raises(SystemExit):
        app.main(["-d", str(tmp_path), "--unblocking", "--no_info"])
    assert (tmp_path / "logs/run2.log").read_text().count("took") == 1
    assert (tmp_path / "logs/run0.log.1").exists()  # rotated
