"""Similarity lists in their file formats, written and read back."""

import json
import sqlite3

import pytest

from samewise import config
from samewise.operators import evaluate, simstore
from samewise.sources import listfiles


def rows(df):
    return sorted((r.key, r.other, r.score) for r in df.collect())


def heap(spark):
    return spark.createDataFrame([(f"idx__{i}", f"idx__{i + r}", 1 - r / 10, r) for i in range(50) for r in (1, 2)], "key string, word string, score double, rank int")


@pytest.mark.parametrize("fmt", listfiles.FORMATS)
def test_lists_come_back(spark, tmp_path, fmt):
    path = f"{tmp_path}/lists.{fmt}"
    for _ in range(2):  # the second takes the place of the first
        simstore.write_lists(heap(spark), path, fmt)
    want = sorted((r.key, r.word, r.score) for r in heap(spark).collect())
    assert rows(evaluate.read_similarities(spark, path, fmt)) == want
    simstore.write_lists(heap(spark).where("false"), path, fmt)
    assert fmt == "parquet" or rows(evaluate.read_similarities(spark, path, fmt)) == []
    with pytest.raises(ValueError):
        evaluate.read_similarities(spark, path, "xml")


def test_a_database_is_read_by_ranges_with_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listfiles, "BLOCK", 3)
    path = f"{tmp_path}/a.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE matchinglist (id TEXT PRIMARY KEY, similarity TEXT)")
        con.executemany("INSERT INTO matchinglist VALUES (?, ?)", [(f"k{i}", json.dumps([(0.5, "x"), (0.25, "y")])) for i in range(100)])
        con.execute("DELETE FROM matchinglist WHERE rowid % 3 = 0 OR rowid BETWEEN 20 AND 60")
        left = [r[0] for r in con.execute("SELECT id FROM matchinglist")]
    con.close()
    assert rows(evaluate.read_similarities(spark, f"file:{path}", "db")) == sorted((k, w, s) for k in left for w, s in (("x", 0.5), ("y", 0.25)))
    for parts in (1, 7, 1000):
        reader = listfiles.ListReader(path, parts)
        found = reader.partitions()
        assert len(found) <= parts and sorted(k for p in found for b in reader.read(p) for k in b.column(0).to_pylist()) == sorted(left)


def test_json_as_one_object_or_by_lines(spark, tmp_path):
    lists = {"idx__1": [[0.5, "idx__2"], [0.25, "key"]], "key": [[1.0, "idx__1"]], "none": []}
    (tmp_path / "one.json").write_text(json.dumps(lists))
    (tmp_path / "lines.json").write_text("".join(json.dumps({"key": k, "similarity": json.dumps(v)}) + "\n" for k, v in lists.items()))
    want = sorted((k, w, s) for k, v in lists.items() for s, w in v)
    for name in ("one", "lines"):
        assert rows(evaluate.read_similarities(spark, f"{tmp_path}/{name}.json", "json")) == want


def test_a_database_stays_on_the_machine():
    assert listfiles.local("file:///a/b.db") == listfiles.local("file:/a/b.db") == "/a/b.db" and listfiles.local("a:b/c") == "a:b/c"
    given = {"task": "smatch", "output_file_name": "hdfs://somewhere/x", "similarity_list": {"output_format": "db"}}
    with pytest.raises(ValueError, match="local"):
        config.checked(given)
    config.checked(given | {"output_file_name": "x"})
