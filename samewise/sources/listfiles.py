"""Similarity lists in files: tables, JSON, and SQLite databases.

A list is the JSON text of [score, word] pairs. In tables it stands in ``similarity`` or ``value`` beside ``key``. A JSON file has on each line
an object of key and similarity, or one whose fields are the keys. A database has a table ``matchinglist`` of id and similarity.

A database is one file with one writer, so it is for results that one machine can hold: it is read by ranges of its rows, by as
many tasks as asked for, each a block at a time, from a path that all workers see; it is written by the driver, which holds a partition at a time.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: the table that holds lists in a database.
TABLE = "matchinglist"
FORMATS = ("parquet", "json", "db")
SCHEMA = "key string, similarity string"
BLOCK = 4096  # rows


class Rows(InputPartition):
    """Rows of a database from one number to another, inclusive."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class ListDatabase(DataSource):
    """``spark.read.format("similarity_db").option("parts", 8).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "similarity_db"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListReader(self.options["path"], int(self.options.get("parts", "8")))


class ListReader(DataSourceReader):
    def __init__(self, path: str, parts: int) -> None:
        self.path, self.parts = path, parts

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        with closing(self._open()) as con:
            first, last = con.execute(f"SELECT min(rowid), max(rowid) FROM {TABLE}").fetchone()
        if first is None:
            return [Rows(0, -1)]
        step = -(-(last - first + 1) // self.parts)
        return [Rows(a, a + step - 1) for a in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with closing(self._open()) as con:
            found = con.execute(f"SELECT id, similarity FROM {TABLE} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while block := found.fetchmany(BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*block, strict=True)], ["key", "similarity"])


def local(path: str) -> str:
    """A path without the scheme of local files; any other scheme is refused."""
    path = re.sub("^file:(//(?=/))?", "", path)
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"a database must be in a local path, not {path}")
    return path


def read_lists(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(key, similarity) of a file or folder."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {', '.join(FORMATS)}")
    if fmt == "db":
        spark.dataSource.register(ListDatabase)
        return spark.read.format("similarity_db").load(local(path))
    if fmt == "parquet":
        rows = spark.read.parquet(path)
        return rows.select("key", F.col("similarity" if "similarity" in rows.columns else "value").alias("similarity"))
    fields = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("f"))
    own = (F.size("f") == 2) & F.col("f")["key"].isNotNull() & F.col("f")["similarity"].isNotNull()
    entries = F.when(own, F.array(F.struct(F.col("f")["key"].alias("key"), F.col("f")["similarity"].alias("value")))).otherwise(F.map_entries("f"))
    return fields.select(F.explode(entries).alias("e")).select("e.key", F.col("e.value").alias("similarity"))


def write_db(lists: DataFrame, path: str) -> None:
    """(key, similarity) as a database, which takes the place of one at the path when it is whole."""
    path = local(path)
    fresh = f"{path}.next"
    if os.path.exists(fresh):
        os.remove(fresh)
    with closing(sqlite3.connect(fresh)) as con, con:
        con.execute(f"CREATE TABLE {TABLE} (id TEXT PRIMARY KEY, similarity TEXT)")
        con.executemany(f"INSERT OR REPLACE INTO {TABLE} VALUES (?, ?)", (tuple(r) for r in lists.select("key", "similarity").toLocalIterator()))
    os.replace(fresh, path)
