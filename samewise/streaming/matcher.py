"""Exact matching of a record stream, window by window.

Every micro-batch is numbered on from the batch before it, joined with the rows that did not fill a window, and cut into count windows.
All full windows of a batch are handled in one plan. Where windows go by time, a micro-batch is one: the trigger's interval is the window's length. A record is judged in the first window that holds it: its match is the first record
with its token set that was judged in an earlier window, and its cluster's survivor the first of those judged with it. State is parquet under one folder, a subfolder per batch that a repeated batch
replaces, so a batch may run twice: next number, first records by token set, and the rows carried over. The first records are gathered
anew every COMPACT batches, so that a batch reads the last gathering and what came since.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.functions.text import token_key

COMPACT = 32  # batches
POLL = 1.0  # seconds between looks at a stream that may be idle
STORE = "token_key string, rid long, window_id long"
MATCHES = "rid long, window_id long, survivor long, match long"


class Matcher:
    def __init__(self, spark: SparkSession, base: str, columns: Sequence[str], order: Sequence[str], window_count: int, stride: int = 0, by_time: bool = False) -> None:
        """stride is how many rows leave a full window; 0 empties it. With by_time every micro-batch is a window, and the counts are not used."""
        if stride < 0 or stride > window_count:
            raise ValueError("stride must be between 0 and window_count")
        self.spark, self.base, self.columns, self.order = spark, base.rstrip("/"), list(columns), list(order)
        self.size, self.stride, self.by_time = window_count, stride or window_count, by_time
        self.record_schema = ", ".join(["rid long", *(f"`{c}` string" for c in self.columns)])

    def _has(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _read(self, name: str, schema: str, before: int, only: bool, keep: bool = False) -> DataFrame:
        """What batches before this one have written; with only, what the last of them has."""
        path = f"{self.base}/{name}"
        if not self._has(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema if keep else f"{schema}, batch long").option("basePath", path).parquet(path)
        rows = rows.where(F.col("batch") == before if only else F.col("batch") <= before)
        return rows if keep else rows.drop("batch")

    def _write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")

    def process(self, records: DataFrame, batch: int) -> None:
        """The function for foreachBatch. A micro-batch is bounded by the trigger, so it is numbered in one task."""
        start = self._read("next", "n long", batch - 1, True).first()
        offset = start[0] if start else 0
        number = (F.row_number().over(Window.orderBy(*self.order)) - 1 + offset).cast("long").alias("rid")
        self._write("records", batch, records.select(number, *[F.col(f"`{c}`").cast("string").alias(c) for c in self.columns]))
        fresh = self._read("records", self.record_schema, batch, True).select("rid", token_key([F.col(f"`{c}`") for c in self.columns]).alias("token_key"))
        carried = self._read("carry", "rid long, token_key string", batch - 1, True)
        self._write("pending", batch, carried.unionByName(fresh))
        pending = self._read("pending", "rid long, token_key string", batch, True)
        n, low = pending.agg(F.count(F.lit(1)), F.min("rid")).first()
        low = low or 0
        windows = 0 if self.by_time or n < self.size else (n - self.size) // self.stride + 1
        self._judge(pending, low, windows, batch)
        self._write("carry", batch, pending.where("false") if self.by_time else pending.where(F.col("rid") >= low + windows * self.stride))
        self._write("next", batch, self.spark.createDataFrame([(offset + self._fresh(n, carried),)], "n long"))

    @staticmethod
    def _fresh(pending: int, carried: DataFrame) -> int:
        return pending - carried.count()

    def flush(self, batch: int) -> None:
        """The rows that fill no window become the last one."""
        rest = self._read("carry", "rid long, token_key string", batch, True)
        low = rest.agg(F.min("rid")).first()[0]
        if low is not None:
            self._judge(rest, low, 1, batch + 1)

    def _judge(self, pending: DataFrame, low: int, windows: int, batch: int) -> None:
        if self.by_time:
            end, first = low + pending.count(), F.lit(batch).cast("long")
        else:
            end = low + max(0, windows - 1) * self.stride + (self.size if windows else 0)
            first = F.greatest(F.lit(0), F.floor((F.col("rid") - self.size) / self.stride) + 1).cast("long")
        known = self._judged_to(batch - 1)
        placed = pending.where((F.col("rid") >= known) & (F.col("rid") < end)).select("rid", first.alias("window_id"), "token_key")
        self._write("judged", batch, self.spark.createDataFrame([(max(known, end),)], "n long"))
        old = self._first(batch - 1).select("token_key", F.col("rid").alias("old_rid"))
        own = placed.groupBy("token_key").agg(F.min(F.struct("rid", "window_id")).alias("f")).select("token_key", F.col("f.rid").alias("first_rid"), F.col("f.window_id").alias("first_window"))
        mine = placed.groupBy("window_id", "token_key").agg(F.min("rid").alias("survivor"))
        both = placed.join(mine, ["window_id", "token_key"]).join(own, "token_key").join(old, "token_key", "left")
        found = F.coalesce("old_rid", F.when(F.col("first_window") < F.col("window_id"), F.col("first_rid")))
        self._write("matches", batch, both.select("rid", "window_id", "survivor", found.alias("match")))
        self._write("store", batch, own.select("token_key", F.col("first_rid").alias("rid"), F.col("first_window").alias("window_id")))
        if batch % COMPACT == COMPACT - 1:
            self._write("gathered", batch, self._first(batch))

    def _first(self, before: int) -> DataFrame:
        """The first record of each token set, of batches up to this one: what was gathered last before it, and what came since."""
        gathered = before // COMPACT * COMPACT - 1
        old = self._read("gathered", STORE, gathered, True)
        since = self._read("store", STORE + ", batch long", before, False, keep=True).where(F.col("batch") > gathered).drop("batch")
        rows = old.unionByName(since)
        return rows.groupBy("token_key").agg(F.min(F.struct("rid", "window_id")).alias("o")).select("token_key", "o.rid", "o.window_id")

    def _judged_to(self, batch: int) -> int:
        found = self._read("judged", "n long", batch, True).first()
        return found[0] if found else 0

    def matches(self, batch: int = 1 << 60, only: bool = False) -> DataFrame:
        """(rid, window_id, survivor, match) of all windows so far, or of those that one batch judged."""
        return self._read("matches", MATCHES, batch, only)

    def latest(self) -> int:
        """The number of the last batch, -1 before the first."""
        found = self._read("next", "n long, batch long", 1 << 60, False, keep=True) if self._has("next") else None
        return -1 if found is None else found.agg(F.max("batch")).first()[0]

    def records(self, batch: int = 1 << 60) -> DataFrame:
        """The records with their numbers."""
        return self._read("records", self.record_schema, batch, False)


def run(stream: DataFrame, matcher, checkpoint: str, idle: float | None = None, **trigger) -> int:
    """Run until the stream is drained (or as the trigger says), flush, and return the last batch's number, -1 if there never was one.
    matcher has process, flush and latest. Flushing again what a run before has flushed changes nothing.

    With ``idle``, a stream that goes on is stopped between two batches once no rows have come for so many seconds.
    """
    query = stream.writeStream.foreachBatch(matcher.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if idle is None:
        query.awaitTermination()
    else:
        seen, since = None, time.monotonic()
        while not query.awaitTermination(POLL):
            progress, status = query.lastProgress, query.status
            last = progress["batchId"] if progress and progress["numInputRows"] else seen
            if status["isTriggerActive"] or status["isDataAvailable"] or last != seen:
                seen, since = last, time.monotonic()
            elif time.monotonic() - since > idle:
                query.stop()
                break
    last = matcher.latest()
    if last >= 0:
        matcher.flush(last)
    return last
