"""Windows over records: by count and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.sources.shared import written


def in_order(df: DataFrame, ts: str, tie: str, name: str = "n") -> DataFrame:
    """Number rows from 0 by (ts, tie). The rows are dealt by ranges of (ts, tie), near equal ones however they bunch in time, and written;
    each range is numbered by itself and starts where those before it end."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, ts, tie).sortWithinPartitions(ts, tie).withColumn("__at", F.monotonically_increasing_id())
    rows = written(dealt, "in-order")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__c")).select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    nth = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + nth).drop("__at", "__part", "__start")


def tumbling(number: Column, size: int) -> Column:
    return F.floor(number / size).cast("long")


def sliding(df: DataFrame, number: str, size: int, stride: int, name: str = "window_id") -> DataFrame:
    """A row per row and window [i * stride, i * stride + size) that holds it."""
    last = F.floor(F.col(number) / stride)
    first = F.greatest(F.lit(0), F.floor((F.col(number) - size) / stride) + 1)
    return df.withColumn(name, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def by_time(df: DataFrame, ts: str, length: str, slide: str | None = None) -> DataFrame:
    return df.withColumn("w", F.window(ts, length, slide)).withColumn("window_start", F.col("w.start")).drop("w")
