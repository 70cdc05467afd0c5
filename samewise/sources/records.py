"""Record tables and record streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(df: DataFrame, start: int = 0, name: str = "rid_num") -> DataFrame:
    """Number rows gaplessly from start, in the order of the partitions: counts per partition are summed first, so no task sees all rows."""
    placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + start).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__in")).drop("__part", "__in", "__start")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all cells text, with rid_num from 0 and rid."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return numbered(rows).withColumn("rid", F.concat(F.lit("idx__"), F.col("rid_num")))


def decoded(raw: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The JSON messages of a stream as columns; a message that is no JSON object gives NULLs. The arrival time is not a record's column."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*").drop("timestamp")


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 10_000, start: str = "earliest") -> DataFrame:
    """Messages from the start on at first, then from where the query's checkpoint is. Needs Spark's Kafka package. A run that drains the
    topic and ends has to start at the earliest offset: from the latest one there is nothing to drain."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).option("maxOffsetsPerTrigger", per_trigger).load()


def json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """The same from a folder of JSON lines."""
    return decoded(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), schema)


def pair_texts(rows: DataFrame) -> DataFrame:
    """(text1, text2, labels) from columns like left1.name and right2.name: each side joins name and value, ids are left out."""

    def side(digit: str) -> Column:
        mine = [c for c in rows.columns if "." in c and c.split(".")[0][-1:] == digit and c.split(".")[1] != "id"]
        return F.concat(F.lit(""), *[F.concat(F.lit(c.split(".")[1]), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))) for c in mine])

    label = F.col("label").cast("int") if "label" in rows.columns else F.lit(0)
    return rows.select(side("1").alias("text1"), side("2").alias("text2"), label.alias("labels"))


def set_of(key: Column, seed: int = 42) -> Column:
    """train, valid or test in the proportions 3 to 1 to 1, by a hash of the key."""
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(5))
    return F.when(part < 3, F.lit("train")).when(part == 3, F.lit("valid")).otherwise(F.lit("test"))


def split_sets(rows: DataFrame, key: str, seed: int = 42) -> dict[str, DataFrame]:
    """The rows of each of the sets."""
    return {name: rows.where(set_of(F.col(key), seed) == name) for name in ("train", "valid", "test")}
