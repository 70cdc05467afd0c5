"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only.

Every shard gets a uniform number from MD5 of key and shard; the record goes to the shard with the least ``-ln(u) / weight``.
A further shard adds one more number and leaves the others as they are, so rows move only into it.

Edge cases: a NULL key is hashed as the empty string; a NULL text counts as no bytes, with CRC-32 0; rows that are equal in
key, size and checksum get different slots; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 8
BLOCKS = 1024  # per shard, for the numbering; a block holds rows / (SHARDS * BLOCKS)
TWO_52 = float(2**52)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / TWO_52


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.ln(uniform(text, F.lit(str(i)))) / F.lit(float(w))).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """Add the shard column. No shuffle."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def numbered(df: DataFrame, shard: str = "shard", slot: str = "slot", blocks: int = BLOCKS) -> DataFrame:
    """One row per row of df, whose columns identify a record, plus a gapless number from 0 within its shard.

    Equal rows are counted first and expanded last. Rows of a shard are dealt to blocks by a hash and numbered there; a block
    starts where the blocks before it end. Only the blocks' counts, at most shards * blocks rows, are broadcast. The number replaces a
    column of its name.
    """
    df = df.drop(slot)
    names = [c for c in df.columns if c != shard]
    own = F.struct(*[F.col(f"`{c}`") for c in names])
    df = df.select(F.col(f"`{shard}`").alias("__shard"), own.alias("__own"))
    listed = [F.col("__own").getField(c) for c in names] + [F.col("__shard")]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in listed]).cast("binary"))
    block = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    counted = df.groupBy("__shard", "__own").agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", block)
    before = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("__shard", "__block").agg(F.sum("__n").alias("__rows")).withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    within = Window.partitionBy("__shard", "__block").orderBy("__own").rowsBetween(Window.unboundedPreceding, 0)
    ended = counted.withColumn("__end", F.sum("__n").over(within))
    first = F.col("__start") + F.col("__end") - F.col("__n")
    placed = ended.join(F.broadcast(starts), ["__shard", "__block"])
    return placed.select("__own.*", F.col("__shard").alias(shard), F.explode(F.sequence(first, F.col("__start") + F.col("__end") - 1)).alias(slot))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law ``key``: document number and shard count decide."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = numbered(assign(rows, "doc_id", [1.0] * SHARDS))
    grown = assign(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_DRAWS = "list_transform(range({0}), lambda i: ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT)"
SQL = f"""
WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 AS n, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT) AS b FROM h),
c AS (SELECT doc_id, n + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS text_crc32 FROM b, t),
d AS (SELECT *, {_DRAWS.format(SHARDS)} AS few, {_DRAWS.format(SHARDS + 1)} AS more FROM c),
s AS (SELECT *, (list_position(few, list_max(few)) - 1)::INTEGER AS shard, (list_position(more, list_max(more)) - 1)::INTEGER AS grown_shard FROM d),
k AS (SELECT *, ('0x' || substr(md5(concat_ws(':', doc_id, size, text_crc32, shard)), 1, 8))::BIGINT % {BLOCKS} AS block FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM k
"""
