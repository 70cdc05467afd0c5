import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from samewise.llm import sharding


def brute(key, weights):
    text = "" if key is None else str(key)
    draw = lambda i: (int(hashlib.md5(f"{text}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min(range(len(weights)), key=lambda i: -math.log(draw(i)) / weights[i])


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == brute(r.doc_id, [1.0] * 8) and r.grown_shard == brute(r.doc_id, [1.0] * 9) and r.grown_shard in (r.shard, 8)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_weights_and_edges(spark):
    rows = [(i if i % 11 else None, "x", i % 3) for i in range(4000)] + [(7, "x", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int").withColumnRenamed("shard", "old")
    placed = sharding.assign(df, "doc_id", [1.0, 2.0, 5.0])
    found = placed.collect()
    assert all(r.shard == brute(r.doc_id, [1.0, 2.0, 5.0]) for r in found)
    share = Counter(r.shard for r in found if r.doc_id is not None)
    assert share[0] < share[1] < share[2]
    numbered = sharding.numbered(placed.select("doc_id", "shard"), blocks=7).collect()
    assert Counter((r.doc_id, r.shard) for r in numbered) == Counter((r.doc_id, r.shard) for r in found)
    for shard in range(3):
        slots = sorted(r.slot for r in numbered if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.numbered(placed.select("doc_id", "shard").where("false")).collect() == []
    with pytest.raises(ValueError, match="positive"):
        sharding.assign(df, "doc_id", [1.0, 0.0])


def test_equal_rows_are_counted_before_they_are_dealt(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("shard"))
    assert sorted(r.slot for r in sharding.numbered(df).collect()) == list(range(5000))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, i % 2, 9, 1, "p") for i in range(20)], "doc_id long, shard int, slot int, __n int, `a.b` string")
    found = sharding.numbered(df)
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted((r.shard, r.slot) for r in found.collect()) == [(s, i) for s in range(2) for i in range(10)]
