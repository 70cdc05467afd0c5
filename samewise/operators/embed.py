"""Node embeddings from walks: word2vec with negative sampling, for a first training and for more.

The trainer works on shards of sentences. A shard gets the vectors of its own words only, trains on them with numpy, and gives them
back; the vectors of a word are averaged over its shards by the number of its places. So neither a worker nor the driver holds the whole
vocabulary, and new words start from a hash of their name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

STATE = "word string, vec array<float>, ctx array<float>, n long"
SHARD_ROWS = 20_000
FIELDS = 3, 6  # lengths of sub-words


def word2vec(walks: DataFrame, path: str = "path", size: int = 64, window: int = 3, negative: int = 5, epochs: int = 5, min_count: int = 0, seed: int = 7) -> DataFrame:
    """(word, vec) of a first training by skip-gram, without words that stand less than min_count times. Spark's own trainer keeps the
    vocabulary with its vectors and its tree on the driver, so it is not used."""
    lines = walks.select(F.col(path).alias("path"))
    if min_count > 1:
        placed = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode("path").alias("at", "word"))
        often = placed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("word")
        kept = placed.join(often, "word").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("l"))
        lines = kept.select(F.col("l.word").alias("path"))
    return trained(lines, size=size, window=window, negative=negative, epochs=epochs, seed=seed).select("word", "vec")


def started(word: str, size: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(zlib.crc32(word.encode()) + seed).random(size) - 0.5) / size


def subwords(word: str, buckets: int) -> list[str]:
    """Hashed character n-grams of a word, as words of their own."""
    marked = f"<{word}>"
    return [f"\x00{zlib.crc32(marked[i : i + n].encode()) % buckets}" for n in range(FIELDS[0], FIELDS[1] + 1) for i in range(len(marked) - n + 1)]


def train_shard(sentences: list[list[str]], known: dict[str, tuple], size: int, window: int, negative: int, epochs: int, seed: int, cbow: bool, rate: float = 0.025) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """Skip-gram or CBOW with negative samples over one shard; (vector, context vector, places) by word."""
    places: dict[str, int] = {}
    for s in sentences:
        for w in s:
            places[w] = places.get(w, 0) + 1
    words = sorted(places)
    number = {w: i for i, w in enumerate(words)}
    vec = np.array([known[w][0] if w in known else started(w, size, seed) for w in words], np.float64).reshape(-1, size)
    ctx = np.array([known[w][1] if w in known else np.zeros(size) for w in words], np.float64).reshape(-1, size)
    odds = np.array([places[w] for w in words], float) ** 0.75
    odds = np.cumsum(odds / odds.sum()) if len(odds) else odds
    rng = np.random.default_rng(seed)
    lines = [np.array([number[w] for w in s]) for s in sentences if len(s) > 1]

    def learn(sources: np.ndarray, shares: np.ndarray, target: np.ndarray, step: float) -> None:
        """Predict each target from the mean of its row of sources, which the shares weigh."""
        drawn = np.searchsorted(odds, rng.random((len(target), negative))).clip(max=len(words) - 1)
        targets = np.concatenate([target[:, None], drawn], axis=1)
        label = np.zeros(targets.shape)
        label[:, 0] = 1
        out, mid = ctx[targets], np.einsum("ij,ijk->ik", shares, vec[sources])
        error = (label - 1 / (1 + np.exp(-np.clip(np.einsum("ijk,ik->ij", out, mid), -15, 15)))) * step
        np.add.at(vec, sources, shares[:, :, None] * np.einsum("ij,ijk->ik", error, out)[:, None, :])
        np.add.at(ctx, targets.ravel(), (error[:, :, None] * mid[:, None, :]).reshape(-1, size))

    shifts = np.array([i for i in range(-window, window + 1) if i])
    for epoch in range(epochs):
        step = rate * max(0.1, 1 - epoch / max(1, epochs))
        for line in lines:
            if cbow:
                at = np.arange(len(line))[:, None] + shifts
                inside = (at >= 0) & (at < len(line))
                learn(line[at.clip(0, len(line) - 1)], inside / inside.sum(axis=1, keepdims=True), line, step)
                continue
            for shift in range(1, window + 1):
                if len(line) <= shift:
                    break
                a, b = np.append(line[:-shift], line[shift:]), np.append(line[shift:], line[:-shift])
                learn(a[:, None], np.ones((len(a), 1)), b, step)
    return {w: (vec[i], ctx[i], places[w]) for w, i in number.items()}


def trained(walks: DataFrame, state: DataFrame | None = None, path: str = "path", size: int = 64, window: int = 3, negative: int = 5, epochs: int = 5, seed: int = 7, cbow: bool = False, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The state (word, vec, ctx, n) after training on walks; words that state has go on from there, and those not walked stay."""
    spark = walks.sparkSession
    state = state if state is not None else spark.createDataFrame([], STATE)
    shards = max(1, -(-walks.count() // shard_rows))
    lines = walks.select(F.pmod(F.xxhash64(path), F.lit(shards)).alias("shard"), F.col(path).alias("path"))
    wanted = lines.select("shard", F.explode("path").alias("word")).distinct()
    known = wanted.join(state, "word").select(F.col("shard").alias("of_shard"), "word", "vec", "ctx")

    def train(lines: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        have = {w: (v, c) for w, v, c in zip(known["word"], known["vec"], known["ctx"], strict=True)}
        found = train_shard([list(p) for p in sorted(map(tuple, lines["path"]))], have, size, window, negative, epochs, seed, cbow)
        return pd.DataFrame({"word": list(found), "vec": [x[0].tolist() for x in found.values()], "ctx": [x[1].tolist() for x in found.values()], "n": [x[2] for x in found.values()]}, columns=["word", "vec", "ctx", "n"])

    parts = lines.groupBy("shard").cogroup(known.groupBy("of_shard")).applyInPandas(train, STATE)
    mean = lambda c: F.array(*[(F.sum(F.col(c)[i] * F.col("n")) / F.sum("n")).cast("float") for i in range(size)])
    fresh = parts.groupBy("word").agg(mean("vec").alias("vec"), mean("ctx").alias("ctx"), F.sum("n").alias("n"))
    both = fresh.join(state.select("word", F.col("vec").alias("v0"), F.col("ctx").alias("c0"), F.col("n").alias("n0")), "word", "full")
    return both.select("word", F.coalesce("vec", "v0").alias("vec"), F.coalesce("ctx", "c0").alias("ctx"), (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"))


def with_subwords(walks: DataFrame, buckets: int = 1 << 16, path: str = "path") -> DataFrame:
    """Walks with one line more per word: the word and its sub-words, so that words of like spelling come near to each other."""

    @arrow_udf("array<string>")
    def spelled(words: pa.Array) -> pa.Array:
        return pa.array([[w, *subwords(w, buckets)] for w in words.to_pylist()], pa.list_(pa.string()))

    words = walks.select(F.explode(path).alias("w")).distinct().select(spelled("w").alias(path))
    return walks.select(path).unionByName(words)


def records_only(state: DataFrame, prefix: str = "idx__") -> DataFrame:
    """(vec_id, embedding) of the record nodes."""
    return state.where(F.col("word").startswith(prefix)).select(F.expr(f"cast(substr(word, {len(prefix) + 1}) as bigint)").alias("vec_id"), F.col("vec").alias("embedding"))
