"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text becomes its 1- to 3-grams of lower-case characters, hashed into BUCKETS columns. Training adds up the counts of a bounded sample
of labelled texts and takes smoothed log probabilities. The matrix has BUCKETS rows of one number per language and is broadcast. It is kept
as each language's number for columns not seen with it, and what the seen ones have above that; so its size is bounded by the sample, however
many values a dirty language column has. Scoring gathers matrix rows for all n-grams of a batch at once and adds them up by text; texts
of any length are scored whole, in stretches.

The sample: of the rows with text and language, those with the SAMPLE least hashes of key and text; it is chosen by the hashes alone, rows
that repeat key and text count once, and its counts are added up by all executors.

Edge cases: a NULL text, or one without a letter, gets ``und`` with score 0, and so does every text if nothing could be learned; rows
without language are not learned from; a NULL document number is neither held out nor learned from; an empty table gives an empty
result. The result column replaces an input column of the same name; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BUCKETS = 1 << 15
SAMPLE = 20_000
DENSE = 64  # languages up to which the matrix is laid out in full for scoring; the numbers are the same
SMOOTHING = 0.5
LARGEST_N = 3
PIECE = 1 << 18  # characters scored at once
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray
    unseen: np.ndarray  # by language, the log likelihood of a column that was not seen with it
    first: np.ndarray  # BUCKETS + 1 places in of and above
    of: np.ndarray  # languages that a column was seen with
    above: np.ndarray  # their log likelihood less unseen

    def likelihoods(self) -> np.ndarray:
        """The whole matrix, (BUCKETS, languages)."""
        out = np.repeat(self.unseen[None, :], BUCKETS, axis=0)
        out[np.repeat(np.arange(BUCKETS), np.diff(self.first)), self.of] += self.above
        return np.asfortranarray(out)


def grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, the column of the n-gram that starts at each character."""
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, LARGEST_N + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] + codes[n - 1 :].astype(np.uint64) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield n, ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int64)


def stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(characters, text of each) of stretches of texts; a space stands before each text. Long texts come in overlapping parts, and an
    n-gram is in the stretch where it starts."""
    codes, owner, held = [], [], 0
    for d, text in enumerate(texts):
        whole = " " + text
        for a in range(0, len(whole), PIECE):
            part = whole[a : a + PIECE + LARGEST_N - 1]
            codes.append(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
            mine = np.full(len(codes[-1]), d)
            mine[PIECE:] = -1
            owner.append(mine)
            held += len(part)
            if held >= PIECE:
                yield np.concatenate(codes), np.concatenate(owner)
                codes, owner, held = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(owner)


def _placed(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, column) of the n-grams that start in a stretch and do not reach into another text."""
    for n, column in grams(codes):
        start, end = owner[: len(column)], owner[n - 1 :]
        ok = (start >= 0) & ((start == end) | (end == -1))
        yield start[ok], column[ok]


def counted(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows of (lang, column, n): the n-gram counts of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for language in set(langs):
                sums = total.setdefault(language, np.zeros(BUCKETS, np.int64))
                for codes, owner in stretches([t for t, x in zip(texts, langs, strict=True) if x == language]):
                    for _, column in _placed(codes, owner):
                        sums += np.bincount(column, minlength=BUCKETS)
        for language, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], ["lang", "column", "n"])

    parts = labelled.select(F.lower(F.col(text)).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, column int, n long")
    return parts.groupBy("lang", "column").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on the bounded sample. The driver gets one number per language and column that were seen together in it."""
    labelled = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).alias("mark")).where("text IS NOT NULL AND lang IS NOT NULL")
    most = labelled.select("mark").distinct().orderBy("mark").limit(sample).agg(F.max("mark")).first()[0]
    if most is None:
        return Model([], np.zeros(0), np.zeros(0), np.zeros(BUCKETS + 1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    chosen = labelled.where(F.col("mark") <= most).groupBy("mark").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.text", "r.lang")
    priors = {r[0]: r[1] for r in chosen.groupBy("lang").count().collect()}
    languages = sorted(priors)
    found = counted(chosen, "text", "lang").toArrow()
    column, n = found["column"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(float)
    coded = found["lang"].combine_chunks().dictionary_encode()
    slot = {x: i for i, x in enumerate(languages)}
    of = np.array([slot[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(column) else np.zeros(0, np.int64)
    total = np.bincount(of, n, len(languages)) + SMOOTHING * BUCKETS
    order = np.lexsort((of, column))
    first = np.searchsorted(column[order], np.arange(BUCKETS + 1))
    prior = np.array([priors[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(SMOOTHING / total), first, of[order], np.log1p(n[order] / SMOOTHING))


def scores(model: Model, texts: list[str], matrix: np.ndarray | None = None) -> np.ndarray:
    """Log posteriors up to a constant, a row per text: the prior and the sum over the text's n-grams; matrix is the model's, in full."""
    out = np.repeat(model.log_prior[None, :], len(texts), axis=0)
    for codes, owner in stretches(texts):
        for text, column in _placed(codes, owner):
            if not len(text):
                continue
            new = np.flatnonzero(np.diff(text, prepend=-1))
            if matrix is not None:
                for j in range(len(model.languages)):
                    out[text[new], j] += np.add.reduceat(matrix[:, j][column], new)
                continue
            out[text[new]] += np.diff(np.append(new, len(text)))[:, None] * model.unseen
            for a in range(0, len(column), 1 << 14):
                t, c = text[a : a + (1 << 14)], column[a : a + (1 << 14)]
                sizes = model.first[c + 1] - model.first[c]
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(model.first[c], sizes)
                np.add.at(out, (np.repeat(t, sizes), model.of[at]), model.above[at])
    return out


def identified(model: Model, text: Column, spark: SparkSession) -> Column:
    """A struct of lang and score, the posterior probability of the language."""
    if not model.languages:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    laid: list[np.ndarray] = []

    @arrow_udf("struct<lang:string,score:double>")
    def column(texts: pa.Array) -> pa.Array:
        model = shared.value
        if not laid and len(model.languages) <= DENSE:
            laid.append(model.likelihoods())
        listed = pc.fill_null(texts, "").to_pylist()
        step = max(1, (1 << 22) // len(model.languages))  # texts at once, for which a row of all languages is held
        parts = [_best(model, scores(model, listed[a : a + step], laid[0] if laid else None)) for a in range(0, len(listed), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = column(F.lower(F.when(lettered, text)))
    return F.struct(F.when(lettered, found["lang"]).otherwise(UNKNOWN).alias("lang"), F.when(lettered, found["score"]).otherwise(0.0).alias("score"))


def _best(model: Model, total: np.ndarray) -> pa.Array:
    """The likeliest language of each row of log posteriors, and its share."""
    best = total.argmax(axis=1)
    part = np.exp(total - total.max(axis=1, keepdims=True))
    score = part.max(axis=1) / part.sum(axis=1)
    return pa.StructArray.from_arrays([pa.array([model.languages[i] for i in best.tolist()], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct of lang and score."""
    return docs.withColumn(out, identified(model, F.col(text), docs.sparkSession))


def held_out(key: Column) -> Column:
    """Whether the checksum of the key's text is divisible by 5; NULL for NULL."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def trained_on(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), trained_on(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
