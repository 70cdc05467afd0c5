import numpy as np
from pyspark.sql import functions as F

from samewise.llm import language


def brute(model, text):
    """One n-gram at a time."""
    total, matrix = model.log_prior.copy(), model.likelihoods()
    text = " " + text.lower()
    for i in range(len(text)):
        for n in range(1, 4):
            if i + n <= len(text):
                codes = np.array([ord(c) for c in text[i : i + n]], np.uint32)
                column = list(language.grams(codes))[n - 1][1][0]
                total += matrix[column]
    return total


def test_scores_are_those_of_single_grams(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.trained_on(docs)
    texts = [r.text for r in docs.limit(15).collect()] + ["", "x", "é" * 50, "word " * 40]
    monkeypatch.setattr(language, "PIECE", 100)
    want = [brute(model, t[:900]) for t in texts]
    for matrix in (None, model.likelihoods()):
        assert np.allclose(language.scores(model, [t[:900].lower() for t in texts], matrix), want)


def test_training_counts_and_priors(spark):
    """The matrix against counts of single n-grams in plain Python."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text is not None and r.lang is not None]
    model = language.train(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string"))
    distinct = {(r.doc_id, r.text): r.lang for r in rows}
    langs = sorted(set(distinct.values()))
    counts = np.full((language.BUCKETS, len(langs)), language.SMOOTHING)
    for (_, text), lang in distinct.items():
        codes = np.array([ord(c) for c in " " + text.lower()], np.uint32)
        for _, columns in language.grams(codes):
            for c in columns.tolist():
                counts[c, langs.index(lang)] += 1
    priors = np.array([sum(x == lang for x in distinct.values()) for lang in langs], float)
    assert model.languages == langs and np.allclose(model.log_prior, np.log(priors / priors.sum()))
    assert np.allclose(model.likelihoods(), np.log(counts / counts.sum(axis=0)))


def test_many_languages_and_repeated_rows(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 8, f"x{i:03d}") for i in range(300)]
    docs = spark.createDataFrame([*rows, *[(7, "repeated words", "x007")] * 500], "doc_id long, text string, lang string").withColumn("a.b", F.lit(1))
    model = language.train(docs, sample=10_000)
    assert len(model.languages) == 300 and np.isclose(np.exp(model.log_prior).max(), 2 / 301)
    found = language.identify(docs.where("doc_id <> 7"), model).collect()
    assert np.mean([r.language.lang == r.lang for r in found]) > 0.95
    assert len(language.train(docs, sample=40).languages) <= 40


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.trained_on(docs)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !? ** 99"), (None, "the and of that")], "doc_id long, text string")
    found = language.identify(docs.select("doc_id", "text", "lang").unionByName(extra, allowMissingColumns=True).withColumn("language", F.lit("gone")), model).collect()
    assert len(found) == 1004
    held = [r for r in found if r.doc_id is not None and r.lang and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([r.language.lang == r.lang for r in held]) > 0.97
    by_id = {r.doc_id: r.language for r in found}
    assert all(by_id[i] == ("und", 0.0) for i in (-1, -2, -3)) and by_id[None].lang == "en"
    assert all(0 <= r.language.score <= 1 for r in found)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None), (None, "text", "en")], "doc_id long, text string, lang string")
    model = language.trained_on(docs)
    assert [r.language for r in language.identify(docs, model).collect()] == [("und", 0.0)] * 2
    assert language.identify(docs.where("false"), model).collect() == []
