import hashlib
import random
from collections import Counter

import pytest

from samewise.llm import passages

SPACE = " \t\n\x0b\x0c\r"


def brute(texts, size=35):
    split = []
    for t in texts:
        for c in SPACE:
            t = (t or "").replace(c, " ")
        split.append([w for w in t.split(" ") if w])
    seen = Counter(tuple(s[i : i + size]) for s in split for i in range(len(s) - size + 1))
    out = []
    for s in split:
        gone = set()
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        rest = [w for i, w in enumerate(s) if i not in gone]
        out.append((len(s), len(gone), hashlib.sha256(" ".join(rest).encode()).hexdigest()))
    return out


def compare(spark, docs, **more):
    rows = docs.collect()
    size = more.get("words", 35)
    want = sorted(map(repr, ((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], size), strict=True))))
    got = passages.find(docs, **more).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    return got


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "ü", "x", "\x00", "\xa0"])
    run = lambda n: [word() for _ in range(n)]
    shared = [run(60), run(36), run(35), run(200)]
    out = [None, "", " \n", "a " * 34, "a " * 35, "b " * 36, "same " * 3000]
    for _ in range(60):
        parts = run(rng.randrange(0, 50))
        for _ in range(rng.randrange(4)):
            parts += rng.choice(shared)[rng.choice([0, 0, 3]) :] + run(rng.randrange(0, 40))
        out.append(rng.choice([" ", "\n", "\t  "]).join(parts))
    copy = " ".join(run(90))
    return out + [copy, copy, copy.replace(" ", "\n"), " ".join(f"w{i}" for i in range(30000))]


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 3)])
def test_cases(spark, seed, hot):
    rows = [(i if i % 9 else None, t, 0, "x") for i, t in enumerate(texts(seed))]
    docs = spark.createDataFrame([*rows, *rows[30:33]], "doc_id long, text string, n_words int, spans string")
    assert any(r.n_removed for r in compare(spark, docs, hot=hot))
    compare(spark, docs, hot=hot, words=12)
    assert passages.find(docs.where("false")).collect() == []


def test_against_brute_force(spark):
    compare(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_the_two_hashes_of_a_text_are_independent(spark):
    """The second is no function of the first: rows with equal first hashes are told apart by it."""
    from pyspark.sql import functions as F

    texts = spark.range(1000).select(F.col("id").cast("string").alias("t"))
    rows = texts.select(F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"), F.xxhash64(F.xxhash64("t"), F.lit(1)).alias("chained")).collect()
    assert len({r.k2 for r in rows}) == 1000 and all(r.k1 != r.k2 != r.chained for r in rows)


def test_texts_of_one_first_hash(spark, monkeypatch):
    """Where all texts have the same first hash, the second keeps them apart."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(passages.F, "xxhash64", lambda *c: F.lit(0).cast("long") if len(c) == 1 else real(*c))
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(40))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) + " " + (common if i % 3 else "") for i in range(20)] + ["short", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.find(docs).collect()}
    assert got == dict(enumerate(brute(texts)))
