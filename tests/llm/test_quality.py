import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from samewise.llm import quality
from tests.compare import assert_same

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    words = split(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if split(x)]
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def numbers(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def shannon(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    half = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    return np.sqrt(max(0, (half(p) + half(q)) / 2))


def check(spark, docs):
    rows = quality.judged(docs).collect()
    texts = Counter((r.doc_id, brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, numbers(r)) for r in rows) == texts
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_cases(spark, seed):
    rng = random.Random(seed)
    phrase = [rng.choice(["ab", "é", "c#", "the", "<x>", "\x00", "\xa0"]) for _ in range(11)]
    texts = [None, "", " \n\n\r\n", "a b c d e f g h a b c d e f g h", "same " * 5000, "a " * 9, "x\ny\nx \nx\n\ny", "x" * 100_000]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(12)):
            parts += phrase[rng.randrange(3) :] if rng.random() < 0.4 else [str(rng.randrange(50)) for _ in range(rng.randrange(9))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in parts))
    rows = [(i if i else None, t, rng.choice([None, "en", "zz"]), 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[20:22]], "doc_id long, text string, lang string, n_words int")
    check(spark, docs)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert_same(quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), con, quality.SQL)
    assert quality.judged(docs.where("false")).collect() == []


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = check(spark, docs)
    sums = {x: [np.sum([r[c] for r in rows if langs[r.doc_id] == x and not r.base_failed], axis=0) for c in ("classes", "common")] for x in set(langs.values())}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[::7]:
        bare = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "" if c not in quality.PUNCTUATION))
        listed = quality.COMMON[langs[r.doc_id]]
        assert r.common == [*(bare.count(w) for w in listed), sum(w not in listed for w in bare)]
    for r in rows[::7]:
        classes, common = sums[langs[r.doc_id]]
        assert abs(r.character_distance - shannon(r.classes, classes)) < 1e-9 and abs(r.word_distance - shannon(r.common, common)) < 1e-9
    assert not any(r.kept and r.base_failed for r in rows)
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    kept = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert len(kept) > 100 and all(kept)
    shouted = docs.selectExpr("-doc_id - 1 AS doc_id", "upper(text) AS text", "lang").limit(200)
    assert sum(r.kept for r in quality.judged(docs.unionByName(shouted)).collect() if r.doc_id < 0) < 5


def test_wrong_languages_and_word_salad_fail(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    good = [r for r in quality.judged(docs).where("kept AND n_words >= 100").collect()]
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    rng = random.Random(9)
    wrong = [(-1 - r.doc_id, texts[r.doc_id][0], "de") for r in good if texts[r.doc_id][1] == "en"][:60]
    salad = [(-100_000 - i, " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(150)), "en") for i in range(40)]
    found = quality.judged(docs.unionByName(spark.createDataFrame([*wrong, *salad], docs.schema))).collect()
    assert len(wrong) > 30 and not any(r.kept for r in found if r.doc_id < 0)
    kept = {r.doc_id for r in found if r.kept}
    assert sum(r.doc_id in kept for r in good) >= 0.99 * len(good)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    assert len(rows) == len(texts) and all(numbers(r) == brute(texts[r.doc_id]) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
