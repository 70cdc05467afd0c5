import math

import numpy as np
import pytest

import corpus_pipeline as p
from samewise.llm import language, simhash
from samewise.sources.shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.limit(2)
    odd = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "123 456", None, None, 7), (None, "the and of that with", "en", None, 20)], docs.schema)
    frames = [docs.union(twice).union(odd)]
    for name, stage in p.STAGES:
        frames.append(written(stage(spark, frames[-1], SF), f"test-{name}"))
    return frames


def test_columns(steps):
    for frame in steps[:-1]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert steps[-1].columns == [*steps[0].columns, "shard"]


def test_language_rejects_what_has_none(spark, steps):
    before, after = steps[0].collect(), steps[1].collect()
    model = language.train(steps[0])
    lettered = [r for r in before if any(c.isalpha() for c in r.text or "")]
    total = language.scores(model, [r.text.lower() for r in lettered])
    sure = np.exp(total.max(axis=1) - np.logaddexp.reduce(total, axis=1)) >= p.LEAST_SCORE
    assert sorted(map(repr, after)) == sorted(repr(r) for r, ok in zip(lettered, sure, strict=True) if ok)


def near_groups(rows):
    """The least id of each row's component of texts whose five-word shingles are similar to 0.8 or more."""
    sets = [frozenset(simhash.shingle_hashes(r.text, p.SHINGLE_WORDS).tolist()) for r in rows]
    holders = {}
    for i, x in enumerate(sets):
        for h in x:
            holders.setdefault(h, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in {j for h in x for j in holders[h] if j < i}:
            common = len(x & sets[j])
            if common / (len(x) + len(sets[j]) - common) >= p.SIMILARITY:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    return sorted(min((x for x in ids if x is not None), default=None) for ids in groups.values())


def test_one_of_each_group_stays(steps):
    left = steps[2].collect()
    numbered = [r.doc_id for r in left if r.doc_id is not None]
    assert sorted(numbered) == near_groups(steps[1].where("doc_id IS NOT NULL").collect()) and len(left) == len(numbered) + 1
    assert {(r.doc_id, r.text) for r in left} <= {(r.doc_id, r.text) for r in steps[1].collect()}


def test_groups_of_more_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stays = {r.doc_id for r in simhash.deduplicated(docs.select("doc_id", "text")).collect()}
    assert sorted(stays) == near_groups(docs.collect()) and len(stays) < 940


def test_benchmark_passages_go(spark, steps):
    from tests.llm.test_licenses import WORD, lowered

    items = [WORD.findall(lowered(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = []
    for r in steps[2].collect():
        words = WORD.findall(lowered(r.text))
        if not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1)):
            clean.append(repr(r))
    assert sorted(clean) == sorted(map(repr, steps[3].collect())) and len(clean) < steps[2].count()


def test_mixing_takes_rows_as_they_are(steps):
    before, after = [repr(r) for r in steps[3].collect()], [repr(r) for r in steps[4].collect()]
    assert set(after) <= set(before) and 0.6 * len(before) < len(after) <= len(before)


def test_shards(steps):
    import hashlib

    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        draws = [(int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(8)]
        assert r.shard == max(range(8), key=lambda i: math.log(draws[i]))


def test_run_is_the_stages(spark):
    """The whole run against the stages one by one; every stage is held against plain Python above."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [frame.count()]
    for name, stage in p.STAGES:
        frame = written(stage(spark, frame, SF), f"test-whole-{name}")
        sizes.append(frame.count())
    out = p.run(spark, SF)
    assert out.columns == frame.columns and sorted(map(repr, out.collect())) == sorted(map(repr, frame.collect()))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
