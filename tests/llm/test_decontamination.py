import random

import numpy as np
import pytest

from samewise.llm import decontamination
from tests.llm.test_licenses import WORD, lowered


def brute(text, items, width=10):
    words = WORD.findall(lowered(text))
    hit, named = set(), set()
    for key, item in items:
        w = WORD.findall(lowered(item))
        n = min(width, len(w))
        if key is None or not n:
            continue
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                named.add(str(key))
    return len(words), len(hit), sorted(named)


def data(seed):
    rng = random.Random(seed)
    run = lambda n: " ".join(rng.choice(["a", "B", "ü", "the", "of", "x9"]) for _ in range(n))
    items = [(i, run(rng.choice([1, 2, 5, 10, 11, 40]) if i > 3 else 30)) for i in range(14)] + [(99, None), (None, "a a"), (98, "?!"), (97, "")]
    items.append((50, items[0][1]))
    texts = [None, "", "!!", "a" * 100_000, run(3000)]
    for _ in range(60):
        parts = [run(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items[:14])[1]).split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(9, 14)]), run(rng.randrange(4))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return items, texts


@pytest.mark.parametrize("blocks", [1, 4])
def test_against_brute_force(spark, blocks):
    items, texts = data(blocks)
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, hits int")
    frame = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len((t or "").encode()) + len(str(k)) for k, t in items if k is not None)
    found = decontamination.find(docs, frame, block_bytes=1 << 20 if blocks == 1 else -(-size // blocks)).collect()
    assert len(found) == len(texts) + 3
    for r in found:
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute(r.text, items), r.doc_id
        assert sum(b - a for a, b in zip(r.hits.starts, r.hits.ends, strict=True)) == r.hits.n_hit
    assert decontamination.find(docs.where("false"), frame).collect() == []
    assert all(r.hits.n_hit == 0 for r in decontamination.find(docs, frame.where("false")).collect())


def test_benchmark_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = decontamination.query(spark, sf).collect()
    hit = {r.doc_id: r for r in rows if r.contaminated}
    assert len(hit) > 3
    for r in docs.where(docs.doc_id.isin(list(hit)[:40])).collect():
        n, h, named = brute(r.text, items)
        assert (hit[r.doc_id].n_words, hit[r.doc_id].n_hit, hit[r.doc_id].n_items) == (n, h, len(named))


def test_shift_skips_only_what_cannot_match():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 5, 4000).astype(np.uint64)
    patterns = {tuple(int(x) for x in text[a : a + 6]) for a in range(0, 3000, 97)}
    s = decontamination._searcher(np.array(sorted(patterns), np.uint64), np.zeros(len(patterns), np.int32))
    first = np.array([0, 1700, 1700, 4000])
    ends, which = decontamination.search(s, first, text)
    want = {(i + 5, tuple(int(x) for x in text[i : i + 6])) for a, b in zip(first, first[1:], strict=False) for i in range(a, b - 5) if tuple(int(x) for x in text[i : i + 6]) in patterns}
    assert {(e, tuple(s.patterns[p].tolist())) for e, p in zip(ends.tolist(), which.tolist(), strict=True)} == want


def test_a_whole_block_is_small_enough_to_broadcast():
    rng = np.random.default_rng(2)
    item = lambda size: "".join(chr(97 + c) for c in rng.integers(0, 26, size))
    items, held = [], 0
    while held < decontamination.BLOCK_BYTES:
        items.append((str(len(items)), " ".join(item(5) for _ in range(300))))
        held += len(items[-1][1])
    assert decontamination.compiled(items).nbytes() < 60 << 20
    short = [(str(i), " ".join(item(1) for _ in range(2000))) for i in range(decontamination.BLOCK_BYTES // 4000)]
    assert decontamination.compiled(short).nbytes() < 120 << 20
