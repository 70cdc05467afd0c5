import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from samewise.llm import simhash
from samewise.sources.shared import written

SPACE = " \t\n\x0b\x0c\r"


def brute_print(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        lowered = lowered.replace(c, " ")
    parts = [w for w in lowered.split(" ") if w]
    k = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + k]).encode(), 42) for i in range(len(parts) - k + 1)] if parts else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=4):
    """rows of (id, print); the least id reachable."""
    left, out = set(range(len(rows))), {}
    prints = np.array([p for _, p in rows], np.uint64)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {int(j) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= bits)} & left
            left -= near
            todo += near
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out |= dict.fromkeys(group, least)
    return [out[i] for i in range(len(rows))]


def compare(spark, docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    want = sorted(map(repr, zip([i for i, _ in rows], [p for _, p in rows], brute_components(rows), strict=True)))
    got = sorted(repr((r.doc_id, r.print % 2**64, r.component)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    data = [(5, "A b c d e"), (4, "a  B\tc\nd\x0be"), (3, None), (2, ""), (1, " \r\n"), (6, "one"), (6, "one"), (7, "a\xa0b c"), (None, "only null"), (8, long), (9, long + " end"), (10, "x" * 100000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in data], "doc_id long, text string, print int, component int")
    compare(spark, docs)
    compare(spark, docs.where("false"))


def test_against_brute_force(spark):
    compare(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(texts, brute_components(texts), strict=True))
    assert sorted(tuple(r) for r in simhash.query(spark, sf).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_links_are_whole(spark, monkeypatch, agree):
    monkeypatch.setattr(simhash, "bands_to_agree", lambda points, bits: agree)
    rng = np.random.default_rng(agree)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                b ^= 1 << bit
            prints.add(b)
    array = np.array(sorted(prints), np.uint64)
    want = {frozenset((int(array[i]), int(array[j]))) for i in range(len(array)) for j in range(i) if (int(array[i]) ^ int(array[j])).bit_count() <= 4}
    points = spark.createDataFrame([(int(x),) for x in array.view(np.int64)], "print long")
    found = [frozenset((r.src % 2**64, r.dst % 2**64)) for r in simhash.links(points, 1).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    bound = points.alias("a").crossJoin(points.alias("b")).where(F.bit_count(simhash.unary_counts(F.col("a.print")).bitwiseXOR(simhash.unary_counts(F.col("b.print")))) > F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))))
    assert bound.count() == 0


def test_variants_of_one_original_are_one_group(spark):
    rng = np.random.default_rng(3)
    original = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    texts = [" ".join(original)]
    for v in range(400):
        words = list(original)
        for i in rng.choice(200, 4, replace=False):
            words[i] = f"v{v}x{i}"
        texts.append(" ".join(words))
    others = [" ".join(f"o{i}" for i in rng.integers(0, 5000, 200)) for _ in range(20)]
    sets = [set(simhash.shingle_hashes(x, 5).tolist()) for x in texts]
    similar = [i for i in range(1, 401) if len(sets[0] & sets[i]) / len(sets[0] | sets[i]) >= 0.8]
    docs = spark.createDataFrame([(i, texts[i]) for i in [0, *similar]] + [(1000 + i, x) for i, x in enumerate(others)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert len(similar) > 300 and kept == [0, *range(1000, 1020)]


def test_texts_that_meet_are_in_one_group_or_not_similar(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for family in range(6):
        original = [f"{family}w{i}" for i in range(60)]
        for v in range(12):
            words = [w if rng.random() > 0.02 else f"n{v}" for w in original]
            texts[f"{family}-{v:02d}"] = " ".join(words)
    members = [("all", n, min(texts)) for n in texts]
    found = simhash.linked(spark.createDataFrame(members, "part string, node string, hub string"), spark.createDataFrame(list(texts.items()), "node string, text string").withColumn("s", simhash.sketched(F.col("text"), 5)).select("node", "text", "s.n", "s.odd"), 5, 0.8)
    got = {r.node: r.component for r in found.collect()}
    sets = {n: set(simhash.shingle_hashes(x, 5).tolist()) for n, x in texts.items()}
    want, moved = {n: n for n in texts}, True
    while moved:
        moved = False
        for a in texts:
            for b in texts:
                if want[a] < want[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    want[b], moved = want[a], True
    assert {n: got.get(n, n) for n in texts} == want and 6 <= len(set(want.values())) < 60


def test_unlike_texts_of_one_passage_meet_few_others(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([*passage, *(f"x{i}" for i in rng.integers(0, 50000, 30))]) for _ in range(300)]
    twin = texts[7] + " end"
    docs = spark.createDataFrame(list(enumerate([*texts, twin])), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == list(range(300))


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1, "p"), (1, "a b c d e f", "x", 1, "p"), (2, "A b c d e f", "y", 2, "q"), (None, None, None, 3, None), (3, "", "z", 4, "r")], "doc_id long, text string, row string, node int, `own.key` string")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.node) for r in got.collect()) == [(1, 1), (3, 4)]
    assert simhash.deduplicated(docs.where("false")).count() == 0


def test_bands_grow_with_the_points():
    chosen = [simhash.bands_to_agree(10**e, 4) for e in range(3, 11)]
    assert chosen == sorted(chosen) and chosen[0] == 2
    for e, agree in zip(range(3, 11), chosen, strict=True):
        by_chance = 10**e / 2 ** (simhash.SEGMENT_BITS * simhash.SEGMENTS * agree / (agree + 4))
        assert by_chance < 6


def test_odd_sketches_bound_the_difference():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 8, rng.integers(1, 400))) for _ in range(40)]
    for h, cuts in simhash.shingle_sets(pa.array(texts), 5):
        odd = simhash.odd_sketch(h, cuts)
        sets = [set(h[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in range(len(sets)):
            for j in range(i):
                assert int(np.bitwise_count(odd[i] ^ odd[j]).sum()) <= len(sets[i] ^ sets[j])


def test_recall_of_similar_pairs(spark, capsys):
    """Pairs of 0.8 to 1.0 by brute force that share a fingerprint, over 10,000 documents."""
    import pyarrow as pa

    texts = sorted({r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text})
    sets, keys = [], []
    for h, cuts in simhash.shingle_sets(pa.array(texts), 5):
        owner, key = simhash.partial_keys(h, cuts)
        order = np.argsort(owner, kind="stable")
        edge = np.searchsorted(owner[order], np.arange(len(cuts)))
        for d in range(len(cuts) - 1):
            sets.append(frozenset(h[cuts[d] : cuts[d + 1]].tolist()))
            keys.append(frozenset(key[order][edge[d] : edge[d + 1]].tolist()))
    holders = {}
    for i, x in enumerate(sets):
        for v in sorted(x)[: max(1, len(x) - -(-len(x) * 4 // 5) + 1)]:  # a pair of 0.8 shares one of these
            holders.setdefault(v, []).append(i)
    pairs = {(i, j) for held in holders.values() for i in held for j in held if i < j}
    bands = {}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        s = common / (len(sets[i]) + len(sets[j]) - common)
        if s >= 0.8:
            band = bands.setdefault(min(int((s - 0.8) * 20 + 1e-9), 3), [0, 0])
            band[0] += 1
            band[1] += bool(keys[i] & keys[j])
    with capsys.disabled():
        print("\nsimilarity, pairs, recall:", [(round(0.8 + b / 20, 2), n, round(f / n, 4)) for b, (n, f) in sorted(bands.items())])
    assert bands and all(f >= 0.9 * n for n, f in bands.values())


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_is_not_broadcast(spark):
    points = written(spark.createDataFrame([(1,), (3,), (1 << 40,)], "print long"), "test-points")  # of a known, small size
    found = simhash.links(points, 3)
    assert "SortMergeJoin" in initial_plan(found) and "Broadcast" not in initial_plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 3), (1, 1 << 40), (3, 1 << 40)]


def test_only_counted_rows_are_broadcast(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = plans.get(name, "") + initial_plan(df)
        return written(df, name)

    monkeypatch.setattr(simhash, "written", kept)
    monkeypatch.setattr(simhash, "picked", lambda rows, ids, how: rows.join(ids.hint("merge"), "row", how))
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if rng.random() > 0.04 else f"n{v}" for w in base) for v in range(40)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-docs")
    assert 0 < simhash.deduplicated(docs).count() < 40 and "simhash-rare" in plans
    assert [name for name, plan in plans.items() if "BroadcastHashJoin" in plan] == []
