import re

import pytest
from pyspark.sql import functions as F

from samewise.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CASES = [
    (1, "Released under the MIT License. Übung released under the mit-license and CC BY-NC!"),
    (2, None),
    (3, ""),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "the of and to in with or without the free software is to be used for any use of this work"),
    (6, "under the mit"),
    (7, "license apache license, version 2.0 under the"),
    (8, "x" * 200000 + " under the MIT\nlicense\x00cc by nc " * 3),
    (9, licenses.TEMPLATES["isc"][0].replace("copy", "kopie")),
    (9, licenses.TEMPLATES["isc"][0].replace("copy", "kopie")),
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def places(text):
    words = WORD.findall(lowered(text))
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def check(rows):
    for r in rows:
        n, found = places(r.text)
        x = r.license
        assert (x.n_words, x.n_base) == (n, len(found))
        assert (x.first_word, x.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert x.base_labels == sorted({label for _, label in found})
        assert set(x.base_labels) <= set(x.labels) and 0 <= x.score <= 1


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "was here") for i, t in CASES], "doc_id long, text string, license string")
    rows = licenses.find(docs).collect()
    check(rows)
    labels = {r.doc_id: r.license.labels for r in rows}
    assert labels[4] == ["gpl"] and labels[5] == [] and labels[9] == ["isc"] and labels[2] == []
    assert licenses.find(docs.where("false")).collect() == []


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").ilike("%licen%")))
    rows = licenses.find(docs).collect()
    check(rows)
    assert {label for r in rows for label in r.license.labels} == {"mit", "apache-2", "gpl", "cc-by-nc"}


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics(seed):
    import random

    rng = random.Random(seed)
    templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
    words = [rng.randrange(5) for _ in range(40)]
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    automaton = licenses.Automaton(templates)
    for i, (size, state) in enumerate(automaton.statistics(words)):
        assert size == max((n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in runs or n == 0))
        for t, template in enumerate(templates):
            run = words[i + 1 - size : i + 1]
            want = tuple(e for e in range(size, len(template) + 1) if template[e - size : e] == run) if size else None
            assert want is None or automaton.places[state].get(t, ()) == want


def brute_chains(templates, text, min_run, max_gap):
    """Chains from matches that are found by comparing every stretch of the text with every stretch of the templates."""
    out = []
    longest = {}
    for j in range(len(text)):
        for n in range(j + 1, 0, -1):
            if any(t[i : i + n] == text[j + 1 - n : j + 1] for t in templates for i in range(len(t) - n + 1)):
                longest[j] = n
                break
    for k, t in enumerate(templates):
        chains, chain = [], None
        for j, n in sorted(longest.items(), key=lambda x: (x[0] + 1 - x[1], x[0])):
            if n < min_run or longest.get(j + 1, 0) > n:
                continue
            run = text[j + 1 - n : j + 1]
            ends = [i + n for i in range(len(t) - n + 1) if t[i : i + n] == run]
            if not ends:
                continue
            after = [e for e in ends if chain and e > chain["place"]]
            if chain and j + 1 - n - chain["end"] <= max_gap and after:
                chain["covered"] += min(n, after[0] - chain["place"], max(0, j + 1 - chain["end"]))
                chain["end"], chain["place"] = max(chain["end"], j + 1), after[0]
            else:
                chain = {"start": j + 1 - n, "end": j + 1, "place": ends[0], "covered": n}
                chains.append(chain)
        out += [(k, c["start"], c["end"], round(c["covered"] / len(t), 9)) for c in chains]
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_chains_against_brute_force(seed):
    import random

    rng = random.Random(seed)
    templates = [[rng.randrange(1, 5) for _ in range(rng.randrange(3, 14))] for _ in range(3)]
    text = [rng.randrange(1, 6) for _ in range(60)]
    for _ in range(3):
        t, at = rng.choice(templates), rng.randrange(40)
        text[at : at + len(t)] = t
    found = licenses.Automaton(templates).matches(text, 0, 2)
    got = licenses.chained(found, [len(t) for t in templates], 3)
    assert sorted((t, a, b, round(c, 9)) for t, a, b, c in got) == brute_chains(templates, text, 2, 3)


def test_a_run_that_stands_twice_does_not_break_a_chain():
    template = [1, 2, 3, 4, 9, 8, 1, 2, 3, 4, 7, 6]
    found = licenses.Automaton([template]).matches([1, 2, 3, 4, 5, 9, 8, 1, 2, 3, 4, 7, 6], 0, 4)
    assert licenses.chained(found, [12], 12) == [(0, 0, 13, 1.0)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = licenses.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, found = places(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), ",".join(sorted({label for _, label in found})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
