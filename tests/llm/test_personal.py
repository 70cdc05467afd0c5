import hashlib
import random
import re
from collections import Counter

import pytest

from samewise.llm import personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def count(s):
    return sum(c in "0123456789" for c in s)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed([int(c) for c in d if c in "0123456789"])):
        total += c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
    return total % 10 == 0


def brute(text):
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= count(m[0]) <= 19 and luhn(m[0])]
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= count(m[0]) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(found)]


@pytest.mark.parametrize("seed", range(6))
def test_base_is_that_of_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["@", ".", "-", "+", " ", "(", ")", "a", "b.c", "x@y.z", "1", "42", "255.", "300", "4111111111111111", "4929 9955-8928 7635", "+1 (988) 555-2485", "é", "٣", "\n", "1.2.3.4", "%_"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert personal.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@b" * 100_000, "1 " * 150_000):
        personal.base_spans(text)
        personal.loose_spans(text, [])


def test_reliable_labelers_win():
    counted = [("phone", "1111", 400), ("phone", "0-00", 300), ("phone", "1-1-", 200), ("phone", "0-1-", 10), ("phone", "1-00", 5)]
    post = personal.posteriors(counted)
    assert post["phone", "1111"] > 0.95 and post["phone", "0-00"] < 0.05 and personal.posteriors([]) == {}


def test_maximisation_finds_the_rates_of_each_kind():
    """Votes drawn from known rates, which differ by kind, against the share of personal data in each pattern."""
    import random

    rng = random.Random(11)
    rates = {"phone": ((0.9, 0.8, 0.85, 0.9), (0.1, 0.2, 0.15, 0.1)), "card": ((0.95, 0.9, 0.7, 0.9), (0.3, 0.05, 0.1, 0.2))}
    drawn, real = Counter(), Counter()
    for kind, sides in rates.items():
        for _ in range(20_000):
            true = rng.random() < 0.4
            vote = "".join("-" if rng.random() < 0.2 else "1" if rng.random() < p else "0" for p in sides[0 if true else 1])
            drawn[kind, vote] += 1
            real[kind, vote] += true
    post = personal.posteriors([(k, v, n) for (k, v), n in drawn.items()])
    assert max(abs(post[x] - real[x] / n) for x, n in drawn.items() if n >= 400) < 0.1
    for kind in rates:
        mean = sum(post[x] * n for x, n in drawn.items() if x[0] == kind) / 20_000
        assert abs(mean - 0.4) < 0.02


def test_added_spans(spark):
    yes = [f"please call (21{i % 10}) 555-01{i:02d} today" for i in range(60)]
    no = [f"order part 112-045-10{i:02d}/x" for i in range(60)]
    odd = [None, "", "mail jo (at) site (dot) com", "1.2.3.4 and 212-555-0100", "card 4929.9955.8928.7635", "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "taken") for i, t in enumerate([*yes, *no, *odd])] + [(None, yes[0], "taken")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in personal.find(docs).collect()}
    for i in range(60):
        assert [(s.start, s.end, s.kind) for s in rows[i].spans] == [(12, 26, "phone")] and rows[60 + i].spans == []
    assert rows[120].spans == rows[121].spans == rows[125].spans == []
    assert [s.kind for s in rows[123].base] == ["ip"] and rows[123].spans[0].kind == "ip"
    assert rows[None].spans
    assert personal.find(docs.where("false")).collect() == []


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in personal.find(docs).collect():
        assert [(s.start, s.end, s.kind) for s in r.base] == brute(texts[r.doc_id])
        assert set(r.base) <= set(r.spans)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = personal.query(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_card for r in rows) > 5
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in personal.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
