import pytest
from pyspark.sql import functions as F

from samewise.functions import text as T


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


LITERALS = {
    "12.7": (["12"], True), "-5": (["-5"], True), "3104753585": (["3104753585"], True), "1_000": (["1000"], True), "True": (["1"], True), "007": (["007"], False),
    "1e400": (["1e400"], False), "None": (["none"], False), "(1,2)": (["1_2"], False), "[1, 2.5]": (["1", "2_5"], True), "[]": ([], False), "{'a': 1}": (["a_1"], False),
    "10801_w_pico_blvd": (["10801_w_pico_blvd"], False), "'quoted Text'": (["quoted_text"], False), "0": (["0"], True), "00": (["0"], True), "-0": (["0"], True), "-0.5": (["0"], True),
    "  x y ": (["x_y"], False), "Honey Basil": (["honey_basil"], False), "1.": (["1"], True), ".5": (["0"], True), "+3": (["3"], True), "1e3": (["1000"], True), "[oops": (["oops"], False), "007.5": (["7"], True), "é a": (["a"], False),
}


def test_token_value(spark):
    found = column(spark, [*LITERALS, "", None], T.token_value)
    assert [(r.tokens, r.is_numeric) for r in found[:-2]] == list(LITERALS.values()) and found[-2:] == [None, None]


def test_token_value_is_pythons(spark):
    cells = ["1__0", "_1", "1_", "0x1F", "1j", "12 ", "-12.75", "b'x'", "1 + 1", "abc'", "5 # five", "--3", "+-3", "99999999999999999999999999999999999", "12345678901234567.5", "True ", "a(b)", "nan", "inf", "1.5.2", "01", "0.0", "1,2"]
    for cell, r in zip(cells, column(spark, cells, T.token_value), strict=True):
        want = T._literal_tokens(cell)
        assert (r and (r.tokens, r.is_numeric)) == want, cell


def test_dates(spark):
    cells = ["1999-3-3", "1999/03/04", "05-06-2001", "7/8/2002", "2003-04", "2004/5", "1999_03_03", "x", None]
    assert column(spark, cells, T.clean_date) == ["19990303", "19990304", "20010605", "20020807", "200304", "200405", "1999_03_03", "x", None]


def test_idx_suffix(spark):
    assert column(spark, ["idx__12", "idx__12.0", "idx__x", "tt__3", None, "idx__", "idx__nan", "idx__1e3"], T.idx_suffix) == [12, 12, None, None, None, None, None, 1000]


def test_bitmask(spark):
    want = [sum(1 << T.ALPHABET.index(c) for c in set(s) if c in T.ALPHABET) for s in ("abc", "z9", "", "a_b")]
    assert column(spark, ["abc", "z9", "", "a_b"], lambda c: T.bitmask(F.array(c))) == want


def brute_skip(t, n, skip):
    out = []
    for i in range(len(t) if len(t) >= n else 0):
        window = t[i : i + n + skip]
        if len(window) >= n:
            gram = window[:: max(1, (len(window) - 1) // (n - 1))][:n]
            out += [gram] if len(gram) == n else []
    return out


def test_ngrams(spark):
    for line in ("a_b_c_d_e", "a", "", "a_b"):
        t = [x for x in line.split("_") if x]
        for n in (2, 3):
            assert column(spark, [line], lambda c: T.ngrams(T.tokens(c), n))[0] == [t[i : i + n] for i in range(len(t) - n + 1)]  # noqa: B023
            for skip in (1, 2):
                assert column(spark, [line], lambda c: T.skip_ngrams(T.tokens(c), n, skip))[0] == brute_skip(t, n, skip)  # noqa: B023


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", ""), ("", "abc"), ("abc", "abc"), ("abcdef", "badcfe"), ("été", "ete")])
def test_lev_ratio(spark, a, b):
    want = 2 * lcs(a, b) / (len(a) + len(b)) if a + b else 1.0
    assert column(spark, [a], lambda c: T.lev_ratio(c, F.lit(b))) == [pytest.approx(want)]


def test_multisets(spark):
    rows = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), ([], []), (["x_y"], ["y", "x"])], "p array<string>, q array<string>")
    p, q = F.col("p"), F.col("q")
    found = rows.select(T.multiset_jaccard(p, q), T.set_jaccard(p, q), T.multiset_equal(p, q), T.multiset_equal(T.unigrams(p), T.unigrams(q))).collect()
    assert [tuple(r) for r in found] == [(0.5, 1.0, False, False), (1.0, None, True, True), (0.0, 0.0, False, True)]


