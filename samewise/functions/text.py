"""Cleaning and tokenising of cells, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_str(s: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 becomes one underscore, none at the ends. NULL stays NULL."""
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))


def tokens(s: Column) -> Column:
    """The parts between underscores, without empty ones."""
    return F.filter(F.split(s, "_"), lambda x: x != "")


def record_tokens(cells: list[Column]) -> Column:
    """The sorted distinct tokens of a record's cleaned cells; empty cells, NULLs and the token ``nan`` do not count."""
    joined = F.concat_ws("_", *[clean_str(c.cast("string")) for c in cells])
    return F.array_sort(F.array_distinct(F.filter(F.split(joined, "_"), lambda x: (x != "") & (x != "nan"))))


def token_key(cells: list[Column]) -> Column:
    """One string for the token set, usable as a join and grouping key."""
    return F.array_join(record_tokens(cells), " ")


# The date patterns, tried in this order, and what becomes of a match.
DATE_PATTERNS = (("yyyy-M-d", "yyyyMMdd"), ("yyyy/M/d", "yyyyMMdd"), ("d-M-yyyy", "yyyyMMdd"), ("d/M/yyyy", "yyyyMMdd"), ("yyyy-M", "yyyyMM"), ("yyyy/M", "yyyyMM"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
_NUMBER = r"^\s*[+-]?(?:0(?:_?0)*|[1-9](?:_?[0-9])*)\s*$"
_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)\s*$"


def clean_date(s: Column) -> Column:
    """The first pattern that fits gives yyyyMMdd or yyyyMM; other text stays."""
    tries = [F.date_format(F.try_to_timestamp(s, F.lit(found)), out) for found, out in DATE_PATTERNS]
    return F.coalesce(*tries, s)


def _literal_tokens(s: str | None) -> tuple[list[str], bool] | None:
    """What Python's literal grammar makes of a cell; None if the cell is none of its literals."""
    import ast
    import re

    cleaned = lambda x: re.sub(r"[^a-z0-9]+", "_", str(x).lower().strip()).strip("_")
    try:
        value = ast.literal_eval(s)
        if isinstance(value, int | float):
            return ([str(int(value))], True) if value == value else None
    except (ValueError, SyntaxError, OverflowError, MemoryError, RecursionError):
        return [cleaned(s)], False
    if isinstance(value, list):
        return [cleaned(x) for x in value], bool(value) and all(isinstance(x, int | float) for x in value)
    if isinstance(value, dict):
        return [f"{cleaned(k)}_{cleaned(v)}" for k, v in value.items()], False
    return [cleaned(value)], False


def _literals(cell: Column) -> Column:
    kind = pa.struct([("tokens", pa.list_(pa.string())), ("is_numeric", pa.bool_())])

    @F.arrow_udf("struct<tokens:array<string>,is_numeric:boolean>")
    def column(cells: pa.Array) -> pa.Array:
        rows = [_literal_tokens(s) if s is not None else None for s in cells.to_pylist()]
        return pa.array([r and {"tokens": r[0], "is_numeric": r[1]} for r in rows], kind)

    return column(cell)


def token_value(s: Column) -> Column:
    """A cell's tokens and whether they are numeric. Plain numbers, booleans and words stay in the JVM; only cells that look like other
    literals go to Python's grammar. Numbers are cut to integers, list elements and dict pairs give a token each; empty cells give NULL."""
    made = lambda token, numeric: F.struct(F.array(token).alias("tokens"), F.lit(numeric).alias("is_numeric"))
    none = F.lit(None).cast("struct<tokens:array<string>,is_numeric:boolean>")
    cut = F.regexp_extract(F.trim(s), r"^[+]?(-?[0-9]*)\.", 1)
    plain_cut = F.regexp_replace(F.when(cut.isin("", "-"), F.lit("0")).otherwise(cut), r"^(-?)0+(?=[0-9])", "$1")
    is_int, is_dec = s.rlike(_NUMBER) & (F.length(s) <= 30), s.rlike(_DECIMAL) & (F.length(s) <= 15)
    simple = s.rlike(r"^[A-Za-z_ \x80-￿][^\[\]{}()\"'#+*]*$") & ~F.trim(s).isin("True", "False", "None")
    rest = _literals(F.when(~(is_int | is_dec | simple | s.isNull() | (s == "")), s))
    digits = F.regexp_replace(F.regexp_replace(F.trim(s), "[_+]", ""), "^-?0+$", "0")
    return (
        F.when(s.isNull() | (s == ""), none)
        .when(is_int, made(digits, True))
        .when(is_dec, made(F.when(plain_cut == "-0", "0").otherwise(plain_cut), True))
        .when(simple, made(clean_str(s), False))
        .otherwise(rest)
    )


def idx_suffix(word: Column, prefix: str = "idx__") -> Column:
    """The number of ``idx__<number>``, cut to an integer; NULL for other words."""
    number = F.get(F.split(word, "__", 2), F.lit(1)).try_cast("double")
    return F.when(word.startswith(prefix), number.try_cast("bigint"))


def bitmask(tokens_: Column) -> Column:
    """One bit for each of the 36 letters and digits that the tokens hold."""
    letters = F.array_distinct(F.split(F.array_join(tokens_, ""), ""))
    bits = F.transform(F.filter(letters, lambda c: c.rlike("^[a-z0-9]$")), lambda c: F.pow(F.lit(2.0), F.instr(F.lit(ALPHABET), c) - 1).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a + b)


def ngrams(t: Column, n: int) -> Column:
    """All runs of n neighbours."""
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(t, i, F.lit(n)))


def skip_ngrams(t: Column, n: int, skip: int) -> Column:
    """From each place, n tokens at an even step of a window of n + skip; windows cut short by the end still count if n tokens are left."""
    if skip <= 0:
        return ngrams(t, n)
    if n == 1:
        return ngrams(t, 1)
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        size = F.least(F.lit(n + skip), F.size(t) - i + 1)
        step = F.greatest(F.lit(1), F.floor((size - 1) / (n - 1)).cast("int"))
        return F.slice(F.filter(F.slice(t, i, size), lambda _, k: k % step == 0), 1, n)

    return F.filter(F.transform(starts, at), lambda g: F.size(g) == n)


def unigrams(items: Column) -> Column:
    """The parts between underscores of all items."""
    return F.flatten(F.transform(items, lambda x: F.split(x, "_")))


def set_jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; NULL if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger; 1 if both are empty."""
    times = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    both = F.array_union(a, b)
    zero = F.lit(0).cast("long")
    low = F.aggregate(both, zero, lambda s, w: s + F.least(times(a, w), times(b, w)))
    high = F.aggregate(both, zero, lambda s, w: s + F.greatest(times(a, w), times(b, w)))
    return F.when(high == 0, F.lit(1.0)).otherwise(low / high)


def multiset_equal(a: Column, b: Column) -> Column:
    """Whether both hold the same items as often, empty ones left out."""
    sorted_ = lambda x: F.array_sort(F.filter(x, lambda y: y != ""))
    return sorted_(a) == sorted_(b)


def lev_ratio(a: Column, b: Column) -> Column:
    """1 - (insertions and deletions) / (both lengths): twice the longest common subsequence over both lengths; 1 if both are empty."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    size = F.length(a) + F.length(b)

    def row(before: Column, c: Column) -> Column:
        """The next row of the table of lengths, from the row before."""
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(0).alias("left"))

        def cell(s: Column, x: Column) -> Column:
            j = F.size(s["row"])
            best = F.when(x == c, before[j - 1] + 1).otherwise(F.greatest(before[j], s["left"]))
            return F.struct(F.array_append(s["row"], best).alias("row"), best.alias("left"))

        return F.aggregate(letters(b), start, cell, lambda s: s["row"])

    first = F.array_repeat(F.lit(0), F.length(b) + 1)
    common = F.element_at(F.aggregate(letters(a), first, row), -1)
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * common / size)
