"""Quality rules and distribution divergence, with DataFrame functions only.

Two rules are fixed: too few words, or too many words in eight-word windows that repeat within the text. Beyond them a text is
compared with its language: the Jensen-Shannon distance between its histogram of character classes and the language's, and the same for
the histogram of the language's common words, whose case and punctuation do not count. Short texts give noisy histograms, so each distance
counts from a minimum of words on. The limit of the second is set by the reference: a text without any common word is at a distance that
depends on their share in the language, and a text fails from WORDS_PART of that on.

Texts are read once: a table of counts per document is written, the references are its sums per language over the documents that pass the
fixed rules, and the distances are taken from it. Sums combine before the shuffle, so one language may hold all rows. The references are broadcast up to MAX_REFERENCES languages,
and joined by shuffle beyond.

Edge cases: a NULL or empty text has no words and fails; a language without reference of enough words, or NULL, leaves out the comparison;
languages without a list of common words, or in whose reference none stands, are compared by character classes alone; repeated rows each get a row; an empty table gives an
empty result; only the key, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.sources.shared import written

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 0.30
CHARACTERS_FROM, WORDS_FROM = 50, 100  # words
MAX_CHARACTERS = 0.31  # distance
WORDS_PART = 0.8  # of the distance of a text without common words
REFERENCE_FROM = 1000  # words in a language's reference
MAX_REFERENCES = 10_000
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
CLASSES = ("[a-z]+", BLANK, r"[^\x00-\x7F]+", r"""[.,;:!?'"()-]+""", "[A-Z]+", "[0-9]+")  # the rest is the last class

# Frequent function words by language.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "su"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "par", "qui", "dans"),
}
CAPITALS, PUNCTUATION = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?\"'()"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def tail(a: Column, n: int) -> Column:
    """The array without its first n elements."""
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def head(a: Column, n: int) -> Column:
    """The array without its last n elements."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all runs of eight words, by doubling three times."""
    double = lambda a, n: F.zip_with(head(a, n), tail(a, n), lambda x, y: F.xxhash64(x, y))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda a: let(double(a, 1), lambda b: let(double(b, 2), lambda c: double(c, 4))))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash stands twice or more. Neighbours in order of hash tell which do; then the starts' gaps add up."""

    def starts(a: Column) -> Column:
        same = F.zip_with(head(a, 1), tail(a, 1), lambda x, y: x["h"] == y["h"])
        no = F.array(F.lit(False))
        flags = let(same, lambda s: F.zip_with(F.concat(no, s), F.concat(s, no), lambda p, q: p | q))
        return F.sort_array(F.filter(F.zip_with(a, flags, lambda x, f: F.when(f, x["i"])), lambda i: i.isNotNull()))

    indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    gaps = lambda s: F.zip_with(s, tail(s, 1), lambda x, y: F.least(y - x, F.lit(WINDOW)))
    return let(let(indexed, starts), lambda s: F.aggregate(gaps(s), F.lit(0).cast("long"), lambda n, g: n + g))


def repeated_words(words: Column) -> Column:
    """How many words stand in eight-word windows that the text has twice or more. Texts without such windows need no sorting."""
    return let(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def character_counts(text: Column) -> Column:
    """A struct: n_symbols, and counts of the classes in order with the rest last. Each class is taken out before the next is counted."""

    def step(left: Column, classes: Sequence[str], counts: list[Column]) -> Column:
        size = F.length(left).cast("long")
        if not classes:
            symbols = F.length(F.regexp_replace(left, SYMBOLS.replace("[", "[^"), "")).cast("long")
            return F.struct(symbols.alias("n_symbols"), F.array(*counts, size).alias("classes"))
        return let(F.regexp_replace(left, classes[0], ""), lambda rest: step(rest, classes[1:], [*counts, size - F.length(rest)]))

    return step(text, CLASSES, [])


def common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words and, last, of all others; NULL for a language without a list."""
    every = sorted({w for listed in COMMON.values() for w in listed})
    listed = F.when(F.lit(False), F.array(F.lit("")))
    for name, its in COMMON.items():
        listed = listed.when(lang == name, F.array(*map(F.lit, its)))
    each = lambda some: F.transform(listed, lambda x: F.size(F.filter(some, lambda w: w == x)).cast("long"))
    counts = let(F.filter(words, lambda w: w.isin(every)), each)
    return let(counts, lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and common, a row per row of docs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    language = F.col(lang).cast("string")
    split = lambda t: F.filter(F.split(t, BLANK), lambda w: w != "")
    of_words = let(split(whole), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    bare = F.translate(whole, CAPITALS + PUNCTUATION, CAPITALS.lower())
    common = let(split(bare), lambda w: common_counts(w, language))
    rows = docs.select(F.col(key), language.alias("__lang"), of_words.alias("w"), common.alias("common"), character_counts(whole).alias("c"), F.length(whole).cast("long").alias("n"), repeated_lines(whole).alias("n_dup_lines"))
    return rows.select(
        key,
        "__lang",
        "w.n_words",
        (F.col("n") - F.col("c.classes")[CLASSES.index(BLANK)]).alias("word_chars"),
        "c.n_symbols",
        "n_dup_lines",
        "w.n_repeat_words",
        "c.classes",
        "common",
    )


def references(rows: DataFrame) -> DataFrame:
    """The summed histograms of each language, for languages of enough words."""
    add = lambda name, n: F.array(*[F.coalesce(F.sum(F.col(name)[i]), F.lit(0)) for i in range(n)])
    n_common = max(map(len, COMMON.values())) + 1
    sums = rows.where("__lang IS NOT NULL").groupBy("__lang").agg(F.sum("n_words").alias("n"), add("classes", len(CLASSES) + 1).alias("ref_classes"), add("common", n_common).alias("ref_common"))
    return sums.where(F.col("n") >= REFERENCE_FROM).drop("n")


def distance(a: Column, b: Column) -> Column:
    """The Jensen-Shannon distance, to base 2, of two histograms of counts; 0 if one is empty, NULL if one is NULL."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    shares = lambda x: let(total(x), lambda t: F.transform(x, lambda v: F.when(t > 0, v / t).otherwise(0.0)))
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    both = F.zip_with(shares(a), shares(b), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.when((total(a) == 0) | (total(b) == 0), 0.0).otherwise(F.sqrt(F.greatest(total(both), F.lit(0.0))))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts of each document with base_failed, both distances and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MAX_REPEATED) * F.col("n_words"))
    rows = written(measured(docs, key, text, lang).withColumn("base_failed", base), "quality")
    none = F.transform("ref_common", lambda v, i: F.when(i == F.size("ref_common") - 1, 1).otherwise(0).cast("long"))
    known = written(references(rows.where("NOT base_failed")).withColumn("none_distance", distance(none, F.col("ref_common"))), "quality-references")
    few = known.limit(MAX_REFERENCES + 1).count() <= MAX_REFERENCES
    both = rows.join(F.broadcast(known) if few else known, "__lang", "left")
    with_distances = both.withColumn("character_distance", distance(F.col("classes"), F.col("ref_classes"))).withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
    far = ((F.col("n_words") >= CHARACTERS_FROM) & (F.coalesce("character_distance", F.lit(0.0)) > MAX_CHARACTERS)) | ((F.col("n_words") >= WORDS_FROM) & F.coalesce((F.col("none_distance") > 0) & (F.col("word_distance") >= WORDS_PART * F.col("none_distance")), F.lit(False)))
    return with_distances.withColumn("kept", ~F.col("base_failed") & ~far).drop("__lang", "ref_classes", "ref_common", "none_distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _counted(chars: str) -> str:
    """SQL for the number of characters of the text in a class such as [a-z]+."""
    return "length(t) - length(regexp_replace(t, '{}', '', 'g'))".format(chars.replace("'", "''"))


_LISTED = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in COMMON.items() for i, w in enumerate(words))
_BARE = (CAPITALS + PUNCTUATION).replace("'", "''")
_WORD = r"[^\x20\x09-\x0D]+"
_PART = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS w, regexp_extract_all(translate(t, '{_BARE}', '{CAPITALS.lower()}'), '{_WORD}') AS bare,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, [{", ".join(map(_counted, CLASSES))}] AS known FROM d),
placed AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM c),
runs AS (SELECT r, i, concat_ws(' ', x, {", ".join(f"lead(x, {n}) OVER o" for n in range(1, WINDOW))}) AS k, lead(x, {WINDOW - 1}) OVER o AS last FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM runs WHERE last IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, sum(gap)::BIGINT AS n FROM (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS gap FROM twice) GROUP BY r),
rules AS (
  SELECT r, doc_id, lang, len(w) AS n_words, length(t) - known[{CLASSES.index(BLANK) + 1}] AS word_chars, {_counted(SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, list_append(known, length(t) - list_sum(known)::BIGINT) AS classes, bare,
    len(w) < {MIN_WORDS} OR 100 * coalesce(n, 0) > {round(100 * MAX_REPEATED)} * len(w) AS base_failed FROM c LEFT JOIN covered USING (r)),
listed AS (SELECT * FROM (VALUES {_LISTED}) AS v(lang, i, x)),
found AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(bare) AS x FROM rules) GROUP BY r, x),
common AS (SELECT rules.r, listed.i, coalesce(found.n, 0) AS n FROM rules JOIN listed USING (lang) LEFT JOIN found ON found.r = rules.r AND found.x = listed.x),
counts AS (
  SELECT r, 'c' AS kind, unnest(range(len(classes))) AS i, unnest(classes) AS n FROM rules
  UNION ALL SELECT r, 'w', i, n FROM common
  UNION ALL SELECT r, 'w', -1, any_value(len(bare)) - sum(n)::BIGINT FROM common JOIN rules USING (r) GROUP BY r),
shares AS (SELECT r, kind, i, n, n / nullif(sum(n) OVER (PARTITION BY r, kind), 0) AS p FROM counts),
passing AS (SELECT lang FROM rules WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= {REFERENCE_FROM}),
sums AS (SELECT lang, kind, i, sum(n) AS n FROM counts JOIN rules USING (r) JOIN passing USING (lang) WHERE NOT base_failed GROUP BY lang, kind, i),
refs AS (SELECT lang, kind, i, n / nullif(sum(n) OVER (PARTITION BY lang, kind), 0) AS q FROM sums),
far AS (
  SELECT r, kind, sqrt(greatest(sum(({_PART.format("p", "q")}) + ({_PART.format("q", "p")})) / 2, 0)) AS apart
  FROM shares JOIN rules USING (r) JOIN refs USING (lang, kind, i) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY r, kind),
without AS (SELECT lang, sqrt((1 - q + log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END) / 2) AS none FROM refs WHERE kind = 'w' AND i = -1 AND q < 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {CHARACTERS_FROM} AND coalesce(a.apart, 0) > {MAX_CHARACTERS}) AND NOT (n_words >= {WORDS_FROM} AND coalesce(b.apart >= {WORDS_PART} * none, FALSE)) AS kept
FROM rules LEFT JOIN far AS a ON a.r = rules.r AND a.kind = 'c' LEFT JOIN far AS b ON b.r = rules.r AND b.kind = 'w' LEFT JOIN without ON without.lang = rules.lang
"""
