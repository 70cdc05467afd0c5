"""Benchmark passages in documents, by Wu-Manber search over words.

A pattern is a run of ``width`` consecutive words of an item, or the whole item where it has fewer. Patterns of one length make one
searcher. It looks at the last two words of a window: a shift table says how far the window can move because no pattern holds these
two words nearer to its end. Where the shift is zero, a bucket by the hash of the last two words gives the patterns that end so,
and they are compared with the window word by word, last with the words' bytes. Many stretches of text are searched in step, so
that numpy does the work of each step at once.

The items are measured first. Up to ``block_bytes`` they are one block of patterns that is broadcast; beyond it they are dealt into
several blocks, each searched over all documents after the one before it was written. A block's tables take up to some 100 bytes for
each word of its items, which is what bounds a broadcast: 40 MB for a block of words of five letters, 100 MB for words of one.

Edge cases: a NULL or empty text has no words; an item without words, or whose id or text is NULL, is no item; equal items are
all named; a word is hit once however many occurrences cover it; no items mean no hits; an empty table gives an empty result. The
result column replaces an input column of the same name; other columns pass.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from samewise.llm import textbytes as tb
from samewise.sources.shared import written

WIDTH = 10
BLOCK_BYTES = 2 << 20
LANE = 512
HITS = "struct<n_words:bigint,n_hit:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"


class Searcher(NamedTuple):
    """Patterns of one length in words."""

    size: int
    patterns: np.ndarray  # (patterns, size) word hashes, ordered by the bucket of their last block
    first: np.ndarray  # pattern to its first place in owners
    owners: np.ndarray  # numbers of items
    shift: np.ndarray
    head: np.ndarray  # bucket to first pattern

    @property
    def block(self) -> int:
        return min(2, self.size)


class Patterns(NamedTuple):
    searchers: list[Searcher]
    keys: list[str]
    spelling: dict[int, bytes]

    def nbytes(self) -> int:
        """Bytes of the tables."""
        return sum(x.nbytes for s in self.searchers for x in (s.patterns, s.first, s.owners, s.shift, s.head)) + sum(map(len, self.spelling.values()))


def compiled(items: list[tuple[str, str]], width: int = WIDTH) -> Patterns:
    """Searchers over the windows of (id, text) items."""
    spelling: dict[int, bytes] = {}
    grids: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for number, (_, text) in enumerate(items):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = tb.words(raw, np.array([0, len(raw)]), tb.ALNUM)
        spelling |= {h: w.word(i) for i, h in enumerate(w.hash.tolist())}
        size = min(width, len(w.hash))
        if size:
            grids.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(w.hash, size))
            owners.setdefault(size, []).append(np.full(len(w.hash) - size + 1, number, np.int32))
    return Patterns([_searcher(np.concatenate(grids[n]), np.concatenate(owners[n])) for n in sorted(grids)], [key for key, _ in items], spelling)


def _searcher(grid: np.ndarray, owners: np.ndarray) -> Searcher:
    """grid has a row of word hashes per window, owners the number of its item."""
    grid, which = np.unique(grid, axis=0, return_inverse=True)
    count, size = grid.shape
    block = min(2, size)
    slots = 1 << max(10, (4 * count - 1).bit_length())  # windows overlap, so there are hardly more blocks than windows
    shift = np.full(slots, size - block + 1, np.uint8 if size < 255 else np.int32)
    for end in range(block - 1, size):
        np.minimum.at(shift, _slot(grid[:, end - block + 1 : end + 1], slots), size - 1 - end)
    last = _slot(grid[:, size - block :], slots)
    order = np.argsort(last, kind="stable")
    head = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=slots))]).astype(np.int32)
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    pairs = np.unique(np.stack([place[which.ravel()], owners], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(count + 1)).astype(np.int32)
    return Searcher(size, grid[order], first, pairs[:, 1].astype(np.int32), shift, head)


def _slot(block: np.ndarray, slots: int) -> np.ndarray:
    key = block[:, 0] if block.shape[1] == 1 else tb.paired(block[:, 0], block[:, 1])
    return (key & np.uint64(slots - 1)).astype(np.int64)


def search(s: Searcher, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last word, pattern) of all occurrences in the texts first[d]:first[d + 1] of the word hashes."""
    at, stop = first[:-1] + s.size - 1, first[1:]
    lanes = np.maximum(0, -(-(stop - at) // LANE))
    text = np.repeat(np.arange(len(at)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    pos = at[text] + nth * LANE
    end = np.minimum(pos + LANE, stop[text])
    slots, found = len(s.shift), []
    while len(pos):
        block = h[pos[:, None] - np.arange(s.block - 1, -1, -1)]
        slot = _slot(block, slots)
        move = s.shift[slot].astype(np.int64)
        stand = move == 0
        if stand.any():
            found.append(np.stack([pos[stand], slot[stand]]))
            move[stand] = 1
        pos = pos + move
        on = pos < end
        pos, end = pos[on], end[on]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, slot = np.concatenate(found, axis=1)
    return _compared(s, h, pos, slot)


def _compared(s: Searcher, h: np.ndarray, pos: np.ndarray, slot: np.ndarray, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """The candidates whose words are those of a pattern of their bucket."""
    ends, patterns = [], []
    sizes = (s.head[slot + 1] - s.head[slot]).astype(np.int64)
    total = np.cumsum(sizes)
    a = 0
    while a < len(pos):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + chunk, "right")))
        n = sizes[a:b]
        p = np.repeat(pos[a:b], n)
        q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.head[slot[a:b]], n)
        for back in range(s.size):
            same = h[p - back] == s.patterns[q, s.size - 1 - back]
            p, q = p[same], q[same]
        ends.append(p)
        patterns.append(q)
        a = b
    return np.concatenate(ends), np.concatenate(patterns)


def _spelled(w: tb.Words, spelling: dict[int, bytes], s: Searcher, ends: np.ndarray) -> np.ndarray:
    """Which occurrences hold in bytes, not in hashes only."""
    covered = np.unique((ends[:, None] - np.arange(s.size)).ravel())
    wrong = [i for i in covered.tolist() if w.word(i) != spelling[int(w.hash[i])]]
    return ~np.isin(ends[:, None] - np.arange(s.size), wrong).any(axis=1) if wrong else np.ones(len(ends), bool)


def hits(patterns: Patterns, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, list[int], list[int], list[str]]]:
    """For each text: words, words hit, starts and ends of the stretches hit, items."""
    w = tb.words(data, offsets, tb.ALNUM)
    hit = np.zeros(len(w.start) + 1, np.int64)
    named: dict[int, set[str]] = {}
    for s in patterns.searchers:
        ends, which = search(s, w.first, w.hash)
        if len(ends):
            ok = _spelled(w, patterns.spelling, s, ends)
            ends, which = ends[ok], which[ok]
            np.add.at(hit, ends - s.size + 1, 1)
            np.add.at(hit, ends + 1, -1)
            text = np.searchsorted(w.first, ends, "right") - 1
            for d, p in np.unique(np.stack([text, which], axis=1), axis=0).tolist():
                named.setdefault(d, set()).update(patterns.keys[i] for i in s.owners[s.first[p] : s.first[p + 1]].tolist())
    flags = np.cumsum(hit[:-1]) > 0
    out = []
    for d in range(len(offsets) - 1):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if d in named:
            starts, ends = tb.spans_of(flags[a:b])
            out.append((b - a, int(flags[a:b].sum()), starts.tolist(), ends.tolist(), sorted(named[d])))
        else:
            out.append((b - a, 0, [], [], []))
    return out


def _column(shared: Broadcast[Patterns]):
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    @arrow_udf(HITS)
    def found(text: pa.Array) -> pa.Array:
        rows = [dict(zip(kind.names, row, strict=True)) for _, _, data, offsets in tb.pieces(text) for row in hits(shared.value, data, offsets)]
        return pa.array(rows, kind)

    return found


def _merged(a: Column, b: Column) -> Column:
    """The hits of two blocks of patterns together."""
    flat = lambda x: F.flatten(F.transform(F.arrays_zip(x["starts"], x["ends"]), lambda s: F.sequence(s["starts"], s["ends"] - 1)))
    both = F.array_sort(F.array_union(flat(a), flat(b)))

    def edges(x: Column) -> Column:
        """The words that follow no hit word and those that none follows, from neighbours in order."""
        gap = lambda p, q: F.coalesce(q - p != 1, F.lit(True))
        before = F.zip_with(F.concat(F.array(F.lit(None).cast("long")), x), x, lambda p, q: F.when(gap(p, q), q))
        after = F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda p, q: F.when(gap(p, q), p + 1))
        some = lambda y: F.filter(y, lambda v: v.isNotNull())
        return F.struct(F.size(x).cast("long").alias("n"), some(before).alias("starts"), some(after).alias("ends"))

    found = F.transform(F.array(both), edges)[0]
    return F.struct(a["n_words"].alias("n_words"), found["n"].alias("n_hit"), found["starts"].alias("starts"), found["ends"].alias("ends"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"))


def find(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "hits", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add a struct: n_words, n_hit, starts and ends of the stretches of words hit, and the ids of the items found."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("string").alias("key"), F.col(item_text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    total = named.agg(F.sum(F.octet_length("text") + F.octet_length("key"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for i in range(blocks):
        part = named.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == i) if blocks > 1 else named
        column = _column(spark.sparkContext.broadcast(compiled([tuple(r) for r in part.collect()], width)))(F.col(text))
        if not i:
            docs = docs.withColumn(out, column)
        else:
            docs = written(docs, "decontamination").withColumn("__more", column).withColumn(out, _merged(F.col(out), F.col("__more"))).drop("__more")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    h = F.col("hits")
    return find(docs, items).select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (h["n_hit"] > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
    SELECT item_id, w, least({WIDTH}, len(w)) AS n, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
occ AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.k = win.k),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
